"""Benchmark decontamination: SimHash windows of an item's size, found by multi-index Hamming blocks, verified exactly.

For an item of n words (five at least) every window of n words of every document counts, the document itself where it is
shorter. A window and an item match at a weighted Jaccard similarity of SIMILARITY or more over five-word shingles, the
weight of a shingle being the number of times it occurs. Since such a window shares that part of the item's shingles at
least, windows with fewer shingles of the index are passed over, which loses none. The others get a 128-bit SimHash; the
eight 16-bit blocks of two fingerprints within RADIUS cannot all differ in more than RADIUS // 8 bits, so an index of every
block value within that many bits of an item's block gives all items within RADIUS. Their weighted similarity is then
computed from the shingles themselves. An item of one to four words matches where its words stand.

Items are indexed in slices of SLICE_ITEMS and SLICE_BYTES at most, chosen by a hash of the item; a slice is all that is sent
to the executors at a time, and every slice reads all documents.

Defined results: null and empty texts, and texts without a word, match nothing on either side; repeated items count once,
items of equal text under different ids both; a null item_id is kept as null; rows repeating a doc_id are one document in the
result and are all dropped or all kept by the filter; empty tables match nothing; other columns are carried, never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .near_dedup import simhash
from .textkit import combine, flat, light, pieces, words

WORDS, SIMILARITY, RADIUS = 5, 0.8, 31
SLICE_ITEMS, SLICE_BYTES = 1000, 4 << 20
_NEAR = RADIUS // 8
_MASKS = np.array([sum(1 << b for b in c) for k in range(_NEAR + 1) for c in combinations(range(16), k)], np.uint16)


def _weighed(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingle hashes."""
    terms, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(terms)), np.bincount(at[len(a) :], minlength=len(terms))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class Index:
    """Items of one slice."""

    def __init__(self, texts: list[str]):
        hashes, rows, *_ = words(*flat(pa.array(texts, pa.string())))
        self.length = np.bincount(rows, minlength=len(texts))
        begins = np.cumsum(self.length) - self.length
        self.short = {q: self._short(hashes, begins, q) for q in range(1, WORDS) if (self.length == q).any()}
        self.items = np.flatnonzero(self.length >= WORDS)
        grams = combine(hashes, WORDS)
        self.bags = [grams[begins[i] : begins[i] + self.length[i] - WORDS + 1] for i in self.items]
        self.of = self.length[self.items]
        owner = np.repeat(np.arange(len(self.items)), [len(b) for b in self.bags]) if self.bags else np.zeros(0, np.int64)
        every = np.concatenate(self.bags) if self.bags else np.zeros(0, np.uint64)
        self.shingles = np.unique(every)
        # a shingle is looked for in windows of the lengths of its own items
        pairs = np.unique(np.stack([np.searchsorted(self.shingles, every), self.of[owner]], 1), axis=0) if len(every) else np.zeros((0, 2), np.int64)
        self.lengths, self.by_shingle = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.shingles) + 1))
        self.prints = np.stack(simhash(every, owner, len(self.items)), 1) if len(every) else np.zeros((0, 2), np.uint64)
        self.blocks = []
        for block in np.ascontiguousarray(self.prints).view(np.uint16).reshape(len(self.items), 8).T:
            values = (block[:, None] ^ _MASKS).ravel()
            order = np.argsort(values, kind="stable")
            self.blocks.append((np.searchsorted(values[order], np.arange(65537)), (order // len(_MASKS)).astype(np.int32)))

    def _short(self, hashes: np.ndarray, begins: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        items = np.flatnonzero(self.length == q)
        own = combine(hashes, q)[begins[items]]
        order = np.argsort(own, kind="stable")
        return own[order], items[order]

    def search(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, item, similarity and first word of the best window of every match."""
        hashes, rows, *_ = words(*flat(column))
        sizes = np.bincount(rows, minlength=len(column))
        begins = np.cumsum(sizes) - sizes
        out: list[tuple[np.ndarray, ...]] = []
        for q, (own, items) in self.short.items():
            grams = combine(hashes, q)
            at = np.flatnonzero(rows[: len(grams)] == rows[q - 1 :]) if len(grams) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(own, grams[at]), np.searchsorted(own, grams[at], "right")
            each, k = _expand(lo, hi)
            out.append((rows[at[each]], items[k], np.ones(len(k)), at[each] - begins[rows[at[each]]]))
        out += self._long(hashes, rows, sizes, begins)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        row, item, like, first = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((first, -like, item, row))
        row, item, like, first = row[order], item[order], like[order], first[order]
        best = np.ones(len(row), bool)
        best[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        return row[best], item[best], like[best], first[best]

    def _long(self, hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        grams = combine(hashes, WORDS)
        if not len(grams) or not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, grams), len(self.shingles) - 1)
        hit = (self.shingles[at] == grams) & (rows[: len(grams)] == rows[WORDS - 1 :])
        places = np.flatnonzero(hit)
        if not len(places):
            return []
        seen = np.concatenate([[0], np.cumsum(hit)])
        each, k = _expand(self.by_shingle[at[places]], self.by_shingle[at[places] + 1])
        place, length = places[each], self.lengths[k]
        found = []
        for n in np.unique(length):
            here = np.unique(place[length == n])
            row = rows[here]
            lo = np.maximum(here - (n - WORDS), begins[row])
            hi = np.minimum(here, np.maximum(begins[row] + sizes[row] - n, begins[row]))
            _, start = _expand(lo, hi + 1)
            start = np.unique(start)
            many = np.minimum(n, sizes[rows[start]] - (start - begins[rows[start]])) - WORDS + 1
            keep = seen[start + many] - seen[start] >= SIMILARITY * (n - WORDS + 1) - 1e-9
            found.append(np.stack([start[keep], many[keep], np.full(keep.sum(), n)], 1))
        windows, out = np.concatenate(found), []
        # a window is judged against items of its own length; windows go through in slices of bounded size
        for part in np.array_split(windows, max(1, int(windows[:, 1].sum() // 200_000))):
            if not len(part):
                continue
            owner, place = _expand(part[:, 0], part[:, 0] + part[:, 1])
            prints = np.ascontiguousarray(np.stack(simhash(grams[place], owner, len(part)), 1))
            pairs = []
            for (starts, items), value in zip(self.blocks, prints.view(np.uint16).reshape(len(part), 8).T):
                w, k = _expand(starts[value], starts[value.astype(np.int64) + 1])
                pairs.append(w * len(self.items) + items[k])
            w, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
            near = (self.of[item] == part[w, 2]) & (np.bitwise_count(prints[w] ^ self.prints[item]).sum(1) <= RADIUS)
            w, item = w[near], item[near]
            like = np.array([_weighed(grams[part[i, 0] : part[i, 0] + part[i, 1]], self.bags[j]) for i, j in zip(w, item)])
            good = np.flatnonzero(like >= SIMILARITY - 1e-12) if len(like) else np.zeros(0, np.int64)
            start = part[w[good], 0]
            out.append((rows[start], self.items[item[good]], like[good] if len(like) else np.zeros(0), start - begins[rows[start]]))
        return out


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range lo..hi its number and its members."""
    many = np.maximum(hi - lo, 0)
    each = np.repeat(np.arange(len(lo)), many)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)


def slices(items: DataFrame) -> list[tuple[list, list[str]]]:
    """(ids, texts) of each slice; one slice is held at a time by whoever asks for the next."""
    rows = light(items).select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''").distinct()
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-count // SLICE_ITEMS), -(-size // SLICE_BYTES))
    for k in range(parts):
        own = sorted(rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == k).collect(), key=lambda r: (r[1], str(r[0])))
        if own:
            yield [r[0] for r in own], [r[1] for r in own]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and first_word (from 0) of the best window, for every document and item that match."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    kind, out = to_arrow_type(kinds[1]), None
    for ids, texts in slices(items):
        sent = docs.sparkSession.sparkContext.broadcast((Index(texts), ids))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, names = sent.value
            names = pa.array(names, kind)
            for batch in pieces(batches):
                row, item, like, first = index.search(batch.column("text"))
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), names.take(pa.array(item)), pa.array(like), pa.array(first)], ["doc_id", "item_id", "similarity", "first_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, similarity double, first_word long")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, similarity double, first_word long")
    best = F.min_by(F.struct("similarity", "first_word"), F.struct(-F.col("similarity"), "first_word")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), "best.first_word")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a window like an item; nothing is shuffled or joined."""
    for _, texts in slices(items):
        sent = docs.sparkSession.sparkContext.broadcast(Index(texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[sent.value.search(batch.column("text"))[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
