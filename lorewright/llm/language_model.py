"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays that workers map into memory.

1. Tasks count the 64-bit hashes of training tokens and deal them by hash range; a reducer merges a range and writes its hashes,
   sorted, with their counts. A token's number is its rank over all ranges.
2. Tasks count pairs of numbers, exact in 64 bits, and deal them by a mixed hash, so that no frequent word gathers its followers in
   one task. A reducer writes its sorted pairs and counts, and passes on what they add to each context (total, followers seen
   once, twice, more often) and to each token's continuation count; these sums are dealt by number and written as arrays.
3. Scoring maps the files, looks up the distinct tokens and pairs of a piece of text in sorted order, and adds up
   log10 p(w | v) = log10(max(c - D(c), 0) / c(v) + g(v) p(w)), where p(w) interpolates continuation counts with 1 / (V + 1).

What is sent through Spark are packed arrays, one row a task and range. Files lie in the shared folder; a file that is not on a
path is fetched once a worker. Nothing is sampled, pruned or capped. A vocabulary is bounded by 2**32 - 2 numbers.

Defined results: null and empty texts are the end token alone; a null id is in training; without training documents every
token has probability 1; an empty table gives no rows; rows keep their ids, null or repeated; other columns are never read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import whole_groups
from .textkit import U64, cut, flat, light, mix, pieces, words, workspace
from .token_files import opened

END = U64(0x5BD1E9955BD1E995)
FLUSH = 2_000_000
_ROW = "part int, keys binary, counts binary"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and where each text begins, with the total last."""
    hashes, rows, *_ = words(*flat(column), ink=True)
    n = len(column)
    counts = np.bincount(rows, minlength=n) + 1
    begins = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(int(begins[-1]), END, np.uint64)
    out[np.arange(len(hashes)) + rows] = hashes
    return out, begins


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def _pack(x: np.ndarray) -> bytes:
    """Byte planes: sorted numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind)[:, 0]


def _dealt(keys: np.ndarray, counts: np.ndarray, part: np.ndarray, kind: type) -> pa.RecordBatch:
    """One row for each part that sorted keys fall into."""
    order = np.argsort(part, kind="stable")
    ids, first = np.unique(part[order], return_index=True)
    ends = [*first[1:], len(order)]
    rows = [(int(p), _pack(keys[order[a:b]]), _pack(counts[order[a:b]].astype(kind))) for p, a, b in zip(ids, first, ends)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "keys", "counts"])


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(np.array([len(arrays), len(arrays[0]), *(a.itemsize for a in arrays)], "<i8").tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    system.move(draft, f"{path}/{name}")  # a task that runs again writes the same bytes


@cache
def _mapped(folder: str, name: str) -> list[np.ndarray]:
    """Arrays of a file, mapped into memory; unsigned integers of the widths that the file states."""
    system, path = opened(folder)
    file = f"{path}/{name}"
    if not os.path.exists(file):
        local = f"{tempfile.gettempdir()}/{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}-{name}"
        if not os.path.exists(local):
            with system.open_input_stream(file) as src, open(f"{local}.{os.getpid()}", "wb") as out:
                while block := src.read(1 << 22):
                    out.write(block)
            os.rename(f"{local}.{os.getpid()}", local)
        file = local
    raw = np.memmap(file, np.uint8, "r")
    k, n = raw[:16].view("<i8")
    widths, at, out = raw[16 : 16 + 8 * k].view("<i8"), 16 + 8 * int(k), []
    for w in widths.tolist():
        out.append(raw[at : at + n * w].view(f"<u{w}"))
        at += int(n) * w + -(int(n) * w) % 8
    return out


class Ranges:
    """Sorted keys over several files, a file for each value of the top bits of route(key)."""

    def __init__(self, folder: str, name: str, sizes: dict[int, int], bits: int):
        self.folder, self.name, self.bits = folder, name, bits
        self.base = np.zeros((1 << bits) + 1, np.int64)
        for p, n in sizes.items():
            self.base[p + 1] = n
        self.base = np.cumsum(self.base)

    def find(self, keys: np.ndarray, route: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and count of each of the sorted distinct keys; -1 and 0 where there is none."""
        part = (route(keys) if route else keys) >> U64(64 - self.bits)
        order = np.argsort(part, kind="stable")
        rank, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        ids, first = np.unique(part[order], return_index=True)
        for p, a, b in zip(ids.tolist(), first, [*first[1:], len(order)]):
            if self.base[p + 1] == self.base[p]:
                continue
            own, counts = _mapped(self.folder, f"{self.name}-{p}")
            at = order[a:b]
            k = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
            hit = own[k] == keys[at]
            rank[at[hit]], count[at[hit]] = self.base[p] + k[hit], counts[k[hit]]
        return rank, count


def _bits(n: int) -> int:
    return min(max(4, int(np.ceil(np.log2(max(n, 1))))), 16)


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32) if not len(counts) or counts.max() < 1 << 32 else counts.astype(np.uint64)


def _counted(text: str, bits: int, keys_of: Callable[[pa.RecordBatch], np.ndarray], route: Callable[[np.ndarray], np.ndarray]):
    """A task that counts keys and deals them out whenever it holds FLUSH of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches, text):
            own, many = np.unique(keys_of(batch), return_counts=True)
            held.append((own, many))
            size += len(own)
            if size >= FLUSH:
                own, many = _sum(*(np.concatenate(x) for x in zip(*held)))
                yield _dealt(own, many, (route(own) >> U64(64 - bits)).astype(np.int64), np.uint32)
                held, size = [], 0
        if size:
            own, many = _sum(*(np.concatenate(x) for x in zip(*held)))
            yield _dealt(own, many, (route(own) >> U64(64 - bits)).astype(np.int64), np.uint32)

    return run


def _same(keys: np.ndarray) -> np.ndarray:
    return keys


def _groups(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for table in whole_groups(batches, ["part"]):
        part = table.column("part").to_numpy()
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(first, [*first[1:], len(part)]):
            own = table.slice(a, b - a)
            keys = np.concatenate([_unpack(k, np.uint64) for k in own.column("keys").to_pylist()])
            counts = np.concatenate([np.frombuffer(_planes(c, len(keys_), kind), kind).reshape(len(keys_), -1) for c, keys_ in zip(own.column("counts").to_pylist(), [range(len(k) // 8) for k in own.column("keys").to_pylist()])])
            yield int(part[a]), keys, counts


def _planes(raw: bytes, n: int, kind: type) -> bytes:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).tobytes()


class Model:
    """Sizes and discounts, which travel to the workers; the arrays stay in their files."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        """Trains on all rows of docs."""
        spark = docs.sparkSession
        self.folder = workspace(spark, "language-model")
        folder = self.folder
        texts = docs.select(text)

        bits = _bits(texts.rdd.getNumPartitions())

        def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, keys, counts in _groups(batches, np.uint32):
                keys, counts = _sum(keys, counts[:, 0].astype(np.int64))
                _save(folder, f"words-{part}", keys, _narrow(counts))
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

        counted = texts.mapInArrow(_counted(text, bits, lambda b: tokens(b.column(text))[0], _same), _ROW)
        sizes = counted.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(write_words, "part int, n long, total long").collect()  # a row a file
        self.total, self.vocabulary = sum(r[2] for r in sizes), sum(r[1] for r in sizes)
        if self.vocabulary >= (1 << 32) - 2:
            raise ValueError("token numbers exceed 32 bits")
        self.words = Ranges(folder, "words", {r[0]: r[1] for r in sizes}, bits)
        self.start = self.vocabulary  # the number of the context before a text

        model_words, start = self.words, self.start
        bits = _bits(self.total // 1_500_000)
        # numbers fall into ranges of which each holds an equal share of the vocabulary
        self.share = max(1, -(-(self.vocabulary + 1) >> bits) if self.vocabulary >> bits else 1)
        share = self.share

        def pairs_of(batch: pa.RecordBatch) -> np.ndarray:
            hashes, begins = tokens(batch.column(text))
            own, at = np.unique(hashes, return_inverse=True)
            ids = model_words.find(own)[0].astype(np.uint64)[at]
            before = np.concatenate([[U64(start)], ids[:-1]])
            before[begins[:-1][begins[:-1] < len(before)]] = U64(start)
            return before << U64(32) | ids

        def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, keys, counts in _groups(batches, np.uint32):
                keys, counts = _sum(keys, counts[:, 0].astype(np.int64))
                _save(folder, f"pairs-{part}", keys, _narrow(counts))
                seen = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([-1 - part], pa.int32()), pa.array([np.array([len(keys)], "<i8").tobytes()], pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], ["part", "keys", "counts"])
                once, twice = counts == 1, counts == 2
                context = np.stack([counts, once, twice, ~once & ~twice, 0 * counts], 1).astype(np.int64)
                follow = np.zeros((len(keys), 5), np.int64)
                follow[:, 4] = 1
                ids, sums = _sum(np.concatenate([keys >> U64(32), keys & U64(0xFFFFFFFF)]), np.concatenate([context, follow]))
                at = (ids // U64(share)).astype(np.int64)
                yield _dealt_wide(ids, sums, at)

        def write_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, keys, counts in _groups(batches, np.int64):
                ids, sums = _sum(keys, counts)
                dense = np.zeros((share, 5), np.int64)
                dense[ids.astype(np.int64) - part * share] = sums
                follow = dense[:, 4]
                _save(folder, f"numbers-{part}", *(_narrow(dense[:, k]) for k in range(5)))
                seen = np.bincount(np.minimum(follow, 5), minlength=6)[1:5]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seen": pa.array([seen.tolist()], pa.list_(pa.int64())), "more": pa.array([int((follow > 2).sum())]), "total": [int(follow.sum())]})

        counted = texts.mapInArrow(_counted(text, bits, pairs_of, mix), _ROW)
        merged = cut(counted.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(write_pairs, _ROW))
        about = merged.where("part < 0").collect()  # a row a file
        self.pairs = Ranges(folder, "pairs", {-1 - r[0]: int(np.frombuffer(r[1], "<i8")[0]) for r in about}, bits)
        self.discount = discounts(sum((np.frombuffer(r[2], "<i8") for r in about), np.zeros(4, np.int64)))
        numbers = merged.where("part >= 0").repartition(1 << bits, "part").sortWithinPartitions("part")
        follow = numbers.mapInArrow(write_numbers, "part int, seen array<long>, more long, total long").collect()  # a row a file
        self.parts = {r[0] for r in follow}
        seen = np.sum([r[1] for r in follow], axis=0) if follow else np.zeros(4)
        self.unigram = discounts(seen)
        self.types = sum(r[3] for r in follow)
        given = self.unigram[1] * seen[0] + self.unigram[2] * seen[1] + self.unigram[3] * sum(r[2] for r in follow)
        self.spare = given / self.types if self.types else 1.0

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """(n, 5) context total, followers seen once, twice and more, and continuation count; zeros for -1."""
        out = np.zeros((len(ids), 5))
        part = np.where(ids >= 0, ids // self.share, -1)
        for p in np.unique(part):
            if p in self.parts:
                at = np.flatnonzero(part == p)
                own = _mapped(self.folder, f"numbers-{p}")
                for k in range(5):
                    out[at, k] = own[k][ids[at] - p * self.share]
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base log10 probability and the model's, of each text."""
        hashes, begins = tokens(column)
        if not len(column):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2
        own, at = np.unique(hashes, return_inverse=True)
        ids, counts = self.words.find(own)
        table = self.numbers(np.append(ids, self.start))
        n, c = len(own), counts[at]
        base = np.log10((c + 1) / (self.total + self.vocabulary + 1))
        cont = table[:n, 4]
        unigram = self.spare / (self.vocabulary + 1) + (np.maximum(cont - self.unigram[np.minimum(cont, 3).astype(int)], 0) / self.types if self.types else 0)
        before = np.concatenate([[n], at[:-1]])
        before[begins[:-1]] = n
        key = (np.append(ids, self.start)[before].astype(np.uint64) << U64(32)) | ids[at].astype(np.uint64)
        known = (np.append(ids, self.start)[before] >= 0) & (ids[at] >= 0)
        pairs, where = np.unique(key[known], return_inverse=True)
        seen = np.zeros(len(at), np.int64)
        seen[known] = self.pairs.find(pairs, mix)[1][where]
        total = table[before, 0]
        weight = table[before, 1] * self.discount[1] + table[before, 2] * self.discount[2] + table[before, 3] * self.discount[3]
        safe = np.maximum(total, 1)
        p = np.where(total > 0, np.maximum(seen - self.discount[np.minimum(seen, 3)], 0) / safe + weight / safe * unigram[at], unigram[at])
        add = lambda x: np.add.reduceat(x, begins[:-1])
        return np.diff(begins), add((c > 0).astype(np.int64)), add(base), add(np.log10(p))


def _dealt_wide(keys: np.ndarray, sums: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    ids, first = np.unique(part, return_index=True)  # keys are sorted, and so are their parts
    rows = [(int(p), _pack(keys[a:b]), _pack(np.ascontiguousarray(sums[a:b]).view(np.dtype((np.void, 40)))[:, 0])) for p, a, b in zip(ids, first, [*first[1:], len(keys)])]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "keys", "counts"])


def discounts(seen: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more from the numbers of things seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; perplexity of the text."""
    model = Model(light(docs).where(~held_out(F.col("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, known, base, own = model.score(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), *(pa.array(x) for x in (n, known, np.full(len(n), model.total), base, own, 10 ** (-own / n)))]
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(8)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
