"""Removal of repeated 200-byte strings by a hash-compared suffix sort.

Sorting a suffix for every byte of a corpus moves the corpus hundreds of times, so suffixes are sorted at anchors. Among the
KEY-byte strings inside a LENGTH-byte window the one of the smallest hash is the window's anchor (all of them in a tie); equal
windows have equal anchors at equal places, so every repeated window shows as two occurrences of one anchor. About one byte
in seventy-seven is an anchor.

1. Anchors are counted natively; one that occurs once ends here.
2. Occurrences of equal whole context (the bytes a window around the anchor can reach) are counted as one: if there are two,
   all windows in the context repeat. Equal here means two 64-bit hashes, of the anchor and of the context, from tables that are
   independent; their bytes are not compared. Only different contexts of one anchor go on, and their bytes are fetched by document.
3. Contexts of an anchor are suffix-sorted: suffixes right of the anchor and reversed prefixes left of it each go through a
   mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes, at most eight
   steps for 200 bytes. Neighbours' extensions are then checked byte by byte; should a hash have collided, that batch is sorted
   by its bytes. A window with o bytes left of the anchor repeats if another context shares its run of common right
   extensions of 200 - o and its run of common left extensions of o. The outermost such windows bound what is removed.
4. An anchor of more than CROWD contexts is not brought together: its windows, each with the anchor and its place in
   them, are hashed to 128 bits and counted natively; those bytes are not compared either.

Each step is stored in the shared folder and dropped once the next has been stored, so the texts of one step are on disk at a time.

Defined results: null counts as empty; texts under 200 bytes are left as they are; a repeated row repeats all its windows; a
null id is a document like others; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import whole_groups
from .textkit import _TABLE, U64, Stored, flat, light, mix, pieces, powers, prefix, signed

LENGTH, KEY, CROWD = 200, 48, 16384
LEFT = LENGTH - KEY
_OTHER = mix(_TABLE ^ U64(0x94D049BB133111EB))


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for every i that has as many."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and row numbers of the anchors of all windows that lie within a row."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none
    grams = mix((sums[KEY:] - sums[:-KEY]) * powers(len(data) + 1)[1][: len(data) - KEY + 1])
    low = _sliding(grams, LEFT + 1, np.minimum)  # for each window start
    crossing = np.zeros(len(data) + LENGTH, np.int32)  # windows that begin less than 200 bytes before a row's end run over it
    ends = offsets[1:]
    np.add.at(crossing, np.maximum(ends - LENGTH + 1, 0), 1)
    np.add.at(crossing, ends, -1)
    low[np.cumsum(crossing)[: len(low)] > 0] = 0
    reach = np.concatenate([np.zeros(LEFT, np.uint64), low, np.zeros(LEFT, np.uint64)])
    most = _sliding(reach, LEFT + 1, np.maximum)
    at = np.flatnonzero(most == grams)
    rows = np.searchsorted(offsets, at, "right") - 1
    return at, grams[at], rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = flat(batch.column("text"))
        _, hashes, _ = anchors(data, offsets, prefix(_TABLE[data]))
        found, many = np.unique(hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(np.minimum(many, 2).astype(np.int32))], ["ah", "n"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (anchor, context) of each document, with the place of one and whether there are more; and, as rows without an anchor, what the others cover."""
    for batch in pieces(batches):
        data, offsets = flat(batch.column("text"))
        at, hashes, rows = anchors(data, offsets, prefix(_TABLE[data]))
        if not len(at):
            continue
        lo, hi = np.minimum(at - offsets[rows], LEFT), np.minimum(offsets[rows + 1] - at, LENGTH)
        sums = prefix(_OTHER[data])
        context = mix((sums[at + hi] - sums[at - lo]) * powers(len(data) + 1)[1][at - lo] + (lo * 256 + hi).astype(np.uint64))
        order = np.lexsort((at, context, hashes, rows))
        first = np.ones(len(order), bool)
        first[1:] = (rows[order][1:] != rows[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]) | (context[order][1:] != context[order][:-1])
        many = np.diff(np.append(np.flatnonzero(first), len(order))) > 1
        group = np.cumsum(first) - 1
        again = np.sort(order[many[group]])
        kept = order[first]
        id_, h = batch.column("id"), batch.column("h")
        own = rows[kept]
        columns = [id_.take(pa.array(own)), h.take(pa.array(own)), pa.array(signed(hashes[kept])), pa.array(signed(context[kept])), pa.array(at[kept] - offsets[own]), pa.array(lo[kept]), pa.array(hi[kept]), pa.array(many)]
        yield pa.RecordBatch.from_arrays(columns, _COLUMNS)
        if len(again):  # repeats inside a document are settled here, as few runs
            r, s, e = rows[again], at[again] - lo[again], at[again] + hi[again]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (s[1:] > np.maximum.accumulate(e)[:-1])
            begin, own = s[new], r[new]
            end = np.maximum.reduceat(e, np.flatnonzero(new))
            none = pa.nulls(len(own), pa.int64())
            columns = [id_.take(pa.array(own)), h.take(pa.array(own)), none, none, pa.array(begin - offsets[own]), pa.array(np.zeros(len(own), np.int64)), pa.array(end - begin), pa.array(np.ones(len(own), bool))]
            yield pa.RecordBatch.from_arrays(columns, _COLUMNS)


_COLUMNS = ["id", "h", "ah", "ch", "pos", "lo", "hi", "more"]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = flat(batch.column("text"))
        wanted = batch.column("wanted")
        many = np.diff(wanted.offsets.to_numpy())
        at = wanted.flatten()
        rows = np.repeat(np.arange(batch.num_rows), many)
        pos, lo, hi = (at.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "lo", "hi"))
        begin = offsets[rows] + pos
        left, right = [], []
        body = data.tobytes()
        for b, l, r in zip(begin.tolist(), lo.tolist(), hi.tolist()):
            left.append(body[b - l : b][::-1])
            right.append(body[b : b + r])
        yield pa.RecordBatch.from_arrays([at.field("ah"), at.field("ch"), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["ah", "ch", "left", "right"])


class Suffixes:
    """Strings with prefix hashes, compared by their longest common extension."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.start, self.size = np.append(data, np.uint8(0)), offsets[:-1], np.diff(offsets)
        self.sums, self.inverse = prefix(_TABLE[data]), powers(len(data) + 1)[1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of strings a and b, by binary search over hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        x, y = self.start[a], self.start[b]
        hx, hy, ix, iy = self.sums[x], self.sums[y], self.inverse[x], self.inverse[y]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (self.sums[x + mid] - hx) * ix == (self.sums[y + mid] - hy) * iy
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a sorts after b; equal strings don't."""
        n = self.common(a, b)
        ended_a, ended_b = n >= self.size[a], n >= self.size[b]
        return np.where(ended_a | ended_b, ended_b & ~ended_a, self.data[self.start[a] + n] > self.data[self.start[b] + n])

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the strings within their groups, which stand in runs, and each one's common extension with the one before, -1 at a group's first."""
        n = len(group)
        order = np.arange(n)
        head = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if n else 0))
        begin = np.repeat(head, np.diff(np.append(head, n)))
        end = np.repeat(np.append(head[1:], n), np.diff(np.append(head, n)))
        size = 1
        while size < (end - begin).max(initial=0):
            live = np.flatnonzero(end - begin > size)
            block = (live - begin[live]) // size
            odd = block % 2 == 1
            other = np.where(odd, begin[live] + (block - 1) * size, begin[live] + (block + 1) * size)
            lo, hi = np.minimum(other, end[live]), np.minimum(other + size, end[live])
            base = lo.copy()
            while (busy := np.flatnonzero(lo < hi)).size:  # place among the other block's strings
                mid = (lo[busy] + hi[busy]) // 2
                own, there = order[live[busy]], order[mid]
                # of equals the left block's come first
                right = np.where(odd[busy], ~self.after(there, own), self.after(own, there))
                lo[busy], hi[busy] = np.where(right, mid + 1, lo[busy]), np.where(right, hi[busy], mid)
            at = begin[live] + (block - odd) * size + (live - begin[live]) % size + (lo - base)
            new = order.copy()
            new[at] = order[live]
            order, size = new, 2 * size
        shared = np.full(n, -1, np.int64)
        inner = np.flatnonzero(np.arange(n) > begin)
        shared[inner] = self.common(order[inner], order[inner - 1])
        return order, shared

    def verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours have just the extensions and the order that their hashes gave."""
        at = np.flatnonzero(shared >= 0)
        a, b, n = order[at], order[at - 1], shared[at]
        for part in np.array_split(np.arange(len(at)), max(1, int(n.sum() // 400_000))):
            inside = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            if (self.data[np.repeat(self.start[a[part]], n[part]) + inside] != self.data[np.repeat(self.start[b[part]], n[part]) + inside]).any():
                return False
        open_ = (n < self.size[a]) & (n < self.size[b])
        return bool((self.data[self.start[a] + n] > self.data[self.start[b] + n])[open_].all() and (n >= self.size[b])[~open_].all())

    def by_bytes(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes."""
        text = [self.data[s : s + n].tobytes() for s, n in zip(self.start.tolist(), self.size.tolist())]
        order = np.array(sorted(range(len(group)), key=lambda i: (np.searchsorted(group, group[i]), text[i])), np.int64)
        shared = np.full(len(group), -1, np.int64)
        for k in range(1, len(group)):
            a, b = text[order[k]], text[order[k - 1]]
            if group[order[k]] == group[order[k - 1]]:
                shared[k] = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        return order, shared


def repeated(group: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes left and right of the anchor that repeated windows cover; 0, 0 without one. group stands in runs."""
    runs, best = [], []
    for data, offsets in (left, right):
        s = Suffixes(data, offsets)
        order, shared = s.sorted(group)
        if not s.verified(order, shared):
            order, shared = s.by_bytes(group)
        near = np.empty(len(group), np.int64)
        near[order] = np.maximum(shared, np.append(shared[1:], -1))
        runs.append((order, shared))
        best.append(near)
    n = len(group)
    most, least = np.full(n, -1, np.int64), np.full(n, LENGTH, np.int64)
    for o in range(LEFT + 1):
        live = np.flatnonzero((best[0] >= o) & (best[1] >= LENGTH - o))
        if len(live) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, shared), need in zip(runs, (o, LENGTH - o)):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(shared < need)
            key = key * (n + 1) + run
        by = live[np.argsort(key[live], kind="stable")]
        same = key[by][1:] == key[by][:-1]
        found = by[np.append(same, False) | np.append(False, same)]
        most[found], least[found] = o, np.minimum(least[found], o)
    hit = most >= 0
    return np.where(hit, most, 0), np.where(hit, LENGTH - least, 0)


def _suffix_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["ah"]):
        table = table.combine_chunks()
        side = [flat(table.column(c).combine_chunks().cast(pa.large_binary()).view(pa.large_string())) for c in ("left", "right")]
        l, r = repeated(table.column("ah").to_numpy(), *side)
        hit = pa.array(np.flatnonzero(r))
        if len(hit):
            yield pa.RecordBatch.from_arrays([table.column("ah").combine_chunks().take(hit), table.column("ch").combine_chunks().take(hit), pa.array(l).take(hit), pa.array(r).take(hit)], ["ah", "ch", "l", "r"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            left = [x[::-1] for x in part.column("left").to_pylist()]
            whole = [a + b for a, b in zip(left, part.column("right").to_pylist())]
            data, offsets = flat(pa.array(whole, pa.large_binary()).view(pa.large_string()))
            lo = np.array([len(x) for x in left])
            count = np.diff(offsets) - LENGTH + 1  # windows of a context, all of which hold its anchor
            count = np.maximum(np.minimum(count, lo + 1), 0)
            rows = np.repeat(np.arange(len(whole)), count)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[rows] + within
            keys, anchor = [], part.column("ah").to_numpy().view(np.uint64)
            for table in (_TABLE, _OTHER):
                sums = prefix(table[data])
                own = mix(np.repeat(anchor, count) + (lo[rows] - within).astype(np.uint64))
                keys.append(mix((sums[start + LENGTH] - sums[start]) * powers(len(data) + 1)[1][start] ^ own))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([part.column("ah").take(at), part.column("ch").take(at), pa.array((lo[rows] - within).astype(np.int32)), *(pa.array(signed(k)) for k in keys)], ["ah", "ch", "o", "w1", "w2"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out = []
        texts = pa.compute.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
        for body, runs in zip(texts, batch.column("runs").to_pylist()):
            kept, last, n, removed = [], 0, 0, 0
            runs = sorted((r["b"], r["e"]) for r in runs or [])
            at = 0
            while at < len(runs):
                b, e = runs[at]
                while at + 1 < len(runs) and runs[at + 1][0] <= e:
                    at += 1
                    e = max(e, runs[at][1])
                kept.append(body[last:b])
                last, n, removed, at = e, n + 1, removed + e - b, at + 1
            rest = b"".join([*kept, body[last:]])
            out.append((len(body), removed, n, hashlib.sha256(rest).hexdigest(), rest))
        columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([x[3] for x in out], pa.string()), pa.array([x[4] for x in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def covered(docs: DataFrame) -> DataFrame:
    """(id, h, runs): the byte runs [b, e) that repeated windows cover, for each document that has any; runs may overlap."""
    tables = Stored(docs.sparkSession)
    rows = docs.select("id", "h", "text").where(F.octet_length("text") >= LENGTH)
    twice = rows.select("text").mapInArrow(_count, "ah long, n int").groupBy("ah").agg(F.sum("n").alias("n")).where("n > 1").select("ah")
    found = rows.mapInArrow(_occurrences, "id long, h long, ah long, ch long, pos long, lo long, hi long, more boolean")
    settled = found.where("ah is null")
    seen = tables.put("seen", found.where("ah is not null").join(twice, "ah").union(settled.select("ah", *[c for c in found.columns if c != "ah"])))
    inside = seen.where("ah is null").select("id", "h", F.col("pos").alias("b"), (F.col("pos") + F.col("hi")).alias("e"))
    seen = seen.where("ah is not null")
    contexts = tables.put("contexts", seen.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.max("more").alias("more"), F.min(F.struct("id", "h", "pos", "lo", "hi")).alias("at")))
    several = contexts.groupBy("ah").agg(F.count("*").alias("d")).where("d > 1")
    need = contexts.join(several, "ah").select("ah", "ch", "d", "at.*")
    wanted = need.groupBy("id", "h").agg(F.collect_list(F.struct("pos", "lo", "hi", "ah", "ch")).alias("wanted"))  # at most one in a byte of the document
    fetched = tables.put("fetched", rows.join(wanted, ["id", "h"]).select("text", "wanted").mapInArrow(_contexts, "ah long, ch long, left binary, right binary"))
    crowded = tables.put("crowded", several.where(F.col("d") > CROWD).select("ah"))
    calm, parts = fetched, []
    if crowded.limit(1).count():
        calm = fetched.join(crowded, "ah", "left_anti")
        windows = fetched.join(crowded, "ah").mapInArrow(_windows, "ah long, ch long, o int, w1 long, w2 long")
        again = windows.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
        own = windows.join(again, ["w1", "w2"]).groupBy("ah", "ch").agg(F.max("o").cast("long").alias("l"), (F.lit(LENGTH) - F.min("o")).cast("long").alias("r"))
        parts.append(own)
    parts.append(calm.repartition("ah").sortWithinPartitions("ah").mapInArrow(_suffix_sort, "ah long, ch long, l long, r long"))
    parts.append(contexts.where("n > 1 or more").select("ah", "ch", F.lit(LENGTH).cast("long").alias("l"), F.lit(LENGTH).cast("long").alias("r")))
    settled = parts[0]
    for p in parts[1:]:
        settled = settled.union(p)
    reach = tables.put("reach", settled.groupBy("ah", "ch").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    tables.drop("contexts", "fetched", "crowded")
    l, r = F.least("l", "lo"), F.least("r", "hi")
    outside = seen.join(reach, ["ah", "ch"]).where(l + r >= LENGTH).select("id", "h", (F.col("pos") - l).alias("b"), (F.col("pos") + r).alias("e"))
    runs = inside.where(F.col("e") - F.col("b") >= LENGTH).union(outside).groupBy("id", "h").agg(F.collect_list(F.struct("b", "e")).alias("runs"))
    runs = tables.put("runs", runs)
    tables.drop("seen", "reach")
    return runs


def suffix_dedup(docs: DataFrame, payload: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats (whether anything goes); payload adds kept, the remaining bytes, which may cut a character."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = light(docs).select("doc_id", text.alias("text")).select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"), "text")
    runs = covered(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.join(runs, ["id", "h"], "left").select("doc_id", "text", "runs")
    out = out.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("repeats", F.col("n_removed") > 0)
    return out if payload else out.drop("kept")
