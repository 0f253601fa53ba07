"""Vectorised text kernels over Arrow buffers, shared by the training-data operators.

Everything works on the contiguous UTF-8 buffer of an Arrow string column, a few megabytes at a time, so memory is
bounded by the piece size plus the longest single document, and no Python loop runs per word.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A word byte is a lower-case letter, a digit, an underscore or any byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[97:123] = _WORD[48:58] = _WORD[128:] = _WORD[95] = True
#: What separates tokens of the language model: space and the five controls from tab to carriage return.
_INK = np.ones(256, bool)
_INK[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of uint64 codes: a run's hash is (H[end] - H[start]) times the inverse power of start."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about limit text bytes each, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            done = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(low, high - low)
            low = high


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of marked bytes; no run crosses a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    full = np.diff(offsets) > 0
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, ink: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, row numbers, starts and ends of the words, A-Z lower-cased; ink: words are all but white space."""
    low = _LOWER[data]
    starts, ends, rows = spans(data, offsets, (_INK if ink else _WORD)[low])
    sums = prefix(_TABLE[low])
    hashes = mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64))
    return hashes, rows, starts, ends


def combine(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams at each place of a word-hash array."""
    n = len(hashes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (q * 0xA24BAED4963EE407) % (1 << 64), np.uint64)
    for k in range(q):
        out = out * U64(0x9FB21C651E98DF25) + hashes[k : n + k]
    return mix(out)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, q: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, row numbers and first-word indexes of the word q-grams; a row of fewer words, one at least, gives one of all its words."""
    grams = combine(hashes, q)
    at = np.flatnonzero(rows[: len(grams)] == rows[q - 1 :]) if len(grams) else np.zeros(0, np.int64)
    out, owner, first = [grams[at]], [rows[at]], [at]
    counts = np.bincount(rows, minlength=n_rows)
    begins = np.cumsum(counts) - counts
    for short in range(1, q):
        if len(few := np.flatnonzero(counts == short)):
            out.append(combine(hashes, short)[begins[few]])
            owner.append(few)
            first.append(begins[few])
    hashes, rows, first = np.concatenate(out), np.concatenate(owner), np.concatenate(first)
    order = np.argsort(first, kind="stable")
    return hashes[order], rows[order], first[order]


def distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by both."""
    if not len(hashes):
        return hashes, rows
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for n nodes and edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local one serves a local master, as in tests; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if path:
        if not folder.isDefined():
            context.setCheckpointDir(path)
        return path.rstrip("/")
    if not folder.isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), f"lorewright-{os.getpid()}"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _opened(spark: SparkSession, path: str) -> tuple:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; what is written there goes when the session's JVM ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, own = _opened(spark, path)
    system.mkdirs(own.getParent())
    system.mkdirs(own)
    system.deleteOnExit(own)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go as soon as it has ended; the session's own setting stands again afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


class Stored:
    """Tables that cut lineage as compressed Parquet in the shared folder, and that can be dropped once they have been read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = workspace(self.spark, name)
        with tidy(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            system, own = _opened(self.spark, self.paths.pop(name))
            system.delete(own, True)


def light(df: DataFrame) -> DataFrame:
    """df, its session set to hand Python workers at most four megabytes at a time: rows here are texts, and ten thousand of them are many.

    The limit is by bytes alone, so narrow rows still travel by the session's own number.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) of every node of the edges (a, b), the root being the component's smallest node.

    Alternates large and small stars; minima are partial aggregates, and the joins back are left to adaptive skew splitting,
    so a hub with very many edges never meets in one task. A round's edges are dropped once the next has been stored. Raises
    RuntimeError if labels still move after rounds, which halve what is left of every path.
    """
    tables = Stored(edges.sparkSession)
    now = tables.put("edges-0", edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for k in range(1, rounds + 1):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = tables.put(f"edges-{k}", small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        tables.drop(f"edges-{k - 1}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        mark = seen
    raise RuntimeError(f"components still move after {rounds} rounds")
