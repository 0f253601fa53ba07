"""Vectors, metadata filters, rank fusion and triple patterns.

Vectors are rows (ord, id, vec ARRAY<FLOAT>, meta MAP<STRING,STRING> or columns). A query vector is a literal; a set of queries is a table that is
broadcast behind a check of its size, in slices beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import cosine, distance, dot, norm

QUERIES = 512  # query vectors sent to the tasks at a time where pairs meet one by one
NUMBERS = 8_000_000  # numbers of query vectors sent to the tasks at a time as a matrix


class DimensionError(ValueError):
    """Vectors of unequal dimension."""


def metric(name: str, a: Column, b: Column) -> Column:
    """Higher is nearer."""
    return {"cos": cosine, "dot": dot, "euclid": lambda x, y: -distance(x, y)}[name](a, b)


def search(vectors: DataFrame, query: list[float] | None, k: int = 10, name: str = "cos", where: Column | None = None) -> DataFrame:
    """(id, score): filter, exact score, k best with equal scores by id; without a query the filter alone, in order."""
    rows = vectors.where(where) if where is not None else vectors
    if query is None:
        out = rows.orderBy("ord").select("id", F.lit(0.0).alias("score"))
        return out.limit(k) if k > 0 else out
    if rows.where(F.size("vec") != len(query)).limit(1).count():
        raise DimensionError(f"query has {len(query)} dimensions")
    literal = F.array(*[F.lit(float(x)) for x in query])
    out = rows.select("id", metric(name, F.col("vec"), literal).alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(k) if k > 0 else out


def search_many(vectors: DataFrame, queries: DataFrame, k: int, name: str = "cos") -> DataFrame:
    """(query, id, score, rank): the k best for each of queries (query, vec).

    A task multiplies blocks of vectors by the queries and keeps for each query what may still be of its k best, by bounds that cover
    the rounding; only that is scored as `metric` does, so what moves is some k rows a query and task. Copies within a block count as one
    vector with the k smallest ids, and equal queries as one. Rows that a matrix does not hold (nulls, other lengths, no finite
    numbers) meet the others one by one, as do all for more than one length of queries.
    """
    good = (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e15))
    sizes = [r[0] for r in queries.where(good).select(F.size("vec")).distinct().limit(2).collect()]
    plain = good & (F.size("vec") == sizes[0]) if len(sizes) == 1 else F.lit(False)
    plain = F.coalesce(plain, F.lit(False))
    odd = lambda df, c: df.where(~plain).select(c, "vec")
    pairs = [*_one_by_one(odd(vectors, "id"), queries.select("query", "vec")), *_one_by_one(vectors.where(plain).select("id", "vec"), odd(queries, "query"))]
    out = [df.select("query", "id", metric(name, F.col("vec"), F.col("q")).alias("score")) for df in pairs]
    if len(sizes) == 1:
        regular, n = queries.where(plain), queries.where(plain).count()
        slices = max(1, -(-n * sizes[0] // NUMBERS))
        spread = vectors.where(plain).select("id", "vec")
        spread = spread.repartition(max(spread.rdd.getNumPartitions(), 3 * vectors.sparkSession.sparkContext.defaultParallelism))
        for s in range(slices):
            part = regular.where(F.pmod(F.xxhash64("query"), F.lit(slices)) == s).select("query", "vec")
            out.append(_near(spread, part, max(k, 1), name).select("query", "id", metric(name, F.col("vec"), F.col("q")).alias("score")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = reduce(DataFrame.union, out).withColumn("_task", F.spark_partition_id())
    own = Window.partitionBy("_task", "query").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r", "_task")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _one_by_one(vectors: DataFrame, queries: DataFrame) -> list[DataFrame]:
    """(query, id, vec, q) of all pairs, the queries broadcast in slices; none where a side is empty."""
    n = queries.count() if vectors.limit(1).count() else 0
    slices = -(-n // QUERIES)
    return [vectors.crossJoin(F.broadcast(queries.where(F.pmod(F.xxhash64("query"), F.lit(slices)) == s).select("query", F.col("vec").alias("q")))).select("query", "id", "vec", "q") for s in range(slices)]


def _near(vectors: DataFrame, queries: DataFrame, k: int, name: str) -> DataFrame:
    """(query, id, vec, q): all pairs that may be of a query's k best among a task's vectors; every vector is finite and of one length."""
    table = queries.toArrow()
    asked = np.asarray(table.column("vec").combine_chunks().flatten()).reshape(len(table), -1)
    asked, same = np.unique(asked, axis=0, return_inverse=True)
    order = np.argsort(same.ravel(), kind="stable")
    begins = np.searchsorted(same.ravel()[order], np.arange(len(asked) + 1))
    sent = vectors.sparkSession.sparkContext.broadcast((asked, table.column("query").combine_chunks().take(pa.array(order)), begins))
    kinds = {f.name: f.dataType for f in [*vectors.schema.fields, *queries.withColumnRenamed("vec", "q").schema.fields]}
    schema = StructType([StructField(c, kinds[c]) for c in ("query", "id", "vec", "q")])

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names, begins = sent.value
        q64 = asked.astype(np.float64)
        qsize = np.sqrt((q64**2).sum(1))
        turned = (q64 / np.where(qsize > 0, qsize, 1)[:, None] if name == "cos" else q64).astype(np.float32).T.copy()
        most, rounding = 0.0, (asked.shape[1] + 16) * 2.0**-22
        best = np.full((len(asked), k), -np.inf, np.float32)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]] = []  # query, score, row, ids, vectors

        def slack() -> np.ndarray:
            each = {"cos": np.ones(len(asked)), "dot": most * qsize, "euclid": 2 * most * qsize + most**2}[name]
            return (rounding * each + 1e-37).astype(np.float32)

        def prune() -> None:
            floor = best[:, -1] - 2 * slack()
            for n, (q, x, row, ids, vecs) in enumerate(kept):
                stay = x >= floor[q]
                used, at = np.unique(row[stay], return_inverse=True)
                kept[n] = (q[stay], x[stay], at.ravel(), ids.take(pa.array(used)), vecs[used])

        held = 0
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                piece = batch.slice(lo, 2048)
                vecs = np.asarray(piece.column(1).flatten()).reshape(len(piece), -1)
                ids = piece.column(0)
                rows = np.asarray(pc.sort_indices(ids))  # of equal vectors the k smallest ids stay
                keys = np.ascontiguousarray(vecs).view([("", np.void, vecs.itemsize * vecs.shape[1])]).ravel()
                tag = np.unique(keys[rows], return_inverse=True)[1].ravel()
                by = np.argsort(tag, kind="stable")
                first = np.searchsorted(tag[by], np.arange(tag.max() + 1))
                rows = rows[by[np.arange(len(by)) - first[tag[by]] < k]]
                vecs, ids = vecs[rows], ids.take(pa.array(rows))
                v64 = vecs.astype(np.float64)
                size = np.sqrt((v64**2).sum(1))
                most = max(most, float(size.max()))
                if name == "cos":
                    v64 = v64 / np.where(size > 0, size, 1)[:, None]
                left = v64.astype(np.float32)
                wide = slack()
                for c in range(0, len(asked), 4096):
                    x = left @ turned[:, c : c + 4096]
                    if name == "euclid":
                        x = 2 * x - (size**2).astype(np.float32)[:, None]
                    floor = best[c : c + 4096, -1]
                    if len(x) > k and np.isneginf(floor).any():
                        floor = np.maximum(floor, np.partition(x, len(x) - k, axis=0)[len(x) - k])
                    row, q = np.nonzero(x >= floor - 2 * wide[c : c + 4096])
                    if not len(q):
                        continue
                    score, q = x[row, q], q + c
                    here = np.unique(q)
                    all_q, all_x = np.concatenate([np.repeat(here, k), q]), np.concatenate([best[here].ravel(), score])
                    by = np.lexsort((-all_x, all_q))
                    start = np.searchsorted(all_q[by], here)
                    best[here] = all_x[by[(start[:, None] + np.arange(k)).ravel()]].reshape(-1, k)
                    used, at = np.unique(row, return_inverse=True)
                    kept.append((q, score, at.ravel(), ids.take(pa.array(used)), vecs[used]))
                    held += len(q)
                if held > 4 * len(asked) * k + 100_000:
                    prune()
                    kept[:] = [e for e in kept if len(e[0])]
                    held = sum(len(e[0]) for e in kept) // 2
        prune()
        for q, _, row, ids, vecs in kept:
            for lo in range(0, len(q), 1024):
                part, at = q[lo : lo + 1024], row[lo : lo + 1024]
                many = begins[part + 1] - begins[part]
                times = np.repeat(np.arange(len(part)), many)
                for c in range(0, len(times), 8192):
                    t = times[c : c + 8192]
                    which = begins[part[t]] + np.arange(c, c + len(t)) - (np.cumsum(many) - many)[t]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(which)), ids.take(pa.array(at[t])), lists(vecs[at[t]]), lists(asked[part[t]])], names=["query", "id", "vec", "q"])

    return vectors.mapInArrow(run, schema)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def condition(c: Column, op: str, value: object) -> Column:
    """One metadata condition; a field that is absent fails every operator, ne included."""
    there = c.isNotNull()
    if op == "in":
        test = c.isin(list(value))
    elif op == "has":
        test = F.array_contains(c, value)
    else:
        test = {"eq": c == value, "ne": c != value, "gt": c > value, "ge": c >= value, "lt": c < value, "le": c <= value}[op]
    return there & F.coalesce(test, F.lit(False))


def matching(rows: DataFrame, *conditions: tuple[str, str, object]) -> DataFrame:
    """Rows that meet every (field, operator, value)."""
    return rows.where(reduce(lambda a, b: a & b, [condition(F.col(f), o, v) for f, o, v in conditions], F.lit(True)))


def fuse(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion of lists (id, score), ranked by score and id."""
    own = Window.orderBy(F.desc("score"), "id")  # each list is a top-k of bounded length
    ranked = [df.select("id", (1 / (k + F.row_number().over(own))).alias("score")) for df in lists.values()]
    return reduce(DataFrame.union, ranked).groupBy("id").agg(F.sum("score").alias("score"))


def blend(lists: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score): weighted sums of scores; a list without a weight counts one n-th."""
    rows = [df.select("id", (F.col("score") * (weights or {}).get(n, 1 / len(lists))).alias("score")) for n, df in lists.items()]
    return reduce(DataFrame.union, rows).groupBy("id").agg(F.sum("score").alias("score"))


def match(facts: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Facts that agree with every term given."""
    for c, v in (("s", s), ("p", p), ("o", o)):
        facts = facts.where(F.col(c) == v) if v is not None else facts
    return facts


def retract(facts: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Facts but for those that agree with every term given."""
    test = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None], F.lit(True))
    return facts.where(~test)


def put(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: an id known before keeps its place and takes the last value put."""
    both = stored.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    cols = [c for c in stored.columns if c not in ("id", "ord")]
    return both.groupBy("id").agg(F.min(F.struct("_new", "ord"))["ord"].alias("ord"), F.max_by(F.struct(*cols), F.struct("_new", "ord")).alias("v")).select("ord", "id", "v.*")


def drop(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti")


def scan(stored: DataFrame, offset: int = 0, limit: int = 0) -> DataFrame:
    rows = stored.orderBy("ord").offset(offset)
    return rows.limit(limit) if limit > 0 else rows


def cut(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes gone, with every edge that touches them."""
    kept = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return drop(nodes, ids), kept
