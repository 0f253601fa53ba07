"""Fixpoints over DataFrames: lineage is cut by reliable checkpoints in the shared folder, so a lost executor costs a read."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or a local one where that is unset, as in tests."""
    inner, path = spark.sparkContext._jsc.sc(), spark.conf.get("spark.checkpoint.dir", None)
    if not inner.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path or "file://" + os.path.join(tempfile.gettempdir(), f"lorewright-{os.getpid()}"))
    return path or inner.getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stars(edges: DataFrame) -> DataFrame:
    """edges (u, v) with each Arrow batch's links replaced by stars around the smallest nodes they connect: as many parts, and no more links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            up: dict = {}

            def root(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for a, b in zip(pdf.u.tolist(), pdf.v.tolist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            rows = [(x, r) for x in up if (r := root(x)) != x]
            yield pd.DataFrame({"u": pd.Series([x for x, _ in rows], dtype=pdf.u.dtype), "v": pd.Series([r for _, r in rows], dtype=pdf.v.dtype)})

    return edges.mapInPandas(run, edges.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) by alternating stars over edges (u, v); the root is the component's smallest node.

    Links that lie together are made stars first, so that chains told in order need no rounds of joins.
    """
    near = stars(edges.where("u <> v").select("u", "v"))
    now = settle(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
