"""The k best of many queries against scores of all pairs: copies, ties, odd rows, and more blocks than one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewright.operators import store


def every_pair(v, q, k, name):
    """The k best by scores of all pairs."""
    from pyspark.sql import Window

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    x = v.crossJoin(q.select("query", F.col("vec").alias("q"))).select("query", "id", store.metric(name, F.col("vec"), F.col("q")).alias("score"))
    return x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


@pytest.mark.parametrize("name", ["cos", "dot", "euclid"])
def test_search_many_equals_all_pairs(spark, monkeypatch, name):
    r = np.random.default_rng(7)
    rows = r.normal(size=(6000, 6)).astype(np.float32).tolist()
    rows[100:2500] = [rows[0]] * 2400  # one very common vector, some of whose copies ask
    rows[3000] = [2 * x for x in rows[0]]
    rows[3001:3004] = [[0.0] * 6, None, [1.0, None, 0.0, 0.0, 0.0, 0.0]]
    v = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "id long, vec array<float>").cache()
    q = v.where("id % 50 = 0 or id = 3001 or id = 3003").select(F.col("id").alias("query"), "vec").where("vec is not null").cache()
    monkeypatch.setattr(store, "NUMBERS", 200)
    found = lambda df: {(r.query, r.rank): (r.id, r.score) for r in df.collect()}
    assert found(store.search_many(v, q, 5, name)) == found(every_pair(v, q, 5, name))


def test_search_many_forms_no_pair_of_all_rows(spark):
    """Pairs of all vectors and queries never meet in a join."""
    v = spark.range(200).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    out = store.search_many(v, v.where("id % 50 = 0").select(F.col("id").alias("query"), "vec"), 5)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20
