"""Arrow UDFs whose types are read when a query is built, so that workers can import the modules that hold them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20  # as llm.textkit.light has it


def light(df: DataFrame) -> DataFrame:
    """df, its session set to hand Python workers batches of BATCH_BYTES at most: rows may be long texts, and ten thousand of them are many."""
    _limit(df.sparkSession)
    return df


def _limit(spark: SparkSession | None) -> None:
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(kernel: Callable) -> Callable[..., Column]:
        @wraps(kernel)
        def call(*columns: Column | str) -> Column:
            _limit(SparkSession.getActiveSession())
            return F.pandas_udf(kernel, ddl)(*columns)

        return call

    return wrap
