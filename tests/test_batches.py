"""Python workers see texts in batches limited by bytes, and results do not hang on where a batch ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorewright.functions import split as S
from lorewright.functions import text as T
from lorewright.functions.udf import arrow
from lorewright.operators import resolve

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def texts(spark):
    spark.conf.unset(NAME)
    yield spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(". ")), 250).alias("text"))
    spark.conf.unset(NAME)


@pytest.mark.parametrize("name", ["recursive", "tokens", "words"])
def test_splitters_are_given_few_bytes_at_a_time(spark, texts, name):
    plan = S.split(texts, name, 300)
    assert 0 < int(spark.conf.get(NAME).rstrip("b")) <= 8 << 20
    assert plan.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == texts.agg(F.sum(F.octet_length("text"))).first()[0]


def test_text_functions_are_given_few_bytes_at_a_time(texts):
    @arrow("long")
    def bytes_seen(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    assert texts.agg(F.sum(F.length("text"))).first()[0] > 10 << 20
    assert texts.select(bytes_seen(F.col("text")).alias("n")).agg(F.max("n")).first()[0] < 8 << 20
    assert texts.select(T.normal_form(F.col("text"), F.lit("NFD")).alias("t")).where("t like 'word%'").count() == 4000


def test_simhash_of_many_words_equals_bit_counts(spark):
    texts = ["", " ".join(f"w{k}" for k in range(20_000)), None, "a b", " ".join(f"x{k}" for k in range(8192)), "", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").coalesce(1)
    got = [r[0] for r in df.orderBy("k").select(resolve.simhash("text")).collect()]

    def plain(text):
        words = {w for w in (text or "").lower().split()}
        counts = [0] * 64
        for w in words:
            h = 0xCBF29CE484222325
            for byte in w.encode():
                h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            for b in range(64):
                counts[b] += h >> b & 1
        return int(np.array([sum((2 * c > len(words)) << b for b, c in enumerate(counts))], np.uint64).view(np.int64)[0])

    assert got == [plain(t) for t in texts]
