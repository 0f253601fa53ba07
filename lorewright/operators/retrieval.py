"""Retrieval and its measures: weighted vocabularies, stems, answers' overlap, ranking quality, intervals."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations_with_replacement
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import arrow
from ..plans.iterate import settle

_V = r"(?:[aeiou]|(?<=[^aeiou])y)"
_STEPS2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEPS3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEPS4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _forms(word: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _forms(word)))


def stem(word: str) -> str:
    """Porter's algorithm (1980)."""
    w = word.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    vowel = lambda s: "v" in _forms(s)
    cvc = lambda s: _forms(s)[-3:] == "cvc" and s[-1] not in "wxy"
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: -len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and vowel(w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _forms(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEPS2, _STEPS3):
        for a, b in sorted(steps, key=lambda x: -len(x[0])):
            if w.endswith(a):
                w = w[: -len(a)] + b if _measure(w[: -len(a)]) > 0 else w
                break
    for a in sorted([*_STEPS4, "ion"], key=len, reverse=True):
        if w.endswith(a):
            base = w[: -len(a)]
            if _measure(base) > 1 and (a != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@arrow("array<string>")
def stems(words: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [seen.setdefault(w, stem(w)) for w in ws])


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


WORDS = 2_000_000  # terms, or terms of questions, sent to all tasks as one table


def _sent(table: DataFrame) -> DataFrame:
    """A settled table, marked to be sent to all tasks if it has at most WORDS rows: a join on terms then moves no other row, and common terms meet in no one task."""
    table = settle(table)
    return F.broadcast(table) if table.limit(WORDS + 1).count() <= WORDS else table


def _dealt(docs: DataFrame, key: str) -> DataFrame:
    """(key, text) with the rows of a key in one task, so that what is counted by key and term moves no more."""
    return docs.select(key, "text").repartition(key)


def _weighed(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, w): tf times idf."""
    f = _dealt(docs, key).select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = _sent(f.groupBy("term").agg(F.count("*").alias("df")))
    n = docs.agg(F.count("*").alias("n"))
    return f.join(df, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))  # one row


def vectors(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): tf times idf, scaled to length one, as a sparse table."""
    x = _weighed(docs, key)
    size = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("size"))
    return x.join(size, key).select(key, "term", (F.col("w") / F.col("size")).alias("weight"))


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(auc): the mid-ranked Mann-Whitney share of pairs in order, from counts by score.

    Distinct scores are ranged into partitions and each partition's totals are added up first, so no task holds all scores.
    """
    by = scored.groupBy(F.col(score).alias("x")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    parts = settle(by.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.sum("q").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    own = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("q").over(own), F.lit(0))
    rows = parts.join(F.broadcast(totals.select("part", "before")), "part").withColumn("b", below)
    return rows.agg((F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))


def counted(docs: DataFrame, key: str = "doc_id", pattern: str = r"([a-z]+)") -> DataFrame:
    """(key, term, tf)."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def heaviest(docs: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(key, term, weight): the k terms of each document that weigh most by tf times idf. Texts move once a pass, counts do not."""
    f = counted(_dealt(docs, key), key)
    df = _sent(f.groupBy("term").agg(F.count("*").alias("df")))
    n = docs.agg(F.count("*").alias("n"))
    x = f.join(df, "term").crossJoin(F.broadcast(n)).withColumn("v", F.col("tf") * F.log(F.col("n") / F.col("df")))  # one row
    best = Window.partitionBy(key).orderBy(F.desc(F.round("v", 9)), "term")
    return x.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).select(key, "term", F.round("v", 6).alias("weight"))


def _best(scored: DataFrame, k: int, key: str, order: Column) -> DataFrame:
    """scored with the k best of each ask ranked."""
    best = Window.partitionBy("ask").orderBy(order, key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def shared(docs: DataFrame, asks: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(ask, key, shared, rank): the k documents that have most of a question's terms, through a join on the terms.

    The questions' terms go to the documents, so that a common term meets in no one task; what a document shares is counted where it is.
    """
    q = counted(asks, "ask").select("ask", "term")
    sought = _sent(q.groupBy("term").agg(F.collect_list("ask").alias("asks")))
    found = counted(_dealt(docs, key), key).join(sought, "term").select(key, F.explode("asks").alias("ask")).groupBy("ask", key).agg(F.count("*").alias("shared"))
    return _best(found, k, key, F.desc("shared"))


_SELF = r"(?i)\b(i|i'm|i've|i'd|i'll|me|my|mine|we|our)\b"


def claims(turns: DataFrame) -> DataFrame:
    """(conv, turn, who, k, text): what a speaker says of themselves or of things, one row a sentence; questions are no claims, and I stands for the speaker."""
    said = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: (F.trim(x) != "") & ~F.trim(x).endswith("?"))
    own = turns.select("conv", "turn", "who", F.posexplode(said).alias("k", "text"))
    return own.withColumn("of", F.when(F.col("text").rlike(_SELF), F.col("who")).otherwise(F.lit(None).cast("string")))


def evaluate(results: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, f1, recall, quiet) of results (..., answer, gold, found ARRAY, evidence ARRAY): an answer of null or none is quiet.

    Adversarial rows have no gold, and being quiet is right for them.
    """
    quiet = F.coalesce(F.trim("answer"), F.lit("")) == ""
    f1 = F.when(F.col("gold").isNull(), quiet.cast("double")).when(quiet, 0.0).otherwise(overlap_f1(F.col("answer"), F.col("gold")))
    recall = F.when(F.size("evidence") > 0, F.size(F.array_intersect("found", "evidence")) / F.size("evidence"))
    return results.withColumn("_f1", f1).groupBy(*by).agg(F.count("*").alias("n"), F.avg("_f1").alias("f1"), F.avg(recall).alias("recall"), F.avg(quiet.cast("double")).alias("quiet"))


def answers(docs: DataFrame, asks: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(ask, key, score, rank): the k nearest of docs to each of asks (ask, text) by weighted terms; only shared terms are joined.

    The questions' terms go to the documents, and a document's length and scores are added up where it is.
    """
    q = asks.select("ask", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    sought = _sent(q.groupBy("term").agg(F.collect_list("ask").alias("asks")))
    scored = vectors(docs, key).join(sought, "term").select(key, "weight", F.explode("asks").alias("ask")).groupBy("ask", key).agg(F.sum("weight").alias("score"))
    return _best(scored, k, key, F.desc(F.round("score", 9)))


@arrow("long")
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many terms two bags share, in time that grows with their sizes."""
    return pd.Series([0 if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a, b)], dtype="int64")


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two answers' terms as bags."""
    x, y = terms(a), terms(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2 * _common(x, y) / (F.size(x) + F.size(y))).otherwise(F.lit(0.0))


def bootstrap(values: list[float], level: float = 0.95) -> tuple[float, float]:
    """The exact bootstrap interval of a mean of few values: every bag of draws with its probability."""
    n = len(values)
    if n > 10:
        raise ValueError("the exact interval enumerates all bags; ten values at most")
    means = []
    for bag in combinations_with_replacement(range(n), n):
        ways, left = 1, n
        for k in set(bag):
            ways *= comb(left, bag.count(k))
            left -= bag.count(k)
        means.append((sum(values[k] for k in bag) / n, ways))
    means.sort()
    total, seen, low, high = n**n, 0, None, means[-1][0]
    for m, w in means:
        seen += w
        if low is None and seen >= total * (1 - level) / 2:
            low = m
        if seen >= total * (1 + level) / 2:
            high = m
            break
    return low, high
