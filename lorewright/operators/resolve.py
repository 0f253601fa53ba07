"""Entity resolution and conflicts: blocking, scoring, grouping, merging, and settling what records disagree about.

Entities are rows (ord, id, name, kind, props MAP<STRING,STRING>, edges ARRAY<STRING>, vector ARRAY<FLOAT>, score, doc). Claims are rows
(ord, subject, prop, value, doc, at, score). Pairs come from an equi-join on block keys, never from a cross join.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alike, cosine01, fold
from ..functions.udf import arrow
from ..plans.iterate import components, settle


def block_keys(name: Column) -> Column:
    """t: and the first four letters of each word of three letters or more; else n: and the whole name; - without a name."""
    folded = fold(name)
    words = F.filter(F.split(folded, r"[ _\-\t\n]+"), lambda w: F.length(w) > 2)
    keys = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.concat(F.lit("t:"), F.substring(w, 1, 4)))))
    return F.when(F.size(keys) > 0, keys).when(folded != "", F.array(F.concat(F.lit("n:"), folded))).otherwise(F.array(F.lit("-")))


def candidates(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(a, b): ordinals of records that share a block key, a < b; of fresh and known records if right is given."""
    keyed = lambda df, n: df.select(F.col("ord").alias(n), F.explode(block_keys(F.col("name"))).alias("key"))
    if right is None:
        return keyed(left, "a").join(keyed(left, "b"), "key").where("a < b").select("a", "b").distinct()
    return keyed(left, "a").join(keyed(right, "b"), "key").where("a <> b").select("a", "b").distinct()


def likeness(metric: str = "jaro", name: float = 0.6, props: float = 0.2, edges: float = 0.2, vector: float = 0.0) -> Column:
    """Weighted share of name, properties, edges and, where both sides have one, vector, over columns a_* and b_*."""
    keys = F.array_sort(F.array_union(F.map_keys("a_props"), F.map_keys("b_props")))
    same = lambda k: F.coalesce((F.col("a_props")[k] == F.col("b_props")[k]).cast("double"), F.lit(0.5))
    each = F.transform(keys, lambda k: F.when(same(k) == 0.0, F.lit(0.5)).otherwise(same(k)))
    own_props = F.when(F.size(keys) == 0, F.lit(1.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(keys))
    union = F.size(F.array_union("a_edges", "b_edges"))
    own_edges = F.when(union == 0, F.lit(0.5)).otherwise(F.size(F.array_intersect("a_edges", "b_edges")) / union)
    both = (F.size("a_vector") > 0) & (F.size("b_vector") > 0) & F.lit(vector > 0)
    total = F.lit(name + props + edges) + F.when(both, F.lit(vector)).otherwise(F.lit(0.0))
    base = name * alike(F.col("a_name"), F.col("b_name"), metric) + props * own_props + edges * own_edges
    return (base + F.when(both, vector * cosine01(F.col("a_vector"), F.col("b_vector"))).otherwise(F.lit(0.0))) / total


def find(entities: DataFrame, metric: str = "jaro", like: float = 0.7, score: float = 0.6, vector: float = 0.0, known: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, like, score): pairs of one kind whose likeness and confidence reach the thresholds.

    Confidence adds .1 for equal names, .05 for each agreed property and .05 for equal kinds, at most 1.
    """
    pairs = candidates(entities, known) if pairs is None else pairs
    other = entities if known is None else entities.unionByName(known)
    side = lambda n: other.select(F.col("ord").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("name", "kind", "props", "edges", "vector")])
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where("a_kind = b_kind or a_kind = '' or b_kind = ''")
    rows = rows.withColumn("like", likeness(metric, vector=vector))
    agreed = F.size(F.filter(F.map_keys("a_props"), lambda k: F.coalesce(F.col("a_props")[k] == F.col("b_props")[k], F.lit(False))))
    bonus = F.when(fold(F.col("a_name")) == fold(F.col("b_name")), 0.1).otherwise(0.0) + 0.05 * agreed + F.when((F.col("a_kind") == F.col("b_kind")) & (F.col("a_kind") != ""), 0.05).otherwise(0.0)
    rows = rows.withColumn("score", F.least(F.lit(1.0), F.col("like") + bonus))
    return rows.where((F.col("like") >= like) & (F.col("score") >= score)).select("a", "b", "like", "score")


def limit(pairs: DataFrame, floor: float = 0.0, per: int = 0, most: int = 0) -> DataFrame:
    """Best pairs first; per keeps a pair while either side has fewer than per. That choice is sequential, so it runs within a component."""
    rows = pairs.where(F.col("score") >= floor)
    if per > 0:
        parts = components(rows.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "a")

        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["score", "a", "b"], ascending=[False, True, True])
            used: dict[int, int] = {}
            out = []
            for r in pdf.itertuples():
                if used.get(r.a, 0) < per or used.get(r.b, 0) < per:
                    used[r.a], used[r.b] = used.get(r.a, 0) + 1, used.get(r.b, 0) + 1
                    out.append(r.Index)
            return pdf.loc[out].drop(columns="root")

        rows = rows.join(parts, "a").groupBy("root").applyInPandas(keep, rows.schema)
    rows = rows.orderBy(F.desc("score"), "a", "b")
    return rows.limit(most) if most > 0 else rows


def groups(pairs: DataFrame) -> DataFrame:
    """(ord, grp): records held together by pairs, under the smallest ordinal."""
    return components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("ord"), F.col("root").alias("grp"))


def group_stats(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """(grp, size, tight, score): tight is the mean score of a group's pairs, scaled by size up to five."""
    own = pairs.join(grouped.withColumnRenamed("ord", "a"), "a").groupBy("grp").agg(F.avg("score").alias("tight"))
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"))
    return sizes.join(own, "grp").select("grp", "size", "tight", (F.col("tight") * (0.8 + 0.2 * F.least(F.col("size") / 5, F.lit(1.0)))).alias("score"))


def loose(entities: DataFrame, grouped: DataFrame) -> DataFrame:
    return entities.join(grouped.select("ord"), "ord", "left_anti")


def merge(entities: DataFrame, grouped: DataFrame, keep: str = "fullest") -> DataFrame:
    """(grp, id, name, kind, props, edges, members, clashes): the survivor's values, gaps filled from the rest in order, edges united."""
    rows = entities.join(grouped, "ord").withColumn("full", F.size("props") + F.size("edges"))
    by = {"first": F.struct(-F.col("ord")), "last": F.struct(F.col("ord")), "fullest": F.struct("full", -F.col("ord")), "surest": F.struct("score", -F.col("ord"))}[keep]
    head = rows.groupBy("grp").agg(F.max_by(F.struct("ord", "id", "name", "kind"), by).alias("h"), F.array_sort(F.collect_list("id")).alias("members"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("edges")))).alias("edges"))
    each = rows.join(head.select("grp", F.col("h.ord").alias("head")), "grp").select("grp", "ord", (F.col("ord") != F.col("head")).alias("rest"), F.explode("props").alias("k", "v"))
    values = each.groupBy("grp", "k").agg(F.min_by("v", F.struct("rest", "ord")).alias("v"), F.count_distinct("v").alias("n"))
    props = values.groupBy("grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("k")))).alias("clashes"))
    return head.join(props, "grp", "left").select("grp", "h.id", "h.name", "h.kind", "props", "edges", "members", "clashes")


def _conflicts(claims: DataFrame, kind: str, *key: str) -> DataFrame:
    """Keys with two claims and two texts at least, and their claims in order."""
    own = claims.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"), F.avg(F.when(F.col("score") == 0, 0.5).otherwise(F.col("score"))).alias("mean"), F.min(F.col("value").try_cast("double") if hasattr(Column, "try_cast") else F.expr("try_cast(value as double)")).alias("lo"), F.max(F.expr("try_cast(value as double)")).alias("hi"), F.count_distinct(fold(F.col("value"))).alias("folded"))
    own = own.where("n >= 2 and values >= 2")
    prop = F.col("prop") if "prop" in key else F.lit("kind")
    spread = (F.col("values") - 1) / F.col("n")
    level = F.when(F.col("folded") == 1, "low").when(F.lower(prop).isin("id", "name", "kind", "type", "class"), "critical").when(F.col("hi") - F.col("lo") > 1000, "high").otherwise("medium")
    return own.select(F.lit(kind).alias("conflict"), *key, "n", "values", F.least(F.lit(1.0), F.col("mean") * (1 + spread)).alias("score"), level.alias("level"))


def value_conflicts(claims: DataFrame) -> DataFrame:
    return _conflicts(claims, "value", "subject", "prop")


def type_conflicts(claims: DataFrame) -> DataFrame:
    return _conflicts(claims.where(F.lower("prop").isin("type", "kind", "class")), "type", "subject", "prop")


def time_conflicts(claims: DataFrame) -> DataFrame:
    """Values that are dates of different years."""
    return _conflicts(claims.withColumn("value", F.expr("cast(year(try_cast(value as timestamp)) as string)")).where("value is not null"), "time", "subject", "prop")


def edge_conflicts(triples: DataFrame, many: list[str]) -> DataFrame:
    """(subject, predicate) with several objects, but for predicates that may have many."""
    rows = triples.where(~F.col("p").isin(*many) if many else F.lit(True)).select(F.col("s").alias("subject"), F.col("p").alias("prop"), F.col("o").alias("value"), "score", "ord")
    return _conflicts(rows, "edge", "subject", "prop")


def overlaps(spans: DataFrame) -> DataFrame:
    """Pairs of spans (subject, ord, lo, hi) of one subject that meet, ends included, and differ."""
    a, b = (spans.select("subject", *[F.col(c).alias(f"{c}_{n}") for c in ("ord", "lo", "hi")]) for n in "ab")
    return a.join(b, "subject").where("ord_a < ord_b and lo_a <= hi_b and lo_b <= hi_a and (lo_a <> lo_b or hi_a <> hi_b)")


def limits(claims: DataFrame, bounds: DataFrame) -> DataFrame:
    """Claims outside bounds (prop, lo, hi), numbers read from text too."""
    return claims.withColumn("num", F.expr("try_cast(value as double)")).join(bounds, "prop").where("num < lo or num > hi")


def excludes(claims: DataFrame, apart: DataFrame) -> DataFrame:
    """The first pair of kinds (k1, k2), stated of one subject, that exclude each other."""
    kinds = claims.where(F.lower("prop").isin("type", "kind", "class")).select("subject", "value", "ord")
    both = kinds.select("subject", F.col("value").alias("k1"), F.col("ord").alias("o1")).join(apart, "k1").join(kinds.select("subject", F.col("value").alias("k2"), F.col("ord").alias("o2")), ["subject", "k2"])
    return both.groupBy("subject").agg(F.min_by(F.struct("k1", "k2"), F.struct("o1", "o2")).alias("x")).select("subject", "x.k1", "x.k2")


def tally(conflicts: DataFrame) -> DataFrame:
    """Counts by kind, by level and by property in one pass of grouping sets."""
    by = [F.col(c) for c in ("conflict", "level", "prop")]
    return conflicts.groupingSets([[c] for c in by], *by).agg(F.count("*").alias("n")).select("conflict", "level", "prop", "n")


def settle_claims(claims: DataFrame, rule: str, trust: DataFrame | None = None) -> DataFrame:
    """(subject, prop, value, support): one value for each, by vote, credible, newest, oldest or sure; ties to the first stated.

    The rule flag settles nothing: value and support are null, so that a person can decide.

    trust (doc, weight) says how far a document is believed, .5 where nothing is said.
    """
    rows = claims
    if rule == "flag":
        return rows.select("subject", "prop").distinct().select("subject", "prop", F.lit(None).cast(claims.schema["value"].dataType).alias("value"), F.lit(None).cast("double").alias("support"))
    if rule == "credible":
        rows = rows.join(trust, "doc", "left").withColumn("w", F.coalesce("weight", F.lit(0.5)))
    support = {"vote": F.count("*"), "credible": F.round(F.sum("w"), 9) if rule == "credible" else None, "newest": F.max("at"), "oldest": F.min("at"), "sure": F.max("score")}[rule]
    per = rows.groupBy("subject", "prop", "value").agg(F.min("ord").alias("first"), support.alias("support"))
    order = F.asc_nulls_last("support") if rule == "oldest" else F.desc_nulls_last("support")
    best = per.groupBy("subject", "prop", "support").agg(F.min_by("value", "first").alias("value"))
    return best.withColumn("k", F.row_number().over(Window.partitionBy("subject", "prop").orderBy(order))).where("k = 1").select("subject", "prop", "value", "support")


def unique(triples: DataFrame) -> DataFrame:
    """Triples that agree after folding once: the first spelling, the largest score."""
    key = [fold(F.col(c)).alias(f"k{c}") for c in "spo"]
    return triples.groupBy(*key).agg(*[F.min_by(c, "ord").alias(c) for c in "spo"], F.max("score").alias("score"), F.min("ord").alias("ord")).drop("ks", "kp", "ko")


def repeats(triples: DataFrame, threshold: float, metric: str = "jaro") -> DataFrame:
    """Pairs of triples of one folded subject alike by .6 predicate and .4 object."""
    side = lambda n: triples.select(fold(F.col("s")).alias("key"), F.col("ord").alias(n), F.col("p").alias(f"{n}_p"), F.col("o").alias(f"{n}_o"))
    rows = side("a").join(side("b"), "key").where("a < b")
    return rows.withColumn("like", 0.6 * alike(F.col("a_p"), F.col("b_p"), metric) + 0.4 * alike(F.col("a_o"), F.col("b_o"), metric)).where(F.col("like") >= threshold).select("a", "b", "like")


def _word_hashes(text: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a of every text's distinct words, and each text's number of them; a word is hashed once a batch."""
    known: dict[str, int] = {}

    def fnv(word: str) -> int:
        h = 0xCBF29CE484222325
        for byte in word.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        known[word] = h
        return h

    own = [[known[w] if w in known else fnv(w) for w in set((t or "").lower().split())] for t in text]
    return np.array([h for hs in own for h in hs], np.uint64), np.array([len(hs) for hs in own], np.int64)


@arrow("long")
def simhash(text: pd.Series) -> pd.Series:
    """64-bit SimHash over distinct folded words, FNV-1a for each."""
    hashes, sizes = _word_hashes(text)
    counts = np.zeros((len(text), 64), np.int64)
    ends = np.cumsum(sizes)
    for lo in range(0, len(hashes), 8192):  # bits of so many words at a time
        part = hashes[lo : lo + 8192]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = np.searchsorted(ends, np.arange(lo, lo + len(part)), side="right")
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        counts[owner[first]] += np.add.reduceat(bits, first, dtype=np.int64)
    most = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
    return pd.Series(most.view(np.int64)[:, 0])


def simhash_near(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@arrow("array<long>")
def minhash(text: pd.Series) -> pd.Series:
    """64 minima of mixed word hashes, -1 in each place where there is no word."""
    seeds = _mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes, sizes = _word_hashes(text)
    out = np.full((len(text), 64), -1, np.int64)
    full = np.flatnonzero(sizes)
    begins = (np.cumsum(sizes) - sizes)[full]
    for k, seed in enumerate(seeds if len(full) else []):
        out[full, k] = np.minimum.reduceat(_mixed(hashes ^ seed), begins).view(np.int64)
    return pd.Series(out.tolist())


def minhash_like(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def fuse(entities: DataFrame, metric: str = "jaro", like: float = 0.7, score: float = 0.6, keep: str = "fullest") -> DataFrame:
    """Records to merged records: find, group, merge."""
    return merge(entities, settle(groups(find(entities, metric, like, score))), keep)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
