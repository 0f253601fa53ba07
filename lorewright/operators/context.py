"""The temporal graph as one table of nodes and one of edges: writing, counting, finding, likeness, and routes, also between graphs.

Nodes are (ord, id, kind, text, ...), edges (ord, src, dst, label, weight, ...); a write that repeats a key keeps its place and takes the new values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.iterate import settle
from .agent import CAUSAL, holds, share, word_set
from .store import put


def band(hops: Column) -> Column:
    return F.when(hops <= 1, "direct").when(hops <= 3, "near").when(hops <= 6, "mid").otherwise("far")


def add(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with the new ones written over or after them; one without an id is refused, one without a kind is an entity."""
    own = new.where("id <> ''").withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("entity")))
    return put(nodes, own.select(nodes.columns))


def join(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the new edges written; ends that nobody wrote become entities under their own id, after all others."""
    label = F.coalesce(F.nullif("label", F.lit("")), F.lit("about"))
    weight = F.coalesce(F.when(F.col("weight") != 0, F.col("weight")), F.lit(1.0))
    own = new.where("src <> '' and dst <> ''").withColumns({"label": label, "weight": weight}).select(edges.columns)
    rest = [c for c in edges.columns if c not in ("ord", "src", "dst", "label")]
    both = edges.withColumn("_new", F.lit(False)).union(own.withColumn("_new", F.lit(True)))
    at = F.struct("_new", "ord")
    kept = both.groupBy("src", "dst", "label").agg(F.min(at)["ord"].alias("ord"), F.max_by(F.struct(*rest), at).alias("v")).select("ord", "src", "dst", "label", "v.*").select(edges.columns)
    last = nodes.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"))
    ends = own.select(F.col("src").alias("id"), (F.col("ord") * 2).alias("at")).union(own.select("dst", F.col("ord") * 2 + 1))
    made = ends.groupBy("id").agg(F.min("at").alias("at")).join(nodes.select("id"), "id", "left_anti").crossJoin(F.broadcast(last))
    values = {"ord": (F.col("last") + 1 + F.col("at")).cast(nodes.schema["ord"].dataType), "id": F.col("id"), "kind": F.lit("entity"), "text": F.col("id")}
    made = made.select(*[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in nodes.schema])
    return nodes.union(made), kept


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, value): nodes and edges in all, by kind and by label, and density over ordered pairs of different nodes."""
    row = lambda df, what, name: df.groupBy(name).agg(F.count("*").cast("double").alias("value")).select(F.lit(what).alias("what"), F.col(name).alias("name"), "value")
    n, m = nodes.agg(F.count("*").cast("double").alias("n")), edges.agg(F.count("*").cast("double").alias("m"))
    one = n.crossJoin(m)  # a row each
    density = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0))
    total = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), F.lit("").alias("name"), v.alias("value")) for k, v in (("nodes", F.col("n")), ("edges", F.col("m")), ("density", density))])).alias("x")).select("x.*")
    return total.union(row(nodes, "kind", "kind")).union(row(edges, "label", "label"))


def find(nodes: DataFrame, ask: str) -> DataFrame:
    """(id, score, ord): nodes whose text has a word of the question, by the share of its words."""
    return nodes.select("id", share(F.col("text"), ask).alias("score"), "ord").where("score > 0").orderBy(F.desc("score"), "ord")


_DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def _pairs(c: Column) -> Column:
    plain = F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")
    return F.when(F.length(plain) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substring(plain, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def alike(ask: Column, text: Column) -> Column:
    """How much of one text's words another has; by pairs of letters, three at least, where words can't tell: one word, or a script without spaces."""
    q, t = word_set(ask), word_set(text)
    part = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))
    own, p = part(q, t), _pairs(ask)
    return F.when((~ask.rlike(_DENSE) & (F.size(q) > 1)) | (F.size(p) < 3), own).otherwise(F.greatest(own, part(p, _pairs(text))))


def like(nodes: DataFrame, edges: DataFrame, node: str, by_shape: bool = False, n: int = 0) -> DataFrame:
    """(id, score): the other nodes by words shared with one, or by shape: nodes of a kind are as alike as their numbers of edges out."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    rows = nodes.join(out, "id", "left").na.fill(0, ["out"])
    ref = rows.where(F.col("id") == node).select(F.col("kind").alias("_kind"), F.col("text").alias("_text"), F.col("out").alias("_out"))
    both = rows.where(F.col("id") != node).crossJoin(F.broadcast(ref.limit(1)))  # one row
    most = F.greatest("out", "_out", F.lit(1))
    shape = F.when(F.col("kind") == F.col("_kind"), 1 - F.abs(F.col("out") - F.col("_out")) / most).otherwise(F.lit(0.0))
    got = both.select("id", (shape if by_shape else alike(F.col("_text"), F.col("text"))).alias("score"), "ord").orderBy(F.desc("score"), "ord")
    return (got.limit(n) if n > 0 else got).select("id", "score")


_ROUTE = "path array<string>, hops int, decay double, doors int, weights array<double>"


def _route(spark: SparkSession, links: DataFrame, start: str, end: str, most: int | None) -> DataFrame:
    """(path, hops, decay, doors, weights) of the first route that a breadth-first walk over links (src, dst, weight, ord, door) meets; no row without one.

    Nodes are met in the order of the edges that led to them. A round joins the frontier alone.
    """
    links = settle(links.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.col("ord").cast("long").alias("ord"), F.col("door").cast("int").alias("door")))
    front = settle(spark.createDataFrame([(start, [start], 1.0, 0, [], [])], "id string, path array<string>, decay double, doors int, weights array<double>, by array<bigint>"))
    seen, hop = front.select("id"), 0
    while True:
        found = front.where(F.col("id") == end)
        if found.limit(1).count():
            return found.select("path", F.lit(hop).cast("int").alias("hops"), "decay", "doors", "weights")
        if most is not None and hop >= most:
            break
        hop += 1
        step = links.join(front, links["src"] == front["id"]).select(F.col("dst").alias("to"), F.array_append("path", F.col("dst")).alias("path"), (F.col("decay") * F.col("weight")).alias("decay"), (F.col("doors") + F.col("door")).alias("doors"), F.array_append("weights", F.col("weight")).alias("weights"), F.array_append("by", F.col("ord")).alias("by"))
        best = step.groupBy("to").agg(F.min_by(F.struct("path", "decay", "doors", "weights", "by"), "by").alias("x"))
        front = settle(best.select(F.col("to").alias("id"), "x.*").join(seen, "id", "left_anti"))
        if not front.limit(1).count():
            break
        seen = settle(seen.union(front.select("id")))
    return spark.createDataFrame([], _ROUTE)


def path(spark: SparkSession, edges: DataFrame, start: str, end: str, hops: int = 10, labels: list[str] | None = None, at: Column | None = None) -> DataFrame:
    """(path, hops, decay, band) of the first route between two nodes along directed edges."""
    rows = edges.where(F.col("label").isin(labels)) if labels else edges
    rows = rows.where(holds(at)) if at is not None else rows
    return _route(spark, rows.withColumn("door", F.lit(0)), start, end, hops).select("path", "hops", "decay", band(F.col("hops")).alias("band"))


def cross(spark: SparkSession, edges: DataFrame, doors: DataFrame, start: tuple[str, str], end: tuple[str, str], hops: int = 10) -> DataFrame:
    """The same between graphs: edges have a graph, doors (ord, graph, src, to_graph, dst) lead from one to another and count as a hop of full weight, after the edges."""
    key = lambda g, i: F.concat(F.col(g), F.lit("\u0001"), F.col(i))
    own = edges.select(key("graph", "src").alias("src"), key("graph", "dst").alias("dst"), "weight", "ord", F.lit(0).alias("door"))
    more = doors.select(key("graph", "src").alias("src"), key("to_graph", "dst").alias("dst"), F.lit(1.0).alias("weight"), (F.col("ord") + (1 << 50)).alias("ord"), F.lit(1).alias("door"))
    got = _route(spark, own.union(more), "\u0001".join(start), "\u0001".join(end), hops)
    return got.select(F.transform("path", lambda x: F.replace(x, F.lit("\u0001"), F.lit("/"))).alias("path"), "hops", "decay", "doors", band(F.col("hops")).alias("band"))


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def trace(spark: SparkSession, edges: DataFrame, decisions: DataFrame, start: str, end: str) -> DataFrame:
    """(path, hops, between, decay, weakest_src, weakest_dst, weight, band, gloss): how one decision led to another, and the edge that costs most."""
    links = edges.where(F.col("label").isin(CAUSAL)).withColumn("door", F.lit(0))
    got = _route(spark, links, start, end, None)
    low = F.array_min("weights")
    k = F.array_position("weights", low)
    inner = F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))
    between = got.select(F.posexplode(inner).alias("k", "id")).join(decisions.select("id"), "id", "left_semi").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("between"))
    sure = F.concat(F.lit("confidence "), F.format_number("decay", 2))
    near = F.concat(F.lit("mediated by "), _counted(F.col("hops") - 1, "decision", "decisions"), F.lit(", "), sure, F.lit(", "), F.when(F.col("decay") > 0.4, "moderate evidence").otherwise("weak evidence"))
    far = F.concat(F.lit("distal, "), _counted(F.col("hops"), "causal step", "causal steps"), F.lit(", "), sure, F.lit(", weak evidence"))
    gloss = F.when(F.col("band") == "direct", F.concat(F.lit("direct cause, "), sure)).when(F.col("band") == "near", near).otherwise(far)
    rows = got.withColumn("band", band(F.col("hops"))).crossJoin(between)  # a row each
    return rows.select("path", "hops", "between", "decay", F.when(F.size("weights") > 0, F.get("path", (k - 1).cast("int"))).alias("weakest_src"), F.when(F.size("weights") > 0, F.get("path", k.cast("int"))).alias("weakest_dst"), F.coalesce(low, F.lit(1.0)).alias("weight"), "band", gloss.alias("gloss"))


def strength(label: Column, confidence: Column, hops: Column) -> Column:
    weight = F.when(label == "caused", 1.0).when(label == "influenced", 0.8).otherwise(0.6)
    return confidence * weight / (1 + F.greatest(hops, F.lit(0)) * 0.1)


def fit(score: Column, same_topic: Column, same_choice: Column) -> Column:
    return F.least(F.lit(1.0), score * F.when(same_topic, 1.1).otherwise(0.7) * F.when(same_choice, 1.1).otherwise(0.8))


def covers(agent: str = "", session: str = "", task: str = "") -> Column:
    """Whether a row's scope is within a filter; what the filter leaves empty is free."""
    test = F.lit(True)
    for column, value in (("agent", agent), ("session", session), ("task", task)):
        test = test & F.coalesce(F.col(column) == value, F.lit(False)) if value else test
    return test


def about(notes: DataFrame, entity: str) -> DataFrame:
    """Notes that name an entity among those they are of, oldest first."""
    return notes.where(F.array_contains("of", entity)).orderBy("ord")


def forget(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("id"), "id", "left_anti")
