"""Decisions as a journal, and an agent that learns, recalls, decides and explains over tables.

Decisions are (ord, id, topic, case, reason, choice, agent, rule, confidence, allowed, gloss, at, because ARRAY<STRING>); evidence
and leads are edges (ord, src, dst, label, weight, vfrom, vuntil). Notes are (ord, id, text, at, agent, session, task, of ARRAY<STRING>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import agent, context

DECISION = "ord long, id string, topic string, `case` string, reason string, choice string, agent string, rule string, confidence double, allowed boolean, gloss string, at timestamp_ntz, because array<string>"
NOTE = "ord long, id string, text string, at timestamp_ntz, agent string, session string, task string, of array<string>"
NODE = "ord long, id string, kind string, text string, vfrom timestamp_ntz, vuntil timestamp_ntz"
EDGE = "ord long, src string, dst string, label string, weight double, vfrom timestamp_ntz, vuntil timestamp_ntz"


class DecisionError(ValueError):
    """A decision that cannot be written, or a lead between what are not decisions."""


def faults(new: DataFrame) -> DataFrame:
    """(id, fault) of rows that cannot be decisions."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    sure = F.coalesce(F.col("confidence"), F.lit(0.0))
    fault = F.when(blank("topic"), "needs a topic").when(blank("case"), "needs a case").when(blank("choice"), "needs a choice").when((sure < 0) | (sure > 1), "confidence is outside 0 to 1")
    return new.select("id", fault.alias("fault")).where("fault is not null")


def _edges(rows: DataFrame, src: str, dst: str, label: Column) -> DataFrame:
    """Edges in the order of their rows, and of their places in a list."""
    return rows.select("ord", F.col(src).alias("src"), F.col(dst).alias("dst"), label.alias("label"), F.lit(1.0).alias("weight"), F.lit(None).cast("timestamp_ntz").alias("vfrom"), F.lit(None).cast("timestamp_ntz").alias("vuntil"))


def _named(rows: DataFrame, kind: str) -> DataFrame:
    """A row without an id takes one from its content."""
    own = F.concat(F.lit(kind + "-"), F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 16))
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), own))


def write(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, new: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, nodes and edges after new decisions: each is a node, joined to what it rests on by about. Faulty rows raise DecisionError."""
    bad = faults(new).limit(1).collect()
    if bad:
        raise DecisionError(f"{bad[0]['id']}: {bad[0]['fault']}")
    own = _named(new, "decision").withColumn("at", F.coalesce("at", now if now is not None else F.localtimestamp()))
    own = own.select([f.name for f in decisions.schema])
    nodes = context.add(nodes, own.select("ord", "id", F.lit("decision").alias("kind"), F.col("case").alias("text"), F.lit(None).cast("timestamp_ntz").alias("vfrom"), F.lit(None).cast("timestamp_ntz").alias("vuntil")))
    each = own.select((F.col("ord") * 1000).alias("base"), "id", F.posexplode("because").alias("k", "to")).where("to <> ''").select((F.col("base") + F.col("k")).alias("ord"), "id", "to")
    nodes, edges = context.join(nodes, edges, _edges(each, "id", "to", F.lit("about")))
    kept = agent.latest(decisions.withColumns({"seq": F.lit(0), "op": F.lit("put")}).unionByName(own.withColumns({"seq": F.lit(1), "op": F.lit("put")})), "id")
    return kept.select(decisions.columns), nodes, edges


def read(decisions: DataFrame, ident: str) -> DataFrame:
    return decisions.where(F.col("id") == ident)


def on(decisions: DataFrame, topic: str) -> DataFrame:
    return decisions.where(F.col("topic") == topic).orderBy("ord")


def by(decisions: DataFrame, who: str) -> DataFrame:
    return decisions.where(F.col("agent") == who).orderBy("ord")


def about(decisions: DataFrame, edges: DataFrame, entity: str) -> DataFrame:
    """Decisions that rest on an entity."""
    return decisions.join(edges.where((F.col("label") == "about") & (F.col("dst") == entity)).select(F.col("src").alias("id")), "id", "left_semi").orderBy("ord")


def lead(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with links (ord, src, dst, label) between decisions: caused, influenced or precedes. Anything else raises DecisionError."""
    ids = decisions.select("id")
    other = links.where(~F.col("label").isin(agent.CAUSAL)).select(F.concat(F.col("label"), F.lit(" is no way to lead")).alias("why"))
    for end in ("src", "dst"):
        other = other.union(links.join(ids.withColumnRenamed("id", end), end, "left_anti").select(F.concat(F.col(end), F.lit(" is no decision"))))
    bad = other.limit(1).collect()
    if bad:
        raise DecisionError(bad[0]["why"])
    return context.join(nodes, edges, _edges(links, "src", "dst", F.col("label")))


def before(decisions: DataFrame, edges: DataFrame, ident: str) -> DataFrame:
    """The precedents of a decision, in the order they were linked."""
    own = edges.where((F.col("label") == "precedes") & (F.col("dst") == ident)).select(F.col("src").alias("id"), F.col("ord").alias("_at"))
    return decisions.join(own, "id").orderBy("_at").select(decisions.columns)


def learn(notes: DataFrame, nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, nodes and edges after new notes: each is a node, joined by about to every entity it is of."""
    if new.where(F.coalesce(F.col("text"), F.lit("")) == "").limit(1).count():
        raise DecisionError("a note needs text")
    own = _named(new, "note").select(notes.columns)
    nodes = context.add(nodes, own.select("ord", "id", F.lit("note").alias("kind"), "text", F.col("at").alias("vfrom"), F.lit(None).cast("timestamp_ntz").alias("vuntil")))
    each = own.select((F.col("ord") * 1000).alias("base"), "id", F.posexplode("of").alias("k", "to")).where("to <> ''").select((F.col("base") + F.col("k")).alias("ord"), "id", "to")
    nodes, edges = context.join(nodes, edges, _edges(each, "id", "to", F.lit("about")))
    return notes.union(own), nodes, edges


def recall(notes: DataFrame, nodes: DataFrame, ask: str, n: int = 0, recent: int = 10, tokens: int = 2000, scope: Column | None = None) -> DataFrame:
    """(id, score): notes by their words, a tenth more inside the window; an entity of the question's words brings its notes in at .3 of its score, and lifts by 1.2 those found already.

    The window is of all notes, whatever their scope. Lists meet in one join by id.
    """
    own = notes.where(scope) if scope is not None else notes
    fresh = agent.window(notes.withColumn("_all", F.lit(0)), recent, tokens, "_all").select("id", F.lit(0.1).alias("more"))
    said = own.select("id", "ord", agent.share(F.col("text"), ask).alias("own")).where("own > 0").join(fresh, "id", "left")
    said = said.select("id", "ord", F.least(F.lit(1.0), F.col("own") + F.coalesce("more", F.lit(0.0))).alias("words"))
    hits = nodes.where("kind = 'entity'").select(F.col("id").alias("e"), agent.share(F.col("text"), ask).alias("hit"), F.col("ord").alias("place")).where("hit > 0")
    named = own.select("id", "ord", F.explode(F.array_distinct("of")).alias("e")).join(hits, "e")
    # the entity found best comes first; each further one lifts what is there
    found = named.groupBy("id", "ord").agg(F.max_by("hit", F.struct("hit", -F.col("place"))).alias("hit"), F.count("*").alias("k"))
    both = said.join(found, ["id", "ord"], "full")
    grown = lambda base, times: F.least(F.lit(1.0), base * F.pow(F.lit(1.2), times))
    score = F.when(F.col("words").isNull(), grown(0.3 * F.col("hit"), F.col("k") - 1)).when(F.col("k").isNull(), F.col("words")).otherwise(grown(F.col("words"), F.col("k")))
    rows = both.select("id", score.alias("score"), F.col("words").isNull().alias("late"), "ord").orderBy(F.desc("score"), "late", "ord")
    return (rows.limit(n) if n > 0 else rows).select("id", "score")


def decide(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, new: DataFrame, policies: list[tuple[str, str, dict[str, str]]], now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New decisions put to the policies and written either way, with what the rules said."""
    seen = agent.vet(new.drop("allowed", "gloss"), policies)
    gloss = F.when(F.col("allowed"), F.lit("passed")).otherwise(F.concat(F.col("policy"), F.lit(": "), F.col("failed")))
    return write(decisions, nodes, edges, seen.withColumns({"gloss": gloss, "rule": F.coalesce(F.nullif("rule", F.lit("")), F.col("policy"))}), now)


def why(spark: SparkSession, decisions: DataFrame, nodes: DataFrame, edges: DataFrame, ident: str, depth: int = 10) -> DataFrame:
    """(id, because, led, roots, gloss) of one decision: its evidence as it stands, what led to it, the farthest first, and where that begins."""
    d = read(decisions, ident)
    if not d.limit(1).count():
        raise DecisionError(f"{ident} is no decision")
    led = agent.follow(spark, edges, d.select("id"), depth, down=False).join(decisions.select("id", "ord"), "id")
    starts = agent.roots(decisions, edges).select("id").join(led, "id", "left_semi")
    held = d.select(F.posexplode("because").alias("k", "id")).join(nodes.select("id"), "id", "left_semi")
    names = lambda df, key, name: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*key, "id"))), lambda x: x["id"]).alias(name))
    one = d.select("id", "topic", "choice", "allowed", F.col("gloss").alias("said")).crossJoin(names(held, ["k"], "because")).crossJoin(names(led.withColumn("far", -F.col("hop")), ["far", "ord"], "led")).crossJoin(names(starts, [], "roots"))  # a row each
    count = lambda c, a, b: F.concat(F.size(c).cast("string"), F.when(F.size(c) == 1, f" {a}").otherwise(f" {b}"))
    gloss = F.concat(F.when(F.col("allowed"), "allowed").otherwise("refused"), F.lit(' "'), F.col("choice"), F.lit('" on '), F.col("topic"), F.lit(": "), F.coalesce("said", F.lit("")), F.lit("; rests on "), count("because", "piece of evidence", "pieces of evidence"), F.lit("; follows "), count("led", "earlier decision", "earlier decisions"))
    return one.select("id", "because", "led", "roots", gloss.alias("gloss"))
