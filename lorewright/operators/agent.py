"""Time, memory, decisions, policies and causes.

Temporal nodes are (ord, id, kind, text, vfrom, vuntil), edges (ord, src, dst, label, weight, vfrom, vuntil); spans include both ends and null is
open. Decisions are (ord, id, topic, choice, agent, confidence, at, ...). Policies are (ord, id, version, topic, rules MAP<STRING,STRING>).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.iterate import components, settle


def holds(at: Column, start: str = "vfrom", end: str = "vuntil") -> Column:
    return F.coalesce(F.col(start) <= at, F.lit(True)) & F.coalesce(F.col(end) >= at, F.lit(True))


def snapshot(nodes: DataFrame, edges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The graph as it stood: live nodes, and live edges between them."""
    live = nodes.where(holds(at))
    kept = edges.where(holds(at)).join(live.select(F.col("id").alias("src")), "src", "left_semi").join(live.select(F.col("id").alias("dst")), "dst", "left_semi")
    return live, kept


def retract(nodes: DataFrame, edges: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Closes the spans of nodes and of their edges at a time; a span is only ever shortened."""
    gone = ids.select("id").distinct()
    closed = F.least(F.coalesce("vuntil", at), at)
    marked = nodes.join(gone.withColumn("_g", F.lit(True)), "id", "left")
    ends = edges.join(gone.select(F.col("id").alias("src"), F.lit(True).alias("_a")), "src", "left").join(gone.select(F.col("id").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    hit = F.coalesce("_a", "_b", F.lit(False))
    return marked.withColumn("vuntil", F.when(F.coalesce("_g", F.lit(False)), closed).otherwise(F.col("vuntil"))).drop("_g"), ends.withColumn("vuntil", F.when(hit, closed).otherwise(F.col("vuntil"))).drop("_a", "_b")


def purge(nodes: DataFrame, edges: DataFrame, ids: DataFrame, at: Column, reason: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes nodes and their edges, and leaves (id, at, reason) of each."""
    kept = nodes.join(ids.select("id"), "id", "left_anti")
    left = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return kept, left, nodes.join(ids.select("id"), "id", "left_semi").select("id", at.alias("at"), F.lit(reason).alias("reason"))


def latest(log: DataFrame, *key: str) -> DataFrame:
    """The last change of every key in a log (seq, op, ...), deletions out."""
    own = log.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), "seq").alias("v"))
    return own.select(*key, "v.*").where("op <> 'drop'")


def near(spark: SparkSession, edges: DataFrame, start: str, hops: int, floor: float = 0.0, labels: list[str] | None = None, at: Column | None = None) -> DataFrame:
    """(id, hop, decay) along directed edges, the product of weights on the first path; hop up, decay down."""
    rows = edges.where(F.col("label").isin(labels)) if labels else edges
    rows = settle(rows.where(holds(at)) if at is not None else rows)
    seen = settle(spark.createDataFrame([(start, 0, 1.0, [0])], "id string, hop int, decay double, by array<bigint>"))
    for k in range(1, hops + 1):
        step = rows.join(seen.where(F.col("hop") == k - 1), rows["src"] == seen["id"]).select(F.col("dst").alias("id"), (F.col("decay") * F.col("weight")).alias("decay"), F.array_append("by", rows["ord"]).alias("by"))
        new = step.groupBy("id").agg(F.min_by(F.struct("decay", "by"), "by").alias("x")).select("id", F.lit(k).alias("hop"), "x.decay", "x.by").where(F.col("decay") >= floor)
        new = settle(new.join(seen.select("id"), "id", "left_anti"))
        if not new.limit(1).count():
            break
        seen = settle(seen.union(new))
    return seen.where("hop > 0").select("id", "hop", "decay").orderBy("hop", F.desc("decay"), "id")


def tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4)


def window(notes: DataFrame, notes_most: int = 10, tokens_most: int = 2000, scope: str = "scope") -> DataFrame:
    """The latest notes of each scope that fit a number of notes and of tokens, both counted back from the newest."""
    back = Window.partitionBy(scope).orderBy(F.desc("ord"))
    spent = F.sum(tokens(F.col("text"))).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return notes.withColumn("place", F.row_number().over(back)).withColumn("spent", spent).where((F.col("place") <= notes_most) & (F.col("spent") <= tokens_most))


def expire(notes: DataFrame, hold: Column, scope: str = "scope") -> DataFrame:
    """Notes no older than hold before their scope's newest."""
    newest = notes.groupBy(scope).agg(F.max("at").alias("_newest"))
    return notes.join(newest, scope).where(F.col("at") >= F.col("_newest") - hold).drop("_newest")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def share(text: Column, ask: str) -> Column:
    """Share of the question's words that the text has."""
    q = word_set(F.lit(ask))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(word_set(text), q)) / F.size(q)).otherwise(F.lit(0.0))


def recall(notes: DataFrame, ask: str, n: int, **window_of: int) -> DataFrame:
    """(scope, ord, score): notes by share of the question's words, a tenth more inside the window, at most 1."""
    recent = window(notes, **window_of).select("scope", "ord", F.lit(0.1).alias("more"))
    rows = notes.withColumn("own", share(F.col("text"), ask)).where("own > 0").join(recent, ["scope", "ord"], "left")
    return rows.select("scope", "ord", F.least(F.lit(1.0), F.col("own") + F.coalesce("more", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "scope", "ord").limit(n)


TESTS = ("min", "max", "has", "one", "present")


def rule(name: str, value: str, columns: list[str]) -> Column:
    """True where a rule test_field holds; a field nobody states fails."""
    test, _, field = name.partition("_")
    if test not in TESTS:
        raise ValueError(f"no test {test}")
    c = F.col(field) if field in columns else F.col("props")[field] if "props" in columns else F.lit(None)
    number = F.expr(f"try_cast('{float(value)}' as double)") if test in ("min", "max") else None
    out = {"min": lambda: c.cast("double") >= number, "max": lambda: c.cast("double") <= number, "has": lambda: F.contains(F.lower(c.cast("string")), F.lit(value.lower())), "one": lambda: c.cast("string").isin([v.strip() for v in value.split(",")]), "present": lambda: c.isNotNull()}[test]()
    return F.coalesce(out, F.lit(False))


def current(policies: DataFrame) -> DataFrame:
    """The latest version of each policy."""
    return policies.groupBy("id").agg(F.max_by(F.struct("ord", "version", "topic", "rules"), "ord").alias("p"), F.min("ord").alias("first")).select("id", "p.version", "p.topic", "p.rules", F.col("first").alias("ord"))


def vet(decisions: DataFrame, policies: list[tuple[str, str, dict[str, str]]], waivers: DataFrame | None = None) -> DataFrame:
    """Adds allowed, policy and failed: the first failing policy in order, its first failing rule by name. A waiver (id, policy) lifts one."""
    rows = decisions
    if waivers is not None:
        lifted = waivers.groupBy("id").agg(F.collect_set("policy").alias("lifted"))
        rows = rows.join(lifted, "id", "left")
    else:
        rows = rows.withColumn("lifted", F.lit(None).cast("array<string>"))
    checks = []
    for name, topic, rules in policies:
        on = (F.col("topic") == topic) & ~F.coalesce(F.array_contains("lifted", name), F.lit(False))
        for r in sorted(rules):
            checks.append(F.when(on & ~rule(r, rules[r], decisions.columns), F.struct(F.lit(name).alias("policy"), F.lit(r).alias("failed"))))
    first = F.coalesce(*checks) if checks else F.lit(None).cast("struct<policy:string,failed:string>")
    return rows.withColumn("_v", first).select("*", F.col("_v").isNull().alias("allowed"), F.col("_v.policy").alias("policy"), F.col("_v.failed").alias("failed")).drop("_v", "lifted")


def sway(decisions: DataFrame, policy: tuple[str, str, dict[str, str]], rules: dict[str, str]) -> DataFrame:
    """One row: decisions under a policy, how many its new rules would turn down that pass now, and the share."""
    name, topic, now = policy
    was, new = (vet(decisions.where(F.col("topic") == topic), [(name, topic, r)]).select("id", F.col("allowed").alias(n)) for r, n in ((now, "was"), (rules, "new")))
    both = was.join(new, "id").agg(F.count("*").alias("affected"), F.count_if(F.col("was") & ~F.col("new")).alias("fall"))
    changed = sorted(k for k in {*now, *rules} if now.get(k) != rules.get(k))
    return both.select("affected", "fall", F.when(F.col("affected") > 0, F.col("fall") / F.col("affected")).otherwise(F.lit(0.0)).alias("risk"), F.lit(",".join(changed)).alias("changed"))


CAUSAL = ["caused", "influenced", "precedes"]


def follow(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int = 10, down: bool = True, labels: list[str] | None = None) -> DataFrame:
    """(id, hop) of decisions downstream or upstream along causal edges."""
    a, b = ("src", "dst") if down else ("dst", "src")
    links = settle(edges.where(F.col("label").isin(labels or CAUSAL)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    seen = settle(starts.select("id", F.lit(0).alias("hop")).distinct())
    for k in range(1, depth + 1):
        new = links.join(seen.where(F.col("hop") == k - 1).select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        new = settle(new.select("id", F.lit(k).alias("hop")))
        if not new.limit(1).count():
            break
        seen = settle(seen.union(new))
    return seen.where("hop > 0")


def roots(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Decisions that nothing caused."""
    return decisions.join(edges.where(F.col("label").isin(CAUSAL)).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def loops(spark: SparkSession, edges: DataFrame, depth: int = 6) -> DataFrame:
    """(cycle): simple causal cycles up to depth, each once, from its smallest member."""
    links = settle(edges.where(F.col("label").isin(CAUSAL)).select("src", "dst").distinct())
    now, out = settle(links.select(F.array("src").alias("path"), F.col("dst").alias("at"))), []
    for _ in range(depth):
        out.append(now.where(F.col("path")[0] == F.col("at")).select(F.col("path").alias("cycle")))
        now = settle(now.where((F.col("at") > F.col("path")[0]) & ~F.array_contains("path", F.col("at"))).join(links, F.col("at") == F.col("src")).select(F.array_append("path", F.col("at")).alias("path"), F.col("dst").alias("at")))
        if not now.limit(1).count():
            break
    return reduce(DataFrame.union, out).distinct()


def force(decisions: DataFrame, edges: DataFrame, depth: int = 5) -> Column | DataFrame:
    """(id, force): confidences downstream by cause and influence, and half those of what precedes it, over their numbers, at most 1."""
    def reach(labels: list[str], a: str, b: str, tag: str) -> DataFrame:
        links = settle(edges.where(F.col("label").isin(labels)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
        seen = front = settle(links.select(F.col("u").alias("id"), F.col("v").alias("to")).distinct())
        for _ in range(depth - 1):
            front = settle(front.join(links, front["to"] == links["u"]).select("id", F.col("v").alias("to")).distinct().join(seen, ["id", "to"], "left_anti").where("id <> to"))
            if not front.limit(1).count():
                break
            seen = settle(seen.union(front))
        return seen.join(decisions.select(F.col("id").alias("to"), "confidence"), "to").groupBy("id").agg(F.sum("confidence").alias(f"s{tag}"), F.count("*").alias(f"n{tag}"))

    down, up = reach(["caused", "influenced"], "src", "dst", "a"), reach(["precedes"], "dst", "src", "b")
    rows = decisions.select("id").join(down, "id", "left").join(up, "id", "left").na.fill(0)
    value = (F.col("sa") + 0.5 * F.col("sb")) / (F.greatest("na", F.lit(1)) + 0.5 * F.greatest("nb", F.lit(1)))
    return rows.select("id", F.when(F.col("na") + F.col("nb") > 0, F.least(F.lit(1.0), value)).otherwise(F.lit(0.0)).alias("force"))


def net(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, causal edges, density and components of the causal graph."""
    own = edges.where(F.col("label").isin(CAUSAL))
    found = components(own.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    alone = decisions.select("id").join(found.select(F.col("node").alias("id")), "id", "left_anti").count()
    one = decisions.agg(F.count("*").alias("nodes")).crossJoin(own.agg(F.count("*").alias("edges"))).crossJoin(found.agg((F.count_distinct("root") + alone).alias("parts")))
    return one.select("nodes", "edges", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)).alias("density"), "parts")


def precedents(decisions: DataFrame, ask: str, topic: str | None = None, n: int = 5, floor: float = 0.0) -> DataFrame:
    """(id, score): past decisions by words shared with the question."""
    a, q = word_set(F.concat_ws(" ", "topic", "choice")), word_set(F.lit(ask))
    union = F.size(F.array_union(a, q))
    score = F.when(union > 0, F.size(F.array_intersect(a, q)) / union).otherwise(F.lit(0.0))
    rows = decisions.where(F.col("topic") == topic) if topic else decisions
    return rows.select("id", score.alias("score")).where(F.col("score") > floor).orderBy(F.desc("score"), "id").limit(n)
