"""Forward chaining: rules compiled to joins, run semi-naively to a fixpoint.

Facts are rows (s, p, o, score, rule, premises, depth, ord). Each round joins, for every rule and every body atom in turn, that
atom's part of the last round's facts with all facts known at the round's start; a new fact is kept under its first derivation,
by rule, atom and the ordinals of its premises, and facts already known are taken out by an anti join. Variables that body
atoms share become equi-join keys. Rounds are settled in the shared folder.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import settle

DEPTH, PARTS = 32, 8


class RuleError(ValueError):
    """A rule that cannot be run."""


class DepthError(RuntimeError):
    """The bound on rounds was met; .model holds what was derived so far."""

    def __init__(self, model: DataFrame):
        super().__init__("facts are still being derived at the depth bound")
        self.model = model


@dataclass(frozen=True)
class Pattern:
    """A triple whose terms may be ?variables."""

    s: str
    p: str
    o: str

    def terms(self) -> tuple[str, str, str]:
        return self.s, self.p, self.o

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for t in self.terms() if t.startswith("?")))


@dataclass(frozen=True)
class Rule:
    head: Pattern
    body: tuple[Pattern, ...]
    name: str = ""
    score: float = 1.0

    def check(self) -> Rule:
        if not self.body:
            raise RuleError("a rule needs a body")
        if any(not t.strip() for a in (self.head, *self.body) for t in a.terms()):
            raise RuleError("a term is blank")
        bound = {v for a in self.body for v in a.variables()}
        if free := [v for v in self.head.variables() if v not in bound]:
            raise RuleError(f"{free[0]} is not bound by the body")
        if not 0 <= self.score <= 1:
            raise RuleError("a score lies between 0 and 1")
        return self

    def __str__(self) -> str:
        atom = lambda a: f"{a.p}({a.s}, {a.o})"
        return f"{atom(self.head)} :- {', '.join(map(atom, self.body))}."


_ATOM = re.compile(r"\s*([^(),]+?)\s*\(\s*([^(),]*?)\s*,\s*([^(),]*?)\s*\)\s*")


def parse(text: str, name: str = "", score: float = 1.0) -> Rule:
    """head(?x, ?y) :- first(?x, ?z), second(?z, ?y)."""
    head, sign, body = text.strip().removesuffix(".").partition(":-")
    if not sign:
        raise RuleError("a rule reads head :- body")

    def atoms(part: str) -> list[Pattern]:
        out, at = [], 0
        while at < len(part):
            m = _ATOM.match(part, at)
            if not m or m.end() < len(part) and part[m.end()] != ",":
                raise RuleError(f"cannot read {part[at:]!r}")
            out.append(Pattern(m[2], m[1], m[3]))
            at = m.end() + 1
        return out

    heads = atoms(head)
    if len(heads) != 1:
        raise RuleError("a rule has one head")
    return Rule(heads[0], tuple(atoms(body)), name or heads[0].p, score).check()


def transitive(p: str) -> Rule:
    return Rule(Pattern("?x", p, "?z"), (Pattern("?x", p, "?y"), Pattern("?y", p, "?z")), f"transitive:{p}")


def symmetric(p: str) -> Rule:
    return Rule(Pattern("?y", p, "?x"), (Pattern("?x", p, "?y"),), f"symmetric:{p}")


def inverse(p: str, q: str) -> Rule:
    return Rule(Pattern("?y", q, "?x"), (Pattern("?x", p, "?y"),), f"inverse:{p}:{q}")


def key(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("\x1f", s, p, o)


def match(facts: DataFrame, pattern: Pattern) -> DataFrame:
    """One row of bindings, a column for each variable, for every fact that fits."""
    return _atom(facts, pattern, 0).select(*[F.col(_v(v)).alias(v[1:]) for v in pattern.variables()], "ord0").withColumnRenamed("ord0", "ord")


def _v(variable: str) -> str:
    return f"v_{variable[1:]}"


def _atom(facts: DataFrame, pattern: Pattern, k: int) -> DataFrame:
    """Facts that fit an atom, as its variables and ord, weight and key under the atom's number."""
    rows, seen = facts, {}
    for column, term in zip("spo", pattern.terms()):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif term in seen:
            rows = rows.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    weight = F.when(F.col("score") == 0, F.lit(1.0)).otherwise(F.col("score"))  # nothing stated counts as certain
    return rows.select(*[F.col(c).alias(_v(t)) for t, c in seen.items()], F.col("ord").alias(f"ord{k}"), weight.alias(f"w{k}"), key(F.col("s"), F.col("p"), F.col("o")).alias(f"k{k}"))


def _order(rule: Rule, pinned: int) -> list[int]:
    """The pinned atom, which is the small side, and then always one that shares a variable with those before; only what shares none is crossed."""
    out, rest = [pinned], [i for i in range(len(rule.body)) if i != pinned]
    bound = set(rule.body[pinned].variables())
    while rest:
        k = next((i for i in rest if bound & set(rule.body[i].variables())), None)
        if k is None:
            k = rest[0]
            warnings.warn(f"an atom of {rule.name or rule.head} shares no variable with the others: all pairs are made", stacklevel=2)
        out.append(k)
        rest.remove(k)
        bound |= set(rule.body[k].variables())
    return out


def _fire(rule: Rule, number: int, known: DataFrame, fresh: DataFrame) -> list[DataFrame]:
    out = []
    for pinned in range(len(rule.body)):
        joined, bound = None, set()
        for k in _order(rule, pinned):
            own = _atom(fresh if k == pinned else known, rule.body[k], k)
            shared = [_v(v) for v in rule.body[k].variables() if v in bound]
            joined = own if joined is None else joined.join(own, shared) if shared else joined.crossJoin(own)
            bound |= set(rule.body[k].variables())
        n = len(rule.body)
        head = [F.col(_v(t)) if t.startswith("?") else F.lit(t) for t in rule.head.terms()]
        order = [F.lit(0), F.lit(number), F.lit(pinned), *[F.col(f"ord{k}") for k in range(n)]]
        weights = [F.col(f"w{k}") for k in range(n)]
        score = (F.least(*weights) if n > 1 else weights[0]) * rule.score
        out.append(joined.select(head[0].alias("s"), head[1].alias("p"), head[2].alias("o"), score.alias("score"), F.lit(rule.name).alias("rule"), F.array_distinct(F.array(*[F.col(f"k{k}") for k in range(n)])).alias("premises"), F.array(*[x.cast("long") for x in order]).alias("by")))
    return out


@dataclass
class Engine:
    rules: list[Rule] = field(default_factory=list)
    classes: DataFrame | None = None  # (child, anc, dist): ancestors of classes, nearest first
    properties: DataFrame | None = None  # the same of properties
    type_predicate: str = "type"
    depth: int = DEPTH

    def _entailed(self, fresh: DataFrame) -> list[DataFrame]:
        out = []
        weight = F.when(F.col("score") == 0, F.lit(1.0)).otherwise(F.col("score"))
        premise = F.array(key(F.col("s"), F.col("p"), F.col("o")))
        for number, (table, column, name) in enumerate(((self.classes, "o", "subclass"), (self.properties, "p", "subproperty"))):
            if table is None:
                continue
            rows = fresh.where(F.col("p") == self.type_predicate) if name == "subclass" else fresh
            rows = rows.join(table, rows[column] == table["child"])
            spo = {c: F.col("anc") if c == column else F.col(c) for c in "spo"}
            out.append(rows.select(*[spo[c].alias(c) for c in "spo"], weight.alias("score"), F.lit(name).alias("rule"), premise.alias("premises"), F.array(*[x.cast("long") for x in (F.lit(1), F.col("ord"), F.lit(number), F.col("dist"))]).alias("by")))
        return out

    def run(self, facts: DataFrame) -> DataFrame:
        """The closure of facts (s, p, o, score, ord). Raises DepthError with the partial model when the bound is met."""
        for r in self.rules:
            r.check()
        first = Window.partitionBy("s", "p", "o").orderBy("ord")
        given = facts.where("trim(s) <> '' and trim(p) <> '' and trim(o) <> ''").withColumn("_k", F.row_number().over(first)).where("_k = 1")
        fresh = settle(given.select("s", "p", "o", "score", F.lit("").alias("rule"), F.array().cast("array<string>").alias("premises"), F.lit(0).alias("depth"), F.col("ord").cast("long")))
        parts, base = [fresh], fresh.agg(F.max("ord")).first()[0] or 0
        for depth in range(1, self.depth + 2):
            if len(parts) > PARTS:  # many small tables are read slower than one
                parts = [settle(reduce(DataFrame.union, parts))]
            model = reduce(DataFrame.union, parts)
            derived = [d for n, r in enumerate(self.rules) for d in _fire(r, n, model, fresh)] + self._entailed(fresh)
            if not derived:
                return model
            best = reduce(DataFrame.union, derived).where("s <> '' and p <> '' and o <> ''").groupBy("s", "p", "o").agg(F.min_by(F.struct("score", "rule", "premises", "by"), "by").alias("b"))
            new = best.join(model.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select("s", "p", "o", "b.*")
            # ordinals within a round are ranks of the derivation's key; the text keys part what is left equal
            ranked, many = _ranked(new, base)
            if not many:
                return model
            if depth > self.depth:
                raise DepthError(model)
            fresh = settle(ranked.select("s", "p", "o", "score", "rule", "premises", F.lit(depth).alias("depth"), "ord"))
            parts.append(fresh)
            base += many
        return reduce(DataFrame.union, parts)


def _ranked(new: DataFrame, base: int) -> tuple[DataFrame, int]:
    """Rows with ord after base in the order of by, s, p, o, by ranges of that order, and how many there are."""
    keys = ["by", "s", "p", "o"]
    ranged = settle(new.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in ranged.groupBy("_part").count().collect())  # a row a partition
    if not counts:
        return ranged, 0
    sums, total = [], 0
    for part, n in counts:
        sums.append((part, total))
        total += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    before = new.sparkSession.createDataFrame(sums, "_part int, _base long")
    return ranged.join(F.broadcast(before), "_part").withColumn("ord", (F.col("_base") + own + base).cast("long")).drop("_part", "_base"), total


def ancestors(tree: DataFrame, limit: int = 64) -> DataFrame:
    """(child, anc, dist) of a hierarchy (child, parent), nearest first; a cycle adds no node to its own ancestors."""
    tree = settle(tree.where("child <> parent").distinct())
    now = settle(tree.select("child", F.col("parent").alias("anc"), F.lit(1).alias("dist")))
    for d in range(2, limit + 1):
        step = now.where(F.col("dist") == d - 1).join(tree.select(F.col("child").alias("anc"), "parent"), "anc").select("child", F.col("parent").alias("anc"), F.lit(d).alias("dist"))
        new = settle(step.where("child <> anc").distinct().join(now.select("child", "anc"), ["child", "anc"], "left_anti"))
        if not new.limit(1).count():
            break
        now = settle(now.union(new.select("child", "anc", "dist")))
    return now


def why(model: DataFrame, s: str, p: str, o: str, limit: int = 64) -> DataFrame:
    """The facts that a fact rests on and itself, premises before what follows from them."""
    keyed = settle(model.withColumn("key", key(F.col("s"), F.col("p"), F.col("o"))))
    seen = settle(keyed.where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)))
    if not seen.count():
        raise KeyError((s, p, o))
    front = seen
    for _ in range(limit):
        need = front.select(F.explode("premises").alias("key")).distinct().join(seen.select("key"), "key", "left_anti")
        front = settle(keyed.join(need, "key").select(keyed.columns))
        if not front.limit(1).count():
            break
        seen = settle(seen.union(front))
    return seen.orderBy("depth", "ord")


def provenance(model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Derived facts as PROV entities (id, activity), and rules' uses as activities (activity, rule, used)."""
    derived = model.where("rule <> ''").withColumn("id", key(F.col("s"), F.col("p"), F.col("o")))
    activity = F.concat(F.lit("derive:"), F.col("rule"), F.lit(":"), F.col("ord"))
    return derived.select("id", activity.alias("activity")), derived.select(activity.alias("activity"), "rule", F.explode("premises").alias("used"))
