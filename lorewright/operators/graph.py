"""The knowledge graph: assertions folded into nodes and edges, walks over it, and its measures.

Assertions are rows (ord, s, p, o, score, doc). Nodes are (id, name, type, ord), edges (src, dst, label, label_key, score, cnt,
docs, ord). Every "first wins" is min_by over ord. Measures read the graph as undirected, without repeats and self-links, except
`rank`. Loops settle each round in the shared folder; nothing is collected but counters and, where a function says so, a
graph whose size it has checked.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import edge_key, fold
from ..plans.iterate import components, settle

TYPES = ("type", "is_a", "instance_of", "rdf:type", "a")
SMALL = 50_000  # edges that a single task may hold for sequential measures


def nodes(triples: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(id, name, type, ord): each end of an assertion once, under its folded name; the first type asserted wins."""
    whole = _whole(triples)
    typing = fold(F.col("p")).isin(*types)
    ends = whole.select(F.col("s").alias("name"), (F.col("ord") * 2).alias("at")).union(whole.where(~typing).select("o", F.col("ord") * 2 + 1))
    kinds = whole.where(typing).groupBy(fold(F.col("s")).alias("id")).agg(F.min_by("o", "ord").alias("type"))
    own = ends.groupBy(fold(F.col("name")).alias("id")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("ord"))
    return own.join(kinds, "id", "left").select("id", "name", "type", "ord")


def put(node: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (id, name, type, ord, props MAP<STRING,STRING>) after new (ord, id, props): unknown ids are added, after those there are; a property that stands keeps its first value. Ids that fold to nothing are refused."""
    if "props" not in node.columns:
        node = node.withColumn("props", F.create_map().cast("map<string,string>"))
    told = new.where(fold(F.col("id")) != "").select(fold(F.col("id")).alias("id"), F.col("id").alias("name"), "ord", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))
    each = node.select("id", F.lit(-1).cast("long").alias("ord"), F.explode("props").alias("k", "v")).union(told.select("id", "ord", F.explode("props").alias("k", "v")))
    props = each.groupBy("id", "k").agg(F.min_by("v", "ord").alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("p"))
    last = node.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"))
    fresh = told.groupBy("id").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("at")).join(node.select("id"), "id", "left_anti").crossJoin(F.broadcast(last))  # one row
    every = node.select("id", "name", "type", "ord").union(fresh.select("id", "name", F.lit(None).cast("string"), F.col("last") + 1 + F.col("at")))
    return every.join(props, "id", "left").select("id", "name", "type", "ord", F.coalesce("p", F.create_map().cast("map<string,string>")).alias("props"))


def _whole(triples: DataFrame) -> DataFrame:
    return triples.where(" and ".join(f"trim({c}) <> ''" for c in "spo"))


def edges(triples: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Assertions that agree after folding are one edge: counted, with the largest score and the documents in order of sight."""
    rows = _whole(triples).where(~fold(F.col("p")).isin(*types))
    key = [fold(F.col("s")).alias("src"), fold(F.col("p")).alias("label_key"), fold(F.col("o")).alias("dst")]
    seen = F.transform(F.array_sort(F.collect_set(F.when(F.col("doc") != "", F.struct("first", "doc")))), lambda x: x["doc"])
    by_doc = rows.groupBy(*key, "doc").agg(F.count("*").alias("n"), F.max("score").alias("score"), F.min("ord").alias("first"), F.min_by("p", "ord").alias("label"))
    return by_doc.groupBy("src", "label_key", "dst").agg(F.min_by("label", "first").alias("label"), F.max("score").alias("score"), F.sum("n").alias("cnt"), seen.alias("docs"), F.min("first").alias("ord"))


def with_ids(edge: DataFrame) -> DataFrame:
    return edge.withColumn("id", edge_key("src", "label_key", "dst"))


def neighbours(edge: DataFrame) -> DataFrame:
    """(u, v): both directions of every link between different nodes, once."""
    pairs = edge.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return pairs.union(pairs.select("v", "u")).distinct()


def sub(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (id)."""
    return edge.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def merge(node: DataFrame, edge: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folds nodes into others by into (id, target): edges are keyed anew, counts added, documents united, aliases recorded."""
    to = lambda c: F.coalesce("target", c)
    moved = edge.join(into.withColumnRenamed("id", "src"), "src", "left").withColumn("src", to("src")).drop("target")
    moved = moved.join(into.withColumnRenamed("id", "dst"), "dst", "left").withColumn("dst", to("dst")).drop("target")
    docs = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "docs"))), lambda x: x["docs"])))
    folded = moved.groupBy("src", "label_key", "dst").agg(F.min_by("label", "ord").alias("label"), F.max("score").alias("score"), F.sum("cnt").alias("cnt"), docs.alias("docs"), F.min("ord").alias("ord"))
    alias = node.join(into, "id").groupBy(F.col("target").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("alias"))
    kept = node.join(into.select("id"), "id", "left_anti").join(alias, "id", "left").withColumn("alias", F.coalesce("alias", F.array().cast("array<string>")))
    return kept, folded


def levels(spark: SparkSession, links: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within hops of the starts (id) over links (u, v)."""
    links = settle(links)
    seen = settle(starts.select("id", F.lit(0).alias("hop")).distinct())
    for k in range(1, hops + 1):
        front = seen.where(F.col("hop") == k - 1)
        new = links.join(front, links["u"] == front["id"], "left_semi").select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti")
        new = settle(new.select("id", F.lit(k).alias("hop")))
        if not new.limit(1).count():
            break
        seen = settle(seen.union(new))
    return seen


def near(spark: SparkSession, edge: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    return levels(spark, neighbours(edge), starts, hops)


def walk(spark: SparkSession, edge: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Edges within hops of the starts, each once with the hop that first reaches it."""
    seen = near(spark, edge, starts, hops - 1)
    ends = edge.join(seen.select(F.col("id").alias("src"), F.col("hop").alias("a")), "src", "left").join(seen.select(F.col("id").alias("dst"), F.col("hop").alias("b")), "dst", "left")
    return ends.where("a is not null or b is not null").withColumn("hop", F.least("a", "b") + 1).drop("a", "b")


def path(spark: SparkSession, links: DataFrame, start: str, end: str, limit: int = 32) -> DataFrame:
    """(step, id) of one shortest path over links (u, v), the smallest predecessor at each step; no rows without one."""
    links, seen, found = settle(links), settle(spark.createDataFrame([(start, 0, None)], "id string, hop int, back string")), start == end
    for k in range(1, limit + 1):
        if found:
            break
        front = seen.where(F.col("hop") == k - 1).select(F.col("id").alias("u"))
        new = links.join(front, "u").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("back")).join(seen, "id", "left_anti")
        new = settle(new.select("id", F.lit(k).alias("hop"), "back"))
        if not new.limit(1).count():
            break
        seen = settle(seen.union(new))
        found = new.where(F.col("id") == end).limit(1).count() > 0
    steps, at = [], end
    while found:
        row = seen.where(F.col("id") == at).first()
        steps.append((row["hop"], at))
        if row["back"] is None:
            break
        at = row["back"]
    return spark.createDataFrame(steps, "step int, id string")


def degree(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, score): distinct neighbours over n - 1."""
    n = node.agg(F.count("*").alias("n"))
    many = neighbours(edge).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    return node.select("id").join(many, "id", "left").crossJoin(F.broadcast(n)).select("id", F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("score"))


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n highest, equal scores by id; all for n of zero or less."""
    ranked = scores.orderBy(F.desc("score"), "id")
    return ranked.limit(n) if n > 0 else ranked


def parts(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, part): connected components under their smallest id; a lone node is one."""
    found = components(edge.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return node.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("part"))


def rank(node: DataFrame, edge: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """PageRank over directed pairs once each, self-edges kept; what dangling nodes hold goes to all. Sums to 1.

    A large graph's ranks are the shares of what one unit a node adds up to as it flows along the links, damped at each; what dangling nodes
    hold goes to all alike, so it changes no share. Rounds end when nothing flows, in a graph without cycles after its longest path.
    """
    if edge.limit(SMALL + 1).count() <= SMALL:
        return _alone(node, edge, lambda ids, adj, own: _rank_here(ids, own, damping, rounds, tolerance), "id string, score double", SMALL)
    links = edge.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("d"))
    links = settle(links.join(out, "src").select("src", "dst", "d"))
    flow = settle(node.select("id", F.lit(1.0).alias("x")))
    done, total, left = [flow], float(flow.count()), 0.0
    for _ in range(rounds):
        flow = settle(links.join(flow.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(damping * F.col("x") / F.col("d")).alias("x")))
        left = flow.agg(F.sum("x")).first()[0] or 0.0
        total += left
        if not left:
            break
        done.append(flow)
        if left < tolerance * total:
            break
        if len(done) == 8:
            done = [settle(reduce(DataFrame.union, done).groupBy("id").agg(F.sum("x").alias("x")))]
    if left and damping < 1:  # what still flows goes on as it is dealt now, as in a power iteration's last round
        rest = damping / (1 - damping)
        done.append(flow.select("id", (F.col("x") * rest).alias("x")))
        total += left * rest
    return reduce(DataFrame.union, done).groupBy("id").agg((F.sum("x") / total).alias("score"))


def eigen(node: DataFrame, edge: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Eigenvector centrality by power iteration on A + I, the largest entry scaled to 1.

    Nodes with the same neighbours have the same entry in every round, so a large graph is iterated as kinds of such nodes, by 128-bit
    hashes of their neighbours: in one place if that is small, else as joins.
    """
    if edge.limit(SMALL + 1).count() <= SMALL:
        return _alone(node, edge, lambda ids, adj, own: _eigen_here(ids, adj, rounds, tolerance), "id string, score double", SMALL)
    links = settle(neighbours(edge))
    n = node.count()
    if not n:
        return node.select("id", F.lit(0.0).alias("score"))
    sign = links.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"), F.expr("bit_xor(xxhash64(v))").alias("x"), F.expr("bit_xor(xxhash64(v, 1))").alias("y"))
    own = settle(node.select("id").join(sign, "id", "left").select("id", F.coalesce(F.concat_ws("/", "d", F.hex("x"), F.hex("y")), F.lit("")).alias("kind")))
    kinds = settle(own.groupBy("kind").agg(F.count("*").alias("many"), F.min("id").alias("one")))
    part = links.join(kinds.select(F.col("one").alias("u"), F.col("kind").alias("to")), "u").select(F.col("v").alias("id"), "to")
    part = settle(part.join(own, "id").groupBy("to", "kind").agg(F.count("*").alias("k")))
    if part.limit(2 * SMALL + 1).count() <= 2 * SMALL and kinds.limit(2 * SMALL + 1).count() <= 2 * SMALL:
        rows = kinds.select("kind", "many").collect()
        at = {r["kind"]: i for i, r in enumerate(rows)}
        many = np.array([r["many"] for r in rows], float)
        cells = [(at[r["to"]], at[r["kind"]], r["k"]) for r in part.collect()]
        u, v, k = (np.array([c[i] for c in cells], int) for i in range(3))
        now = np.full(len(rows), 1.0 / n**0.5)
        for _ in range(rounds):
            new = now + np.bincount(u, k * now[v], len(rows))
            new /= np.sqrt((many * new**2).sum())
            moved, now = np.sqrt((many * (new - now) ** 2).sum()), new
            if moved < tolerance:
                break
        scores = node.sparkSession.createDataFrame([(r["kind"], float(x)) for r, x in zip(rows, now / now.max())], "kind string, score double")
        return own.join(scores, "kind").select("id", "score")
    now = kinds.select("kind", "many", F.lit(1.0 / n**0.5).alias("score"))
    for _ in range(rounds):
        came = part.join(now.select("kind", "score"), "kind").groupBy(F.col("to").alias("kind")).agg(F.sum(F.col("k") * F.col("score")).alias("in"))
        new = settle(now.join(came, "kind", "left").select("kind", "many", F.col("score").alias("was"), (F.col("score") + F.coalesce("in", F.lit(0.0))).alias("x")))
        size = new.agg(F.sqrt(F.sum(F.col("many") * F.col("x") ** 2))).first()[0]
        moved = new.agg(F.sqrt(F.sum(F.col("many") * (F.col("x") / size - F.col("was")) ** 2))).first()[0]
        now = new.select("kind", "many", (F.col("x") / size).alias("score"))
        if moved < tolerance:
            break
    most = now.agg(F.max("score")).first()[0]
    return own.join(now.select("kind", (F.col("score") / most).alias("score")), "kind").select("id", "score")


def _rank_here(ids: list[str], own: pd.DataFrame, damping: float, rounds: int, tolerance: float) -> pd.DataFrame:
    """rank of a graph that one task holds."""
    n, pairs = len(ids), own[["a", "b"]].drop_duplicates().to_numpy(int).reshape(-1, 2)
    out, now = np.bincount(pairs[:, 0], minlength=n), np.full(n, 1.0 / max(n, 1))
    for _ in range(rounds if n else 0):
        came = np.bincount(pairs[:, 1], now[pairs[:, 0]] / out[pairs[:, 0]], n)
        new = (1 - damping) / n + damping * (came + now[out == 0].sum() / n)
        moved, now = np.abs(new - now).sum(), new
        if moved < tolerance:
            break
    return pd.DataFrame({"id": ids, "score": now})


def _eigen_here(ids: list[str], adj: list[list[int]], rounds: int, tolerance: float) -> pd.DataFrame:
    """eigen of a graph that one task holds."""
    n = len(ids)
    u, v = np.repeat(np.arange(n), [len(a) for a in adj]), np.array([w for a in adj for w in a], int)
    now = np.full(n, 1.0 / max(n, 1) ** 0.5)
    for _ in range(rounds if n else 0):
        new = now + np.bincount(u, now[v], n)
        new /= np.sqrt((new**2).sum())
        moved, now = np.sqrt(((new - now) ** 2).sum()), new
        if moved < tolerance:
            break
    return pd.DataFrame({"id": ids, "score": now / now.max() if n else now})


class TooLarge(ValueError):
    """A sequential measure was asked of a graph that one task should not hold."""


def _alone(node: DataFrame, edge: DataFrame, kernel: Callable[[list[str], list[list[int]], pd.DataFrame], pd.DataFrame], schema: str, limit: int) -> DataFrame:
    """kernel over the whole graph in one task, which is refused beyond limit edges."""
    if edge.limit(limit + 1).count() > limit:
        raise TooLarge(f"more than {limit} edges")
    rows = node.select("id", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("label_key"), "ord").union(edge.select("src", "dst", "label_key", "ord"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        ids = pdf[pdf.dst.isna()]["id"].tolist()
        at = {x: k for k, x in enumerate(ids)}
        own = pdf[pdf.dst.notna()].copy()
        own["a"], own["b"] = own["id"].map(at), own["dst"].map(at)
        adj: list[list[int]] = [[] for _ in ids]
        for a, b in zip(own.a, own.b):
            if a != b:
                if b not in adj[a]:
                    adj[a].append(b)
                if a not in adj[b]:
                    adj[b].append(a)
        return kernel(ids, adj, own)

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: run(pdf.drop(columns="one")), schema)


def peel(links: DataFrame, rounds: int = 64) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Pendant trees taken off links (u, v), leaf by leaf: what stays (id, size, down, sq), what went in each round (the same and up), and the core's links.

    size counts the nodes of the tree that hangs on a node, itself too, down sums their distances to it, and sq the squares of the
    sizes of its branches. A path of two leaves keeps its smaller end. Small cores with few leaves are left to one task.
    """
    links = settle(links)
    now = links.select(F.col("u").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("down"), F.lit(0).cast("decimal(38,0)").alias("sq"))
    now, gone = settle(now), []
    for k in range(rounds):
        leaf = settle(links.groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("v")).where("d = 1").select("u", "v"))
        off = leaf.join(leaf.select(F.col("u").alias("v"), F.col("v").alias("u"), F.lit(True).alias("both")), ["u", "v"], "left").where("both is null or u > v").select(F.col("u").alias("id"), F.col("v").alias("up"))
        off = settle(now.join(off, "id"))
        n = off.count()
        if not n:
            break
        more = off.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_size"), F.sum(F.col("down") + F.col("size")).alias("_down"), F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("decimal(38,0)").alias("_sq"))
        left = now.join(off.select("id"), "id", "left_anti").join(more, "id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        now = settle(left.select("id", (F.col("size") + zero("_size")).alias("size"), (F.col("down") + zero("_down")).alias("down"), (F.col("sq") + zero("_sq")).cast("decimal(38,0)").alias("sq")))
        links = settle(links.join(off.select(F.col("id").alias("u")), "u", "left_anti").join(off.select(F.col("id").alias("v")), "v", "left_anti"))
        gone.append(off)
        if k >= 4 and n < 100 and links.limit(2 * SMALL + 1).count() <= 2 * SMALL:
            break
    return now, gone, links


def _bridges_here(ids: list[str], adj: list[list[int]], own: pd.DataFrame) -> pd.DataFrame:
    """The bridges of a graph that one task holds, depth first."""
    order, low, found = [-1] * len(ids), [0] * len(ids), set()
    clock = 0
    for root in range(len(ids)):
        if order[root] >= 0:
            continue
        stack = [(root, -1, iter(adj[root]))]
        order[root] = low[root] = clock
        clock += 1
        while stack:
            v, up, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if up >= 0:
                    low[up] = min(low[up], low[v])
                    if low[v] > order[up]:
                        found.add((up, v))
            elif order[w] < 0:
                order[w] = low[w] = clock
                clock += 1
                stack.append((w, v, iter(adj[w])))
            elif w != up:
                low[v] = min(low[v], order[w])
    return pd.DataFrame([(ids[a], ids[b]) for a, b in found], columns=["u", "v"])


def _bridges_far(links: DataFrame) -> DataFrame:
    """(u, v) of each bridge among links of a graph that no task holds.

    A link of a breadth-first forest is a bridge if no other link spans it. Each other link has a 128-bit mark, a node the marks of its
    own exclusive-ored, and a subtree's marks add up to none if nothing leaves it; that a spanned link adds up to none too has odds of 2^-128.
    """
    spark = links.sparkSession
    seen = settle(components(links).where("node = root").select(F.col("node").alias("id"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("back")).distinct())
    forest, front, deep = [seen], seen, 0
    while True:
        new = links.join(front.select(F.col("id").alias("u")), "u").groupBy(F.col("v").alias("id")).agg(F.min("u").alias("back")).join(seen.select("id"), "id", "left_anti")
        front = settle(new.select("id", F.lit(deep + 1).alias("hop"), "back"))
        if not front.limit(1).count():
            break
        deep += 1
        forest.append(front)
        seen = settle(seen.union(front))
    tree = seen.where("back is not null").select(F.col("id").alias("u"), F.col("back").alias("v"))
    rest = links.join(tree.union(tree.select("v", "u")), ["u", "v"], "left_anti")
    mark = settle(rest.groupBy(F.col("u").alias("id")).agg(F.expr("bit_xor(xxhash64(least(u, v), greatest(u, v)))").alias("x"), F.expr("bit_xor(xxhash64(greatest(u, v), least(u, v), 1))").alias("y")))
    below, out = None, spark.createDataFrame([], "u string, v string")
    for k in range(deep, 0, -1):
        own = mark.join(forest[k].select("id"), "id", "left_semi")
        own = own if below is None else own.union(below)
        total = own.groupBy("id").agg(F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"))
        level = settle(forest[k].join(total, "id", "left").select("id", "back", F.coalesce("x", F.lit(0).cast("long")).alias("x"), F.coalesce("y", F.lit(0).cast("long")).alias("y")))
        out = out.union(level.where("x = 0 and y = 0").select("id", "back"))
        below = level.select(F.col("back").alias("id"), "x", "y")
    return out


def bridges(node: DataFrame, edge: DataFrame, limit: int | None = None) -> DataFrame:
    """(src, dst, label_key) of every edge on a link whose loss would part the graph.

    Links to pendant trees are bridges, and are taken off first; the rest goes to one task if that holds it, else by levels of a forest.
    A caller's own limit of edges is kept.
    """
    if limit is not None and edge.limit(limit + 1).count() > limit:
        raise TooLarge(f"more than {limit} edges")
    _, gone, core = peel(neighbours(edge))
    found = [g.select(F.col("id").alias("u"), F.col("up").alias("v")) for g in gone]
    if core.limit(2 * SMALL + 1).count() <= 2 * SMALL:
        rest = core.where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit("").alias("label_key"), F.lit(0).cast("long").alias("ord"))
        found.append(_alone(core.select(F.col("u").alias("id"), F.lit(0).cast("long").alias("ord")).distinct(), rest, _bridges_here, "u string, v string", SMALL))
    else:
        found.append(_bridges_far(core))
    pairs = reduce(DataFrame.union, found)
    pairs = pairs.union(pairs.select("v", "u")).select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return edge.join(pairs, ["src", "dst"], "left_semi").select("src", "dst", "label_key")


def groups(node: DataFrame, edge: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, community): one level of modularity moves, node by node in order of assertion.

    Each move depends on those before it, so one task makes them, on whole numbers alone: it holds some 40 bytes a node and eight a
    link, in flat arrays, while names are numbered and given back by joins. A caller's own limit of edges is kept.
    """
    if limit is not None and edge.limit(limit + 1).count() > limit:
        raise TooLarge(f"more than {limit} edges")
    ids = settle(numbered(node.select("id", "ord"), "ord", "id"))
    n = ids.count()
    pairs = edge.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("ord").alias("at"))
    pairs = pairs.join(ids.select(F.col("id").alias("a"), F.col("ord").alias("u")), "a").join(ids.select(F.col("id").alias("b"), F.col("ord").alias("v")), "b").select("u", "v", "at")
    rows = pairs.union(pairs.select("v", "u", "at")).repartition(1).sortWithinPartitions("u", "at", "v").select("u", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adj, deg = array("q"), np.zeros(n, np.int64)
        for pdf in batches:
            adj.frombytes(pdf.v.to_numpy(np.int64).tobytes())
            deg += np.bincount(pdf.u.to_numpy(np.int64), minlength=n) if len(pdf) > n // 8 else 0
            if len(pdf) <= n // 8:
                np.add.at(deg, pdf.u.to_numpy(np.int64), 1)
        label = array("q", range(n))
        if len(adj):
            _moves(adj, array("q", deg.tobytes()), label)
        first: dict[int, int] = {}
        for k, c in enumerate(label):
            first.setdefault(c, k)
        for lo in range(0, n, 100_000):
            part = label[lo : lo + 100_000]
            yield pd.DataFrame({"k": np.arange(lo, lo + len(part)), "c": [first[c] for c in part]})

    found = settle(rows.mapInPandas(run, "k long, c long"))
    heads = ids.join(found.select(F.col("c").alias("ord")).distinct(), "ord").select(F.col("ord").alias("c"), F.col("id").alias("community"))
    return ids.select("id", F.col("ord").alias("k")).join(found, "k").join(heads, "c").select("id", "community")


def _moves(adj: array, deg: array, label: array) -> None:
    """Moves each node in turn to the neighbours' group that gains most, until none moves; label is changed in place."""
    total, m2, at, moved = array("q", deg), sum(deg), array("q", [0]), True
    for d in deg:
        at.append(at[-1] + d)
    while moved:
        moved = False
        for v in range(len(deg)):
            here, d = label[v], deg[v]
            total[here] -= d
            into: dict[int, int] = {}
            for w in adj[at[v] : at[v + 1]]:
                into[label[w]] = into.get(label[w], 0) + 1
            best, gain = here, into.get(here, 0) - total[here] * d / m2
            for c, k in into.items():
                if k - total[c] * d / m2 > gain + 1e-12:
                    best, gain = c, k - total[c] * d / m2
            total[best] += d
            moved |= best != here
            label[v] = best


def modularity(edge: DataFrame, community: DataFrame) -> DataFrame:
    """(modularity) of a partition (id, community): the sum over groups of in/2m - (tot/2m)^2."""
    c = community.select(F.col("id").alias("u"), F.col("community").alias("cu"))
    d = community.select(F.col("id").alias("v"), F.col("community").alias("cv"))
    links = neighbours(edge).join(c, "u").join(d, "v")
    own = links.groupBy("cu").agg(F.count("*").alias("tot"), F.sum((F.col("cu") == F.col("cv")).cast("long")).alias("in"))
    all_ = links.agg(F.count("*").alias("m2"))
    return own.crossJoin(F.broadcast(all_)).agg(F.round(F.sum(F.col("in") / F.col("m2") - (F.col("tot") / F.col("m2")) ** 2), 6).alias("modularity"))


def _sources(now: DataFrame, links: DataFrame, kernel: Callable[[int, list[np.ndarray], np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """(id, x ARRAY): a measure that walks from every node of a core now (id, size, down): the checked graph is sent to all tasks, and the sources are dealt out.

    A kernel gives width numbers of its source, or for a width of 0 a number of every node, which are added up.
    """
    spark = now.sparkSession
    rows = now.join(links.select(F.col("u").alias("id")).distinct(), "id", "left_semi").orderBy("id").limit(2 * SMALL + 1).collect()
    ids = [r["id"] for r in rows]
    at = {x: k for k, x in enumerate(ids)}
    adj: list[list[int]] = [[] for _ in ids]
    for u, v in links.orderBy("u", "v").collect():
        adj[at[u]].append(at[v])
    sent = spark.sparkContext.broadcast(([np.array(a, int) for a in adj], np.array([r["size"] for r in rows], float), np.array([r["down"] for r in rows], float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if width:
                yield pd.DataFrame({"k": pdf.id, "x": [kernel(int(k), *sent.value).tolist() for k in pdf.id]})
            elif len(pdf):
                total = sum((kernel(int(k), *sent.value) for k in pdf.id), np.zeros(len(sent.value[0])))
                yield pd.DataFrame({"k": np.arange(len(total)), "x": [[t] for t in total]})

    found = spark.range(len(ids)).repartition(max(1, min(len(ids), 64))).mapInPandas(run, "k long, x array<double>")
    if not width:
        found = found.groupBy("k").agg(F.array(F.sum(F.col("x")[0])).alias("x"))
    return found.join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), "k long, id string")), "k").select("id", "x")


def _blocks(now: DataFrame, links: DataFrame, pairs: int) -> Iterator[tuple[list[DataFrame], DataFrame]]:
    """Walks of a graph that no task holds, a block of sources at a time, so that some pairs rows are stored at once: its levels (s, id, hop, sigma), sigma counting shortest paths."""
    ends = settle(links.select(F.col("u").alias("id")).distinct())
    n = ends.count()
    many = max(1, -(-n * n // pairs))
    for b in range(many):
        front = settle(ends.where(F.pmod(F.xxhash64("id"), F.lit(many)) == b).select(F.col("id").alias("s"), "id", F.lit(0).alias("hop"), F.lit(1.0).alias("sigma")))
        seen, levels_ = front, [front]
        while True:
            new = links.join(front.select("s", F.col("id").alias("u"), "sigma"), "u").groupBy("s", F.col("v").alias("id")).agg(F.sum("sigma").alias("sigma"))
            new = new.join(seen.select("s", "id"), ["s", "id"], "left_anti")
            front = settle(new.select("s", "id", F.lit(len(levels_)).alias("hop"), "sigma"))
            if not front.limit(1).count():
                break
            levels_.append(front)
            seen = reduce(DataFrame.union, levels_)
        yield levels_, seen


PAIRS = 50_000_000  # pairs of nodes of a large core stored at once


def _bfs(start: int, adj: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    dist = np.full(len(adj), -1)
    dist[start], order, k = 0, [start], 0
    while k < len(order):
        v = order[k]
        for w in adj[v].tolist():
            if dist[w] < 0:
                dist[w] = dist[v] + 1
                order.append(w)
        k += 1
    return order, dist


def _distances(now: DataFrame, links: DataFrame) -> DataFrame:
    """(id, n, total) of the core's nodes: how many nodes are in the component, pendant ones too, and the sum of their distances."""

    def kernel(s: int, adj: list[np.ndarray], size: np.ndarray, down: np.ndarray) -> np.ndarray:
        order, dist = _bfs(s, adj)
        return np.array([size[order].sum(), (size[order] * dist[order] + down[order]).sum()])

    if links.limit(2 * SMALL + 1).count() <= 2 * SMALL:
        found = _sources(now, links, kernel, 2).select("id", F.col("x")[0].cast("long").alias("n"), F.col("x")[1].cast("long").alias("total"))
    else:
        weigh = lambda seen: settle(seen.join(now, "id").groupBy(F.col("s").alias("id")).agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("hop") + F.col("down")).alias("total")))
        found = reduce(DataFrame.union, [weigh(seen) for _, seen in _blocks(now, links, PAIRS)])
    alone = now.join(links.select(F.col("u").alias("id")).distinct(), "id", "left_anti")
    return found.union(alone.select("id", F.col("size").alias("n"), F.col("down").alias("total")))


def _outward(found: DataFrame, gone: list[DataFrame]) -> DataFrame:
    """(id, n, total) of the pendant nodes too: one step off the core brings the nodes below nearer and takes all others away."""
    known = settle(found)
    for off in reversed(gone):
        new = off.join(known.select(F.col("id").alias("up"), "n", "total"), "up")
        known = settle(known.union(new.select("id", "n", (F.col("total") + F.col("n") - 2 * F.col("size")).alias("total"))))
    return known


def close(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, score): nodes reached over the sum of their distances, 0 where nothing is.

    Pendant trees are summed up by joins; only the core that is left is walked from every node, in tasks that hold it or, beyond that, by joins.
    """
    now, gone, core = peel(neighbours(edge))
    found = _outward(_distances(now, core), gone)
    return node.select("id").join(found, "id", "left").select("id", F.when(F.col("total") > 0, (F.col("n") - 1) / F.col("total")).otherwise(F.lit(0.0)).alias("score"))


def _dependencies(now: DataFrame, links: DataFrame) -> DataFrame:
    """(id, x): pairs of other core nodes, by the sizes of what hangs on them, times the share of their shortest paths through a node."""

    def kernel(s: int, adj: list[np.ndarray], size: np.ndarray, down: np.ndarray) -> np.ndarray:
        order, dist = _bfs(s, adj)
        sigma, delta = np.zeros(len(adj)), np.zeros(len(adj))
        sigma[s] = 1
        for v in order:
            for w in adj[v].tolist():
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        for v in reversed(order):
            for w in adj[v].tolist():
                if dist[w] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (size[w] + delta[w])
        delta[s] = 0
        return delta * size[s]

    if links.limit(2 * SMALL + 1).count() <= 2 * SMALL:
        return _sources(now, links, kernel, 0).select("id", F.col("x")[0].alias("x"))
    size, out = now.select("id", F.col("size").cast("double").alias("size")), []
    for levels_, _ in _blocks(now, links, PAIRS):
        block, delta = [], None
        for k in range(len(levels_) - 1, 0, -1):
            own = levels_[k].join(size, "id")
            own = own.withColumn("delta", F.lit(0.0)) if delta is None else own.join(delta, ["s", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
            own = settle(own)
            block.append(own.select("s", "id", "delta"))
            back = own.join(links.select(F.col("u").alias("id"), F.col("v").alias("w")), "id").select("s", F.col("w").alias("id"), ((F.col("size") + F.col("delta")) / F.col("sigma")).alias("part"))
            delta = settle(back.join(levels_[k - 1], ["s", "id"]).groupBy("s", "id").agg(F.sum(F.col("sigma") * F.col("part")).alias("delta")))
        if block:
            weighed = reduce(DataFrame.union, block).join(size.select(F.col("id").alias("s"), F.col("size").alias("times")), "s")
            out.append(settle(weighed.groupBy("id").agg(F.sum(F.col("times") * F.col("delta")).alias("x"))))
    return reduce(DataFrame.union, out).groupBy("id").agg(F.sum("x").alias("x"))


def between(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, score): shortest paths through a node, over (n - 1)(n - 2).

    Every path between two branches of pendant trees at a node passes it, so those are counted from the branches' sizes; only the core
    that is left is walked from every node.
    """
    now, gone, core = peel(neighbours(edge))
    part = components(core)
    size = now.join(part.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), "size")
    there = settle(size.join(size.groupBy("root").agg(F.sum("size").alias("n")), "root").select("id", "n"))
    known = there
    for off in reversed(gone):
        known = settle(known.union(off.join(known.select(F.col("id").alias("up"), "n"), "up").select("id", "n")))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    leaf = reduce(DataFrame.union, [g.select("id", "size", "sq") for g in gone]) if gone else now.where("false").select("id", "size", "sq")
    rest = whole("n") - whole("size")
    hung = leaf.join(known, "id").select("id", ((whole("n") - 1) * (whole("n") - 1) - F.col("sq") - rest * rest).cast("double").alias("x"))
    own = now.join(there, "id").join(_dependencies(now, core), "id", "left")
    held = own.select("id", ((((whole("size") - 1) * (whole("size") - 1) - F.col("sq")) + 2 * (whole("size") - 1) * rest).cast("double") + F.coalesce("x", F.lit(0.0))).alias("x"))
    n = node.count()
    return node.select("id").join(hung.union(held), "id", "left").select("id", (F.coalesce("x", F.lit(0.0)) / max((n - 1) * (n - 2), 1)).alias("score"))


def stat(node: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: nodes, edges, links, density, degrees, components, and what shape that is."""
    d = node.select("id").join(neighbours(edge).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d")), "id", "left").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("d", F.lit(0))).alias("twice"), F.min(F.coalesce("d", F.lit(0))).alias("deg_min"), F.max(F.coalesce("d", F.lit(0))).alias("deg_max"))
    p = parts(node, edge).groupBy("part").count().agg(F.count("*").alias("parts"), F.max("count").alias("biggest"))
    one = d.crossJoin(edge.agg(F.count("*").alias("edges"))).crossJoin(p)
    density = F.when(F.col("nodes") > 1, F.col("twice") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0))
    shape = F.when(F.col("parts") > 1, "disconnected").when(density > 0.5, "dense").when(density < 0.1, "sparse").otherwise("moderate")
    return one.select("nodes", "edges", (F.col("twice") / 2).cast("long").alias("links"), F.round(density, 6).alias("density"), "deg_min", "deg_max", F.round(F.col("twice") / F.col("nodes"), 6).alias("deg_avg"), "parts", "biggest", shape.alias("shape"))


def numbered(df: DataFrame, *key: Column | str) -> DataFrame:
    """ord from a total order on natural keys, dealt by ranges so that no single task sorts all rows."""
    keys = [F.col(k) if isinstance(k, str) else k for k in key]
    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    ranged = settle(ranged)
    counts = ranged.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.join(F.broadcast(before), "_part").withColumn("ord", (F.col("_base") + own - 1).cast("long")).drop("_part", "_base")
