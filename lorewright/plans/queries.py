"""Registered queries of the graph engine and the SQL they are checked against.

Triples of the supply graph: customer -in_nation-> nation, nation -in_region-> region, supplier -in_nation-> nation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import split as S
from ..functions import text as T
from ..functions import values as V
from ..operators import agent, extract, graph, ontology, reason, resolve, retrieval, store
from ..sources import export
from ..streaming import memory

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- the graph

_TRIPLES = """
SELECT c_custkey * 4 AS ord, c_name AS s, 'in_nation' AS p, n_name AS o, 0.9 AS score, 'customer' AS doc FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey * 4 + 1, n_name, 'in_region', r_name, 0.8, 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_suppkey * 4 + 2, s_name, 'in_nation', n_name, 0.7, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
_EDGE = f"WITH t AS ({_TRIPLES}), e AS (SELECT lower(s) AS src, lower(p) AS label_key, lower(o) AS dst, count(*) AS cnt, max(score) AS score FROM t GROUP BY 1, 2, 3), l AS (SELECT DISTINCT src AS u, dst AS v FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), n AS (SELECT DISTINCT u AS id FROM l)"
# without customers: the core, for the SQL of graph_bridges and graph_modularity only
_CORE = _EDGE.replace("FROM customer JOIN nation ON c_nationkey = n_nationkey", "FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE false")


def _triples(spark: SparkSession, d: str, core: bool = False) -> DataFrame:
    nation, region = _t(spark, d, "nation"), _t(spark, d, "region")
    row = lambda k, n, s, p, o, score, doc: (
        (F.col(k).cast("long") * 4 + n).alias("ord"), F.col(s).alias("s"), F.lit(p).alias("p"), F.col(o).alias("o"), F.lit(score).alias("score"), F.lit(doc).alias("doc")
    )
    out = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*row("n_nationkey", 1, "n_name", "in_region", "r_name", 0.8, "nation"))
    out = out.union(_t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(*row("s_suppkey", 2, "s_name", "in_nation", "n_name", 0.7, "supplier")))
    if not core:
        out = out.union(_t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*row("c_custkey", 0, "c_name", "in_nation", "n_name", 0.9, "customer")))
    return out


def _graph(spark: SparkSession, d: str, core: bool = False) -> tuple[DataFrame, DataFrame]:
    t = _triples(spark, d, core)
    return graph.nodes(t), graph.edges(t)


@query(f"{_EDGE} SELECT src, label_key, dst, cnt, score FROM e")
def graph_build(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_triples(spark, d)).select("src", "label_key", "dst", "cnt", "score")


@query(f"WITH t AS ({_TRIPLES}) SELECT lower(name) AS id, arg_min(name, pos) AS name, min(pos) AS ord FROM (SELECT s AS name, ord * 2 AS pos FROM t UNION ALL SELECT o, ord * 2 + 1 FROM t) GROUP BY 1")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_triples(spark, d)).select("id", "name", "ord")


@query(f"{_EDGE} SELECT u AS id, round(count(*) / ((SELECT count(*) FROM n) - 1), 9) AS score FROM l GROUP BY u")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(*_graph(spark, d)).select("id", F.round("score", 9).alias("score"))


@query(f"{_EDGE} SELECT u AS id, round(count(*) / ((SELECT count(*) FROM n) - 1), 9) AS score FROM l GROUP BY u ORDER BY count(*) DESC, id LIMIT 10")
def graph_top(spark: SparkSession, d: str) -> DataFrame:
    return graph.top(graph.degree(*_graph(spark, d)), 10).select("id", F.round("score", 9).alias("score"))


@query(f"{_EDGE} SELECT src, label_key, dst FROM e WHERE (src LIKE 'nation%' OR src LIKE 'supplier%') AND (dst LIKE 'nation%' OR dst LIKE 'supplier%')")
def graph_sub(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _graph(spark, d)
    return graph.sub(edge, node.where("id like 'nation%' or id like 'supplier%'")).select("src", "label_key", "dst")


@query(f"{_EDGE}, h1 AS (SELECT v AS id FROM l WHERE u = 'asia'), h2 AS (SELECT DISTINCT v AS id FROM l JOIN h1 ON u = h1.id) SELECT 'asia' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 WHERE id <> 'asia' AND id NOT IN (SELECT id FROM h1)")
def graph_near2(spark: SparkSession, d: str) -> DataFrame:
    return graph.near(spark, _graph(spark, d)[1], spark.createDataFrame([("asia",)], "id string"), 2)


@query(f"{_EDGE}, h1 AS (SELECT v AS id FROM l WHERE u = 'asia') SELECT src, label_key, dst, CASE WHEN src = 'asia' OR dst = 'asia' THEN 1 ELSE 2 END AS hop FROM e WHERE src = 'asia' OR dst = 'asia' OR src IN (SELECT id FROM h1) OR dst IN (SELECT id FROM h1)")
def graph_walk2(spark: SparkSession, d: str) -> DataFrame:
    return graph.walk(spark, _graph(spark, d)[1], spark.createDataFrame([("asia",)], "id string"), 2).select("src", "label_key", "dst", "hop")


@query("SELECT 0 AS step, 'supplier#000000000' AS id UNION ALL SELECT 1, lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 0 UNION ALL SELECT 2, lower(r_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = 0")
def graph_path(spark: SparkSession, d: str) -> DataFrame:
    goal = _t(spark, d, "supplier").where("s_suppkey = 0").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name")).first()[0]
    return graph.path(spark, graph.neighbours(_graph(spark, d)[1]), "supplier#000000000", goal)


@query(f"{_EDGE}, own AS (SELECT n.id, CASE WHEN n.id IN (SELECT lower(r_name) FROM region) THEN n.id ELSE coalesce((SELECT lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(n_name) = n.id), (SELECT min(lower(r_name)) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(c_name) = n.id), (SELECT min(lower(r_name)) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(s_name) = n.id)) END AS r FROM n) SELECT id, min(id) OVER (PARTITION BY r) AS part FROM own")
def graph_parts(spark: SparkSession, d: str) -> DataFrame:
    return graph.parts(*_graph(spark, d))


_TREE = f"""{_EDGE}, leaf AS (SELECT src AS id, dst AS nation FROM e WHERE label_key = 'in_nation'), k AS (SELECT src AS nation, dst AS region, (SELECT count(*) FROM leaf WHERE nation = e.src) AS k FROM e WHERE label_key = 'in_region'), g AS (SELECT region, count(*) AS m, sum(k) AS leaves, sum((k + 1) * (k + 1)) AS sq FROM k GROUP BY region), c AS (SELECT count(*) AS n FROM n)"""


@query(f"""{_TREE}, s AS (SELECT (SELECT count(*) FROM leaf) + (SELECT sum(1 + 0.85 * k) FROM k) + (SELECT sum(1 + 0.85 * (m + 0.85 * leaves)) FROM g) AS s)
SELECT id, round(1.0 / s, 8) AS score FROM leaf, s UNION ALL SELECT nation, round((1 + 0.85 * k) / s, 8) FROM k, s UNION ALL SELECT region, round((1 + 0.85 * (m + 0.85 * leaves)) / s, 8) FROM g, s""")
def graph_rank(spark: SparkSession, d: str) -> DataFrame:
    return graph.rank(*_graph(spark, d), rounds=400, tolerance=1e-13).select("id", F.round("score", 8).alias("score"))


@query()
def graph_eigen(spark: SparkSession, d: str) -> DataFrame:
    return graph.eigen(*_graph(spark, d)).select("id", F.round("score", 4).alias("score"))


@query(f"{_CORE}, d AS (SELECT u AS id, count(*) AS k FROM l GROUP BY u) SELECT e.src, e.dst, e.label_key FROM e")
def graph_bridges(spark: SparkSession, d: str) -> DataFrame:
    """The core is a forest, so every link is a bridge."""
    return graph.bridges(*_graph(spark, d, core=True))


@query(f"""{_TREE} SELECT leaf.id, round((leaves + m) / (1 + 2 + 2.0 * (k - 1) + 3 * (m - 1) + 4 * (leaves - k)), 8) AS score FROM leaf JOIN k USING (nation) JOIN g USING (region)
UNION ALL SELECT nation, round((leaves + m) / (k + 1 + 2.0 * (m - 1) + 3 * (leaves - k)), 8) FROM k JOIN g USING (region) UNION ALL SELECT region, round((leaves + m) / (m + 2.0 * leaves), 8) FROM g""")
def graph_close(spark: SparkSession, d: str) -> DataFrame:
    return graph.close(*_graph(spark, d)).select("id", F.round("score", 8).alias("score"))


@query(f"""{_TREE} SELECT id, 0.0::DOUBLE AS score FROM leaf UNION ALL SELECT nation, round(((leaves + m) * (leaves + m) - k - (leaves + m - k) * (leaves + m - k))::DOUBLE / ((n - 1) * (n - 2)), 8) FROM k JOIN g USING (region), c
UNION ALL SELECT region, round(((leaves + m) * (leaves + m) - sq)::DOUBLE / ((n - 1) * (n - 2)), 8) FROM g, c""")
def graph_between(spark: SparkSession, d: str) -> DataFrame:
    return graph.between(*_graph(spark, d)).select("id", F.round("score", 8).alias("score"))


@query()
def graph_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.groups(*_graph(spark, d))


@query(f"{_CORE}, c AS (SELECT id, CASE WHEN id LIKE 'nation%' THEN 'n' WHEN id LIKE 'supplier%' THEN 's' ELSE 'r' END AS g FROM n), x AS (SELECT a.g AS gu, b.g AS gv FROM l JOIN c a ON a.id = u JOIN c b ON b.id = v), m AS (SELECT count(*) AS m2 FROM x) SELECT round(sum(i / m2 - (t / m2) * (t / m2)), 6) AS modularity FROM (SELECT gu, count(*) AS t, sum(CASE WHEN gu = gv THEN 1 ELSE 0 END) AS i FROM x GROUP BY gu), m")
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _graph(spark, d, core=True)
    kind = F.when(F.col("id").like("nation%"), "n").when(F.col("id").like("supplier%"), "s").otherwise("r")
    return graph.modularity(edge, node.select("id", kind.alias("community")))


@query(f"{_EDGE}, d AS (SELECT u, count(*) AS k FROM l GROUP BY u) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT sum(k) // 2 FROM d)::BIGINT AS links, min(k) AS deg_min, max(k) AS deg_max, round(avg(k), 6) AS deg_avg FROM d")
def graph_stat(spark: SparkSession, d: str) -> DataFrame:
    return graph.stat(*_graph(spark, d)).select("nodes", "edges", "links", "deg_min", "deg_max", "deg_avg")


@query(f"{_EDGE} SELECT CASE WHEN src LIKE 'nation%' THEN 'nations' ELSE src END AS src, label_key, CASE WHEN dst LIKE 'nation%' THEN 'nations' ELSE dst END AS dst, sum(cnt)::BIGINT AS cnt FROM e GROUP BY 1, 2, 3")
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _graph(spark, d)
    return graph.merge(node, edge, node.where("id like 'nation%'").select("id", F.lit("nations").alias("target")))[1].select("src", "label_key", "dst", "cnt")


@query(f"{_EDGE} SELECT e.src, e.dst, e.label_key FROM e")
def graph_bridges_all(spark: SparkSession, d: str) -> DataFrame:
    """graph_bridges over the whole graph, customers too; it is a forest, so every link is a bridge."""
    return graph.bridges(*_graph(spark, d))


@query(f"{_EDGE}, c AS (SELECT id, CASE WHEN id LIKE 'nation%' THEN 'n' WHEN id LIKE 'supplier%' THEN 's' WHEN id LIKE 'customer%' THEN 'c' ELSE 'r' END AS g FROM n), x AS (SELECT a.g AS gu, b.g AS gv FROM l JOIN c a ON a.id = u JOIN c b ON b.id = v), m AS (SELECT count(*) AS m2 FROM x) SELECT round(sum(i / m2 - (t / m2) * (t / m2)), 6) AS modularity FROM (SELECT gu, count(*) AS t, sum(CASE WHEN gu = gv THEN 1 ELSE 0 END) AS i FROM x GROUP BY gu), m")
def graph_modularity_all(spark: SparkSession, d: str) -> DataFrame:
    """graph_modularity over the whole graph, customers as a group of their own."""
    node, edge = _graph(spark, d)
    kind = F.when(F.col("id").like("nation%"), "n").when(F.col("id").like("supplier%"), "s").when(F.col("id").like("customer%"), "c").otherwise("r")
    return graph.modularity(edge, node.select("id", kind.alias("community")))


@query(f"""{_EDGE} SELECT src, label_key, dst, lpad(lower(to_hex((list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(src || chr(1) || label_key || chr(1) || dst || chr(1), ''), lambda c: (CASE WHEN c = chr(1) THEN 0 ELSE ascii(c) END)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616))::UBIGINT)), 16, '0') AS id FROM e""")
def graph_edge_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_ids(_graph(spark, d)[1]).select("src", "label_key", "dst", "id")


# ---------------------------------------------------------------- patterns, filters, vectors


@query(f"SELECT s, p, o FROM ({_TRIPLES}) WHERE p = 'in_region' AND o = 'ASIA'")
def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    return store.match(_triples(spark, d), p="in_region", o="ASIA").select("s", "p", "o")


@query(f"SELECT s, p, o FROM ({_TRIPLES}) WHERE NOT (p = 'in_nation' AND o = 'NATION_3')")
def fact_retract(spark: SparkSession, d: str) -> DataFrame:
    return store.retract(_triples(spark, d), p="in_nation", o="NATION_3").select("s", "p", "o")


@query("SELECT lower(p_name) AS k, arg_min(p_name, p_partkey) AS s, max(p_retailprice) AS score FROM part GROUP BY 1, lower(p_brand), lower(p_type)")
def triple_unique(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "part").select(F.col("p_name").alias("s"), F.col("p_brand").alias("p"), F.col("p_type").alias("o"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("ord"))
    return resolve.unique(t).select(F.lower("s").alias("k"), "s", "score")


_FILTERS = {
    "filter_eq": ("event_type", "eq", "error", "event_type = 'error'"), "filter_ne": ("event_type", "ne", "error", "event_type <> 'error'"), "filter_gt": ("value", "gt", 50.0, "value > 50"),
    "filter_ge": ("value", "ge", 50.0, "value >= 50"), "filter_lt": ("k", "lt", 10, "k < 10"), "filter_le": ("k", "le", 10, "k <= 10"), "filter_in": ("event_type", "in", ["error", "click"], "event_type IN ('error', 'click')"),
    "filter_has": ("words", "has", "error", "event_type = 'error'"),
}


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "words": F.split("event_type", "_")})


def _filter(name: str, field: str, op: str, value: object, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return store.matching(_events(spark, d), (field, op, value)).select("event_id")

    run.__name__ = name
    query(f"SELECT event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE {where}")(run)


for _name, _args in _FILTERS.items():
    _filter(_name, *_args)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _first(spark: SparkSession, d: str) -> list[float]:
    return _t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


_V = "SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings"


@query(f"WITH e AS ({_V}) SELECT e.id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e q WHERE q.id = 0 ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.id LIMIT 10")
def vector_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return store.search(_vectors(spark, d), _first(spark, d), 10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH e AS ({_V}) SELECT e.id, round(list_inner_product(e.v, q.v), 6) AS score FROM e, e q WHERE q.id = 0 ORDER BY list_inner_product(e.v, q.v) DESC, e.id LIMIT 10")
def vector_inner_topk(spark: SparkSession, d: str) -> DataFrame:
    return store.search(_vectors(spark, d), _first(spark, d), 10, "dot").select("id", F.round("score", 6).alias("score"))


@query(f"WITH e AS ({_V}) SELECT e.id, round(-list_distance(e.v, q.v), 6) AS score FROM e, e q WHERE q.id = 0 ORDER BY list_distance(e.v, q.v), e.id LIMIT 10")
def vector_euclid_topk(spark: SparkSession, d: str) -> DataFrame:
    return store.search(_vectors(spark, d), _first(spark, d), 10, "euclid").select("id", (F.round("score", 6) + 0.0).alias("score"))


@query(f"WITH e AS ({_V}) SELECT e.id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e q WHERE q.id = 0 AND e.label = 3 ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.id LIMIT 10")
def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    return store.search(_vectors(spark, d), _first(spark, d), 10, where=store.condition(F.col("label"), "eq", 3)).select("id", F.round("score", 6).alias("score"))


@query(f"WITH e AS ({_V}), s AS (SELECT q.id AS query, e.id, list_cosine_similarity(e.v, q.v) AS x FROM e, e q WHERE q.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY x DESC, id) AS rank FROM s) SELECT query, id, round(x, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_join_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return store.search_many(v, v.where("id % 50 = 0").select(F.col("id").alias("query"), "vec"), 5).select("query", "id", F.round("score", 6).alias("score"), "rank")


_LISTS = f"WITH e AS ({_V}), a AS (SELECT e.id, list_cosine_similarity(e.v, q.v) AS s FROM e, e q WHERE q.id = 0 ORDER BY 2 DESC, 1 LIMIT 20), b AS (SELECT e.id, list_cosine_similarity(e.v, q.v) AS s FROM e, e q WHERE q.id = 1 ORDER BY 2 DESC, 1 LIMIT 20)"


def _two_lists(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    v = _vectors(spark, d)
    second = _t(spark, d, "embeddings").where("vec_id = 1").first()["embedding"]
    return {"a": store.search(v, _first(spark, d), 20), "b": store.search(v, second, 20)}


@query(f"{_LISTS} SELECT id, round(sum(x), 9) AS score FROM (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, id)) AS x FROM a UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, id)) FROM b) GROUP BY id")
def rank_fuse(spark: SparkSession, d: str) -> DataFrame:
    return store.fuse(_two_lists(spark, d)).select("id", F.round("score", 9).alias("score"))


@query(f"{_LISTS} SELECT id, round(sum(x), 6) AS score FROM (SELECT id, s * 0.7 AS x FROM a UNION ALL SELECT id, s * 0.5 FROM b) GROUP BY id")
def rank_blend(spark: SparkSession, d: str) -> DataFrame:
    return store.blend(_two_lists(spark, d), {"a": 0.7}).select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- rules

_FACTS = f"SELECT s, p, o, score FROM ({_TRIPLES})"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d)


@query(f"WITH f AS ({_FACTS}) SELECT a.s, 'in_region' AS p, b.o AS o, least(a.score, b.score) AS score FROM f a JOIN f b ON a.o = b.s AND a.p = 'in_nation' AND b.p = 'in_region'")
def rule_conjunction(spark: SparkSession, d: str) -> DataFrame:
    engine = reason.Engine([reason.parse("in_region(?x, ?z) :- in_nation(?x, ?y), in_region(?y, ?z).")])
    return engine.run(_facts(spark, d)).where("depth > 0").select("s", "p", "o", "score")


_CHAIN = "SELECT p_brand || '/' || p_size AS s, p_brand || '/' || (p_size + 1) AS o FROM part GROUP BY ALL"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("s"), F.lit("next").alias("p"), F.concat_ws("/", F.col("p_brand"), (F.col("p_size") + 1).cast("string")).alias("o")).distinct()
    return rows.withColumns({"score": F.lit(1.0), "ord": F.xxhash64("s", "o").bitwiseAND(F.lit((1 << 40) - 1))})


@query(f"WITH RECURSIVE e AS ({_CHAIN}), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s, o FROM c")
def rule_transitive(spark: SparkSession, d: str) -> DataFrame:
    return reason.Engine([reason.transitive("next")]).run(_chain(spark, d)).select("s", "o")


@query(f"WITH e AS ({_CHAIN}) SELECT s, o FROM e UNION SELECT o, s FROM e")
def rule_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return reason.Engine([reason.symmetric("next")]).run(_chain(spark, d)).select("s", "o")


@query(f"WITH e AS ({_CHAIN}) SELECT s, 'next' AS p, o FROM e UNION ALL SELECT o, 'before', s FROM e")
def rule_inverse(spark: SparkSession, d: str) -> DataFrame:
    return reason.Engine([reason.inverse("next", "before")]).run(_chain(spark, d)).select("s", "p", "o")


@query("SELECT c_name AS s, x.o FROM customer, (SELECT unnest(['Customer', 'Party', 'Thing']) AS o) x")
def rule_subclass(spark: SparkSession, d: str) -> DataFrame:
    tree = spark.createDataFrame([("Customer", "Party"), ("Party", "Thing")], "child string, parent string")
    facts = _t(spark, d, "customer").select(F.col("c_name").alias("s"), F.lit("type").alias("p"), F.lit("Customer").alias("o"), F.lit(1.0).alias("score"), F.col("c_custkey").alias("ord"))
    return reason.Engine(classes=reason.ancestors(tree)).run(facts).select("s", "o")


@query()
def rule_why(spark: SparkSession, d: str) -> DataFrame:
    model = reason.Engine([reason.parse("in_region(?x, ?z) :- in_nation(?x, ?y), in_region(?y, ?z).")]).run(_facts(spark, d))
    s, p, o = model.where("depth > 0").orderBy("ord").select("s", "p", "o").first()
    return reason.why(model, s, p, o).select("s", "p", "o", "depth")


@query(f"WITH f AS ({_FACTS}) SELECT count(*) AS used FROM f a JOIN f b ON a.o = b.s AND a.p = 'in_nation' AND b.p = 'in_region', (SELECT unnest([1, 2])) x")
def rule_prov(spark: SparkSession, d: str) -> DataFrame:
    model = reason.Engine([reason.parse("in_region(?x, ?z) :- in_nation(?x, ?y), in_region(?y, ?z).")]).run(_facts(spark, d))
    return reason.provenance(model)[1].agg(F.count("*").alias("used"))


# ---------------------------------------------------------------- entity resolution

_NAMES = "SELECT min(p_partkey) AS ord, p_name AS name FROM part GROUP BY p_name"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    none = {"kind": F.lit("part"), "props": F.create_map().cast("map<string,string>"), "edges": F.array().cast("array<string>"), "vector": F.array().cast("array<float>"), "score": F.lit(1.0), "id": F.col("ord").cast("string")}
    return rows.withColumns(none)


_BLOCKS = f"WITH n AS ({_NAMES}), w AS (SELECT ord, name, unnest(string_split(lower(name), ' ')) AS t FROM n), k AS (SELECT DISTINCT ord, 't:' || left(t, 4) AS key FROM w WHERE length(t) > 2)"


@query(f"{_BLOCKS} SELECT key, count(*) AS n FROM k GROUP BY key")
def dedupe_block(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select(F.explode(resolve.block_keys(F.col("name"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


_PAIRS = f"{_BLOCKS}, p AS (SELECT DISTINCT a.ord AS a, b.ord AS b FROM k a JOIN k b ON a.key = b.key AND a.ord < b.ord), q AS (SELECT p.a, p.b, lower(x.name) AS x, lower(y.name) AS y FROM p JOIN n x ON x.ord = p.a JOIN n y ON y.ord = p.b)"
_EDIT = "1 - levenshtein(x, y) / greatest(length(x), length(y))"


def _likes(spark: SparkSession, d: str, metric: str) -> DataFrame:
    es = _parts(spark, d)
    rows = resolve.candidates(es).join(es.select(F.col("ord").alias("a"), F.col("name").alias("x")), "a").join(es.select(F.col("ord").alias("b"), F.col("name").alias("y")), "b")
    return rows.select("a", "b", F.round(T.alike(F.col("x"), F.col("y"), metric), 6).alias("like"))


@query(f'{_PAIRS} SELECT a, b, round({_EDIT}, 6) AS "like" FROM q')
def dedupe_pairs_edit(spark: SparkSession, d: str) -> DataFrame:
    return _likes(spark, d, "edit")


@query(f"{_PAIRS} SELECT a, b, round(len(list_intersect(string_split(x, ' '), string_split(y, ' '))) / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))), 6) AS \"like\" FROM q")
def dedupe_pairs_token(spark: SparkSession, d: str) -> DataFrame:
    return _likes(spark, d, "token")


@query(f'{_PAIRS}, g AS (SELECT a, b, list_distinct([x[i:i+1] for i in range(1, length(x)::BIGINT)]) AS gx, list_distinct([y[i:i+1] for i in range(1, length(y)::BIGINT)]) AS gy FROM q) SELECT a, b, round(len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))), 6) AS "like" FROM g')
def dedupe_pairs_gram(spark: SparkSession, d: str) -> DataFrame:
    return _likes(spark, d, "gram")


@query()
def dedupe_pairs_jaro(spark: SparkSession, d: str) -> DataFrame:
    return _likes(spark, d, "jaro")


_FOUND = f"{_PAIRS}, f AS (SELECT a, b, 0.6 * ({_EDIT}) + 0.3 AS l FROM q), g AS (SELECT a, b, l, least(1.0, l + 0.05) AS s FROM f WHERE l >= 0.74)"


@query(f'{_FOUND} SELECT a, b, round(l, 6) AS "like", round(s, 6) AS score FROM g')
def dedupe_find(spark: SparkSession, d: str) -> DataFrame:
    return resolve.find(_parts(spark, d), "edit", 0.74, 0.6).select("a", "b", F.round("like", 6).alias("like"), F.round("score", 6).alias("score"))


_GROUPS = _FOUND.replace("WITH n AS", "WITH RECURSIVE n AS") + ", l AS (SELECT a AS u, b AS v FROM g UNION SELECT b, a FROM g), r AS (SELECT u, u AS v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u), gr AS (SELECT u AS ord, min(v) AS grp FROM r GROUP BY u)"


@query(f"{_GROUPS} SELECT ord, grp FROM gr")
def dedupe_groups(spark: SparkSession, d: str) -> DataFrame:
    return resolve.groups(resolve.find(_parts(spark, d), "edit", 0.74, 0.6))


@query(f"{_GROUPS} SELECT n.ord, n.name FROM n WHERE n.ord NOT IN (SELECT ord FROM gr)")
def dedupe_loose(spark: SparkSession, d: str) -> DataFrame:
    es = _parts(spark, d)
    return resolve.loose(es, resolve.groups(resolve.find(es, "edit", 0.74, 0.6))).select("ord", "name")


@query(f"{_GROUPS} SELECT grp, arg_min(n.name, n.ord) AS name, count(*) AS n FROM gr JOIN n USING (ord) GROUP BY grp")
def dedupe_merge(spark: SparkSession, d: str) -> DataFrame:
    return resolve.fuse(_parts(spark, d), "edit", 0.74, 0.6, "first").select("grp", "name", F.size("members").cast("long").alias("n"))


@query()
def dedupe_simhash(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", resolve.simhash("text").alias("hash"))


@query()
def dedupe_minhash(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", resolve.minhash("text").alias("sketch"))


# ---------------------------------------------------------------- conflicts: users' events as claims

_CLAIMS = "SELECT event_id AS ord, 'user' || user_id AS subject, event_type AS prop, CAST(floor(value) AS BIGINT)::VARCHAR AS value, 'doc' || (event_id % 7) AS doc, ts AS at, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE (event_id % 10) / 10 END AS score FROM events"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("event_id") % 5 == 0, 0.0).otherwise((F.col("event_id") % 10) / 10)
    return _t(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("user"), "user_id").alias("subject"), F.col("event_type").alias("prop"), F.floor("value").cast("string").alias("value"), F.concat(F.lit("doc"), F.col("event_id") % 7).alias("doc"), F.col("ts").alias("at"), score.alias("score"))


_CONFLICT = f"WITH c AS ({_CLAIMS}), g AS (SELECT subject, prop, count(*) AS n, count(DISTINCT value) AS \"values\", avg(CASE WHEN score = 0 THEN 0.5 ELSE score END) AS m, max(value::DOUBLE) - min(value::DOUBLE) AS spread FROM c GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT value) >= 2), k AS (SELECT 'value' AS conflict, subject, prop, n, \"values\", round(least(1.0, m * (1 + (\"values\" - 1) / n)), 6) AS score, CASE WHEN spread > 1000 THEN 'high' ELSE 'medium' END AS level FROM g)"


@query(f"{_CONFLICT} SELECT * FROM k")
def conflict_values(spark: SparkSession, d: str) -> DataFrame:
    return resolve.value_conflicts(_claims(spark, d)).withColumn("score", F.round("score", 6))


@query(f"{_CONFLICT} SELECT conflict, level, prop, count(*) AS n FROM k GROUP BY GROUPING SETS ((conflict), (level), (prop))")
def conflict_tally(spark: SparkSession, d: str) -> DataFrame:
    return resolve.tally(resolve.value_conflicts(_claims(spark, d)))


@query("WITH s AS (SELECT c_custkey AS k, o_orderkey AS ord, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi FROM orders JOIN customer ON o_custkey = c_custkey) SELECT a.k AS subject, a.ord AS ord_a, b.ord AS ord_b FROM s a JOIN s b ON a.k = b.k AND a.ord < b.ord AND a.lo <= b.hi AND b.lo <= a.hi AND (a.lo <> b.lo OR a.hi <> b.hi)")
def conflict_overlaps(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spans = o.select(F.col("c_custkey").alias("subject"), F.col("o_orderkey").alias("ord"), F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("hi"))
    return resolve.overlaps(spans).select("subject", "ord_a", "ord_b")


@query(f"WITH c AS ({_CLAIMS}) SELECT ord, prop, value::DOUBLE AS num FROM c WHERE prop = 'click' AND (value::DOUBLE < 5 OR value::DOUBLE > 90)")
def conflict_limits(spark: SparkSession, d: str) -> DataFrame:
    return resolve.limits(_claims(spark, d), spark.createDataFrame([("click", 5.0, 90.0)], "prop string, lo double, hi double")).select("ord", "prop", "num")


@query("SELECT p_name AS subject, p_brand AS prop, count(*) AS n, count(DISTINCT p_type) AS \"values\" FROM part GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT p_type) >= 2")
def conflict_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "part").select(F.col("p_name").alias("s"), F.col("p_brand").alias("p"), F.col("p_type").alias("o"), F.lit(1.0).alias("score"), F.col("p_partkey").alias("ord"))
    return resolve.edge_conflicts(t, []).select("subject", "prop", "n", "values")


@query("WITH t AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL), x AS (SELECT * FROM t WHERE event_type = 'click'), y AS (SELECT * FROM t WHERE event_type = 'error') SELECT x.user_id, 'click' AS k1, 'error' AS k2 FROM x JOIN y USING (user_id)")
def conflict_excludes(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "events").select(F.col("user_id").alias("subject"), F.lit("type").alias("prop"), F.col("event_type").alias("value"), F.col("event_id").alias("ord"))
    return resolve.excludes(c, spark.createDataFrame([("click", "error")], "k1 string, k2 string")).select(F.col("subject").alias("user_id"), "k1", "k2")


@query("SELECT user_id AS subject, event_type AS prop, count(*) AS n, count(DISTINCT year(ts + to_days(CAST(event_id % 700 AS INTEGER)))) AS \"values\" FROM events GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT year(ts + to_days(CAST(event_id % 700 AS INTEGER)))) >= 2")
def conflict_times(spark: SparkSession, d: str) -> DataFrame:
    at = F.expr("ts + make_interval(0, 0, 0, cast(event_id % 700 as int))")
    c = _t(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("subject"), F.col("event_type").alias("prop"), at.cast("string").alias("value"), F.lit(1.0).alias("score"))
    return resolve.time_conflicts(c).select("subject", "prop", "n", "values")


def _settle(rule: str, order: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        trust = spark.createDataFrame([(f"doc{k}", k / 10) for k in range(7)], "doc string, weight double")
        return resolve.settle_claims(_claims(spark, d), rule, trust).select("subject", "prop", "value")

    run.__name__ = f"settle_{rule}"
    query(f"WITH c AS ({_CLAIMS}), g AS (SELECT subject, prop, value, min(ord) AS first, {order} AS s FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subject, prop ORDER BY s DESC, first) AS k FROM g) SELECT subject, prop, value FROM r WHERE k = 1")(run)


for _rule, _order in (("vote", "count(*)"), ("credible", "round(sum((ord % 7) / 10), 9)"), ("newest", "max(epoch_us(\"at\"))"), ("oldest", "-min(epoch_us(\"at\"))"), ("sure", "max(score)")):
    _settle(_rule, _order)


# ---------------------------------------------------------------- text


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def text_flat(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.flat(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.lines(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(replace(text, '’', ''''), '–', '-') AS text FROM documents")
def text_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.quotes(F.col("text")).alias("text"))


@query()
def text_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.octet_length(T.form(F.col("text"), "NFD")).alias("bytes"))


@query("SELECT c_custkey, 'Customer#' || substr(c_name, 10) || ' ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM customer")
def text_title(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", T.title(F.concat_ws(" ", "c_name", F.lower("c_mktsegment"))).alias("title"))


@query()
def text_tags(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.flat(T.tags(F.col("html"))).alias("text"))


@query()
def pages_parse(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", P.parse(F.lit("html"), F.col("html")).alias("p")).select("page_id", "p.title", F.size("p.sections").alias("sections"), F.size("p.links").alias("links"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS text FROM events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", P.parse(F.lit("json"), F.col("props"))["text"].alias("text"))


@query("SELECT c_custkey, c_acctbal::DECIMAL(18, 2)::DOUBLE AS value FROM customer")
def value_money(spark: SparkSession, d: str) -> DataFrame:
    money = V.money_udf(F.concat(F.lit("EUR "), F.col("c_acctbal").cast("decimal(18,2)").cast("string")))
    return _t(spark, d, "customer").select("c_custkey", money["canon"].cast("double").alias("value"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def value_date(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", V.date_udf(F.date_format("o_orderdate", "d MMMM yyyy"))["from"].cast("string").alias("day"))


@query("WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 450)) AS pos FROM documents WHERE length(text) > 0) SELECT doc_id, (pos // 450)::INTEGER AS idx, substring(text, pos + 1, 500) AS text, strlen(left(text, pos))::BIGINT AS start FROM c")
def split_chars(spark: SparkSession, d: str) -> DataFrame:
    return S.chars(_t(spark, d, "documents"), 500, 50).select("doc_id", "idx", "text", "start")


def _tiles(name: str, size: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = S.split(_t(spark, d, "documents"), name, size)
        return out.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("bytes"), F.min("start").alias("lo"), F.max("end").alias("hi"))

    run.__name__ = f"split_{name}"
    query("SELECT doc_id, strlen(text)::BIGINT AS bytes, 0::BIGINT AS lo, strlen(text)::BIGINT AS hi FROM documents WHERE text <> ''")(run)


for _splitter, _size in (("words", 100), ("tokens", 200), ("sentences", 400), ("paragraphs", 800), ("recursive", 300), ("markdown", 1000), ("code", 1000)):
    _tiles(_splitter, _size)


# ---------------------------------------------------------------- extraction


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sentences made of table rows, so that what is to be found is known."""
    rows = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    said = F.concat(F.lit("Supply Corp is based in "), "n_name", F.lit(". It paid $"), F.abs(F.round("s_acctbal")).cast("long"), F.lit(" on 2024-01-02."))
    return rows.select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("idx"), said.alias("text"))


def _gazetteer(spark: SparkSession, d: str) -> dict[str, str]:
    return {r[0]: "GPE" for r in _t(spark, d, "nation").select("n_name").collect()}  # 25 nations


@query("SELECT s_suppkey AS doc_id, n_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return extract.entities(_chunks(spark, d), _gazetteer(spark, d)).where("label = 'GPE'").select("doc_id", "text")


@query("SELECT s_suppkey AS doc_id, 'Supply Corp' AS subject, 'located_in' AS predicate, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    return extract.relations(_chunks(spark, d), _gazetteer(spark, d)).select("doc_id", "subject", "predicate", "object")


@query()
def extract_gap(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return extract.gap(c, extract.entities(c, _gazetteer(spark, d)), ["is based in", "paid", "on"])


@query("SELECT s_suppkey AS doc_id, 'It' AS text, n_name AS refers FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def coref_refer(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return extract.refer(extract.mentions(c, extract.entities(c, _gazetteer(spark, d)).where("label = 'GPE'"))).select("doc_id", "text", "refers")


@query("SELECT count(*) * 4 AS n, count(*) * 3 AS low, 0.7875::DOUBLE AS score, false AS ok FROM supplier")
def extract_floor(spark: SparkSession, d: str) -> DataFrame:
    return extract.report(extract.entities(_chunks(spark, d), _gazetteer(spark, d)), 0.8)


# ---------------------------------------------------------------- time, memory, decisions


def _temporal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("vfrom"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("vuntil"))
    edges = _t(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey") - 1).alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("about").alias("label"), F.lit(1.0).alias("weight"), F.col("o_orderdate").alias("vfrom"), F.lit(None).cast("timestamp_ntz").alias("vuntil"))
    return nodes, edges


_AT = "TIMESTAMP '1997-06-01'"


@query(f"SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderdate <= {_AT} AND o_orderdate + INTERVAL 90 DAY >= {_AT}")
def temporal_at(spark: SparkSession, d: str) -> DataFrame:
    return agent.snapshot(*_temporal(spark, d), F.expr("timestamp_ntz'1997-06-01'"))[0].select("id")


@query(f"WITH live AS (SELECT o_orderkey AS k, o_orderdate FROM orders WHERE o_orderdate <= {_AT} AND o_orderdate + INTERVAL 90 DAY >= {_AT}) SELECT 'o' || (b.k - 1) AS src, 'o' || b.k AS dst FROM live a JOIN live b ON a.k = b.k - 1")
def temporal_edges_at(spark: SparkSession, d: str) -> DataFrame:
    return agent.snapshot(*_temporal(spark, d), F.expr("timestamp_ntz'1997-06-01'"))[1].select("src", "dst")


@query(f"SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN least(o_orderdate + INTERVAL 90 DAY, {_AT}) ELSE o_orderdate + INTERVAL 90 DAY END AS vuntil FROM orders")
def temporal_retract(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _temporal(spark, d)
    return agent.retract(nodes, edges, nodes.where("ord % 10 = 0").select("id"), F.expr("timestamp_ntz'1997-06-01'"))[0].select("id", "vuntil")


@query("SELECT 'o' || o_orderkey AS id, 'asked' AS reason FROM orders WHERE o_orderkey % 10 = 0")
def temporal_losses(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _temporal(spark, d)
    return agent.purge(nodes, edges, nodes.where("ord % 10 = 0").select("id"), F.expr("timestamp_ntz'1997-06-01'"), "asked")[2].select("id", "reason")


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("scope"), F.col("turn").alias("ord"), "text")


@query("WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, sum(strlen(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM conversations) SELECT conv_id AS scope, turn AS ord FROM w WHERE k <= 3 AND spent <= 150")
def memory_window(spark: SparkSession, d: str) -> DataFrame:
    return agent.window(_notes(spark, d), 3, 150).select("scope", "ord")


@query()
def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    return agent.recall(_notes(spark, d), "the and of", 20).select("scope", "ord", F.round("score", 6).alias("score"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("choice"), F.col("o_totalprice").alias("price"), ((F.col("o_orderkey") % 10) / 10).alias("confidence"))


_POLICIES = [("cheap", "1-URGENT", {"max_price": "300000", "one_choice": "O, F"}), ("dear", "5-LOW", {"min_price": "50000"})]
_VET = "SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'max_price' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus NOT IN ('O', 'F') THEN 'one_choice' WHEN o_orderpriority = '5-LOW' AND o_totalprice < 50000 THEN 'min_price' END AS failed FROM orders"


@query(f"WITH v AS ({_VET}) SELECT id, failed IS NULL AS allowed, failed FROM v")
def policy_vet(spark: SparkSession, d: str) -> DataFrame:
    return agent.vet(_decisions(spark, d), _POLICIES).select("id", "allowed", "failed")


@query("SELECT count(*) AS affected, count(*) FILTER (o_totalprice >= 50000 AND o_totalprice < 100000) AS fall FROM orders WHERE o_orderpriority = '5-LOW'")
def policy_sway(spark: SparkSession, d: str) -> DataFrame:
    return agent.sway(_decisions(spark, d), _POLICIES[1], {"min_price": "100000"}).select("affected", "fall")


def _causes(spark: SparkSession, d: str) -> DataFrame:
    """An order causes the next of its customer."""
    o = _t(spark, d, "orders")
    after = F.expr("lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)")
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("o"), after).alias("dst"), F.lit("caused").alias("label")).where("dst is not null")


_CAUSE = "WITH RECURSIVE e AS (SELECT * FROM (SELECT 'o' || o_orderkey AS u, 'o' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS v FROM orders) WHERE v IS NOT NULL), st AS (SELECT 'o' || min(o_orderkey) AS id FROM orders)"


def _start(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").agg(F.concat(F.lit("o"), F.min("o_orderkey")).alias("id"))


@query(f"{_CAUSE}, r AS (SELECT id, 0 AS hop FROM st UNION ALL SELECT v, hop + 1 FROM r JOIN e ON u = id WHERE hop < 10) SELECT id, hop FROM r WHERE hop > 0")
def cause_down(spark: SparkSession, d: str) -> DataFrame:
    return agent.follow(spark, _causes(spark, d), _start(spark, d))


@query(f"{_CAUSE}, r AS (SELECT id, 0 AS hop FROM st UNION ALL SELECT u, hop + 1 FROM r JOIN e ON v = id WHERE hop < 10) SELECT id, hop FROM r WHERE hop > 0")
def cause_up(spark: SparkSession, d: str) -> DataFrame:
    return agent.follow(spark, _causes(spark, d), _start(spark, d), down=False)


@query(f"{_CAUSE} SELECT 'o' || o_orderkey AS id FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT v FROM e)")
def cause_roots(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return agent.roots(own, _causes(spark, d))


@query(f"{_CAUSE}, r AS (SELECT u AS id, v, 1 AS hop FROM e UNION ALL SELECT r.id, e.v, hop + 1 FROM r JOIN e ON e.u = r.v WHERE hop < 5) SELECT r.id, round(least(1.0, sum((o_orderkey % 10) / 10) / (count(*) + 0.5)), 6) AS force FROM r JOIN orders ON 'o' || o_orderkey = r.v GROUP BY r.id")
def cause_force(spark: SparkSession, d: str) -> DataFrame:
    edges = _causes(spark, d)
    return agent.force(_decisions(spark, d), edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", F.round("force", 6).alias("force"))


@query(f"{_CAUSE}, own AS (SELECT 'o' || o_orderkey AS id, o_custkey FROM orders) SELECT count(*) AS nodes, (SELECT count(*) FROM e) AS edges, count(DISTINCT o_custkey) AS parts FROM own")
def cause_net(spark: SparkSession, d: str) -> DataFrame:
    own = _t(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return agent.net(own, _causes(spark, d)).select("nodes", "edges", "parts")


@query()
def decision_like(spark: SparkSession, d: str) -> DataFrame:
    return agent.precedents(_decisions(spark, d), "1-URGENT O", n=10).select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- ontology and export


def _instances(spark: SparkSession, d: str) -> DataFrame:
    of = lambda df, kind, key, name, *attrs: df.select(F.col(key).cast("long").alias("ord"), F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("name"), F.map_from_entries(F.array(*[F.struct(F.lit(a), F.col(a).cast("string")) for a in attrs])).alias("attrs"))
    out = of(_t(spark, d, "customer"), "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    return out.union(of(_t(spark, d, "supplier"), "supplier", "s_suppkey", "s_name", "s_acctbal", "s_nationkey")).union(of(_t(spark, d, "nation"), "nation", "n_nationkey", "n_name", "n_regionkey"))


@query("SELECT 'customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation")
def ontology_classes(spark: SparkSession, d: str) -> DataFrame:
    return ontology.classes(_instances(spark, d)).select("type", "n")


@query("SELECT * FROM (VALUES ('c_acctbal', 'double'), ('c_mktsegment', 'string'), ('c_nationkey', 'integer'), ('s_acctbal', 'double'), ('s_nationkey', 'integer'), ('n_regionkey', 'integer')) v(prop, kind)")
def ontology_widen(spark: SparkSession, d: str) -> DataFrame:
    return ontology.data_properties(_instances(spark, d)).select("prop", F.col("range").alias("kind"))


@query("SELECT 'in_nation' AS prop, (SELECT count(*) FROM customer) AS n, 'customer' AS domain, 'nation' AS \"range\"")
def ontology_endpoints(spark: SparkSession, d: str) -> DataFrame:
    links = _t(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.lit("in_nation").alias("type"), F.col("c_name").alias("src"), F.concat(F.lit("nation:"), "c_nationkey").alias("dst"))
    return ontology.object_properties(_instances(spark, d), links).select("prop", "n", F.concat_ws(",", "domain").alias("domain"), F.concat_ws(",", "range").alias("range"))


@query(f"SELECT '<http://example.org/' || replace(s, '#', '%23') || '> <http://example.org/' || p || '> <http://example.org/' || replace(o, ' ', '_') || '> .' AS line FROM ({_TRIPLES})")
def export_nt(spark: SparkSession, d: str) -> DataFrame:
    return export.nt(_triples(spark, d)).select("line")


@query(f"SELECT s || ',' || p || ',' || o || ',' || score || ',' || doc AS line FROM ({_TRIPLES}) UNION ALL SELECT 'subject,predicate,object,score,doc'")
def export_csv(spark: SparkSession, d: str) -> DataFrame:
    return export.table(_triples(spark, d)).select("line")


@query(f"SELECT '  \"' || s || '\" -> \"' || o || '\" [label=\"' || p || '\"];' AS line FROM ({_TRIPLES}) UNION ALL SELECT unnest(['digraph {{', '}}'])".replace("{{", "{").replace("}}", "}"))
def export_dot(spark: SparkSession, d: str) -> DataFrame:
    return export.dot(_triples(spark, d)).select("line")


@query("WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, g")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return memory.sessions(_t(spark, d, "events"), "30 minutes")


# ---------------------------------------------------------------- retrieval measures


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents), f AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL), g AS (SELECT t, count(*) AS df FROM f GROUP BY t), n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, t, tf * ln(n / df) AS v FROM f JOIN g USING (t), n), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(v, 9) DESC, t) AS k FROM x) SELECT doc_id, t AS term, round(v, 6) AS weight FROM r WHERE k <= 3")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.heaviest(_t(spark, d, "documents"), 3)


@query("WITH a AS (SELECT item_id AS ask, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM documents), x AS (SELECT ask, doc_id, len(list_intersect(a.t, d.t)) AS shared FROM a, d), r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY shared DESC, doc_id) AS rank FROM x WHERE shared > 0) SELECT ask, doc_id, shared, rank FROM r WHERE rank <= 5")
def retrieval_shared(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.shared(_t(spark, d, "documents"), _t(spark, d, "benchmark").select(F.col("item_id").alias("ask"), "text"), 5)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents), f AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL), g AS (SELECT t, count(*) AS df FROM f GROUP BY t), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, t, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM f JOIN g USING (t), n), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM x GROUP BY doc_id),
q AS (SELECT DISTINCT item_id AS ask, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM benchmark), s AS (SELECT ask, doc_id, sum(w / z) AS score FROM x JOIN z USING (doc_id) JOIN q USING (t) GROUP BY ALL),
r AS (SELECT ask, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY ask ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def retrieval_answers(spark: SparkSession, d: str) -> DataFrame:
    asks = _t(spark, d, "benchmark").select(F.col("item_id").alias("ask"), "text")
    return retrieval.answers(_t(spark, d, "documents"), asks, 5).select("ask", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def term_stems(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", retrieval.stems(retrieval.terms(F.col("text"))).alias("stems"))


from . import more as _more  # noqa: E402, F401  registers its queries beside these
