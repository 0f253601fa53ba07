"""Further registered queries: text repair, parsers, splitters chunk by chunk, stores, the temporal graph, the journal, and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import repair as R
from ..functions import split as S
from ..functions import text as T
from ..functions import values as V
from ..operators import agent, context, durable, extract, graph, journal, ontology, resolve, retrieval, store
from ..sources import export, files, remote
from .iterate import settle, shared
from .queries import _TRIPLES, _graph, _notes, _t, _temporal, _triples, query


def _rows(spark: SparkSession, ddl: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- text repair


@query("SELECT n_nationkey, 'CREME ' || n_name AS plain, 6 + strlen(n_name) AS n FROM nation")
def text_marks(spark: SparkSession, d: str) -> DataFrame:
    plain = R.marks(F.concat(F.lit("CRÈMÉ "), "n_name"))
    return _t(spark, d, "nation").select("n_nationkey", plain.alias("plain"), F.octet_length(plain).cast("long").alias("n"))


@query("SELECT n_nationkey, 'café “' || n_name || '”' AS text FROM nation")
def text_repair(spark: SparkSession, d: str) -> DataFrame:
    """UTF-8 read as windows-1252, once and twice, and text that was never damaged."""
    good = F.concat(F.lit("café “"), "n_name", F.lit("”"))
    damaged = F.concat(F.lit("cafÃ© â€œ"), "n_name", F.lit("â€\u009d"))
    twice = F.concat(F.lit("cafÃƒÂ© Ã¢â‚¬Å“"), "n_name", F.lit("Ã¢â‚¬Â\u009d"))
    own = F.when(F.col("n_nationkey") % 3 == 0, good).when(F.col("n_nationkey") % 3 == 1, damaged).otherwise(twice)
    return _t(spark, d, "nation").select("n_nationkey", R.repair(own).alias("text"))


_BYTES = [("plain", "616263"), ("utf8", "C3A9"), ("bom8", "EFBBBF61"), ("bom16", "FFFE61006200"), ("wide", "6100620063006400"), ("wideb", "0061006200630064"), ("win", "93616294"), ("latin", "E9E8"), ("none", "")]


@query("SELECT * FROM (VALUES ('plain', 'utf-8', 1.0::DOUBLE, 'abc', 0), ('utf8', 'utf-8', 0.95, 'é', 0), ('bom8', 'utf-8', 1.0, 'a', 3), ('bom16', 'utf-16le', 1.0, 'ab', 2), ('wide', 'utf-8', 1.0, 'a' || chr(0) || 'b' || chr(0) || 'c' || chr(0) || 'd' || chr(0), 0), ('wideb', 'utf-8', 1.0, chr(0) || 'a' || chr(0) || 'b' || chr(0) || 'c' || chr(0) || 'd', 0), ('win', 'windows-1252', 0.6, '“ab”', 0), ('latin', 'iso-8859-1', 0.6, 'éè', 0), ('none', 'utf-8', 0.0, '', 0)) t(name, encoding, sure, text, mark)")
def text_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "name string, hex string", *_BYTES).select("name", F.unhex("hex").alias("b"))
    g = R.guess(F.col("b"))
    return rows.select("name", g["encoding"].alias("encoding"), g["sure"].alias("sure"), R.decode(F.col("b"), F.lit(None).cast("string")).alias("text"), R.mark_length(F.col("b")).alias("mark"))


@query("SELECT n_nationkey, 'a ' || n_name || ' b' || chr(10) || chr(10) || '    code  ' || n_name || chr(10) || '```' || chr(10) || '  x   y' || chr(10) || '```' AS text FROM nation")
def text_space(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("\n\na  \t"), "n_name", F.lit("   b \r\n\n  \n\n    code  "), "n_name", F.lit("\n```\n  x   y\n```"))
    return _t(spark, d, "nation").select("n_nationkey", R.space(raw).alias("text"))


@query("""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
y AS (SELECT *, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS key FROM l),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
g AS (SELECT source, key FROM y JOIN n USING (source) WHERE key <> '' GROUP BY source, key, n HAVING n > 1 AND count(DISTINCT doc_id) >= greatest(floor(0.02 * n + 0.5), 2)),
s AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY k)) AS body FROM y ANTI JOIN g USING (source, key) GROUP BY doc_id)
SELECT doc_id, coalesce(body, md5('')) AS body FROM documents LEFT JOIN s USING (doc_id)""")
def text_repeats(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    return R.repeats(pages, 0.02, "book").select(F.col("page").alias("doc_id"), F.md5("text").alias("body"))


@query("SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low FROM nation")
def text_case(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", F.upper("n_name").alias("up"), T.fold(F.col("n_name")).alias("low"))


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18, 2)::DOUBLE AS value FROM orders")
def value_number(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", V.number_udf(F.format_number("o_totalprice", 2))["canon"].cast("double").alias("value"))


@query("SELECT p_partkey, p_size::DOUBLE AS value FROM part")
def value_quantity(spark: SparkSession, d: str) -> DataFrame:
    q = V.quantity_udf(F.concat(F.col("p_size").cast("string"), F.lit(" kg")))
    return _t(spark, d, "part").select("p_partkey", F.regexp_extract(q["canon"], r"^([\d.]+)", 1).cast("double").alias("value"))


# ---------------------------------------------------------------- splitters, chunk by chunk


def _chunked(name: str, size: int, pieces: str, most: int) -> None:
    """SQL cuts a text into pieces and packs them greedily up to most characters, as a walk from chunk to chunk."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return S.split(_t(spark, d, "documents"), name, size).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("body"), "start")

    run.__name__ = f"chunks_{name}"
    query(f"""
WITH RECURSIVE u AS (SELECT doc_id, unnest({pieces}) AS p, generate_subscripts({pieces}, 1) AS k FROM documents WHERE text <> ''),
x AS (SELECT doc_id, k, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM u WHERE p <> ''),
l AS (SELECT doc_id, list(c ORDER BY k) AS cum, list(p ORDER BY k) AS w FROM x GROUP BY doc_id),
r AS (SELECT doc_id, 0::BIGINT AS idx, 0::BIGINT AS i, greatest(1, len(list_filter(cum, lambda y: y <= {most})))::BIGINT AS j FROM l
 UNION ALL SELECT r.doc_id, idx + 1, j, greatest(j + 1, len(list_filter(l.cum, lambda y: y <= l.cum[r.j] + {most})))::BIGINT FROM r JOIN l USING (doc_id) WHERE r.j < len(l.cum)),
o AS (SELECT doc_id, idx, array_to_string(list_slice(w, i + 1, j), '') AS text FROM r JOIN l USING (doc_id))
SELECT doc_id, idx, md5(text) AS body, (sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY idx) - strlen(text))::BIGINT AS start FROM o""")(run)


def _marked(pattern: str, after: bool = True) -> str:
    """Pieces that end after, or begin at, what fits a pattern."""
    mark = "'\\1' || chr(1)" if after else "chr(1) || '\\1'"
    return f"string_split(regexp_replace(text, '{pattern}', {mark}, 'g'), chr(1))"


_chunked("tokens", 200, "string_split(regexp_replace(text, '(\\S\\s+)', '\\1' || chr(1), 'g'), chr(1))", 800)
_chunked("sentences", 400, _marked("([.!?]+[\"'')\\]]*\\s+)"), 400)
_chunked("paragraphs", 800, _marked("(\\s*\\n\\s*\\n\\s*)"), 800)
_chunked("code", 1000, "string_split(regexp_replace(text, '(?m)^((?:func|def|class|type|struct|interface|enum|impl|fn|public|private|export|async|const|var|let|package|module)\\b)', chr(1) || '\\1', 'g'), chr(1))", 1000)


@query("WITH p AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\\S\\s+)', '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') AS w FROM documents WHERE text <> ''), c AS (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS a FROM p) SELECT doc_id, (a // 100)::BIGINT AS idx, md5(array_to_string(list_slice(w, a + 1, a + 100), '')) AS body FROM c")
def chunks_words(spark: SparkSession, d: str) -> DataFrame:
    return S.split(_t(spark, d, "documents"), "words", 100).select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("body"))


@query("SELECT n_nationkey AS doc_id, k::BIGINT AS idx, CASE k WHEN 0 THEN 'Intro' || chr(10) ELSE '# ' || n_name || ' ' || k || chr(10) || 'Body. ' || chr(10) END AS text FROM nation, range(0, 3) t(k)")
def chunks_markdown(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k: F.concat(F.lit("# "), "n_name", F.lit(f" {k}\nBody. \n"))
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("Intro\n"), part(1), part(2)).alias("text"))
    return S.split(docs, "markdown", 1).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


def _by_letter(texts: list[str]) -> list[list[float]]:
    return [[1.0, 0.0] if "Body" in t else [0.0, 1.0] for t in texts]


@query("SELECT n_nationkey AS doc_id, k::BIGINT AS idx, CASE k WHEN 0 THEN 'Body one. Body two. ' ELSE n_name || ' ends.' END AS text FROM nation, range(0, 2) t(k)")
def chunks_by_meaning(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("Body one. Body two. "), "n_name", F.lit(" ends.")).alias("text"))
    return S.by_meaning(docs, _by_letter, 0.5).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


@query("SELECT n_nationkey AS doc_id, k::BIGINT AS idx, CASE k WHEN 0 THEN 'First. ' ELSE n_name || ' second.' END AS text FROM nation, range(0, 2) t(k)")
def chunks_first_of(spark: SparkSession, d: str) -> DataFrame:
    S.register("first_of_sentences", S.first_of(_failing, lambda t, n, o: [], "sentences"))
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("First. "), "n_name", F.lit(" second.")).alias("text"))
    return S.split(docs, "first_of_sentences", 1).select("doc_id", F.col("idx").cast("long").alias("idx"), "text")


def _failing(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    raise ValueError("no model")


# ---------------------------------------------------------------- parsers


def _parsed(spark: SparkSession, d: str, kind: str, raw: Column) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", P.parse(F.lit(kind), raw).alias("p"))


@query("SELECT n_nationkey, 'a' || chr(10) || n_name AS text FROM nation")
def parse_text(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "text", F.concat(F.lit("a\r\n"), "n_name")).select("n_nationkey", "p.text")


@query("SELECT n_nationkey, 'key: ' || n_nationkey || chr(10) || 'name: ' || n_name || chr(10) || chr(10) || 'key: 7' || chr(10) || 'name: a, b' AS text FROM nation")
def parse_csv(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "csv", F.concat(F.lit("key,name\n"), F.col("n_nationkey").cast("string"), F.lit(","), F.col("n_name"), F.lit('\n7,"a, b"\n'))).select("n_nationkey", "p.text")


@query("SELECT n_nationkey, n_name AS title, 2::BIGINT AS sections, 'http://x/' || n_nationkey AS target FROM nation")
def parse_markdown(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("# "), "n_name", F.lit("\n\nSee [here](http://x/"), F.col("n_nationkey").cast("string"), F.lit(").\n\n## Part\n\nmore\n"))
    return _parsed(spark, d, "markdown", raw).select("n_nationkey", "p.title", F.size("p.sections").cast("long").alias("sections"), F.col("p.links")[0]["target"].alias("target"))


@query("SELECT n_nationkey, 'T ' || n_name AS title, n_name AS linked, 'http://x/' || n_nationkey AS target FROM nation")
def parse_html(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("<html><head><title>T "), "n_name", F.lit("</title></head><body><h1>H</h1><p>one</p><a href='http://x/"), F.col("n_nationkey").cast("string"), F.lit("'>"), "n_name", F.lit("</a></body></html>"))
    return _parsed(spark, d, "html", raw).select("n_nationkey", "p.title", F.col("p.links")[0]["text"].alias("linked"), F.col("p.links")[0]["target"].alias("target"))


@query("SELECT n_nationkey, 'a: ' || n_nationkey || chr(10) || chr(10) || 'a: x' AS text FROM nation")
def parse_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "jsonl", F.concat(F.lit('{"a": '), F.col("n_nationkey").cast("string"), F.lit('}\n\n{"a": "x"}\n'))).select("n_nationkey", "p.text")


@query("SELECT n_nationkey, true AS named, true AS keyed FROM nation")
def parse_xml(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('<r><n key="'), F.col("n_nationkey").cast("string"), F.lit('">'), "n_name", F.lit("</n></r>"))
    p = _parsed(spark, d, "xml", raw).join(_t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return p.select("n_nationkey", F.contains("p.text", F.concat(F.lit(": "), "n_name")).alias("named"), F.contains("p.text", F.concat(F.lit("@key: "), F.col("n_nationkey").cast("string"))).alias("keyed"))


@query("SELECT n_nationkey, 'About ' || n_name AS title, true AS body FROM nation")
def parse_email(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("From: a@b.c\nTo: d@e.f\nSubject: About "), "n_name", F.lit("\nContent-Type: text/plain\n\nHello "), "n_name", F.lit("\n"))
    p = _parsed(spark, d, "email", raw).join(_t(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return p.select("n_nationkey", "p.title", F.contains("p.text", F.concat(F.lit("Hello "), "n_name")).alias("body"))


@query("SELECT * FROM (VALUES ('a.md', '', 'markdown'), ('b.TSV', '', 'csv'), ('c', '<!DOCTYPE html><p>', 'html'), ('d', '<r/>', 'xml'), ('e', '{\"a\": 1}', 'json'), ('f', 'Subject: x', 'email'), ('g', '# x', 'markdown'), ('h', 'plain', 'text')) t(name, content, kind)")
def parse_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, "name string, content string", ("a.md", ""), ("b.TSV", ""), ("c", "<!DOCTYPE html><p>"), ("d", "<r/>"), ("e", '{"a": 1}'), ("f", "Subject: x"), ("g", "# x"), ("h", "plain"))
    return rows.select("name", "content", P.detect(F.col("name"), F.col("content")).alias("kind"))


# ---------------------------------------------------------------- sources


@query("SELECT n_nationkey, n_name FROM nation")
def source_delimited(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "rows")
    _t(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.csv(path, header=True)
    return files.rows(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT n_name AS text, sha256('{\"name\":\"' || n_name || '\"}') AS doc_id FROM nation")
def source_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "lines")
    _t(spark, d, "nation").select(F.to_json(F.struct(F.col("n_name").alias("name"))).alias("value")).coalesce(1).write.text(path)
    return files.lines(spark, path, "name").select("text", "doc_id")


@query("SELECT n_name || chr(10) AS text, strlen(n_name) + 1 AS size, sha256(n_name || chr(10)) AS hash, 'text/plain' AS mime FROM nation")
def source_folder(spark: SparkSession, d: str) -> DataFrame:
    """A file for every nation, read back as documents with their origin."""
    path = _folder(spark, "folder")
    _t(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("k")).repartition(25, "k").write.partitionBy("k").text(path)
    return files.folder(spark, path, match="*.txt").select("text", F.col("origin.size").alias("size"), F.col("origin.hash").alias("hash"), F.col("origin.mime").alias("mime"))


@query("SELECT 'stdin' AS source, 'some text' AS text, 9::BIGINT AS size")
def source_reader(spark: SparkSession, d: str) -> DataFrame:
    import io

    return files.ingest(spark, "reader", "stdin", io.BytesIO(b"some text")).select("source", "text", F.col("origin.size").alias("size"))


@query("SELECT * FROM (VALUES ('x0', 'ref', 'text 0'), ('x1', 'ref', 'text 1')) t(doc_id, source, text)")
def source_func(spark: SparkSession, d: str) -> DataFrame:
    files.register("made", files.func(lambda ref: [(f"x{k}", f"text {k}") for k in range(2)]))
    out = files.ingest(spark, "made", "ref")
    assert files.unregister("made") and not files.unregister("made") and "made" not in files.registered()
    return out


@query("SELECT n_nationkey, strlen(n_name) AS size, sha256(n_name) AS hash, 'plain' AS type, n_nationkey::BIGINT AS \"offset\", 0::BIGINT AS status FROM nation")
def source_origin(spark: SparkSession, d: str) -> DataFrame:
    """An origin written as a map and read back."""
    meta = files.origin(F.col("n_name").cast("binary"), offset=F.col("n_nationkey"))
    return _t(spark, d, "nation").select("n_nationkey", files.origin_of(meta).alias("o")).select("n_nationkey", "o.size", "o.hash", "o.type", "o.offset", "o.status")


@query("SELECT 'text:' AS source, 'a' AS text UNION ALL SELECT 'text:', 'b'")
def source_text(spark: SparkSession, d: str) -> DataFrame:
    return files.ingest(spark, "text", "a", "b").select("source", "text")


@query("SELECT * FROM (VALUES ('http://127.0.0.1/x', 'refused'), ('http://10.0.0.8/', 'refused'), ('http://169.254.1.1/', 'refused'), ('ftp://x/', 'refused'), ('http://[::1]/', 'refused')) t(source, error)")
def source_guard(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that a reader of the web must not call."""
    return files.web(spark, ["http://127.0.0.1/x", "http://10.0.0.8/", "http://169.254.1.1/", "ftp://x/", "http://[::1]/"], lambda u: (200, b"never")).select("source", "error")


# ---------------------------------------------------------------- stores


@query("SELECT c_custkey::BIGINT AS ord, 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS v FROM customer WHERE c_custkey % 7 <> 0")
def store_log(spark: SparkSession, d: str) -> DataFrame:
    """Put, put again, drop, compact in between, and replay."""
    log = durable.opened("log", spark, _folder(spark, "store"), "ord long, id string, v string")
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("v"))
    log.put(c)
    log.compact()
    log.put(c.where("ord % 3 = 0").select((F.col("ord") + 10**9).alias("ord"), "id", F.lit("new").alias("v")))
    log.drop(c.where("ord % 7 = 0").select("id"))
    log.compact()
    return log.rows()


@query("SELECT count(*) AS rows, 2 AS batches, 2::BIGINT AS last FROM customer WHERE c_custkey % 2 = 0")
def store_stat(spark: SparkSession, d: str) -> DataFrame:
    log = durable.Log(spark, _folder(spark, "store"), "ord long, id string")
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.col("c_name").alias("id"))
    log.put(c)
    log.drop(c.where("ord % 2 = 1").select("id"))
    return log.stat()


@query("SELECT n_nationkey::BIGINT AS ord, n_name AS id FROM nation")
def store_dump_load(spark: SparkSession, d: str) -> DataFrame:
    path, n = _folder(spark, "dump"), _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("id"))
    one = durable.Log(spark, _folder(spark, "store"), "ord long, id string")
    one.put(n)
    one.dump(path)
    two = durable.Log(spark, _folder(spark, "store"), "ord long, id string")
    two.put(_rows(spark, "ord long, id string", (1, "other")))
    two.load(path)
    return two.rows()


@query("SELECT n_nationkey::BIGINT AS ord, 'n' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'put' ELSE n_name END AS v FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 1000, 'z', 'put'")
def store_put_drop(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("v"))
    new = n.where("ord % 2 = 0").select((F.col("ord") + 500).alias("ord"), "id", F.lit("put").alias("v")).union(_rows(spark, "ord long, id string, v string", (1000, "z", "put")))
    return store.drop(store.put(n, new), _rows(spark, "id string", ("n4",)))


@query("SELECT n_nationkey AS ord, n_name AS id FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3")
def store_scan(spark: SparkSession, d: str) -> DataFrame:
    return store.scan(_t(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("id")), 3, 5)


@query(f"SELECT lower(s) AS src, lower(p) AS label_key, lower(o) AS dst FROM ({_TRIPLES}) WHERE lower(o) <> 'asia' AND lower(s) <> 'asia' GROUP BY ALL")
def store_cut(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _graph(spark, d)
    return store.cut(node, edge, _rows(spark, "id string", ("asia",)))[1].select("src", "label_key", "dst")


@query("SELECT vec_id::VARCHAR AS id, vec_id % 5 AS label, 64::BIGINT AS n FROM embeddings")
def remote_points(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of upserts, read back."""
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), F.create_map(F.lit("label"), (F.col("vec_id") % 5).cast("string")).alias("meta"))
    kind = "struct<points:array<struct<vector:array<float>,payload:struct<_id:string,meta:struct<label:string>>>>>"
    back = remote.points(rows, 100).select(F.explode(F.from_json("body", kind)["points"]).alias("p"))
    return back.select(F.col("p.payload._id").alias("id"), F.col("p.payload.meta.label").cast("long").alias("label"), F.size("p.vector").cast("long").alias("n"))


@query("""SELECT '{"filter": {"must": [{"key": "meta.lang", "match": {"value": "en"}}, {"key": "meta.year", "range": {"gte": 2020}}, {"key": "meta.kind", "match": {"any": ["a", "b"]}}], "must_not": [{"key": "meta.x", "match": {"value": 1}}, {"is_empty": {"key": "meta.x"}}]}, "limit": 3, "vector": [1.0, 0.0], "with_payload": true}' AS body""")
def remote_search(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, "body string", (remote.search([1.0, 0.0], 3, ("lang", "eq", "en"), ("year", "ge", 2020), ("kind", "in", ["a", "b"]), ("x", "ne", 1)),))


@query("SELECT n_nationkey AS ask, k::INTEGER AS rank, n_name || k AS id, (1.0 / k)::DOUBLE AS score FROM nation, range(1, 3) t(k)")
def remote_hits(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda k: F.concat(F.lit(f'{{"id": "u{k}", "score": {1 / k}, "payload": {{"_id": "'), "n_name", F.lit(f'{k}", "meta": {{}}}}}}'))
    answers = _t(spark, d, "nation").select(F.col("n_nationkey").alias("ask"), F.concat(F.lit('{"result": ['), hit(1), F.lit(", "), hit(2), F.lit("]}")).alias("body"))
    return remote.hits(answers)


@query("""SELECT 'INSERT DATA {' || chr(10) || string_agg('<http://x/' || n_nationkey || '> <http://x/name> "' || n_name || ' \\"q\\"" .', chr(10) ORDER BY n_nationkey) || chr(10) || '}' AS body FROM nation""")
def remote_inserts(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("http://x/"), "n_nationkey").alias("s"), F.lit("http://x/name").alias("p"), F.concat("n_name", F.lit(' "q"')).alias("o"))
    return remote.inserts(t)


@query("SELECT n_nationkey AS ask, 0 AS k, 'http://x/' || n_nationkey AS s, n_name AS o, 'SELECT ?s ?o WHERE { ?s <http://x/name> ?o . }' AS q FROM nation")
def remote_bindings(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('{"head": {"vars": ["s", "o"]}, "results": {"bindings": [{"s": {"type": "uri", "value": "http://x/'), F.col("n_nationkey").cast("string"), F.lit('"}, "o": {"type": "literal", "value": "'), "n_name", F.lit('"}}]}}'))
    got = remote.bindings(_t(spark, d, "nation").select(F.col("n_nationkey").alias("ask"), body.alias("body")), "s", "o")
    return got.withColumn("q", F.lit(remote.ask(p="http://x/name")))


# ---------------------------------------------------------------- the temporal graph and the journal


@query("SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'late' ELSE o_orderstatus END AS kind, o_orderkey::BIGINT AS ord FROM orders UNION ALL SELECT 'fresh', 'entity', (SELECT max(o_orderkey) FROM orders)::BIGINT + 1")
def context_add(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.lit("t").alias("text"))
    top = n.agg(F.max("ord").alias("m"))
    new = n.where("ord % 5 = 0").withColumn("kind", F.lit("late")).union(top.select(F.col("m") + 1, F.lit("fresh"), F.lit(""), F.lit("t"))).union(_rows(spark, "ord long, id string, kind string, text string", (5, "", "x", "no id")))
    return context.add(n, new).select("id", "kind", "ord")


@query("SELECT lower(c_name) AS src, 'n' || c_nationkey AS dst, 'about' AS label, 1.0::DOUBLE AS weight, (SELECT count(*) FROM (SELECT c_name FROM customer UNION SELECT 'n' || c_nationkey FROM customer)) AS nodes FROM customer")
def context_join(spark: SparkSession, d: str) -> DataFrame:
    """Edges without label and weight, their ends made; written twice, each stands once."""
    nodes, edges = _rows(spark, journal.NODE), _rows(spark, journal.EDGE)
    c = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.lower("c_name").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("").alias("label"), F.lit(0.0).alias("weight"), F.lit(None).cast("timestamp_ntz").alias("vfrom"), F.lit(None).cast("timestamp_ntz").alias("vuntil"))
    nodes, edges = context.join(nodes, edges, c.unionByName(c.withColumn("ord", F.col("ord") + 10**6)))
    return edges.select("src", "dst", "label", "weight").crossJoin(F.broadcast(nodes.agg(F.count("*").alias("nodes"))))


_ORDER_EDGES = "(SELECT count(*) FROM orders WHERE o_orderkey > 0)"


@query(f"SELECT 'nodes' AS what, '' AS name, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'edges', '', {_ORDER_EDGES} UNION ALL SELECT 'density', '', {_ORDER_EDGES}::DOUBLE / (count(*) * (count(*) - 1)) FROM orders UNION ALL SELECT 'kind', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'label', 'about', {_ORDER_EDGES}")
def context_stats(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _temporal(spark, d)
    return context.stats(nodes.join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("kind")), "ord"), edges)


@query("WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM conversations) SELECT conv_id || '-' || turn AS id, len(list_intersect(w, ['the', 'of', 'zzz'])) / 3.0 AS score FROM w WHERE len(list_intersect(w, ['the', 'of', 'zzz'])) > 0")
def context_find(spark: SparkSession, d: str) -> DataFrame:
    nodes = _t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.col("turn").alias("ord"))
    return context.find(nodes, "The of zzz").select("id", "score")


@query("WITH e AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), x AS (SELECT n_nationkey AS k, coalesce(n, 0) AS n FROM nation LEFT JOIN e ON k = n_nationkey) SELECT 'n' || k AS id, 1 - abs(n - (SELECT n FROM x WHERE k = 3))::DOUBLE / greatest(n, (SELECT n FROM x WHERE k = 3), 1) AS score FROM x WHERE k <> 3")
def context_like_shape(spark: SparkSession, d: str) -> DataFrame:
    nodes = _t(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("text"))
    edges = _t(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.col("c_name").alias("dst"))
    return context.like(nodes, edges, "n3", by_shape=True)


@query("SELECT * FROM (VALUES ('a', 'red green', 1.0::DOUBLE), ('b', 'red blue', 0.5), ('c', 'none', 0.0), ('d', 'greens', 0.0)) t(id, text, score)")
def context_like(spark: SparkSession, d: str) -> DataFrame:
    nodes = _rows(spark, "ord long, id string, kind string, text string", (0, "q", "k", "green red"), (1, "a", "k", "red green"), (2, "b", "k", "red blue"), (3, "c", "k", "none"), (4, "d", "k", "greens"))
    got = context.like(nodes, _rows(spark, "src string, dst string"), "q")
    return got.join(nodes.select("id", "text"), "id").select("id", "text", "score")


@query("SELECT list_transform(range(0, 5), lambda x: 'o' || x) AS path, 4 AS hops, 1.0::DOUBLE AS decay, 'mid' AS band")
def context_path(spark: SparkSession, d: str) -> DataFrame:
    return context.path(spark, _temporal(spark, d)[1], "o0", "o4")


@query("SELECT ['here/a', 'here/b', 'there/c', 'there/d'] AS path, 3 AS hops, 0.25::DOUBLE AS decay, 1 AS doors, 'near' AS band")
def context_cross(spark: SparkSession, d: str) -> DataFrame:
    edges = _rows(spark, "graph string, ord long, src string, dst string, weight double", ("here", 0, "a", "b", 0.5), ("there", 1, "c", "d", 0.5), ("there", 2, "c", "x", 1.0))
    doors = _rows(spark, "ord long, graph string, src string, to_graph string, dst string", (0, "here", "b", "there", "c"))
    return context.cross(spark, edges, doors, ("here", "a"), ("there", "d"))


_CHAIN = [(0, "d1", "d2", "caused", 0.9), (1, "d2", "d3", "influenced", 0.8), (2, "d3", "d4", "precedes", 0.7), (3, "d1", "e1", "about", 1.0)]


@query("SELECT ['d1', 'd2', 'd3', 'd4'] AS path, 3 AS hops, ['d2', 'd3'] AS between, round(0.504::DOUBLE, 6) AS decay, 'd3' AS weakest_src, 'd4' AS weakest_dst, 0.7::DOUBLE AS weight, 'near' AS band, 'mediated by 2 decisions, confidence 0.50, moderate evidence' AS gloss")
def cause_trace(spark: SparkSession, d: str) -> DataFrame:
    edges = _rows(spark, "ord long, src string, dst string, label string, weight double", *_CHAIN)
    got = context.trace(spark, edges, _rows(spark, "id string", ("d1",), ("d2",), ("d3",), ("d4",)), "d1", "d4")
    return got.withColumn("decay", F.round("decay", 6))


@query("SELECT o_orderkey, round((o_orderkey % 10) / 10.0 * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 ELSE 0.6 END / (1 + (o_orderkey % 4) * 0.1), 9) AS strength, round(least(1.0, (o_orderkey % 10) / 10.0 * CASE WHEN o_orderstatus = 'F' THEN 1.1 ELSE 0.7 END * CASE WHEN o_orderkey % 2 = 0 THEN 1.1 ELSE 0.8 END), 9) AS fit FROM orders")
def cause_strength(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "caused").when(F.col("o_orderstatus") == "O", "influenced").otherwise("precedes")
    sure = (F.col("o_orderkey") % 10) / 10
    return o.select("o_orderkey", F.round(context.strength(label, sure, F.col("o_orderkey") % 4), 9).alias("strength"), F.round(context.fit(sure, F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2 == 0), 9).alias("fit"))


@query("SELECT ['a', 'b', 'c'] AS cycle")
def cause_loops(spark: SparkSession, d: str) -> DataFrame:
    edges = _rows(spark, "src string, dst string, label string", ("a", "b", "caused"), ("b", "c", "influenced"), ("c", "a", "precedes"), ("c", "d", "caused"), ("d", "c", "about"))
    return agent.loops(spark, edges)


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 2 = 0")
def scope_covers(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("agent"), (F.col("conv_id") % 2).cast("string").alias("session"), F.lit("t").alias("task"))
    return rows.where(context.covers(agent="user", session="0")).select("conv_id", "turn")


@query("SELECT conv_id AS scope, turn AS ord FROM conversations WHERE list_contains(string_split(lower(text), ' '), 'the')")
def memory_about(spark: SparkSession, d: str) -> DataFrame:
    """Notes of an entity; here every word is one."""
    return context.about(_notes(spark, d).withColumn("of", F.split(F.lower("text"), " ")), "the").select("scope", "ord")


@query("SELECT * FROM (VALUES ('b', 1, 0.5::DOUBLE), ('c', 2, 0.25), ('d', 3, 0.125)) t(id, hop, decay)")
def context_near(spark: SparkSession, d: str) -> DataFrame:
    edges = _rows(spark, "ord long, src string, dst string, label string, weight double, vfrom timestamp_ntz, vuntil timestamp_ntz", *[(k, a, b, "x", 0.5, None, None) for k, (a, b) in enumerate((("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")))])
    return agent.near(spark, edges, "a", 3)


def _journal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = _t(spark, d, "orders").where("o_orderkey is not null")
    new = o.select(F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.lit("case").alias("case"), F.lit("because").alias("reason"), F.col("o_orderstatus").alias("choice"), F.concat(F.lit("c"), "o_custkey").alias("agent"), F.lit("").alias("rule"), ((F.col("o_orderkey") % 10) / 10).alias("confidence"), F.lit(True).alias("allowed"), F.lit("").alias("gloss"), F.col("o_orderdate").alias("at"), F.array(F.concat(F.lit("e"), F.col("o_custkey") % 5)).alias("because"))
    return tuple(settle(x) for x in journal.write(_rows(spark, journal.DECISION), _rows(spark, journal.NODE), _rows(spark, journal.EDGE), new))


@query("SELECT 'o' || o_orderkey AS id, o_orderpriority AS topic, o_orderstatus AS choice FROM orders WHERE o_custkey % 5 = 2")
def journal_about(spark: SparkSession, d: str) -> DataFrame:
    decisions, _, edges = _journal(spark, d)
    return journal.about(decisions, edges, "e2").select("id", "topic", "choice")


@query("SELECT 'o' || o_orderkey AS id, 'on' AS what FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'o' || o_orderkey, 'by' FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'o1', 'read' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 1)")
def journal_lists(spark: SparkSession, d: str) -> DataFrame:
    decisions = _journal(spark, d)[0]
    parts = (("on", journal.on(decisions, "1-URGENT")), ("by", journal.by(decisions, "c7")), ("read", journal.read(decisions, "o1")))
    out = [df.select("id", F.lit(name).alias("what")) for name, df in parts]
    return out[0].union(out[1]).union(out[2])


@query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey IN (1, 2)")
def journal_before(spark: SparkSession, d: str) -> DataFrame:
    decisions, nodes, edges = _journal(spark, d)
    links = _rows(spark, "ord long, src string, dst string, label string", (1, "o1", "o3", "precedes"), (2, "o2", "o3", "precedes"), (3, "o4", "o3", "caused"))
    _, edges = journal.lead(decisions, nodes, edges, links)
    return journal.before(decisions, edges, "o3").select("id")


@query("SELECT * FROM (VALUES ('', 'needs a topic'), ('b', 'needs a choice'), ('c', 'confidence is outside 0 to 1')) t(id, fault)")
def journal_faults(spark: SparkSession, d: str) -> DataFrame:
    return journal.faults(_rows(spark, "id string, topic string, `case` string, choice string, confidence double", ("", None, "c", "x", 0.5), ("b", "t", "c", "", 0.5), ("c", "t", "c", "x", 1.5), ("d", "t", "c", "x", 1.0)))


def _known(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    note = lambda k, text, *of: (k, f"n{k}", text, None, "a", "", "", list(of))
    notes = _rows(spark, journal.NOTE, note(0, "rates rose in spring", "bank"), note(1, "the bank closed a branch", "bank"), note(2, "nothing of note", "river"), note(3, "branch lines", "tree"))
    return tuple(settle(x) for x in journal.learn(_rows(spark, journal.NOTE), _rows(spark, journal.NODE), _rows(spark, journal.EDGE), notes))


@query("SELECT * FROM (VALUES ('n1', 1.0::DOUBLE), ('n3', 0.6), ('n0', 0.15)) t(id, score)")
def ken_recall(spark: SparkSession, d: str) -> DataFrame:
    """Found by words and by entity, by words alone, by entity alone."""
    notes, nodes, _ = _known(spark)
    return journal.recall(notes, nodes, "bank branch").select("id", F.round("score", 9).alias("score"))


@query("SELECT * FROM (VALUES ('n0', 'note', 0), ('n1', 'note', 0), ('n2', 'note', 0), ('n3', 'note', 0), ('bank', 'entity', 2), ('river', 'entity', 1), ('tree', 'entity', 1)) t(id, kind, named)")
def ken_learn(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, edges = _known(spark)
    named = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("int").alias("named"))
    return nodes.join(named, "id", "left").na.fill(0).select("id", "kind", "named")


@query("SELECT 'o' || o_orderkey AS id, NOT (o_orderpriority = '1-URGENT' AND o_totalprice > 300000) AS allowed, CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'cheap: max_price' ELSE 'passed' END AS gloss FROM orders")
def ken_decide(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.lit("case").alias("case"), F.lit("").alias("reason"), F.col("o_orderstatus").alias("choice"), F.lit("a").alias("agent"), F.lit("").alias("rule"), F.lit(0.5).alias("confidence"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"), F.array().cast("array<string>").alias("because"))
    return journal.decide(_rows(spark, journal.DECISION), _rows(spark, journal.NODE), _rows(spark, journal.EDGE), o, [("cheap", "1-URGENT", {"max_price": "300000"})])[0].select("id", "allowed", "gloss")


@query("SELECT 'd3' AS id, ['e1', 'e2'] AS because, ['d1', 'd2'] AS led, ['d1'] AS roots, 'allowed \"yes\" on loan: passed; rests on 2 pieces of evidence; follows 2 earlier decisions' AS gloss")
def ken_why(spark: SparkSession, d: str) -> DataFrame:
    row = lambda k: (k, f"d{k}", "loan", "case", "r", "yes", "a", "", 0.9, True, "passed", None, ["e1", "e2"])
    decisions, nodes, edges = (settle(x) for x in journal.write(_rows(spark, journal.DECISION), _rows(spark, journal.NODE), _rows(spark, journal.EDGE), _rows(spark, journal.DECISION, row(1), row(2), row(3))))
    nodes, edges = journal.lead(decisions, nodes, edges, _rows(spark, "ord long, src string, dst string, label string", (10, "d1", "d2", "caused"), (11, "d2", "d3", "influenced")))
    return journal.why(spark, decisions, nodes, edges, "d3")


# ---------------------------------------------------------------- graph, resolution, extraction


@query("SELECT lower(n_name) AS id, n_nationkey::VARCHAR AS first, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS second FROM nation UNION ALL SELECT 'alone', 'x', NULL")
def graph_put(spark: SparkSession, d: str) -> DataFrame:
    """Properties set twice keep their first value; an unknown id becomes a node."""
    one = lambda k, v: F.map_from_entries(F.array(F.struct(F.lit(k), v)))
    n = _t(spark, d, "nation")
    told = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("id"), one("first", F.col("n_nationkey").cast("string")).alias("props"))
    again = n.where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 100).cast("long").alias("ord"), F.lower("n_name").alias("id"), F.map_concat(one("first", F.lit("later")), one("second", F.lit("even"))).alias("props"))
    alone = _rows(spark, "ord long, id string, props map<string,string>", (500, "Alone", {"first": "x"}), (501, "  ", {"a": "b"}))
    got = graph.put(_graph(spark, d)[0], told.union(again).union(alone)).where(F.size("props") > 0)
    return got.select("id", F.col("props")["first"].alias("first"), F.col("props")["second"].alias("second"))


def _small(spark: SparkSession, *links: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    t = _rows(spark, "ord long, s string, p string, o string, score double, doc string", *[(k, a, "r", b, 0.0, "") for k, (a, b) in enumerate(links)])
    return graph.nodes(t), graph.edges(t)


_CLIQUES = [("1", "2"), ("2", "3"), ("1", "3"), ("4", "5"), ("5", "6"), ("4", "6"), ("3", "4")]


@query("SELECT * FROM (VALUES ('3', '4'), ('6', '7'), ('7', '8')) t(src, dst)")
def graph_bridges_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Two triangles, a link between them and a tail: the triangles' links are no bridges, nor is a doubled one."""
    return graph.bridges(*_small(spark, *_CLIQUES, ("6", "7"), ("7", "8"))).select("src", "dst")


@query("SELECT k::VARCHAR AS id, CASE WHEN k < 4 THEN '1' ELSE '4' END AS community FROM range(1, 7) t(k)")
def graph_groups_cliques(spark: SparkSession, d: str) -> DataFrame:
    node, edge = _small(spark, *_CLIQUES)
    got = graph.groups(node, edge)
    first = got.groupBy("community").agg(F.min("id").alias("first"))
    return got.join(first, "community").select("id", F.col("first").alias("community"))


@query("SELECT 'a' AS id, 1.0::DOUBLE AS score UNION ALL SELECT unnest(['b', 'c', 'd', 'e']), 0.5")
def graph_eigen_star(spark: SparkSession, d: str) -> DataFrame:
    """A star of four: a leaf has half of what its middle has."""
    return graph.eigen(*_small(spark, ("a", "b"), ("a", "c"), ("a", "d"), ("a", "e")), rounds=400, tolerance=1e-12).select("id", F.round("score", 4).alias("score"))


_RANK = "WITH RECURSIVE r(k, a, b, c) AS (SELECT 0, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE UNION ALL SELECT k + 1, 0.05 + 0.85 * c, 0.05 + 0.85 * a / 2, 0.05 + 0.85 * (a / 2 + b) FROM r WHERE k < 200)"


def _ranked(name: str, small: int) -> None:
    """PageRank of a ring with a short cut, in one task and as joins."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        was = graph.SMALL
        graph.SMALL = small
        try:
            got = graph.rank(*_small(spark, ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")), rounds=60, tolerance=1e-9)
            return got.select("id", F.round("score", 6).alias("score"))
        finally:
            graph.SMALL = was

    run.__name__ = name
    query(f"{_RANK} SELECT 'a' AS id, round(a, 6) AS score FROM r WHERE k = 200 UNION ALL SELECT 'b', round(b, 6) FROM r WHERE k = 200 UNION ALL SELECT 'c', round(c, 6) FROM r WHERE k = 200")(run)


_ranked("graph_rank_ring", graph.SMALL)
_ranked("graph_rank_joins", 0)


@query("SELECT o_orderkey::VARCHAR AS subject, 'status' AS prop, NULL::VARCHAR AS value, NULL::DOUBLE AS support FROM orders")
def settle_flag(spark: SparkSession, d: str) -> DataFrame:
    claims = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("subject"), F.lit("status").alias("prop"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("ord"))
    return resolve.settle_claims(claims.union(claims), "flag")


@query("SELECT * FROM (VALUES (1, 2, 0.9::DOUBLE), (1, 3, 0.8), (2, 4, 0.6)) t(a, b, score)")
def dedupe_limit(spark: SparkSession, d: str) -> DataFrame:
    """One pair a record: 2-3 falls, since both have theirs."""
    pairs = _rows(spark, "a long, b long, like double, score double", (1, 2, 0.9, 0.9), (1, 3, 0.8, 0.8), (2, 3, 0.7, 0.7), (2, 4, 0.6, 0.6), (5, 6, 0.1, 0.1))
    return resolve.limit(pairs, floor=0.5, per=1).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "score")


@query("SELECT s.s_suppkey::BIGINT AS a, 1000000 + s.s_suppkey::BIGINT AS b FROM supplier s")
def dedupe_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Fresh records against known ones alone: every supplier meets its own copy and no other."""
    row = lambda df, more: df.select((F.col("s_suppkey") + more).cast("long").alias("ord"), F.concat(F.lit("x"), F.lpad(F.hex(F.col("s_suppkey")), 3, "0"), F.lit(" trading")).alias("name"), F.lit("firm").alias("kind"), F.create_map().cast("map<string,string>").alias("props"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<float>").alias("vector"))
    s = _t(spark, d, "supplier")
    pairs = resolve.candidates(row(s, 0), row(s, 10**6)).where("b = a + 1000000")
    return resolve.find(row(s, 0), "exact", 0.5, 0.5, known=row(s, 10**6), pairs=pairs).select("a", "b")


@query("SELECT * FROM (VALUES ('Acme', 'worksAt', 'Ada', 'domain'), ('Ada', 'worksAt', 'Acme', NULL), ('Ada', 'flies', 'Acme', 'predicate'), ('Ada', 'worksAt', 'Ada', 'range'), ('Bob', 'knows', 'Acme', NULL)) t(subject, predicate, object, fault)")
def extract_schema(spark: SparkSession, d: str) -> DataFrame:
    schema = extract.Schema(["Person", "Firm"], {"worksAt": ("Person", "Firm"), "knows": (None, None)})
    rel = _rows(spark, "subject string, predicate string, object string", ("Acme", "worksAt", "Ada"), ("Ada", "worksAt", "Acme"), ("Ada", "flies", "Acme"), ("Ada", "worksAt", "Ada"), ("Bob", "knows", "Acme"))
    return schema.check(rel, _rows(spark, "name string, label string", ("Ada", "Person"), ("Acme", "Firm"))).select("subject", "predicate", "object", "fault")


def _answering(body: str) -> tuple[int, str]:
    import json

    told = json.loads(body)["messages"][1]["content"]
    return 200, json.dumps({"choices": [{"message": {"content": '```json\n[{"subject": "' + told + '", "predicate": "is", "object": "nation", "score": 0.5}, {"subject": "cut'}}]})


@query("SELECT n_nationkey::BIGINT AS doc_id, n_name AS subject, 'is' AS predicate, 'nation' AS object, 0.5::DOUBLE AS score FROM nation")
def extract_by_model(spark: SparkSession, d: str) -> DataFrame:
    """A model behind a chat, whose answer is fenced and cut off."""
    chunks = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit(0).alias("idx"), F.col("n_name").alias("text"))
    return extract.by_model(chunks, extract.chat(_answering, "m", "find triples")).select("doc_id", "subject", "predicate", "object", "score")


@query("SELECT * FROM (VALUES ('worksFor', 'works for'), ('has_part', 'hasPart'), ('HTTPServer', 'http-server')) t(a, b)")
def ontology_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that read alike in camel case; both are given as they were."""
    pairs = [("worksFor", "works for"), ("has_part", "hasPart"), ("HTTPServer", "http-server"), ("one", "two")]
    return _rows(spark, "a string, b string", *[p for p in pairs if ontology.camel(p[0]) == ontology.camel(p[1])])


# ---------------------------------------------------------------- formats written and read back


def _returned(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = _folder(spark, f"export-{name}")
        export.write(_triples(spark, d).where("ord < 400"), name, path)
        return export.read(spark, name, path).select("s", "p", "o")

    run.__name__ = f"export_{name}_returned"
    # an address doesn't tell a space from an underscore; both are read back as a space
    term = (lambda c: f"replace({c}, '_', ' ') AS {c}") if name in ("nt", "jsonld") else str
    query(f"SELECT {term('s')}, {term('p')}, {term('o')} FROM ({_TRIPLES}) WHERE ord < 400")(run)


for _name in ("nt", "ndjson", "csv", "tsv", "parquet", "json", "jsonld"):
    _returned(_name)


def _written(name: str, line: str, head: list[str], foot: list[str]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return export.FORMATS[name](_triples(spark, d)).select("line")

    run.__name__ = f"export_{name}"
    fixed = ", ".join("'" + x.replace("'", "''") + "'" for x in [*head, *foot])
    query(f"SELECT {line} AS line FROM ({_TRIPLES})" + (f" UNION ALL SELECT unnest([{fixed}])" if fixed else ""))(run)


_IRI = lambda c: f"'http://example.org/' || replace(replace({c}, ' ', '_'), '#', '%23')"
_written("yaml", "'- {subject: \"' || s || '\", predicate: \"' || p || '\", object: \"' || o || '\", score: ' || score || ', doc: \"' || doc || '\"}'", [], [])
_written("jsonld", f"'{{\"@id\": \"' || {_IRI('s')} || '\", \"' || {_IRI('p')} || '\": {{\"@id\": \"' || {_IRI('o')} || '\"}}}}'", [], [])
_written("cypher", "'MERGE (a:Entity {name: \"' || s || '\"}) MERGE (b:Entity {name: \"' || o || '\"}) MERGE (a)-[:`' || p || '`]->(b);'", [], [])
_written("mermaid", "'  n' || left(sha256(lower(s)), 12) || '[\"' || s || '\"] -->|' || p || '| n' || left(sha256(lower(o)), 12) || '[\"' || o || '\"]'", ["graph LR"], [])
_written("tsv", "s || chr(9) || p || chr(9) || o || chr(9) || score || chr(9) || doc", ["subject\tpredicate\tobject\tscore\tdoc"], [])


# ---------------------------------------------------------------- retrieval


_AUC = "WITH r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM labels JOIN documents USING (doc_id)), s AS (SELECT sum(CASE WHEN toxic = 1 THEN r ELSE 0 END) AS x, sum(toxic) AS p, count(*) - sum(toxic) AS q FROM r) SELECT round((x - p * (p + 1) / 2) / (p * q), 6) AS auc FROM s"


@query(_AUC)
def auc(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id")
    return retrieval.auc(rows, "n_chars", "toxic").select(F.round("auc", 6).alias("auc"))


@query("SELECT conv_id AS conv, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE text NOT LIKE '%?%' AND trim(text) <> '') GROUP BY 1")
def dialogue_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns that claim something, where none is a question."""
    turns = _t(spark, d, "conversations").where("text not like '%?%'").select(F.col("conv_id").alias("conv"), "turn", F.col("role").alias("who"), "text")
    return retrieval.claims(turns).select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (0, 'I live in Rome.', 'ann'), (1, 'Rome is old.', NULL)) t(k, text, who)")
def dialogue_claims(spark: SparkSession, d: str) -> DataFrame:
    turns = _rows(spark, "conv long, turn long, who string, text string", (1, 1, "ann", "I live in Rome. Do you? Rome is old."))
    return retrieval.claims(turns).select("k", "text", F.col("of").alias("who"))


@query("SELECT conv_id AS conv, count(*) AS n, 1.0::DOUBLE AS f1, avg(CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.5 END) AS recall, 0.0::DOUBLE AS quiet FROM conversations WHERE regexp_matches(text, '[A-Za-z]') GROUP BY conv_id")
def retrieval_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: every answer is right, and half of the evidence is missing on odd turns."""
    c = _t(spark, d, "conversations").where(F.col("text").rlike("[A-Za-z]"))
    found = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = c.select(F.col("conv_id").alias("conv"), F.col("text").alias("answer"), F.col("text").alias("gold"), found.alias("found"), F.array(F.lit("a"), F.lit("b")).alias("evidence"))
    return retrieval.evaluate(rows, ["conv"])


@query("SELECT 1.0::DOUBLE AS low, 3.0::DOUBLE AS high")
def retrieval_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    low, high = retrieval.bootstrap([1.0, 3.0])
    return _rows(spark, "low double, high double", (low, high))
