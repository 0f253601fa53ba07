"""Sinks: triples (ord, s, p, o, score, doc) as lines of RDF, graph and table formats.

Line formats are expressions, so writing is a plain distributed text write; formats with a head and foot write those as lines
that sort first and last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold

ROOT = "http://example.org/"


def iri(c: Column, root: str = ROOT) -> Column:
    """A term as it is where it has a scheme; else under root with everything but unreserved characters escaped."""
    safe = F.replace(F.replace(F.replace(F.url_encode(F.trim(c)), F.lit("+"), F.lit("_")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"{}|\\^`]+$"), c).otherwise(F.concat(F.lit(root), safe))


def _quoted(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _lines(rows: DataFrame, line: Column, head: str = "", foot: str = "") -> DataFrame:
    out = rows.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), line.alias("line"))
    spark = rows.sparkSession
    for part, text in ((0, head), (9, foot)):
        if text:
            out = out.union(spark.createDataFrame([(part, k, t) for k, t in enumerate(text.split("\n"))], "part int, ord long, line string"))
    return out


def _nodes(triples: DataFrame) -> DataFrame:
    ends = triples.select(F.col("s").alias("name"), (F.col("ord") * 2).alias("at")).union(triples.select("o", F.col("ord") * 2 + 1))
    return ends.groupBy(fold(F.col("name")).alias("id")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("ord"))


def nt(t: DataFrame) -> DataFrame:
    return _lines(t, F.concat(F.lit("<"), iri(F.col("s")), F.lit("> <"), iri(F.col("p")), F.lit("> <"), iri(F.col("o")), F.lit("> .")))


def ttl(t: DataFrame) -> DataFrame:
    body = F.concat(F.lit("<"), iri(F.col("s")), F.lit(">\n    <"), iri(F.col("p")), F.lit("> <"), iri(F.col("o")), F.lit("> ."))
    return _lines(t, body, f"@base <{ROOT}> .")


def rdfxml(t: DataFrame) -> DataFrame:
    name = F.regexp_replace("p", r"[^A-Za-z0-9_.-]", "_")
    body = F.concat(F.lit('  <rdf:Description rdf:about="'), _xml(iri(F.col("s"))), F.lit('"><x:'), name, F.lit(' rdf:resource="'), _xml(iri(F.col("o"))), F.lit('"/></rdf:Description>'))
    return _lines(t, body, f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="{ROOT}">', "</rdf:RDF>")


def jsonld(t: DataFrame) -> DataFrame:
    """One JSON-LD object a line."""
    return _lines(t, F.concat(F.lit('{"@id": "'), iri(F.col("s")), F.lit('", "'), iri(F.col("p")), F.lit('": {"@id": "'), iri(F.col("o")), F.lit('"}}')))


def ndjson(t: DataFrame) -> DataFrame:
    return _lines(t, F.to_json(F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "score", "doc")))


def table(t: DataFrame, sep: str = ",", bare: bool = False) -> DataFrame:
    """csv or tsv, a cell quoted where it has to be."""
    cell = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(rf'["\n\r{sep}]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return _lines(t, F.concat_ws(sep, *[cell(F.col(c).cast("string")) for c in ("s", "p", "o", "score", "doc")]), "" if bare else sep.join(("subject", "predicate", "object", "score", "doc")))


def dot(t: DataFrame) -> DataFrame:
    return _lines(t, F.concat(F.lit("  "), _quoted(F.col("s")), F.lit(" -> "), _quoted(F.col("o")), F.lit(" [label="), _quoted(F.col("p")), F.lit("];")), "digraph {", "}")


def graphml(t: DataFrame) -> DataFrame:
    nodes = _nodes(t).select("ord", F.concat(F.lit('    <node id="'), _xml(F.col("id")), F.lit('"/>')).alias("line"))
    edges = t.select((F.col("ord") + (1 << 50)).alias("ord"), F.concat(F.lit('    <edge source="'), _xml(fold(F.col("s"))), F.lit('" target="'), _xml(fold(F.col("o"))), F.lit('"/>')).alias("line"))
    return _lines(nodes.union(edges), F.col("line"), '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <graph edgedefault="directed">', "  </graph>\n</graphml>")


def gexf(t: DataFrame) -> DataFrame:
    nodes = _nodes(t).select("ord", F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.col("name")), F.lit('"/>')).alias("line"))
    edges = t.select((F.col("ord") + (1 << 50)).alias("ord"), F.concat(F.lit('<edge id="'), F.col("ord"), F.lit('" source="'), _xml(fold(F.col("s"))), F.lit('" target="'), _xml(fold(F.col("o"))), F.lit('"/>')).alias("line"))
    return _lines(nodes.union(edges), F.col("line"), '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">', "</graph></gexf>")


def mermaid(t: DataFrame) -> DataFrame:
    key = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(fold(F.col(c)), 256), 1, 12))
    return _lines(t, F.concat(F.lit("  "), key("s"), F.lit("["), _quoted(F.col("s")), F.lit("] -->|"), F.col("p"), F.lit("| "), key("o"), F.lit("["), _quoted(F.col("o")), F.lit("]")), "graph LR")


def cypher(t: DataFrame) -> DataFrame:
    label = F.concat(F.lit("`"), F.replace("p", F.lit("`"), F.lit("``")), F.lit("`"))
    return _lines(t, F.concat(F.lit("MERGE (a:Entity {name: "), _quoted(F.col("s")), F.lit("}) MERGE (b:Entity {name: "), _quoted(F.col("o")), F.lit("}) MERGE (a)-[:"), label, F.lit("]->(b);")))


def json_array(t: DataFrame) -> DataFrame:
    """One array: an object a line, a comma before all but the first, which is that of the smallest ord."""
    first = t.agg(F.min("ord").alias("_first"))
    body = F.to_json(F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "score", "doc"))
    return _lines(t.crossJoin(F.broadcast(first)), F.concat(F.when(F.col("ord") > F.col("_first"), ", ").otherwise("  "), body), "[", "]")  # one row


def yaml(t: DataFrame) -> DataFrame:
    """A list of maps; every text is quoted, so none can be read as another kind."""
    text = lambda c: _quoted(F.coalesce(F.col(c), F.lit("")))
    number = F.col("score").cast("string")
    return _lines(t, F.concat(F.lit("- {subject: "), text("s"), F.lit(", predicate: "), text("p"), F.lit(", object: "), text("o"), F.lit(", score: "), F.coalesce(number, F.lit("null")), F.lit(", doc: "), text("doc"), F.lit("}")))


FORMATS = {"json": json_array, "yaml": yaml, "nt": nt, "ttl": ttl, "rdfxml": rdfxml, "jsonld": jsonld, "ndjson": ndjson, "csv": table, "tsv": lambda t: table(t, "\t"), "dot": dot, "graphml": graphml, "gexf": gexf, "mermaid": mermaid, "cypher": cypher}


def write(triples: DataFrame, name: str, path: str) -> None:
    """By a format's name, in order, as text files; parquet as it is."""
    if name == "parquet":
        triples.write.parquet(path)
        return
    if name not in FORMATS:
        raise KeyError(f"no format {name}")
    FORMATS[name](triples).repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("line").write.text(path)


class DrainedError(ValueError):
    """A source that holds no line."""


def _named(c: Column) -> Column:
    """A term without ROOT and its escapes; anything else as it is."""
    own = F.regexp_extract(c, r"^<(.*)>$", 1)
    return F.when(own.startswith(ROOT), F.url_decode(F.replace(F.substring(own, len(ROOT) + 1, 1 << 20), F.lit("_"), F.lit("%20")))).otherwise(own)


def _bare(c: Column) -> Column:
    return F.when(c.startswith(ROOT), F.url_decode(F.replace(F.substring(c, len(ROOT) + 1, 1 << 20), F.lit("_"), F.lit("%20")))).otherwise(c)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select(F.monotonically_increasing_id().alias("ord"), "s", "p", "o", "score", "doc")


def read_nt(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples whose object is an IRI or a plain literal; comments and blank lines are passed over."""
    lines = spark.read.text(path).where(r"trim(value) <> '' and value not like '#%'")
    part = lambda k: F.regexp_extract("value", r'^\s*(<[^>]*>)\s+(<[^>]*>)\s+(<[^>]*>|"(?:[^"\\]|\\.)*")\S*\s*\.\s*$', k)
    literal = F.regexp_extract(part(3), r'^"(.*)"$', 1)
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\\\", "\\")):
        literal = F.replace(literal, F.lit(a), F.lit(b))
    found = lines.where(part(1) != "").select(_named(part(1)).alias("s"), _named(part(2)).alias("p"), F.when(part(3).startswith("<"), _named(part(3))).otherwise(literal).alias("o"))
    return _numbered(found.withColumns({"score": F.lit(0.0), "doc": F.lit("")}))


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """JSON-LD: objects a line, one array, or one @graph; a value is {"@id"}, {"@value"}, a plain value, or a list of them. @context maps short names by a prefix or a whole address."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    kind = "array<map<string,string>>"
    split = F.concat(F.lit("["), F.regexp_replace("v", r"\}\s*\n\s*\{", "},{"), F.lit("]"))
    array = F.when(F.col("v").startswith("["), F.col("v")).otherwise(split)
    heads = whole.select(F.explode(F.from_json(array, kind)).alias("n"))
    graph = F.col("n")["@graph"]
    context = F.from_json(F.col("n")["@context"], "map<string,string>")
    nodes = heads.select(context.alias("c"), F.explode(F.when(graph.isNotNull(), F.from_json(graph, kind)).otherwise(F.array(F.map_filter("n", lambda k, _: k != "@context")))).alias("n"))
    each = nodes.select("c", F.col("n")["@id"].alias("s"), F.explode("n").alias("p", "v")).where("p not in ('@id', '@context')")
    values = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    each = each.select("c", "s", "p", F.explode(values).alias("v"))
    obj = F.coalesce(F.get_json_object("v", "$['@id']"), F.get_json_object("v", "$['@value']"), F.col("v"))
    prefix = F.substring_index(F.col("p"), ":", 1)
    longer = F.coalesce(F.col("c")[F.col("p")], F.when(F.contains("p", F.lit(":")), F.concat(F.col("c")[prefix], F.substring(F.col("p"), F.length(prefix) + 2, F.lit(1 << 20)))), F.col("p"))
    name = F.when(F.col("p") == "@type", F.lit("type")).otherwise(_bare(longer))
    found = each.select(_bare(F.col("s")).alias("s"), name.alias("p"), _bare(obj).alias("o"))
    return _numbered(found.withColumns({"score": F.lit(0.0), "doc": F.lit("")}))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("subject string, predicate string, object string, score double, doc string").option("multiLine", True).json(path)
    return _numbered(rows.toDF("s", "p", "o", "score", "doc"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("subject string, predicate string, object string, score double, doc string").json(path)
    return _numbered(rows.toDF("s", "p", "o", "score", "doc"))


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Columns by the names in the header, in any order."""
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"')
    own = lambda n: F.coalesce(F.col(n), F.lit("")) if n in rows.columns else F.lit("")
    return _numbered(rows.select(own("subject").alias("s"), own("predicate").alias("p"), own("object").alias("o"), F.coalesce(F.expr("try_cast(score as double)") if "score" in rows.columns else F.lit(0.0), F.lit(0.0)).alias("score"), own("doc").alias("doc")))


READERS = {"jsonld": read_jsonld, "json": read_json, "nt": read_nt, "ndjson": read_ndjson, "csv": read_table, "tsv": lambda spark, path: read_table(spark, path, "\t"), "parquet": lambda spark, path: spark.read.parquet(path)}


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Triples back from a format; formats that are only written raise KeyError, empty sources DrainedError."""
    if name not in READERS:
        raise KeyError(f"{name} is not read")
    rows = READERS[name](spark, path)
    if not rows.limit(1).count():
        raise DrainedError(path)
    return rows


def register(name: str, writer: Callable[[DataFrame], DataFrame], reader: Callable[[SparkSession, str], DataFrame] | None = None) -> None:
    """A format of lines, and how it is read if it is."""
    FORMATS[name] = writer
    if reader:
        READERS[name] = reader


def registered(name: str) -> tuple[Callable | None, Callable | None]:
    return FORMATS.get(name), READERS.get(name)


def unregister(name: str) -> bool:
    """Whether there was one."""
    had = name in FORMATS or name in READERS
    FORMATS.pop(name, None), READERS.pop(name, None)
    return had


def formats() -> list[str]:
    return sorted({*FORMATS, "parquet"})
