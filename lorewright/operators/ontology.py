"""Schema from observed instances, its hierarchy, names and serializations.

Instances are rows (ord, id, type, name, attrs MAP<STRING,STRING>), links (ord, type, src, dst).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = ["boolean", "integer", "double", "decimal", "date", "dateTime", "string"]


class CollisionError(ValueError):
    """Two types that read as one class name."""


def words(name: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)


def pascal(name: str) -> str:
    return "".join(w[:1].upper() + w[1:].lower() for w in words(name))


def camel(name: str) -> str:
    p = pascal(name)
    return p[:1].lower() + p[1:]


def singular(name: str) -> str:
    for end, new in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh")):
        if name.endswith(end):
            return name[: -len(end)] + new
    return name[:-1] if name.endswith("s") and not name.endswith(("ss", "us", "is")) else name


def class_name(name: str) -> str:
    return pascal(singular(name))


def classes(instances: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(type, n, attrs): types seen often enough, with the attributes that a share of their instances state."""
    seen = instances.where("type <> ''").groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    each = instances.select("type", F.explode(F.map_keys("attrs")).alias("attr")).groupBy("type", "attr").agg(F.count("*").alias("k"))
    own = each.join(seen, "type").where(F.col("k") >= share * F.col("n")).groupBy("type").agg(F.array_sort(F.collect_list("attr")).alias("attrs"))
    return seen.join(own, "type", "left").select("type", "n", F.coalesce("attrs", F.array().cast("array<string>")).alias("attrs"))


def check_names(found: DataFrame) -> dict[str, str]:
    """type -> class name; types are few. Raises CollisionError where two agree."""
    out: dict[str, str] = {}
    for (t,) in found.select("type").orderBy("type").collect():
        if (n := class_name(t)) in out.values():
            raise CollisionError(n)
        out[t] = n
    return out


def datatype(value: Column) -> Column:
    v = F.trim(value)
    return (
        F.when(F.lower(v).isin("true", "false"), "boolean").when(v.rlike(r"^[+-]?\d+$"), "integer").when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "double")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "dateTime").otherwise("string")
    )


def widest(kind: Column) -> Column:
    """The widest of several datatypes."""
    ranks = F.create_map(*[F.lit(x) for k, n in enumerate(RANKS) for x in (n, k)])
    return F.max_by(kind, ranks[kind])


def data_properties(instances: DataFrame) -> DataFrame:
    """(prop, domain, range, n): attributes with the types that state them and their widened datatype."""
    each = instances.select("type", F.explode("attrs").alias("prop", "value")).where("value is not null")
    return each.withColumn("kind", datatype(F.col("value"))).groupBy("prop").agg(F.array_sort(F.collect_set("type")).alias("domain"), widest(F.col("kind")).alias("range"), F.count("*").alias("n"))


def object_properties(instances: DataFrame, links: DataFrame) -> DataFrame:
    """(prop, domain, range, n): link types with the types at their ends; an end resolves by id, else by a name of one type."""
    by_id = instances.groupBy(F.col("id").alias("ref")).agg(F.min_by("type", "ord").alias("t"))
    by_name = instances.groupBy(F.col("name").alias("ref")).agg(F.count_distinct("type").alias("k"), F.min("type").alias("u")).where("k = 1").drop("k")
    rows = links
    for end in ("src", "dst"):
        rows = rows.join(by_id.select(F.col("ref").alias(end), F.col("t").alias(f"{end}_t")), end, "left").join(by_name.select(F.col("ref").alias(end), F.col("u").alias(f"{end}_u")), end, "left")
    kept = lambda end: F.array_sort(F.collect_set(F.coalesce(f"{end}_t", f"{end}_u")))
    return rows.groupBy(F.col("type").alias("prop")).agg(kept("src").alias("domain"), kept("dst").alias("range"), F.count("*").alias("n"))


def term(root: str, name: str) -> str:
    return root + ("" if root.endswith(("#", "/")) else "#") + name


def turtle(found: DataFrame, data: DataFrame, objects: DataFrame, root: str = "http://example.org/schema#") -> str:
    """A schema as Turtle; schemas are small."""
    lines = [f"@prefix : <{root}> .", "@prefix owl: <http://www.w3.org/2002/07/owl#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", ""]
    names = check_names(found)
    lines += [f":{n} a owl:Class ." for n in sorted(names.values())]
    for r in data.orderBy("prop").collect():
        lines.append(f":{camel(r.prop)} a owl:DatatypeProperty ; " + "".join(f"rdfs:domain :{names[d]} ; " for d in r.domain if d in names) + f"rdfs:range xsd:{r['range']} .")
    for r in objects.orderBy("prop").collect():
        lines.append(f":{camel(r.prop)} a owl:ObjectProperty ; " + "".join(f"rdfs:domain :{names[d]} ; " for d in r.domain if d in names) + "".join(f"rdfs:range :{names[d]} ; " for d in r["range"] if d in names).rstrip("; ") + " .")
    return "\n".join(lines) + "\n"


_TOKEN = re.compile(r"""\s*(?:\#[^\n]*\n\s*)*(<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]+))?|@prefix|[\w-]*:[\w.-]*\w|[\w-]*:|_:\w+|[+-]?\d+(?:\.\d+)?|true|false|a(?=\s)|[.;,\[\]()])""")


def statements(text: str) -> list[tuple[str, str, str, bool, str, str]]:
    """(s, p, o, literal, datatype, lang) of Turtle or N-Triples with prefixes, lists of objects and predicates."""
    tokens, at = [], 0
    text = re.sub(r"(?m)(?<!\S)#.*$", "", text).strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at : at + 30]!r}")
        tokens.append(m[1])
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    prefixes: dict[str, str] = {}

    def resource(t: str) -> tuple[str, bool, str, str]:
        if t == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", False, "", ""
        if t.startswith("<"):
            return t[1:-1], False, "", ""
        if t.startswith('"'):
            m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^(.+))?', t, re.S)
            body = re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), m[1])
            return body, True, resource(m[3])[0] if m[3] else "", m[2] or ""
        if t in ("true", "false"):
            return t, True, "http://www.w3.org/2001/XMLSchema#boolean", ""
        if re.fullmatch(r"[+-]?\d+(\.\d+)?", t):
            return t, True, "http://www.w3.org/2001/XMLSchema#" + ("decimal" if "." in t else "integer"), ""
        p, _, n = t.partition(":")
        return (t if p == "_" else prefixes.get(p, p + ":") + n), False, "", ""

    out, k = [], 0
    while k < len(tokens):
        if tokens[k] == "@prefix":
            prefixes[tokens[k + 1].rstrip(":")] = tokens[k + 2][1:-1]
            k += 4
            continue
        s = resource(tokens[k])[0]
        k += 1
        while tokens[k] != ".":
            p = resource(tokens[k])[0]
            k += 1
            while True:
                o, literal, kind, lang = resource(tokens[k])
                out.append((s, p, o, literal, kind, lang))
                k += 1
                if tokens[k] != ",":
                    break
                k += 1
            while tokens[k] == ";":
                k += 1
        k += 1
    return out
