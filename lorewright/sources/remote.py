"""Remote vector and triple stores: what is sent and what comes back, as column expressions. The caller brings the transport.

`post` hands a partition's bodies to a caller's sender, so nothing goes through the driver; everything else can be tested offline.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = {"gt": "gt", "ge": "gte", "lt": "lt", "le": "lte"}


def point(ident: Column, vector: Column, meta: Column) -> Column:
    """A point of a vector collection as JSON. Its id is a UUID made from ours, which the payload keeps."""
    h = F.sha2(ident, 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.to_json(F.struct(uuid.alias("id"), vector.alias("vector"), F.struct(ident.alias("_id"), meta.alias("meta")).alias("payload")))


def points(rows: DataFrame, size: int = 256) -> DataFrame:
    """(body): upserts of size points about, dealt by a hash of id, so no task holds them all."""
    parts = max(1, -(-rows.count() // size))
    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("k"), F.struct("id", point(F.col("id"), F.col("vec"), F.col("meta")).alias("p")).alias("x"))
    body = F.concat(F.lit('{"points":['), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), ","), F.lit("]}"))
    return own.groupBy("k").agg(body.alias("body")).select("body")


def conditions(*tests: tuple[str, str, object]) -> dict:
    """A filter in the store's words, from (field, operator, value)."""
    must, must_not = [], []
    for field, op, value in tests:
        key = f"meta.{field}"
        if op in ("eq", "has"):
            must.append({"key": key, "match": {"value": value}})
        elif op == "in":
            must.append({"key": key, "match": {"any": list(value)}})
        elif op == "ne":  # a field that is absent fails here too
            must_not += [{"key": key, "match": {"value": value}}, {"is_empty": {"key": key}}]
        else:
            must.append({"key": key, "range": {_RANGE[op]: value}})
    return {k: v for k, v in (("must", must), ("must_not", must_not)) if v}


def search(vector: list[float], k: int, *tests: tuple[str, str, object]) -> str:
    body = {"vector": vector, "limit": k, "with_payload": True}
    return json.dumps(body | ({"filter": own} if (own := conditions(*tests)) else {}), sort_keys=True)


def hits(answers: DataFrame) -> DataFrame:
    """(ask, rank, id, score) from answers (ask, body)."""
    kind = "struct<result:array<struct<score:double,payload:struct<_id:string>>>>"
    own = answers.select("ask", F.posexplode(F.from_json("body", kind)["result"]).alias("k", "h"))
    return own.select("ask", (F.col("k") + 1).alias("rank"), F.col("h.payload._id").alias("id"), F.col("h.score").alias("score"))


class TermError(ValueError):
    """A term that cannot stand in a query."""


def term(value: Column, literal: bool | Column = False) -> Column:
    """A term that can't break out of its place: addresses with their unsafe signs encoded, literals with theirs escaped."""
    iri = value
    for sign in '%<>"{}|^`\\ \n\r\t':
        iri = F.replace(iri, F.lit(sign), F.lit(f"%{ord(sign):02X}")) if sign != "%" else iri
    text = value
    for sign, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(safe))
    flag = F.lit(literal) if isinstance(literal, bool) else literal
    return F.when(flag, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def inserts(triples: DataFrame, size: int = 500) -> DataFrame:
    """(body): INSERT DATA of size triples about; an object with a colon is an address, any other a literal."""
    line = F.concat_ws(" ", term(F.col("s")), term(F.col("p")), term(F.col("o"), ~F.col("o").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit("."))
    parts = max(1, -(-triples.count() // size))
    own = triples.select(F.pmod(F.xxhash64("s", "p", "o"), F.lit(parts)).alias("k"), F.struct("ord", line.alias("line")).alias("x"))
    return own.groupBy("k").agg(F.concat(F.lit("INSERT DATA {\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), F.lit("\n}")).alias("body")).select("body")


def ask(s: str | None = None, p: str | None = None, o: str | None = None) -> str:
    """SELECT of the triples that agree with the terms given, which are addresses."""
    for v in (s, p, o):
        if v is not None and any(c in v for c in '<>"{}|^`\\ \n\r\t'):
            raise TermError(v)
    place = lambda v, name: f"<{v}>" if v is not None else f"?{name}"
    names = " ".join(f"?{n}" for n, v in (("s", s), ("p", p), ("o", o)) if v is None) or "*"
    return f"SELECT {names} WHERE {{ {place(s, 's')} {place(p, 'p')} {place(o, 'o')} . }}"


def bindings(answers: DataFrame, *names: str) -> DataFrame:
    """(ask, k, names...) from answers (ask, body) in the JSON form of query results; what a row leaves unbound is null."""
    kind = "struct<results:struct<bindings:array<map<string,struct<type:string,value:string>>>>>"
    own = answers.select("ask", F.posexplode(F.from_json("body", kind)["results"]["bindings"]).alias("k", "b"))
    return own.select("ask", "k", *[F.col("b")[n]["value"].alias(n) for n in names])


def post(bodies: DataFrame, send: Callable[[str], tuple[int, str]]) -> DataFrame:
    """(body, status, answer): every body through the caller's sender, on the executors, one after another in a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [send(b) for b in pdf.body]
            yield pd.DataFrame({"body": pdf.body, "status": [s for s, _ in got], "answer": [a for _, a in got]})

    return bodies.select("body").mapInPandas(run, "body string, status int, answer string")
