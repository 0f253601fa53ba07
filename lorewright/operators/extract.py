"""Entities, relations and triples from chunks (doc_id, idx, text), with the characters they stand at."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udf import light

ENTITIES = "doc_id long, idx int, text string, label string, start int, `end` int, score double"
RELATIONS = "doc_id long, idx int, subject string, predicate string, object string, start int, `end` int, score double"
_SHAPES = [
    ("MONEY", re.compile(r"[$€£]\s?\d[\d,]*(?:\.\d+)?(?:\s(?:million|billion))?|\b\d[\d,]*(?:\.\d+)?\s(?:USD|EUR|GBP|dollars|euros)\b")),
    ("PERCENT", re.compile(r"\b\d+(?:\.\d+)?\s?(?:%|percent\b)")),
    ("DATE", re.compile(r"\b(?:\d{4}-\d{2}-\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s\d{1,2},?\s\d{4})\b")),
    ("ORG", re.compile(r"\b(?:[A-Z][\w&]*\s){1,4}(?:Inc|Corp|Ltd|LLC|GmbH|University|Institute|Company|Bank)\b\.?")),
    ("PERSON", re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Prof)\.\s[A-Z]\w+(?:\s[A-Z]\w+)?")),
    ("GPE", re.compile(r"(?<=\bin )[A-Z][a-z]+(?:\s[A-Z][a-z]+)?")),
]
FORMS = {"founded": ["founded", "established", "started"], "works_for": ["works for", "works at", "is employed by", "joined"], "located_in": ["is located in", "is based in", "lies in"], "acquired": ["acquired", "bought", "took over"], "part_of": ["is part of", "belongs to"]}
_PRONOUNS = re.compile(r"\b(he|she|it|they|him|her|them|his|hers|its|their)\b", re.I | re.A)


def sift(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The best spans that do not meet: by score, length, start, label."""
    kept: list[tuple[int, int, str, float]] = []
    for s in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def spans(text: str, gazetteer: dict[str, str], least: float = 0.0) -> list[tuple[int, int, str, float]]:
    found = [(m.start(), m.end(), label, 0.75) for label, shape in _SHAPES for m in shape.finditer(text)]
    for name, label in gazetteer.items():
        found += [(m.start(), m.end(), label, 0.9) for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text)]
    return [s for s in sift(found) if s[3] >= least]


def entities(chunks: DataFrame, gazetteer: dict[str, str], least: float = 0.0) -> DataFrame:
    """Gazetteer names (.9) and shapes (.75), the best that do not meet. The gazetteer travels with the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, t[a:b], label, a, b, score) for d, i, t in zip(pdf.doc_id, pdf.idx, pdf.text.fillna("")) for a, b, label, score in spans(t, gazetteer, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "text", "label", "start", "end", "score"])

    return light(chunks.select("doc_id", "idx", "text")).mapInPandas(run, ENTITIES)


def relations(chunks: DataFrame, gazetteer: dict[str, str], score: float = 0.8) -> DataFrame:
    """subject verb object with both ends among the chunk's entities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, i, t in zip(pdf.doc_id, pdf.idx, pdf.text.fillna("")):
                own = spans(t, gazetteer)
                for (a0, a1, *_), (b0, b1, *_) in zip(own, own[1:]):
                    middle = t[a1:b0].strip().lower()
                    for predicate, verbs in FORMS.items():
                        if middle in verbs:
                            rows.append((d, i, t[a0:a1], predicate, t[b0:b1], a0, b1, score))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "subject", "predicate", "object", "start", "end", "score"])

    return light(chunks.select("doc_id", "idx", "text")).mapInPandas(run, RELATIONS)


def fit(between: str, preds: list[str]) -> tuple[str, float]:
    """The predicate most like the words between two entities, 1 where they name it whole; ties go to the first."""
    low, best = between.lower(), ("", 0.0)
    for p in preds:
        want = p.lower()
        if want:
            named = re.search(rf"(?<![A-Za-z0-9_]){re.escape(want)}(?![A-Za-z0-9_])", low)
            score = 1.0 if named else ratio(want, low)
            best = (p, score) if score > best[1] else best
    return best


def gap(chunks: DataFrame, found: DataFrame, preds: list[str] | None = None, most: int = 100, least: float = 0.6) -> DataFrame:
    """Pairs of a chunk's entities of different names at most so many characters apart, in order.

    Without preds the predicate is related_to; with preds it is the one of them that resembles the words between by least or more,
    and pairs without such, or without words between, are none.
    """
    a, b = (found.select("doc_id", "idx", *[F.col(c).alias(f"{c}_{n}") for c in ("text", "start", "end")]) for n in "ab")
    near = a.join(b, ["doc_id", "idx"]).where((F.col("start_b") >= F.col("end_a")) & (F.col("start_b") - F.col("end_a") <= most) & (F.lower("text_a") != F.lower("text_b")))
    near = near.join(chunks.select("doc_id", "idx", "text"), ["doc_id", "idx"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, i, t, x, y, x0, x1, y0, y1 in zip(pdf.doc_id, pdf.idx, pdf.text, pdf.text_a, pdf.text_b, pdf.start_a, pdf.end_a, pdf.start_b, pdf.end_b):
                predicate, score, between = "related_to", 0.6, None
                if preds:
                    between = t[x1:y0].strip()
                    predicate, score = fit(between, preds) if between else ("", -1.0)
                    if score < least:
                        continue
                rows.append((d, i, x, predicate, y, score, y0 - x1, between, t[max(x0 - 30, 0) : y1 + 30]))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "subject", "predicate", "object", "score", "gap", "between", "context"])

    return near.mapInPandas(run, "doc_id long, idx int, subject string, predicate string, object string, score double, gap int, between string, context string")


def mentions(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, idx, text, start, name): entities under their own name, pronouns without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, m[0], m.start()) for d, i, t in zip(pdf.doc_id, pdf.idx, pdf.text.fillna("")) for m in _PRONOUNS.finditer(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "text", "start"])

    said = light(chunks.select("doc_id", "idx", "text")).mapInPandas(run, "doc_id long, idx int, text string, start int").withColumn("name", F.lit(None).cast("string"))
    return said.union(found.select("doc_id", "idx", "text", "start", F.col("text").alias("name")))


def refer(said: DataFrame) -> DataFrame:
    """Each pronoun with the nearest name before it: an as-of join as a window."""
    before = Window.partitionBy("doc_id", "idx").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return said.withColumn("refers", F.last("name", ignorenulls=True).over(before)).where("name is null").drop("name")


def chains(referred: DataFrame) -> DataFrame:
    """(doc_id, idx, refers, size): a name with what refers to it, two mentions at least."""
    return referred.where("refers is not null").groupBy("doc_id", "idx", "refers").agg((F.count("*") + 1).alias("size"))


def report(found: DataFrame, least: float) -> DataFrame:
    """One row: how many entities, how many below the floor, and whether all is well."""
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("score") < least).alias("low"), F.round(F.avg("score"), 6).alias("score")).withColumn("ok", F.col("low") == 0)


def allowed(rel: DataFrame, predicates: list[str]) -> tuple[DataFrame, DataFrame]:
    """Relations whose predicate a vocabulary has, and the rest."""
    table = F.broadcast(rel.sparkSession.createDataFrame([(p,) for p in predicates], "predicate string"))
    return rel.join(table, "predicate", "left_semi"), rel.join(table, "predicate", "left_anti")


def ratio(a: str, b: str) -> float:
    """2M/T by longest common blocks, no junk heuristic."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def nearest(name: str, names: list[str], synonyms: dict[str, str] | None = None) -> tuple[str | None, float]:
    """Exact 1, synonym .95, containment .9 s/l + .1 (a whole word .88 at least), else likeness."""
    folded, best = name.lower().strip(), (None, 0.0)
    for n in names:
        other = n.lower().strip()
        if other == folded:
            return n, 1.0
        if (synonyms or {}).get(folded) == other:
            s = 0.95
        elif folded and other and (folded in other or other in folded):
            short, long = sorted((folded, other), key=len)
            s = 0.9 * len(short) / len(long) + 0.1
            if re.search(rf"(?<!\w){re.escape(short)}(?!\w)", long):
                s = max(s, 0.88)
        else:
            s = ratio(folded, other)
        if s > best[1]:
            best = n, s
    return best


def by_model(chunks: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Triples from a model's answer, a JSON list of {subject, predicate, object, score}, mended where it is cut off."""
    import json

    def mend(raw: str) -> list[dict]:
        raw = re.sub(r"^```\w*|```$", "", raw.strip())
        start = raw.find("[")
        for end in [len(raw), *[m.end() for m in re.finditer(r"\}", raw)][::-1]] if start >= 0 else []:
            try:
                out = json.loads(raw[start:end] + ("" if raw[start:end].rstrip().endswith("]") else "]"))
                return [x for x in out if isinstance(x, dict)]
            except ValueError:
                continue
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, i, t in zip(pdf.doc_id, pdf.idx, pdf.text.fillna("")):
                for x in mend(model(t)):
                    if all(str(x.get(k) or "").strip() for k in ("subject", "predicate", "object")):
                        rows.append((d, i, str(x["subject"]), str(x["predicate"]), str(x["object"]), 0, len(t), min(max(float(x.get("score") or 0), 0), 1)))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "subject", "predicate", "object", "start", "end", "score"])

    return light(chunks.select("doc_id", "idx", "text")).mapInPandas(run, RELATIONS)


def find(chunks: DataFrame, *finders: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Entities of several finders: of spans that meet in a chunk the best stay, by score, length and start."""
    every = finders[0](chunks)
    for f in finders[1:]:
        every = every.unionByName(f(chunks))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        text = {(a, b): t for a, b, t in zip(pdf.start, pdf.end, pdf.text)}
        kept = sift(list(zip(pdf.start, pdf.end, pdf.label, pdf.score)))
        return pd.DataFrame([(pdf.doc_id.iloc[0], pdf.idx.iloc[0], text[a, b], label, a, b, s) for a, b, label, s in kept], columns=["doc_id", "idx", "text", "label", "start", "end", "score"])

    return every.groupBy("doc_id", "idx").applyInPandas(best, ENTITIES)  # what one chunk holds


def triples(chunks: DataFrame, *finders: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ord, s, p, o, score, doc, idx): relations of several finders as assertions, equal ones of a chunk once with their best score, in reading order."""
    every = finders[0](chunks)
    for f in finders[1:]:
        every = every.unionByName(f(chunks))
    own = every.groupBy("doc_id", "idx", "subject", "predicate", "object").agg(F.max("score").alias("score"), F.min("start").alias("start"))
    at = F.struct("doc_id", "idx", "start", "subject", "predicate", "object")
    return own.select(F.xxhash64(at).alias("ord"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), "score", F.col("doc_id").cast("string").alias("doc"), "idx")


class SchemaError(ValueError):
    """A vocabulary that contradicts itself."""


class Schema:
    """Classes and properties: predicate -> (domain, range), where none is free. Read back from rows (predicate, domain, range)."""

    def __init__(self, classes: list[str], properties: dict[str, tuple[str | None, str | None]]):
        unknown = {c for pair in properties.values() for c in pair if c is not None} - set(classes)
        if unknown:
            raise SchemaError(f"no class {sorted(unknown)[0]}")
        self.classes, self.properties = classes, properties

    @classmethod
    def read(cls, rows: DataFrame) -> Schema:
        found = rows.select("predicate", "domain", "range").distinct().collect()  # a vocabulary
        return cls(sorted({x for r in found for x in (r[1], r[2]) if x}), {r[0]: (r[1], r[2]) for r in found})

    def allows(self, predicate: str, domain: str | None = None, range_: str | None = None) -> bool:
        if predicate not in self.properties:
            return False
        return all(want is None or got is None or want == got for want, got in zip(self.properties[predicate], (domain, range_)))

    def check(self, rel: DataFrame, kinds: DataFrame) -> DataFrame:
        """Relations with fault: unknown predicate, domain or range, by the kinds (name, label) of their ends; null where all is well or a kind is unknown."""
        table = F.broadcast(rel.sparkSession.createDataFrame([(p, d, r) for p, (d, r) in self.properties.items()], "predicate string, _d string, _r string"))
        kind = lambda end: kinds.groupBy(F.col("name").alias(end)).agg(F.min("label").alias(f"_{end}"))
        rows = rel.join(table.withColumn("_known", F.lit(True)), "predicate", "left").join(kind("subject"), "subject", "left").join(kind("object"), "object", "left")
        fault = F.when(F.col("_known").isNull(), "predicate").when(F.col("_d") != F.col("_subject"), "domain").when(F.col("_r") != F.col("_object"), "range")
        return rows.withColumn("fault", fault).select(*rel.columns, "fault")

    def keep(self, rel: DataFrame, kinds: DataFrame) -> DataFrame:
        return self.check(rel, kinds).where("fault is null").drop("fault")


def chat_body(model: str, system: str, user: str, temperature: float = 0.0, most: int | None = None) -> str:
    """The JSON body of a chat completion."""
    import json

    body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature}
    return json.dumps(body | ({"max_tokens": most} if most else {}), sort_keys=True)


class ChatError(ValueError):
    """An answer that is no completion."""


def chat_answer(status: int, body: str) -> str:
    import json

    try:
        got = json.loads(body)
    except ValueError as why:
        raise ChatError(f"status {status}: not JSON") from why
    if status >= 400 or not isinstance(got, dict) or not got.get("choices"):
        reason = got.get("error", {}).get("message") if isinstance(got, dict) and isinstance(got.get("error"), dict) else None
        raise ChatError(reason or f"status {status}: no choices")
    return got["choices"][0]["message"]["content"] or ""


def chat(send: Callable[[str], tuple[int, str]], model: str, system: str) -> Callable[[str], str]:
    """A model for by_model from a sender of bodies, which the caller brings."""
    return lambda text: chat_answer(*send(chat_body(model, system, text)))
