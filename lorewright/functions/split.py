"""Chunking. Without overlap the chunks of a text tile it, byte for byte; each has its byte offsets.

`chars` is native. The other units need a scan with state, so they run in Arrow batches (mapInPandas).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .udf import light

SCHEMA = "doc_id long, idx int, text string, start long, `end` long"


def chars(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Windows of size characters that begin every max(size - overlap, 1)."""
    step = max(size - overlap, 1)
    n = F.length("text")
    begins = F.sequence(F.lit(0), F.greatest(n - (overlap if step > 1 else 0) - 1, F.lit(0)), F.lit(step))
    rows = docs.where(n > 0).select("doc_id", "text", F.posexplode(begins).alias("idx", "at"))
    body = F.substring("text", F.col("at") + 1, F.lit(size))
    start = F.octet_length(F.substring("text", F.lit(1), F.col("at"))).cast("long")
    return rows.select("doc_id", "idx", body.alias("text"), start.alias("start"), (start + F.octet_length(body)).alias("end"))


def word_units(text: str) -> list[tuple[int, int]]:
    """Each word with the white space after it; leading space goes with the first."""
    return _tiled([m.start() for m in re.finditer(r"\S+", text)], text)


def sentence_units(text: str) -> list[tuple[int, int]]:
    """A sentence ends after a run of . ! or ? that white space follows."""
    return _tiled([0, *(m.end() for m in re.finditer(r"[.!?]+[\"')\]]*\s+", text))], text)


def paragraph_units(text: str) -> list[tuple[int, int]]:
    """White space with two line feeds or more parts paragraphs."""
    return _tiled([0, *(m.end() for m in re.finditer(r"\s*\n\s*\n\s*", text))], text)


def heading_units(text: str) -> list[tuple[int, int]]:
    """Before each heading outside fences."""
    starts, fenced, at = [0], False, 0
    for line in text.splitlines(keepends=True):
        if re.match(r" {0,3}(```|~~~)", line):
            fenced = not fenced
        elif not fenced and re.match(r" {0,3}#{1,6}(\s|$)", line):
            starts.append(at)
        at += len(line)
    return _tiled(starts, text)


def code_units(text: str) -> list[tuple[int, int]]:
    """At declarations in the first column."""
    return _tiled([0, *(m.start() for m in re.finditer(r"(?m)^(?:func|def|class|type|struct|interface|enum|impl|fn|public|private|export|async|const|var|let|package|module)\b", text))], text)


def _tiled(starts: list[int], text: str) -> list[tuple[int, int]]:
    if not text:
        return []
    edges = sorted({0, *[s for s in starts if 0 < s < len(text)]})
    if starts and starts[0] > 0 and len(edges) > 1 and edges[1] == starts[0] and not text[: starts[0]].strip():
        edges.remove(starts[0])
    return list(zip(edges, [*edges[1:], len(text)]))


def pack(units: list[tuple[int, int]], cost: Callable[[int, int], float], size: float, overlap: int = 0) -> list[tuple[int, int]]:
    """Merges units while their cost stays within size; the next chunk takes overlap units back, and always moves on."""
    out, i = [], 0
    while i < len(units):
        j = i + 1
        while j < len(units) and cost(units[i][0], units[j][1]) <= size:
            j += 1
        out.append((units[i][0], units[j - 1][1]))
        if j >= len(units):
            break
        i = max(i + 1, j - overlap)
    return out


def recursive(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[tuple[int, int]]:
    """Cut at the first separator that parts it, what is still too long at the next, then packed again."""

    def divide(lo: int, hi: int, level: int) -> list[tuple[int, int]]:
        if hi - lo <= size or level >= len(separators):
            return [(lo, hi)]
        sep = separators[level]
        if not sep:
            return [(k, min(k + size, hi)) for k in range(lo, hi, size)]
        edges, at = [lo], text.find(sep, lo, hi)
        while at >= 0:
            edges.append(at + len(sep))
            at = text.find(sep, at + len(sep), hi)
        edges = sorted({e for e in edges if e < hi})
        return [u for a, b in zip(edges, [*edges[1:], hi]) for u in divide(a, b, level + 1)]

    return pack(divide(0, len(text), 0), lambda a, b: b - a, size) if text else []


def _estimate(text: str) -> int:
    return -(-len(text) // 4)


SPLITTERS: dict[str, Callable[[str, int, int], list[tuple[int, int]]]] = {
    "words": lambda t, n, o: pack(u := word_units(t), lambda a, b: sum(a <= x < b for x, _ in u) if len(u) < 64 else len(t[a:b].split()), n, o),
    "tokens": lambda t, n, o: pack(word_units(t), lambda a, b: _estimate(t[a:b]), n, o),
    "sentences": lambda t, n, o: pack(sentence_units(t), lambda a, b: b - a, n, o),
    "paragraphs": lambda t, n, o: pack(paragraph_units(t), lambda a, b: b - a, n, o),
    "recursive": lambda t, n, o: recursive(t, n),
    "markdown": lambda t, n, o: pack(heading_units(t), lambda a, b: b - a, n, o),
    "code": lambda t, n, o: pack(code_units(t), lambda a, b: b - a, n, o),
}


def register(name: str, splitter: Callable[[str, int, int], list[tuple[int, int]]]) -> None:
    SPLITTERS[name] = splitter


def names() -> list[str]:
    return sorted([*SPLITTERS, "chars"])


def first_of(*splitters: str | Callable[[str, int, int], list[tuple[int, int]]]) -> Callable[[str, int, int], list[tuple[int, int]]]:
    """A splitter, to be registered, that takes the first of others which neither fails nor gives nothing; if all fail, the last failure is raised."""

    def run(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
        failed = None
        for s in splitters:
            try:
                found = (SPLITTERS[s] if isinstance(s, str) else s)(text, size, overlap)
            except Exception as why:
                failed = why
                continue
            if found:
                return found
        if failed:
            raise failed
        return []

    return run


def split(docs: DataFrame, name: str, size: int, overlap: int = 0) -> DataFrame:
    """(doc_id, idx, text, start, end) by a splitter's name; start and end are bytes."""
    if name == "chars":
        return chars(docs, size, overlap)
    kernel = SPLITTERS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                seen, at = 0, 0
                for k, (a, b) in enumerate(kernel(text or "", size, overlap)):
                    start = seen + len(text[at:a].encode()) if a >= at else len(text[:a].encode())
                    seen, at = start, a
                    rows.append((doc_id, k, text[a:b], start, start + len(text[a:b].encode())))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "text", "start", "end"])

    return light(docs.select("doc_id", "text")).mapInPandas(run, SCHEMA)


def by_meaning(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float) -> DataFrame:
    """Sentences joined while neighbours' vectors, which the caller's embed gives, are alike at the threshold or more."""

    def cos(a: list[float], b: list[float]) -> float:
        if len(a) != len(b):
            return 0.0
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                units = sentence_units(text or "")
                vectors = embed([text[a:b] for a, b in units]) if units else []
                cuts = [0, *(k for k in range(1, len(units)) if cos(vectors[k - 1], vectors[k]) < threshold)]
                for i, (k, end) in enumerate(zip(cuts, [*cuts[1:], len(units)])):
                    if units:
                        a, b = units[k][0], units[end - 1][1]
                        rows.append((doc_id, i, text[a:b], len(text[:a].encode()), len(text[:b].encode())))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "text", "start", "end"])

    return light(docs.select("doc_id", "text")).mapInPandas(run, SCHEMA)
