"""Bytes and damaged text: encodings, mojibake, combining marks, spacing, and lines that recur from page to page.

Whether bytes begin with a mark, and recurring lines, are native; what has to look at code points one by one runs in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import flat
from .udf import arrow

#: Codes that windows-1252 leaves open stand for the control of the same number.
_WINDOWS = {b: bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
_WINDOWS = {b: chr(b) if c == "�" else c for b, c in _WINDOWS.items()}
_TO_WINDOWS = {c: b for b, c in _WINDOWS.items()}


def mark_length(content: Column) -> Column:
    """How many bytes a byte-order mark takes at the front: 3, 2 or none."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("EFBBBF"), 3).when(head.startswith("FFFE") | head.startswith("FEFF"), 2).otherwise(0)


def guessed(b: bytes) -> tuple[str, float]:
    """An encoding and how sure that is: a mark settles it, then valid UTF-8, zeros at every other place, and the bytes of C1."""
    if not b:
        return "utf-8", 0.0
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if b.startswith(mark):
            return name, 1.0
    try:
        b.decode("utf-8")
        return "utf-8", 1.0 if b.isascii() else 0.95
    except UnicodeDecodeError:
        pass
    whole = b[: len(b) // 2 * 2]
    if len(whole) >= 4:
        first, second = whole[::2].count(0), whole[1::2].count(0)
        if second > len(whole) // 4 and not first:
            return "utf-16le", 0.8
        if first > len(whole) // 4 and not second:
            return "utf-16be", 0.8
    return ("windows-1252" if any(0x80 <= c <= 0x9F for c in b) else "iso-8859-1"), 0.6


def decoded(b: bytes, name: str | None = None) -> str:
    """Text under a named encoding, or under the guess where the name is unknown; never fails."""
    own, plain = (name or "").lower(), guessed(b)[0]
    b = b[3 if b.startswith(b"\xef\xbb\xbf") else 2 if b[:2] in (b"\xff\xfe", b"\xfe\xff") else 0 :]
    own = {"utf8": "utf-8", "latin-1": "iso-8859-1", "latin1": "iso-8859-1", "iso8859-1": "iso-8859-1", "cp1252": "windows-1252", "windows1252": "windows-1252"}.get(own, own)
    if own not in ("utf-8", "utf-16le", "utf-16be", "iso-8859-1", "windows-1252"):
        own = plain
    if own == "windows-1252":
        return "".join(_WINDOWS.get(c, chr(c)) for c in b)
    if own.startswith("utf-16"):
        b = b[: len(b) // 2 * 2]
    return b.decode(own, "replace")


@arrow("encoding string, sure double")
def guess(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([guessed(bytes(b or b"")) for b in content], columns=["encoding", "sure"])


@arrow("string")
def decode(content: pd.Series, name: pd.Series) -> pd.Series:
    """Bytes as text, by a named encoding or the guess."""
    return pd.Series([None if b is None else decoded(bytes(b), n) for b, n in zip(content, name)])


def repaired(text: str, rounds: int = 3) -> str:
    """UTF-8 that was once read as windows-1252 or Latin-1, read back; what was never damaged stays."""
    for _ in range(rounds):
        if text.isascii() or not any(0xC2 <= ord(c) <= 0xF4 for c in text):
            break
        back = [ord(c) if ord(c) < 0x100 else _TO_WINDOWS.get(c) for c in text]
        if None in back:
            break
        try:
            text = bytes(back).decode("utf-8")
        except UnicodeDecodeError:
            break
    return text


@arrow("string")
def _repair(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else repaired(t) for t in text])


@arrow("string")
def _unmarked(text: pd.Series) -> pd.Series:
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    return pd.Series([None if t is None else unicodedata.normalize("NFC", strip(t)) for t in text])


def _beyond_ascii(c: Column, kernel: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), kernel).otherwise(c)


def repair(c: Column) -> Column:
    return _beyond_ascii(c, _repair(c))


def marks(c: Column) -> Column:
    """Letters without their combining marks."""
    return _beyond_ascii(c, _unmarked(c))


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")


def spaced(text: str) -> str:
    """Runs of space as one and blank lines as one, with fenced and indented code left as it stands."""
    out: list[str] = []
    blank: list[str] = []
    fence, code, prose = "", False, False
    for line in re.sub(r"\r\n?|[\u0085  ]", "\n", text).split("\n"):
        if fence:
            out.append(line)
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if all(c == "\t" or unicodedata.category(c) == "Zs" for c in line):
            blank.append(line)
            prose = False
            continue
        width = 0
        for c in line:
            if c not in " \t":
                break
            width += 1 if c == " " else 4 - width % 4
        verbatim = width >= 4 and (code or not prose)
        if blank:
            out += blank if verbatim and code else [""] if out else []
            blank = []
        m = _FENCE.match(line) if width < 4 else None
        if verbatim:
            out.append(line)
            code = True
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            out.append(line)
            fence, code, prose = m[1], False, False
        else:
            code = False
            out.append(re.sub(" +", " ", "".join(" " if c == "\t" or unicodedata.category(c) == "Zs" else c for c in line)).strip())
            prose = width >= 4 or not re.match(r" {0,3}#{1,6}(\s|$)", line)
    return "\n".join(out)


@arrow("string")
def space(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else spaced(t) for t in text])


def line_key(c: Column) -> Column:
    """What tells lines apart: folded, with every run of digits as one sign."""
    return F.regexp_replace(F.lower(flat(c)), r"\d+", "#")


def repeats(pages: DataFrame, share: float = 0.6, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Pages (doc, page, text) without the lines that stand on a share of their document's pages, two at least; digits don't count.

    Lines are counted by page, so a line that a page repeats counts once; a document of one page stays as it is.
    """
    lines = pages.select(doc, page, F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("key", line_key(F.col("line")))
    least = pages.groupBy(doc).agg(F.count("*").alias("_pages")).select(doc, F.when(F.col("_pages") > 1, F.greatest(F.floor(share * F.col("_pages") + 0.5), F.lit(2))).alias("_least"))
    seen = lines.where("key <> ''").select(doc, page, "key").distinct().groupBy(doc, "key").agg(F.count("*").alias("_n"))
    gone = seen.join(least, doc).where("_n >= _least").select(doc, "key")
    kept = lines.join(gone, [doc, "key"], "left_anti").groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return pages.drop("text").join(kept, [doc, page], "left").withColumn("text", F.coalesce(body, F.lit(""))).drop("_l")
