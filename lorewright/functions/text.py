"""Column expressions on text: folding, clean-up, similarity. All run inside the JVM unless they say otherwise."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow

_QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "–": "-", "—": "-", "−": "-", "…": "...", " ": " "}


def fold(c: Column) -> Column:
    """Lower case with white space collapsed and trimmed, Unicode white space included."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?|[\u0085  ]", "\n")


def control(c: Column) -> Column:
    """Drops C0 and C1 controls but tab and line feed, byte-order marks and soft hyphens."""
    return F.regexp_replace(c, r"[\u0000-\u0008\u000B-\u001F\u007F-\u009F﻿­]", "")


def quotes(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _QUOTES.items(), c)


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tags(c: Column) -> Column:
    """Markup out, the five basic references decoded."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def title(c: Column) -> Column:
    """A capital after any character that is not a letter."""
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.struct(F.substring(c, i, F.lit(1)).alias("now"), F.when(i > 1, F.substring(c, i - 1, F.lit(1))).otherwise(F.lit("")).alias("was")))
    return F.array_join(F.transform(letters, lambda x: F.when(x["was"].rlike(r"\p{L}$"), F.lower(x["now"])).otherwise(F.upper(x["now"]))), "")


@arrow("string")
def normal_form(text: pd.Series, form: pd.Series) -> pd.Series:
    """NFC, NFD, NFKC or NFKD (Arrow batches)."""
    import unicodedata

    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form)])


def form(c: Column, name: str) -> Column:
    """Text outside ASCII goes to Python, the rest stays."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), normal_form(c, F.lit(name))).otherwise(c)


def text(c: Column) -> Column:
    return quotes(control(lines(form(c, "NFC"))))


def clean(c: Column) -> Column:
    return flat(quotes(control(form(tags(c), "NFC"))))


def _words(c: Column) -> Column:
    return F.filter(F.split(fold(c), r"[ _\-\t\n]+"), lambda w: w != "")


def _overlap(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def _bigrams(c: Column) -> Column:
    return F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array(c))


@arrow("double")
def _jaro(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a: str, b: str) -> float:
        window = max(max(len(a), len(b)) // 2 - 1, 0)
        used, mine = [False] * len(b), []
        for i, x in enumerate(a):
            for j in range(max(0, i - window), min(len(b), i + window + 1)):
                if not used[j] and b[j] == x:
                    used[j] = True
                    mine.append(x)
                    break
        m = len(mine)
        if not m:
            return 0.0
        swaps = sum(x != y for x, y in zip(mine, (y for y, u in zip(b, used) if u))) / 2
        plain = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
        prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
        return plain + 0.1 * prefix * (1 - plain)  # the prefix counts at any similarity

    return pd.Series([one(a, b) for a, b in zip(left, right)])


def alike(a: Column, b: Column, metric: str = "jaro") -> Column:
    """Similarity of folded texts from 0 to 1; an empty side gives 0, equal sides 1."""
    x, y = fold(a), fold(b)
    if metric == "exact":
        own = F.lit(0.0)
    elif metric == "edit":
        own = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    elif metric == "gram":
        own = _overlap(F.array_distinct(_bigrams(x)), F.array_distinct(_bigrams(y)))
    elif metric == "token":
        own = _overlap(F.array_distinct(_words(a)), F.array_distinct(_words(b)))
    elif metric == "jaro":
        own = _jaro(x, y)
    else:
        raise ValueError(f"no metric {metric}")
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(own)


def dot(a: Column, b: Column) -> Column:
    """In doubles; the shorter vector counts as padded with zeros."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(y.cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a side is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """(cos + 1) / 2 as entity resolution reads it; vectors of different length score 0."""
    return F.when(F.size(a) == F.size(b), (cosine(a, b) + 1) / 2).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0)))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x * x))


@arrow("string")
def edge_key(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """FNV-1a over three folded parts, a zero byte after each, as sixteen hexadecimal digits."""

    def one(*parts: str) -> str:
        h = 0xCBF29CE484222325
        for part in parts:
            for byte in part.encode() + b"\0":
                h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return pd.Series([one(x, y, z) for x, y, z in zip(a, b, c)])
