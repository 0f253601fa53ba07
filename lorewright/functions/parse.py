"""Documents to text and structure: pure functions of one document, run in Arrow batches.

Each gives (text, title, sections, links, fields): sections are (title, level, start, end) and tile the text by characters.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow

PARSED = "text string, title string, sections array<struct<title:string,level:int,start:int,end:int>>, links array<struct<text:string,target:string>>, fields map<string,string>, error string"
BUDGET = 1 << 28  # bytes that a zipped document may unpack to


class FormatError(ValueError):
    """A format that is not read."""


def _out(text: str, title: str = "", heads: list[tuple[str, int, int]] | None = None, links: list[tuple[str, str]] | None = None, fields: dict[str, str] | None = None) -> dict:
    heads = heads or []
    ends = [*[h[2] for h in heads[1:]], len(text)]
    return {"text": text, "title": title, "sections": [{"title": t, "level": n, "start": s, "end": e} for (t, n, s), e in zip(heads, ends)], "links": [{"text": t, "target": u} for t, u in links or []], "fields": fields or {}, "error": None}


def plain(raw: str) -> dict:
    return _out(re.sub(r"\r\n?", "\n", raw))


def markdown(raw: str) -> dict:
    text = re.sub(r"\r\n?", "\n", raw)
    fields, heads, links, refs = {}, [], [], {}
    if m := re.match(r"---\n(.*?)\n---\n", text, re.S):
        fields = dict(re.findall(r"(?m)^([\w-]+):\s*(.*)$", m[1]))
        text = text[m.end() :]
    fenced, at, previous = False, 0, ("", 0)
    for line in text.splitlines(keepends=True):
        if re.match(r" {0,3}(```|~~~)", line):
            fenced = not fenced
        elif not fenced:
            if m := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
                heads.append((m[2], len(m[1]), at))
            elif (m := re.match(r" {0,3}(=+|-+)\s*$", line)) and previous[0].strip():
                heads.append((previous[0].strip(), 1 if m[1][0] == "=" else 2, previous[1]))
            if m := re.match(r" {0,3}\[([^\]]+)\]:\s*(\S+)", line):
                refs[m[1].lower()] = m[2]
            links += re.findall(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)", line)
            links += [(t, f"\0{r or t}") for t, r in re.findall(r"(?<!!)\[([^\]]+)\]\[([^\]]*)\]", line)]
        previous = (line, at)
        at += len(line)
    links = [(t, refs.get(u[1:].lower(), "") if u.startswith("\0") else u) for t, u in links]
    return _out(text, heads[0][0] if heads else fields.get("title", ""), heads, links, fields)


class _Html(HTMLParser):
    BLOCK = set("p div h1 h2 h3 h4 h5 h6 li ul ol table tr section article header footer nav br blockquote pre td th".split())
    DROP = {"script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.heads, self.links, self.fields, self.title, self.skip, self.head, self.link, self.in_title = [], [], [], {}, "", 0, None, None, False

    def size(self) -> int:
        return sum(map(len, self.parts))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.DROP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and a.get("name") and a.get("content"):
            self.fields[a["name"]] = a["content"]
        elif tag == "a" and a.get("href"):
            self.link = (a["href"], len(self.parts))
        if tag in self.BLOCK:
            self.newline()
        if re.fullmatch("h[1-6]", tag):
            self.head = (int(tag[1]), self.size(), len(self.parts))

    def newline(self):
        if self.parts and not "".join(self.parts[-1:]).endswith("\n"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.link:
            self.links.append((" ".join("".join(self.parts[self.link[1] :]).split()), self.link[0]))
            self.link = None
        if re.fullmatch("h[1-6]", tag) and self.head:
            self.heads.append((" ".join("".join(self.parts[self.head[2] :]).split()), self.head[0], self.head[1]))
            self.head = None
        if tag in self.BLOCK:
            self.newline()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip and (text := re.sub(r"\s+", " ", data)) and (text != " " or self.parts and not self.parts[-1].endswith((" ", "\n"))):
            self.parts.append(text)


def page(raw: str) -> dict:
    p = _Html()
    p.feed(raw)
    p.close()
    return _out("".join(p.parts).strip("\n"), p.title.strip(), p.heads, p.links, p.fields)


def flatten(value: object, path: str = "") -> list[tuple[str, str]]:
    """path: value lines, keys sorted, list places numbered; numbers keep their digits."""
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in flatten(value[k], f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in flatten(v, f"{path}[{k}]")]
    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return [(path, text)]


def _json(raw: str) -> object:
    return json.loads(raw, parse_float=str, parse_int=str)


def structured(raw: str) -> dict:
    rows = flatten(_json(raw))
    return _out("\n".join(f"{k}: {v}" for k, v in rows), fields=dict(rows))


def json_lines(raw: str) -> dict:
    return _out("\n\n".join("\n".join(f"{k}: {v}" for k, v in flatten(_json(line))) for line in raw.splitlines() if line.strip()))


def table(raw: str) -> dict:
    raw = raw.lstrip("﻿")
    first = raw.splitlines()[:2]
    sep = max(",\t;|", key=lambda c: (min((line.count(c) for line in first), default=0), -",\t;|".index(c)))
    rows = [r for r in csv.reader(io.StringIO(raw), delimiter=sep) if r]
    if not rows:
        return _out("")
    return _out("\n\n".join("\n".join(f"{h}: {v}" for h, v in zip(rows[0], r)) for r in rows[1:]))


def xml(raw: str) -> dict:
    lines: list[tuple[str, str]] = []

    def lay(node: ElementTree.Element, path: str) -> None:
        for k, v in node.attrib.items():
            lines.append((f"{path}@{k}", v))
        if (node.text or "").strip():
            lines.append((path, " ".join(node.text.split())))
        names = [c.tag for c in node]
        seen: dict[str, int] = {}
        for c in node:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            lay(c, f"{path}/{c.tag}" + (f"[{seen[c.tag]}]" if names.count(c.tag) > 1 else ""))

    if re.search(r"<!ENTITY", raw):
        raise FormatError("entity declarations are not read")
    root = ElementTree.fromstring(raw)
    lay(root, root.tag)
    return _out("\n".join(f"{k}: {v}" for k, v in lines), fields=dict(lines))


def mail(raw: str) -> dict:
    m = email.message_from_string(raw, policy=email.policy.default)
    part = m.get_body(preferencelist=("plain", "html"))
    body = part.get_content() if part else ""
    text = page(body)["text"] if part and part.get_content_subtype() == "html" else body.replace("\r\n", "\n")
    return _out(text, m.get("subject", "") or "", fields={k.lower(): str(v) for k, v in m.items()})


def _package(raw: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(raw))
    if sum(i.file_size for i in z.infolist()) > BUDGET:
        raise FormatError("the package unpacks to more than its budget")
    return z


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx(raw: bytes) -> dict:
    root = ElementTree.fromstring(_package(raw).read("word/document.xml"))
    text, heads = "", []
    for p in root.iter(f"{_W}p"):
        own = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if style is not None and (m := re.fullmatch(r"Heading([1-9])", style.get(f"{_W}val", ""))):
            heads.append((own, int(m[1]), len(text)))
        text += own + "\n"
    return _out(text.rstrip("\n"), heads[0][0] if heads else "", heads)


def pptx(raw: bytes) -> dict:
    z = _package(raw)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    text, heads = "", []
    for k, n in enumerate(slides):
        lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p")]
        heads.append((next((x for x in lines if x), f"Slide {k + 1}"), 1, len(text)))
        text += "\n".join(x for x in lines if x) + "\n\n"
    return _out(text, heads[0][0] if heads else "", heads)


def xlsx(raw: bytes) -> dict:
    z = _package(raw)
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    text, heads = "", []
    for k, name in enumerate(names):
        if (path := f"xl/worksheets/sheet{k + 1}.xml") not in z.namelist():
            continue
        heads.append((name, 1, len(text)))
        rows = []
        for r in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
            cells = []
            for c in r.iter(f"{_S}c"):
                v, kind = c.find(f"{_S}v"), c.get("t")
                own = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else (v.text if v is not None else "") or ""
                cells.append(shared[int(own)] if kind == "s" and own else {"1": "true", "0": "false"}.get(own, own) if kind == "b" else own)
            rows.append(cells)
        for r in rows[1:]:
            text += "\n".join(f"{h}: {v}" for h, v in zip(rows[0], r)) + "\n\n"
    return _out(text, heads[0][0] if heads else "", heads)


FORMATS: dict[str, Callable[[str], dict]] = {"text": plain, "markdown": markdown, "html": page, "json": structured, "jsonl": json_lines, "csv": table, "xml": xml, "email": mail}
PACKAGES: dict[str, Callable[[bytes], dict]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx}
_BY_NAME = {"txt": "text", "md": "markdown", "markdown": "markdown", "htm": "html", "html": "html", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "csv": "csv", "tsv": "csv", "xml": "xml", "eml": "email", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx"}


def register(name: str, parser: Callable[[str], dict]) -> None:
    FORMATS[name] = parser


def detect(name: Column, content: Column) -> Column:
    """The format by extension, else by how the content begins."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for p in _BY_NAME.items() for x in p])
    head = F.ltrim(F.substring(content, 1, 200))
    sniffed = F.when(head.rlike(r"^PK"), "docx").when(head.rlike(r"^%PDF-"), "pdf").when(head.rlike(r"(?i)^<(!doctype html|html)"), "html").when(head.startswith("<"), "xml")
    sniffed = sniffed.when(head.rlike(r"^[\[{]"), "json").when(head.rlike(r"^(From|Return-Path|Received|Subject|Date|To): "), "email").when(head.startswith("#"), "markdown").otherwise("text")
    return F.coalesce(known[suffix], sniffed)


def _parsed(kind: str, raw: object) -> dict:
    try:
        if kind in PACKAGES:
            return PACKAGES[kind](bytes(raw))
        if kind not in FORMATS:
            raise FormatError(f"{kind} is not read")
        return FORMATS[kind](raw.decode("utf-8", "replace") if isinstance(raw, (bytes, bytearray)) else raw or "")
    except Exception as why:  # a document that cannot be read is a row with its reason
        return {**_out(""), "error": f"{type(why).__name__}: {why}"}


@arrow(PARSED)
def parse(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parsed(k, c) for k, c in zip(kind, content)], columns=["text", "title", "sections", "links", "fields", "error"])


def unescape(text: str) -> str:
    return html.unescape(text)
