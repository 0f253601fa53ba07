"""Sources: files, folders, globs, JSON lines, delimited rows, literal text, and a guarded web reader."""

from __future__ import annotations

import ipaddress
import re
import socket
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SizeError(ValueError):
    """A source beyond its bound."""


def _magic(content: Column) -> Column:
    """Media type by how the bytes begin."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("255044462D"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("1F8B"), "application/gzip").otherwise("text/plain")


def _docs(raw: DataFrame) -> DataFrame:
    """(doc_id, source, text, content, origin): UTF-8 where it is, else Latin-1; bytes that are neither text keep content alone."""
    utf8 = F.expr("is_valid_utf8(cast(content as string))")
    text = F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    origin = F.struct(F.col("path").alias("ref"), F.col("length").alias("size"), F.col("modificationTime").alias("mod"), F.sha2("content", 256).alias("hash"), _magic(F.col("content")).alias("mime"))
    return raw.select(F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source"), F.when(_magic(F.col("content")) == "text/plain", text).alias("text"), "content", origin.alias("origin"))


def file(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    if most and rows.where(F.col("length") > most).limit(1).count():
        raise SizeError(f"{path} exceeds {most} bytes")
    return _docs(rows)


def folder(spark: SparkSession, path: str, match: str = "*", skip: str | None = None, least: int = 0, most: int = 0, hidden: bool = False) -> DataFrame:
    """All files below a folder whose name or relative path fits match, then not skip."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    glob_ = lambda p: re.sub(r"\\\*", "[^/]*", re.sub(r"\\\?", "[^/]", re.escape(p)))
    fits = lambda pattern: F.col("path").rlike("(?s)(^|/)" + glob_(pattern) + "$")
    rows = rows.where(fits(match)).where(F.col("length") >= least)
    rows = rows.where(~fits(skip)) if skip else rows
    rows = rows.where(F.col("length") <= most) if most else rows
    return _docs(rows if hidden else rows.where(~name.startswith(".")))


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    return _docs(spark.read.format("binaryFile").load(pattern))


def lines(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """A document for every JSON line; text is a field, or the line."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    text = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    return rows.select(F.sha2("value", 256).alias("doc_id"), F.lit(path).alias("source"), text.alias("text"))


def rows(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """Delimited rows under a header or given column names."""
    found = spark.read.csv(path, sep=sep, header=columns is None, multiLine=True, escape='"')
    return found.toDF(*columns) if columns else found


def text(spark: SparkSession, *bodies: str) -> DataFrame:
    return spark.createDataFrame([(str(k), "text:", b) for k, b in enumerate(bodies)], "doc_id string, source string, text string")


def reader(spark: SparkSession, ref: str, stream: object, chunk: int = 1 << 20, most: int = 32 << 20) -> DataFrame:
    """One document from an open stream, such as stdin, which only the driver can read; beyond most bytes it raises SizeError."""
    body = b""
    while part := stream.read(chunk):
        body += part.encode() if isinstance(part, str) else part
        if len(body) > most:
            raise SizeError(f"{ref} exceeds {most} bytes")
    kind = "path string, modificationTime timestamp, length long, content binary"
    return _docs(spark.createDataFrame([(ref, None, len(body), bytearray(body))], kind))


def func(make: Callable[[str], list[tuple[str, str]]]) -> Callable[[SparkSession, str], DataFrame]:
    """A source, to be registered, from a callable that gives (doc_id, text) for a reference."""

    def run(spark: SparkSession, ref: str) -> DataFrame:
        return spark.createDataFrame([(d, ref, t) for d, t in make(ref)], "doc_id string, source string, text string")

    return run


ORIGIN = ("offset", "size", "mod", "hash", "type", "mime", "status", "at")


def origin(content: Column, mime: Column | None = None, offset: Column | None = None, status: Column | None = None, mod: Column | None = None, at: Column | None = None) -> Column:
    """Where a document came from, as a map that leaves out what is unknown or zero; size always stands."""
    kind = F.regexp_extract(F.coalesce(mime if mime is not None else F.lit(None).cast("string"), _magic(content)), r"([a-z]+)$", 1)
    given = {"offset": F.nullif(offset, F.lit(0)) if offset is not None else None, "size": F.octet_length(content), "mod": mod, "hash": F.sha2(content, 256), "type": kind, "mime": mime if mime is not None else _magic(content), "status": F.nullif(status, F.lit(0)) if status is not None else None, "at": at}
    every = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in given.items() if v is not None]))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def origin_of(meta: Column) -> Column:
    """The origin that a map tells of; fields it doesn't have are null or 0."""
    number = lambda k: F.coalesce(meta[k].try_cast("long"), F.lit(0).cast("long")).alias(k)
    return F.struct(number("offset"), number("size"), meta["mod"].try_cast("timestamp").alias("mod"), F.coalesce(meta["hash"], F.lit("")).alias("hash"), F.coalesce(meta["type"], F.lit("")).alias("type"), F.coalesce(meta["mime"], F.lit("")).alias("mime"), number("status"), meta["at"].try_cast("timestamp").alias("at"))


def internal(host: str, port: int = 80) -> bool:
    """Whether a name leads to a loopback, private, link-local, shared or reserved address; a name that leads nowhere counts as one."""
    try:
        found = {x[4][0] for x in socket.getaddrinfo(host, port, proto=socket.IPPROTO_TCP)}
    except OSError:
        return True
    shared = ipaddress.ip_network("100.64.0.0/10")
    return any((ip := ipaddress.ip_address(a.partition("%")[0])).is_loopback or ip.is_private or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified or ip.version == 4 and ip in shared for a in found)


def web(spark: SparkSession, urls: list[str], get: Callable[[str], tuple[int, bytes]], most: int = 32 << 20) -> DataFrame:
    """Pages by a caller's getter, each address checked first; a status of 400 or more is an error row."""
    out = []
    for u in urls:
        p = urlparse(u)
        if p.scheme not in ("http", "https") or not p.hostname or internal(p.hostname, p.port or 80):
            out.append((u, None, "refused"))
            continue
        status, body = get(u)
        out.append((u, None, f"status {status}") if status >= 400 else (u, None, "too large") if len(body) > most else (u, body.decode("utf-8", "replace"), None))
    return spark.createDataFrame(out, "source string, text string, error string")


REGISTRY: dict[str, Callable[..., DataFrame]] = {"file": file, "dir": folder, "glob": glob, "jsonl": lines, "csv": rows, "text": text, "web": web, "reader": reader}


def register(scheme: str, source: Callable[..., DataFrame]) -> None:
    REGISTRY[scheme] = source


def registered(scheme: str | None = None) -> list[str] | Callable[..., DataFrame]:
    """All schemes, or the source of one."""
    return sorted(REGISTRY) if scheme is None else REGISTRY[scheme]


def unregister(scheme: str) -> bool:
    """Whether there was one."""
    return REGISTRY.pop(scheme, None) is not None


def ingest(spark: SparkSession, scheme: str, *args: object, **options: object) -> DataFrame:
    """By a registered scheme."""
    if scheme not in REGISTRY:
        raise KeyError(f"no source {scheme}")
    return REGISTRY[scheme](spark, *args, **options)
