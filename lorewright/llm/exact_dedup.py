"""Exact deduplication by deterministic block naming.

A text is cut into fixed blocks of eight bytes; sorting gives every distinct block an integer name, and adjacent names are
paired and named again until one name is left for each document. Names come from comparing contents, never from hashing, so
two documents share a name exactly if they are equal.

Naming needs texts together, so it is laid out as a tree. A native pass counts (xxhash64, byte length); equal texts agree on
both, so a document alone under its pair is alone for certain and moves no text. The rest are dealt by the pair and a salt
into tiles of about TILE_BYTES, every tile names its documents and passes one representative of each name on, and the
representatives are dealt again until each pair fits a tile. A group that holds a third of all rows is thus spread over many
tiles, and each further round sees a few thousandths of its rows.

Defined results: null text is empty; empty texts equal each other; of rows that repeat both id and text one document is
meant, and all of them carry the same answer; a null id is below all others; an empty table gives no rows; columns other
than the two named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import cut, flat, light

TILE_BYTES = 512 << 10
_UPPER, _UNDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FLOOR = -(1 << 63)


def names(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One integer for each document; equal integers mean equal bytes."""
    sizes = np.diff(offsets)
    counts = (sizes + 7) // 8 + 1  # the length is a block of its own, which tells padding from zero bytes
    ends = np.cumsum(counts)
    begins = ends - counts
    padded = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, np.uint8)
    padded[np.arange(len(data)) + np.repeat((begins + 1) * 8 - offsets[:-1], sizes)] = data
    blocks = padded.view(np.uint64)
    blocks[begins] = sizes
    while True:
        now = np.unique(blocks, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        if not len(counts) or counts.max() <= 1:
            return now
        half = (counts + 1) // 2
        ends = np.cumsum(half)
        pairs = np.zeros((int(ends[-1]), 2), np.uint64)
        within = np.arange(len(now)) - np.repeat(begins, counts)
        pairs[np.repeat(ends - half, counts) + within // 2, within % 2] = now
        blocks, counts, begins = pairs[:, 0] << np.uint64(32) | pairs[:, 1], half, ends - half


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for k, c in zip(keys, columns):
            new[1:] |= c[1:] != c[:-1]
            new[0] |= not held or held[-1].column(k)[-1].as_py() != c[0]
        if len(at := np.flatnonzero(new)):
            if held or at[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))])
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _name_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["h", "n", "tile"]):
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        label = names(*flat(table.column("body").combine_chunks().cast(pa.large_binary()).view(pa.large_string())))
        tile, ids = table.column("tile").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, label, tile, table.column("n").to_numpy(), table.column("h").to_numpy()))
        last = np.ones(len(order), bool)
        for c in (label, tile, table.column("n").to_numpy(), table.column("h").to_numpy()):
            last[:-1] &= c[order][1:] == c[order][:-1]
        last[:-1] = ~last[:-1]
        last[-1] = True
        group = np.concatenate([[0], np.cumsum(last)[:-1]])
        heads = order[last]
        root, chosen = np.empty(len(order), np.int64), np.zeros(len(order), bool)
        root[order], chosen[heads] = ids[heads][group], True
        body = pa.compute.if_else(pa.array(chosen), table.column("body").combine_chunks(), pa.scalar(None, table.schema.field("body").type))
        yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in ("h", "n", "c", "id", "sha")), pa.array(root), body], ["h", "n", "c", "id", "sha", "root", "body"])


def _share() -> Column:
    """Documents of n bytes in a tile: by its size, but eight, or two of over a megabyte, at least, so that every round has fewer."""
    return F.greatest(F.when(F.col("n") > 1 << 20, 2).otherwise(8), F.expr(f"{TILE_BYTES} div greatest(n, 1)"))


def _tiles(rows: DataFrame, turn: int = 7) -> DataFrame:
    """Rows named within tiles; c is the number of rows under a pair."""
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("c") / _share())).cast("long"))
    dealt = dealt.select("h", "n", "tile", "c", "id", "sha", "body").repartition("h", "n", "tile").sortWithinPartitions("h", "n", "tile")
    return dealt.mapInArrow(_name_tiles, "h long, n long, c long, id long, sha string, root long, body binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    body = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UNDER)
    rows = light(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FLOOR)).alias("id"), body.alias("t"))
    keyed = rows.select("id", F.xxhash64("t").alias("h"), F.octet_length("t").cast("long").alias("n"), F.sha2("t", 256).alias("sha"))
    many = keyed.groupBy("h", "n").agg(F.count("*").alias("c")).where("c > 1")
    many = cut(many)
    alone = keyed.join(many, ["h", "n"], "left_anti").select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), "sha")
    texts = rows.select("id", F.xxhash64("t").alias("h"), F.octet_length("t").cast("long").alias("n"), F.sha2("t", 256).alias("sha"), F.encode("t", "utf-8").alias("body"))
    named = _tiles(texts.join(many, ["h", "n"]))
    most = many.agg(F.max(F.ceil(F.col("c") / _share()))).first()[0] or 0
    named = cut(named)
    links = named.select("h", "n", "id", "sha", "root")
    turn = 7
    while most > 1:  # the last round had a group in more than one tile
        turn += 1
        heads = named.where("body is not null").drop("root")
        crowd = cut(heads.groupBy("h", "n").agg(F.count("*").alias("c")))
        most = crowd.agg(F.max(F.ceil(F.col("c") / _share()))).first()[0]
        named = cut(_tiles(heads.drop("c").join(crowd, ["h", "n"]), turn))
        moved = named.select("h", "n", F.col("id").alias("root"), F.col("root").alias("top"))
        links = links.join(moved.distinct(), ["h", "n", "root"]).select("h", "n", "id", "sha", F.col("top").alias("root"))
    sizes = links.groupBy("h", "n", "root").agg(F.count("*").alias("size"), F.max("id").alias("keep"))
    found = links.join(sizes, ["h", "n", "root"]).select("id", "keep", "size", "sha")
    real = lambda c: F.when(F.col(c) != _FLOOR, F.col(c))
    kind = docs.schema[id_col].dataType
    return alone.union(found).select(
        real("id").cast(kind).alias("doc_id"), real("keep").cast(kind).alias("keep_id"), F.col("size").alias("group_size"), (F.col("id") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row of larger id has; all columns stay."""
    floor = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_FLOOR))
    kept = exact_dedup(docs).where("kept").select(floor("doc_id").alias("_key"), F.col("text_sha256").alias("_sha"))
    own = F.sha2(F.translate(F.coalesce("text", F.lit("")), _UPPER, _UNDER), 256)
    # repeated rows meet by the join's own keys, so dropping them deals nothing again
    out = docs.withColumns({"_key": floor("doc_id"), "_sha": own}).join(kept, ["_key", "_sha"], "left_semi")
    return out.dropDuplicates(["_key", "_sha"]).drop("_key", "_sha")


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""
