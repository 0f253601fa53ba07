"""SimHash near-deduplication by random bit sampling.

1. Every document gets the set of its five-word shingles, a 128-bit identity of that set and a 128-bit SimHash. Documents of
   one shingle set are one class of copies; a class goes on as one representative and is never expanded into pairs.
2. TABLES tables each sample BITS random coordinates of the SimHash and group representatives by them. At similarity 0.8 two
   SimHashes differ in about 19 of 128 bits, and even pairs that chance sets 27 bits apart meet in a table in 99.6 of 100 cases.
   A bucket of more than CAP members is hot. It is dealt by ADDED further coordinates, in SUBTABLES ways, to find crowds: where
   more than CAP still agree, all are joined to the smallest one as candidates, which can only add work. Members of the bucket's
   largest part of such joins are connected already; every other member is compared with all members, in blocks against blocks,
   so a pair that meets in a hot bucket is found as surely as one that meets in a small one.
3. Within a bucket pairs of Hamming distance RADIUS or less, of sizes that allow the similarity, are candidates; only a spanning forest of them is emitted.
4. Components of candidates are brought together with their texts and linked exactly: two sets are linked at a Jaccard
   similarity of 0.8 or more. Inside a group leaders are compared with all members, until every member outside the largest
   linked part has been a leader; pairs inside the part are connected already, so no link can be lost, and no pairs are listed.
   A component of more than TILE members or TILE_SHINGLES shingles is dealt into tiles that share HUBS members, and afterwards each member outside the
   largest part is compared with every tile, in blocks.

Defined results: null and empty texts, and texts without a word, have no shingles and stay alone; a text of one to four words
has one shingle, all its words; the smallest doc_id of a class stays; a null id is below all others; rows that repeat an id
are one document; an empty table gives no rows; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import whole_groups
from .textkit import U64, Stored, components, cut, distinct, flat, joined, light, mix, pieces, shingles, signed, words

WORDS, SIMILARITY = 5, 0.8
TABLES, BITS, ADDED, SUBTABLES, CAP, RADIUS = 96, 12, 8, 4, 4096, 32
TILE, TILE_SHINGLES, HUBS = 2000, 1_500_000, 32
_FLOOR = -(1 << 63)
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_coins = np.random.default_rng(20240229)
_SAMPLES = np.stack([_coins.permutation(128)[: BITS + ADDED * SUBTABLES] for _ in range(TABLES)])


def simhash(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two uint64 halves of each row's 128-bit SimHash; hashes are grouped by row."""
    sizes = np.bincount(rows, minlength=n)
    out = np.zeros((n, 16), np.uint8)
    full = np.flatnonzero(sizes)
    if len(full):
        ends = np.cumsum(sizes[full])
        parts = (sizes[full] + 254) // 255  # a lane of eight bits counts up to 255
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = np.repeat(ends - sizes[full], parts) + 255 * at
        bits = np.stack([hashes, mix(hashes ^ U64(0x5851F42D4C957F2D))], 1).view(np.uint8)
        for k in range(16):
            sums = np.add.reduceat(_LANES[bits[:, k]], begins).view(np.uint8).reshape(-1, 8).astype(np.int32)
            counts = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)
            out[full, k] = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little")[:, 0]
    halves = out.view(np.uint64)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        n = batch.num_rows
        hashes, rows, *_ = words(*flat(batch.column("text")))
        grams, owner, _ = shingles(hashes, rows, n, WORDS)
        grams, owner = distinct(grams, owner)
        sizes = np.bincount(owner, minlength=n)
        sums = []
        for salt in (0x2545F4914F6CDD1D, 0x6C62272E07BB0142):
            total = np.concatenate([[U64(0)], np.cumsum(mix(grams ^ U64(salt)))])
            ends = np.cumsum(sizes)
            sums.append(total[ends] - total[ends - sizes])
        f1, f2 = simhash(grams, owner, n)
        columns = [batch.column("id"), *(pa.array(signed(x)) for x in (*sums, f1, f2)), pa.array(sizes.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "k1", "k2", "f1", "f2", "size"])


def sketches(docs: DataFrame) -> DataFrame:
    """id, shingle-set identity (k1, k2, size) and SimHash (f1, f2) of each document."""
    rows = light(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FLOOR)).alias("id"), "text")
    return rows.mapInArrow(_sketch, "id long, k1 long, k2 long, f1 long, f2 long, size long")


def _sampled(f: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of (n, 2) uint64 at places, as one number."""
    out = np.zeros(len(f), np.int64)
    for k, p in enumerate(places):
        out |= (((f[:, p // 64] >> U64(p % 64)) & U64(1)) << U64(k)).astype(np.int64)
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = np.stack([batch.column(c).to_numpy() for c in ("f1", "f2")], 1).view(np.uint64)
        for t in range(TABLES):
            keys = t << BITS | _sampled(f, _SAMPLES[t, :BITS])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c) for c in ("id", "f1", "f2", "size"))], ["bucket", "id", "f1", "f2", "size"])


def _subbuckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f, bucket = np.stack([batch.column(c).to_numpy() for c in ("f1", "f2")], 1).view(np.uint64), batch.column("bucket").to_numpy()
        for t in np.unique(bucket >> BITS):
            here = np.flatnonzero(bucket >> BITS == t)
            for e in range(SUBTABLES):
                more = _sampled(f[here], _SAMPLES[t, BITS + ADDED * e : BITS + ADDED * (e + 1)])
                keys = pa.array(((bucket[here] * SUBTABLES + e) << ADDED | more) | 1 << 60)
                own = batch.take(pa.array(here))
                yield pa.RecordBatch.from_arrays([keys, *(own.column(c) for c in ("id", "f1", "f2", "size"))], ["bucket", "id", "f1", "f2", "size"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["bucket"]):
        bucket, ids = table.column("bucket").to_numpy(), table.column("id").to_numpy()
        f1, f2 = (table.column(c).to_numpy().view(np.uint64) for c in ("f1", "f2"))
        size = table.column("size").to_numpy()
        n, label, live, held, step = len(ids), np.arange(len(ids)), np.arange(len(ids)), [], 1
        while True:
            live = live[live + step < n]
            live = live[bucket[live] == bucket[live + step]]
            if not len(live):
                break
            a, b = size[live], size[live + step]
            near = live[10 * np.minimum(a, b) >= 8 * np.maximum(a, b)]  # sets whose sizes differ more cannot be that similar
            near = near[np.bitwise_count(f1[near] ^ f1[near + step]) + np.bitwise_count(f2[near] ^ f2[near + step]) <= RADIUS]
            near = near[label[near] != label[near + step]]
            held.append((near, near + step))
            if sum(len(a) for a, _ in held) > 200_000:
                held.append((np.arange(n), label))
                label, held = joined(n, *(np.concatenate(x) for x in zip(*held))), []
            step += 1
        held.append((np.arange(n), label))
        label = joined(n, *(np.concatenate(x) for x in zip(*held)))
        edge = np.flatnonzero(label != np.arange(n))
        if len(edge):
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[edge]]), pa.array(ids[edge])], ["a", "b"])


def _near_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _near for cells (x, y) of a hot bucket: members of block x against members of block y."""
    for table in whole_groups(batches, ["bucket", "x", "y"]):
        bucket, x, y, block, ids, size, f1, f2 = (table.column(c).to_numpy() for c in ("bucket", "x", "y", "block", "id", "size", "f1", "f2"))
        n, f1, f2 = len(ids), f1.view(np.uint64), f2.view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        label, held, many = np.arange(n), [], 0
        for lo, hi in zip(new, [*new[1:], n]):
            left, right = lo + np.flatnonzero(block[lo:hi] == x[lo]), lo + np.flatnonzero(block[lo:hi] == y[lo])
            g1, g2, sizes = f1[right], f2[right], size[right]
            for k in left:
                near = np.flatnonzero(np.bitwise_count(f1[k] ^ g1) + np.bitwise_count(f2[k] ^ g2) <= RADIUS)
                near = near[10 * np.minimum(size[k], sizes[near]) >= 8 * np.maximum(size[k], sizes[near])]
                near = right[near]
                near = near[label[near] != label[k]]
                if len(near):
                    held.append((np.full(len(near), k), near))
                    many += len(near)
                if many > 200_000:
                    held.append((np.arange(n), label))
                    label, held, many = joined(n, *(np.concatenate(e) for e in zip(*held))), [], 0
        held.append((np.arange(n), label))
        label = joined(n, *(np.concatenate(e) for e in zip(*held)))
        edge = np.flatnonzero(label != np.arange(n))
        if len(edge):
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[edge]]), pa.array(ids[edge])], ["a", "b"])


def _hot_edges(large: DataFrame, stars: DataFrame | None) -> DataFrame:
    """Edges among the members (bucket, id, f1, f2, size) of hot buckets, given the candidates that join crowds."""
    if stars is None:
        own = large.withColumns({"part": F.col("id"), "main": F.lit(None).cast("long")})
    else:
        own = large.join(components(stars).select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
        most = own.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
        own = own.join(most, "bucket")
    own = cut(own.select("bucket", "id", "f1", "f2", "size", (~F.col("part").eqNullSafe(F.col("main"))).alias("rest")))
    blocks = lambda of: F.ceil(F.sum(F.when(of, 1).otherwise(0)) / CAP).cast("long")
    own = own.join(own.groupBy("bucket").agg(blocks(F.col("rest")).alias("rests"), blocks(~F.col("rest")).alias("mains")).where("rests > 0"), "bucket")
    # blocks of the rest come first; a block of the largest part meets only those, a block of the rest meets all
    own = own.withColumn("block", F.when(F.col("rest"), F.pmod(F.xxhash64("id", F.lit(7)), "rests")).otherwise(F.col("rests") + F.pmod(F.xxhash64("id", F.lit(7)), "mains")))
    last = F.when(F.col("rest"), F.col("rests") + F.col("mains")).otherwise(F.col("rests")) - 1
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    met = met.select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "f1", "f2", "size")
    return met.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(_near_blocks, "a long, b long")


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold together every pair of reps that meets in a table within RADIUS."""
    kind = "bucket long, id long, f1 long, f2 long, size long"
    rows = reps.select("id", "f1", "f2", "size").mapInArrow(_buckets, kind)
    hot = cut(rows.groupBy("bucket").count().where(F.col("count") > CAP).select("bucket"))
    edges = []
    if hot.limit(1).count():
        large = cut(rows.join(hot, "bucket"))
        parts = large.mapInArrow(_subbuckets, kind)
        crowded = cut(parts.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("a")).where(F.col("n") > CAP))
        stars = None
        if crowded.limit(1).count():
            stars = cut(parts.join(crowded, "bucket").select("a", F.col("id").alias("b")).where("a <> b").distinct())
            edges.append(stars)
        edges.append(_hot_edges(large, stars))
        rows = rows.join(hot, "bucket", "left_anti")
    edges.append(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_near, "a long, b long"))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out.where("a <> b").distinct()


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles numbered densely and grouped by row, where each row's begin, and their number."""
    grams, owner = [], []
    base = 0
    for batch in pieces(iter(table.to_batches())):
        hashes, rows, *_ = words(*flat(batch.column("text")))
        g, o = distinct(*shingles(hashes, rows, batch.num_rows, WORDS)[:2])
        grams.append(g)
        owner.append(o + base)
        base += batch.num_rows
    ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
    sizes = np.bincount(np.concatenate(owner), minlength=base)
    return ids, np.cumsum(sizes) - sizes, sizes


def linked(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, leaders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows as links at SIMILARITY or more do. leaders: rows that alone are compared with all others."""
    n = len(sizes)
    flag, a, b = np.zeros(int(ids.max()) + 2 if len(ids) else 2, bool), [], []
    sums = np.zeros(len(ids) + 1, np.int64)

    def compare(k: int) -> None:
        own = ids[begins[k] : begins[k] + sizes[k]]
        flag[own] = True
        np.cumsum(flag[ids], out=sums[1:])
        flag[own] = False
        shared = sums[begins + sizes] - sums[begins]
        hits = np.flatnonzero((shared > 0) & (shared * 10 >= 8 * (sizes + sizes[k] - shared)))
        hits = hits[hits != k]
        a.append(np.full(len(hits), k))
        b.append(hits)

    if leaders is not None:
        for k in leaders:
            compare(int(k))
    else:
        label, done = np.arange(n), np.zeros(n, bool)
        while not done.all():
            most = np.bincount(label, minlength=n).argmax()
            rest = np.flatnonzero(~done & (label != most)) if n > 1 and np.count_nonzero(label == most) > 1 else np.flatnonzero(~done)
            if not len(rest):
                break
            compare(int(rest[0]))
            done[rest[0]] = True
            label = joined(n, np.concatenate([b[-1], np.arange(n)]), np.concatenate([a[-1], label]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["root", "tile"]):
        root, tile, ids = (table.column(c).to_numpy() for c in ("root", "tile", "id"))
        new = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (tile[1:] != tile[:-1])]))
        for lo, hi in zip(new, [*new[1:], len(root)]):
            part = table.slice(lo, hi - lo)
            lead = part.column("lead").to_numpy(zero_copy_only=False)
            a, b = linked(*_sets(part), np.flatnonzero(lead) if lead.any() else None)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + a]), pa.array(ids[lo + b])], ["a", "b"])


def _grouped(rows: DataFrame) -> DataFrame:
    kept = rows.select("root", "tile", "id", "lead", "text").repartition("root", "tile").sortWithinPartitions("root", "tile", "id")
    return kept.mapInArrow(_link_groups, "a long, b long")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, root) of representatives that are linked with another; components of exact links."""
    groups = components(candidates(reps)).withColumnRenamed("node", "id")
    groups = groups.join(reps.select("id", "size"), "id")
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("long")
    groups = cut(groups.join(groups.groupBy("root").agg(F.count("*").alias("members"), tiles.alias("tiles")), "root").drop("size"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FLOOR)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    tables = Stored(docs.sparkSession)
    rows = tables.put("candidate-texts", texts.join(groups, "id"))  # dealt more than once
    tiles = F.col("tiles")
    # in a component of more than a tile, members of small hashes stand in all its tiles
    everywhere = F.pmod(F.xxhash64("id", F.lit(3)), F.col("members")) < HUBS
    own = F.array(F.pmod(F.xxhash64("id", F.lit(5)), tiles))
    if not (groups.agg(F.max("tiles")).first()[0] or 0) > 1:
        return _joined(_grouped(rows.select("root", F.lit(0).alias("tile"), "id", F.lit(False).alias("lead"), "text")), tables)
    dealt = rows.select("root", "id", "text", F.explode(F.when(everywhere & (tiles > 1), F.sequence(F.lit(0).cast("long"), tiles - 1)).otherwise(own)).alias("tile"), F.lit(False).alias("lead"))
    edges = cut(_grouped(dealt))
    parts = components(edges).select(F.col("node").alias("id"), F.col("root").alias("part"))
    wide = cut(groups.where("tiles > 1").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")))
    counts = wide.groupBy("root", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    rest = wide.join(main, "root").where("part <> main").select("id", "root", "tiles")
    # each of the rest leads in every block of every tile; a block holds TILE of the rest at most on average
    blocks = rest.groupBy("root").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    if not blocks.limit(1).count():
        return _joined(edges, tables)
    t, k = F.col("tile").cast("long"), F.col("block")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    follow = rows.join(blocks, "root").select("root", "id", "text", own[0].alias("tile"), "blocks", every)
    lead = rows.join(rest.select("id"), "id", "left_semi").join(blocks, "root").select("root", "id", "text", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).alias("block"), "blocks", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"))
    key = (t * F.col("blocks") + k).alias("tile")
    more = _grouped(follow.select("root", key, "id", F.lit(False).alias("lead"), "text").union(lead.select("root", key, "id", F.lit(True).alias("lead"), "text")))
    return _joined(edges.union(more), tables)


def _joined(edges: DataFrame, tables: Stored) -> DataFrame:
    """Components of edges; the texts that the edges were found in go."""
    out = components(edges)
    tables.drop("candidate-texts")
    return out


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept: one row for each row of docs."""
    rows = cut(sketches(docs))
    classes = rows.where("size > 0").groupBy("k1", "k2", "size").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min_by(F.struct("f1", "f2"), "id").alias("f"))
    classes = cut(classes.select("k1", "k2", "size", "id", "n", "f.f1", "f.f2"))
    found = links(docs, classes).select(F.col("node").alias("id"), "root")
    named = classes.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    totals = named.groupBy("root").agg(F.sum("n").alias("total"))
    named = named.join(totals, "root").select("k1", "k2", "size", "root", "total")
    out = rows.join(named, ["k1", "k2", "size"], "left")
    root, kind = F.coalesce("root", "id"), docs.schema["doc_id"].dataType
    real = lambda c: F.when(c != _FLOOR, c).cast(kind)
    return out.select(real(F.col("id")).alias("doc_id"), real(root).alias("class_id"), F.coalesce("total", F.lit(1)).cast("long").alias("class_size"), (F.col("id") == root).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class; all columns stay."""
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
