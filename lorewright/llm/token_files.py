"""Token-id output: independent zstandard frames with a trailing seek table.

File layout, all integers little-endian. Frames of about FRAME_IDS ids follow each other, each a complete zstandard frame
that holds for its documents: count u32, then presence u8, doc_id i64 and number of ids u32 of each, then all their ids as
u32. A skippable zstandard frame ends the file: one entry a frame (compressed size u32, raw size u32, XXH64 of the raw bytes
u64, first document's ordinal u64), then the number of frames u32 and the magic b"LWSEEK01". A reader takes the table from
the tail, finds the frames of the documents asked for, and decompresses and checks only those.

Documents are dealt by ranges of doc_id, each task sorts its range and writes one file into the shared folder under a
temporary name and then renames it, so a task that runs again replaces the same file with the same bytes. The manifest (one
row a file) gives running totals; reading is one task a file.

Ids are those of the tokenizers library. Between a letter and another character, and before the
last of some white space, a pre-token always ends, so a text whose only white space is spaces and line feeds is cut into
chunks that encode independently, and each worker keeps a table of chunks it has seen. New chunks of the first 256 characters
go through a faster core that is given the merges of the same tokenizer file; tests hold it against the library on whole
tables and random texts. Other chunks, texts with other white space, and texts with the special token's string are given to
the library itself.

Defined results: null and empty texts give the end id alone; a null doc_id comes first; rows of equal id are ordered by text;
an empty table writes no files and gives no rows; columns other than the two named are never read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import light, pieces, workspace

FRAME_IDS = 1 << 17
TABLE_LIMIT = 500_000
MAGIC = b"LWSEEK01"
# letters that no letter of another kind follows, other ink, white space but for the space that goes with what follows
_CHUNK = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7fÀ-ÖØ-öø-ÿ])| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_FIRST = re.compile("[\x00-\xff]*")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENTRY = struct.Struct("<IIQQ")


class Encoder(dict):
    """chunk -> ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.splits = not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.fast = _merger(spec["model"]) if self.splits else None
        self.special = [t["content"] for t in spec["added_tokens"]]

    def ids(self, texts: list[str]) -> list[bytes]:
        plain = [self.splits and not _OTHER_SPACE.search(t) and not any(s in t for s in self.special) for t in texts]
        cut = [_CHUNK.findall(t) if p else [t] for t, p in zip(texts, plain)]
        self.learn(set().union(*[c for c, p in zip(cut, plain) if p]))
        return [b"".join([self[c] for c in chunks]) if p else self.whole(chunks[0]) for chunks, p in zip(cut, plain)]

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Encodes each chunk that the table lacks, once. Chunks of the first 256 characters go through the merger in one call, told apart by a line feed's id, which none of them has."""
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > TABLE_LIMIT:
            self.clear()
            new = list(chunks)
        inked = [c for c in new if "\n" not in c and not c.endswith(" ") and _FIRST.fullmatch(c)] if self.fast else []
        if inked:
            core, feed = self.fast
            ids = np.array(core.encode_ordinary("\n".join(inked)), "<u4")
            raw, stops = ids.tobytes(), np.flatnonzero(ids == feed).tolist()
            if len(stops) == len(inked) - 1:
                begin = 0
                for chunk, end in zip(inked, [*stops, len(ids)]):
                    self[chunk] = raw[4 * begin : 4 * end]
                    begin = end + 1
        for chunk in new:
            if chunk not in self:
                self[chunk] = self.whole(chunk)


def _merger(model: dict) -> tuple[object, int] | None:
    """The same merges in a faster core, and the id of a line feed; None unless the file's merges make ids in their order."""
    import tiktoken

    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in signs]
    byte = {chr(b): b for b in signs} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    last = max(made, default=-1)
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if i <= last and all(c in byte for c in t)}
    if not made or made != sorted(made) or len({*made}) != len(made) or len(ranks) != len(made) + 256 or min(made) != 256:
        return None
    return tiktoken.Encoding("merges", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks[b"\n"]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    system, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    return system, path


class Writer:
    """Appends documents to one file."""

    def __init__(self, folder: str, name: str):
        self.system, self.folder = opened(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.name, self.draft = f"{self.folder}/{name}", f"{self.folder}/_{name}.{uuid.uuid4().hex}"
        self.out, self.entries, self.docs, self.held, self.n_docs, self.n_ids = self.system.open_output_stream(self.draft), [], [], 0, 0, 0
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))
        self.held += len(ids) // 4
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        raw = struct.pack("<I", len(self.docs)) + np.array([d is not None for d, _ in self.docs], np.uint8).tobytes() + np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        raw += np.array([len(i) // 4 for _, i in self.docs], "<u4").tobytes() + b"".join([i for _, i in self.docs])
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.entries.append(_ENTRY.pack(len(packed), len(raw), xxhash.xxh64_intdigest(raw), self.n_docs))
        self.n_docs, self.n_ids, self.docs, self.held = self.n_docs + len(self.docs), self.n_ids + self.held, [], 0

    def close(self) -> tuple[str, int, int]:
        self.flush()
        tail = b"".join(self.entries) + struct.pack("<I", len(self.entries)) + MAGIC
        self.out.write(struct.pack("<II", 0x184D2A5E, len(tail)) + tail)
        self.out.close()
        self.system.move(self.draft, self.name)
        return self.name, self.n_docs, self.n_ids


class Reader:
    """Documents of one file; only the frames asked for are read."""

    def __init__(self, system: pafs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(count * _ENTRY.size, size - 12 - count * _ENTRY.size)
        self.entries = [_ENTRY.unpack_from(table, k * _ENTRY.size) for k in range(count)]
        self.starts = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])

    def frame(self, k: int) -> Iterator[tuple[int | None, bytes]]:
        packed, size, check, _ = self.entries[k]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, int(self.starts[k])), max_output_size=size)
        if xxhash.xxh64_intdigest(raw) != check:
            raise ValueError(f"frame {k} is damaged")
        (n,) = struct.unpack_from("<I", raw)
        there, ids, counts = np.frombuffer(raw, np.uint8, n, 4), np.frombuffer(raw, "<i8", n, 4 + n), np.frombuffer(raw, "<u4", n, 4 + 9 * n)
        at = 4 + 13 * n
        for here, doc_id, count in zip(there.tolist(), ids.tolist(), counts.tolist()):
            yield (doc_id if here else None), raw[at : at + 4 * count]
            at += 4 * count

    def document(self, ordinal: int) -> tuple[int | None, bytes]:
        k = int(np.searchsorted([e[3] for e in self.entries], ordinal, "right")) - 1
        return list(self.frame(k))[ordinal - self.entries[k][3]]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns the manifest: shard, path, n_docs, n_ids. It is stored, so reading it never writes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, end, out, shard = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), None, TaskContext.get().partitionId()
        for batch in pieces(batches):
            out = out or Writer(folder, f"ids-{shard:06d}.zst")
            for doc_id, ids in zip(batch.column("id").to_pylist(), table.ids(batch.column("text").to_pylist())):
                out.add(doc_id, ids + end)
        if out:
            path, n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path.rpartition("/")[2]], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = light(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sorted_rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    manifest = f"{folder}/manifest.parquet"
    sorted_rows.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").write.mode("overwrite").parquet(manifest)
    return docs.sparkSession.read.parquet(manifest)


def read(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; payload adds the ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                reader = Reader(system, f"{path}/{name}")
                for k in range(len(reader.entries)):
                    found = list(reader.frame(k))
                    counts = np.array([len(i) // 4 for _, i in found], np.int64)
                    ends = base + np.cumsum(counts)
                    base = int(ends[-1])
                    columns = [pa.array([d for d, _ in found], pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(i) for _, i in found], pa.int64())]
                    columns += [pa.array([i for _, i in found], pa.binary())] if payload else []
                    yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"))  # one row a file
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * payload)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    folder = workspace(docs.sparkSession, "token-ids")
    return read(write(docs, tokenizer, folder, end_id), folder)
