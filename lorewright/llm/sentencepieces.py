"""SentencePiece encoding and decoding through a table of distinct chunks.

The model puts a marker for every space, and none of its pieces has a marker after another character, nor a line feed or tab
beside one; this is checked on the vocabulary when the model is loaded. So merges never cross into a marker or over those
controls, and a text falls into chunks that encode independently: a run of markers with the word after it. Each worker keeps
a table from chunk to ids and to decoded text; a chunk is segmented once by the library, and documents are joined from the
table by position. The table is emptied at TABLE_LIMIT entries, which costs time only. A model that breaks the check is run
by the library over whole texts.

Defined results: null and empty texts give the begin and end id and decode to the empty string; rows keep their ids, null or
repeated; an empty table gives no rows; columns other than the two named are never read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import light, pieces

TABLE_LIMIT = 300_000
_CHUNK = re.compile("▁*[^▁\n\t]+|▁+|[\n\t]+")
_FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec(dict):
    """chunk -> (ids as little-endian 32-bit bytes, decoded text)."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        vocabulary = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        plain = all(sp.normalize(x) == y for x, y in (("a  b ", "▁a▁▁b▁"), (" ﬁ\n", "▁▁ﬁ\n"), ("", "")))
        self.splits = plain and not any("▁" in p.lstrip("▁") or len(p) > 1 and re.search("[\n\t]", p) for p in vocabulary)
        self.begin, self.end = (x.to_bytes(4, "little") for x in (sp.bos_id(), sp.eos_id()))

    def learn(self, chunks: set[str]) -> None:
        """Segments each chunk that the table lacks, once."""
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > TABLE_LIMIT:
            self.clear()
            new = list(chunks)
        # the line feed keeps the marker that the library puts first apart
        ids = self.sp.encode(["\n" + c.replace("▁", " ") for c in new], num_threads=1)
        for chunk, own, text in zip(new, ids, self.sp.decode(ids, num_threads=1) if ids else []):
            self[chunk] = array("I", own[2:]).tobytes(), text[1:]

    def run(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids with begin and end as bytes, and the text that decode(ids) gives, for each text."""
        if not self.splits:
            ids = self.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            return [(array("I", i).tobytes(), self.sp.decode(i)) for i in ids]
        cut = [_CHUNK.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        self.learn(set().union(*cut))
        out = []
        for chunks in cut:
            found = [self[c] for c in chunks]
            out.append((b"".join([self.begin, *[i for i, _ in found], self.end]), "".join([d for _, d in found]).removeprefix(" ")))
        return out


@cache
def codec(model: str) -> Codec:
    return Codec(model)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; payload adds ids (bytes) and decoded (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model)
        for batch in pieces(pa.RecordBatch.from_arrays(b.columns, ["id", "text"]) for b in batches):
            out = table.run([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column("id"), pa.array([len(i) // 4 for i, _ in out], pa.int64())]
            columns += [pa.array([hashlib.sha256(i).hexdigest() for i, _ in out]), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in out])]
            columns += [pa.array([i for i, _ in out], pa.binary()), pa.array([d for _, d in out])] if payload else []
            yield pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])

    kind = docs.schema[id_col].dataType.simpleString()
    return light(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {_FIELDS}" + ", ids binary, decoded string" * payload)
