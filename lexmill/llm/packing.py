"""Harmonic packing: pieces of lengths in reciprocal classes of the capacity, a fixed number of them to a sequence.

A document is cut into whole sequences and then into the powers of two that make up its rest, down to ``least``; the
tail below that stays one piece. Class k holds the pieces of length in (capacity / (k + 1), capacity / k], and k of them
fill a sequence: without a gap for the powers of two. Workers fill the classes' sequences of their own partitions, in row
order, with no shuffle; what a class has left over at a partition's end is laid end to end and cut into powers of two.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.functions.ship import ship

from . import common as C
from .chunk_encoder import ChunkEncoder, slices


def cut(n: int, capacity: int, least: int) -> list[int]:
    """Piece lengths of a document of n ids, in order."""
    pieces, n, size = [capacity] * (n // capacity), n % capacity, capacity // 2
    while size >= least and n:
        if n >= size:
            pieces.append(size)
            n -= size
        size //= 2
    return [*pieces, n] if n else pieces


class Packer:
    """Takes documents one by one; rows of filled sequences come from ``rows``, the rest from ``finish``."""

    def __init__(self, capacity: int, least: int, first_sequence: int):
        assert capacity & (capacity - 1) == 0 and least & (least - 1) == 0, "powers of two"
        self.capacity, self.least, self.next, self.open, self.rows = capacity, least, first_sequence, {}, []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        for n in cut(len(ids), self.capacity, self.least):
            piece, k = (doc, start, ids[start : start + n], len(ids)), self.capacity // n
            start += n
            if k == 1:
                self._emit([piece])
                continue
            held = self.open.setdefault(k, [])
            held.append((doc, piece[1], piece[2].copy(), len(ids)))  # a copy: else a short piece holds its whole document
            if len(held) == k:
                self._emit(self.open.pop(k))

    def finish(self) -> None:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        for size in cut(sum(len(p[2]) for p in left), self.capacity, 1):
            taken = []
            while size:
                doc, start, ids, total = left.pop(0)
                taken.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    left.insert(0, (doc, start + size, ids[size:], total))
                size -= len(taken[-1][2])
            self._emit(taken)


def pack_sequences(docs: DataFrame, tokenizer: str, *, chunks: str, end_id: int, capacity: int = 1024, least: int = 64, id_col: str = "doc_id", text_col: str = "text", emit_ids: bool = True) -> DataFrame:
    """One row per piece: the id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Ids of a document, ``end_id`` last, lie in exactly one piece each; a sequence's pieces have gapless offsets from 0.
    A null or empty text has the end id alone; repeated rows are packed each; an empty table gives no rows; extra columns
    are ignored. ``emit_ids=False`` leaves the ids out, for digests of large tables.
    """
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if emit_ids else [])])

    def run(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, encoder, end = to_arrow_schema(schema), ChunkEncoder.of(tokenizer, chunks), np.array([end_id], "<u4").tobytes()
        packer = Packer(capacity, least, TaskContext.get().partitionId() << 40)

        def flush():
            r = list(zip(*packer.rows, strict=True))
            packer.rows = []
            columns = [r[0], r[1], r[2], [zlib.crc32(np.ascontiguousarray(x)) for x in r[3]], r[4], r[5], r[6]] + ([[x.astype(np.int32) for x in r[3]]] if emit_ids else [])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, out, strict=True)], schema=out)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for key, data in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                    packer.add(key, np.frombuffer(data + end, "<u4"))
                    if len(packer.rows) >= 2000:
                        yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return C.rows(docs, id_col=id_col, text_col=text_col).select("_id", "_text").mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_sequences(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), chunks="spaced", end_id=0, emit_ids=False)
