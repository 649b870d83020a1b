"""Token ids in files of fixed-width bit packing.

A row of a token table is a block of whole documents: each id takes ``width`` bits (the fewest that hold the vocabulary),
lowest bit first, one after another; ``offsets`` has where each document's ids begin and, last, the block's id count;
``low`` and ``high`` are its least and greatest document id, by which readers of one document skip other blocks.
Rows are in Parquet, as only Spark's writers reach every store; shards and blocks ascend with the document id.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.functions.ship import ship

from . import common as C
from .chunk_encoder import ChunkEncoder, slices

#: A block is closed once it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a payload as uint32, read from the bytes that hold them alone."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", stop - start, start * width // 8).astype("<u4")
    low = start * width // 8
    held = np.frombuffer(payload, np.uint8)[low : (stop * width + 7) // 8]
    bits = np.unpackbits(held, bitorder="little")[start * width - low * 8 :][: (stop - start) * width]
    return (bits.reshape(stop - start, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, chunks: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text, appends ``end_id`` to each document and writes the token table to ``path``.

    Documents are in ascending id order (null first), ties by text. A null or empty text has the end id alone. Repeated
    rows are written each. An empty table writes no block. Extra columns are ignored. A text is encoded whole, to at most
    2^31 - 1 ids, as the offsets within a block have 32 bits.
    """
    ship(docs.sparkSession)
    width, id_type = width_of(vocabulary), docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("low", id_type), T.StructField("high", id_type), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("offsets", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType())])

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, shard = to_arrow_schema(schema), TaskContext.get().partitionId()
        encoder, end = ChunkEncoder.of(tokenizer, chunks), np.array([end_id], "<u4").tobytes()
        first = block = waiting = 0
        ids, held, sizes = [], [], []

        def close():
            nonlocal first, block, waiting
            flat = np.frombuffer(b"".join(held), "<u4")
            known = [i for i in ids if i is not None]
            row = [shard, block, first, len(flat), width, known[0] if known else None, known[-1] if known else None, list(ids), [0, *np.cumsum(sizes).tolist()], pack(flat, width)]
            first, block, waiting = first + len(flat), block + 1, 0
            ids.clear(), held.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for key, data in zip(keys[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids.append(key), held.append(data + end), sizes.append(len(data) // 4 + 1)
                    waiting += sizes[-1]
                    if waiting >= block_ids:
                        yield close()
        if ids:
            yield close()

    t = C.rows(docs, id_col=id_col, text_col=text_col)
    ordered = t.repartitionByRange("_id", "_key").sortWithinPartitions("_id", "_key", "_text").select("_id", "_text")
    ordered.mapInArrow(encode, schema).write.mode("overwrite").option("parquet.block.size", 32 << 20).parquet(path)


def read_tokens(spark: SparkSession, path: str, *, emit_ids: bool = True) -> DataFrame:
    """One row per document of a token table: doc_id, start (ids of all documents before it), n_tokens, ids, ids_crc32.

    ``emit_ids=False`` leaves the ids out, for digests of large tables.
    """
    ship(spark)
    blocks = spark.read.parquet(path)
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.ArrayType(T.LongType()))] if emit_ids else [])])

    def decode(batches):
        import zlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                flat, offsets = unpack(row["payload"], row["width"], 0, row["n_ids"]), row["offsets"]
                spans = list(zip(offsets, offsets[1:], strict=False))
                columns = [row["doc_ids"], [row["shard"]] * len(spans), [row["first"] + a for a, _ in spans], [b - a for a, b in spans], [zlib.crc32(flat[a:b]) for a, b in spans]]
                columns += [[flat[a:b].astype(np.int64) for a, b in spans]] if emit_ids else []
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row per written file at most
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    found = blocks.mapInArrow(decode, schema).join(before, "shard")
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if emit_ids else []))


def read_document(spark: SparkSession, path: str, doc_id) -> np.ndarray | None:
    """The ids of one document, from its block alone; None if there is none. Of repeated ids one row's are given.

    The blocks' bounds are pushed down to the files' statistics, so of other blocks neither ids nor payload are read.
    """
    near = (F.col("low") <= F.lit(doc_id)) & (F.col("high") >= F.lit(doc_id))
    row = spark.read.parquet(path).where(near & F.array_contains("doc_ids", F.lit(doc_id))).first()
    if row is None:
        return None
    i = row["doc_ids"].index(doc_id)
    return unpack(bytes(row["payload"]), row["width"], row["offsets"][i], row["offsets"][i + 1])


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{C.ensure_checkpoint_dir(spark).rstrip('/')}/lexmill/tokens-{uuid.uuid4().hex}"
    write_tokens(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), chunks="words", end_id=2, vocabulary=49_408)
    return read_tokens(spark, path, emit_ids=False)
