"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans and packing over ``documents``.

Each stage works on all that its predecessor kept, written as Parquet between them. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import common as C
from lexmill.llm.decontaminate import decontaminate
from lexmill.llm.minhash_dedup import near_duplicates
from lexmill.llm.packing import pack_sequences
from lexmill.llm.quality_rules import quality_rules
from lexmill.llm.secret_scan import scan_secrets


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or blank text has no words and goes; repeated rows share their fate; whole texts
    are read; a null host is the host ''. Other columns, whatever their names, stay as they are. An empty table stays empty, here and in all stages."""
    return C.without(docs, quality_rules(docs).where(~F.col("kept")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays: that of the least id.

    Rows without words are no copies and stay. Where rows repeat an id within a group, the one of the least content key stays; of rows that
    are alike in id and text any one. A null id is never the least unless all are null. Other columns stay as they are.
    """
    found = C.stored(near_duplicates(docs), "near-duplicates")
    kept = C.without(docs, found.where(~F.col("kept")))
    again = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_first")).where("_n > 1")
    again = C.stored(again.select(F.col("doc_id").alias("_again_id"), "_first"), "repeated-ids")
    if again.isEmpty():
        return kept
    same = kept["doc_id"].eqNullSafe(again["_again_id"])
    key = F.xxhash64(F.coalesce(kept["text"], F.lit("")))
    once = kept.join(again, same & (key == again["_first"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and blank texts hold none and stay, as do other columns; repeated rows share their fate."""
    return C.without(docs, decontaminate(docs, C.table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by their kinds, and n_chars follows the text. A null text stays null; repeated rows each stay."""
    found = scan_secrets(docs, keep=tuple(docs.columns), redacted=True, spans_col="_spans_of_secrets").withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def pack_training_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids. A null or empty text has the end id alone; repeated rows are packed each; other columns go."""
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), chunks="spaced", end_id=0)


STAGES = [
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_training_sequences),
]

#: MinHash candidates and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
