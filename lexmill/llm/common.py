"""What several training-data operators share: row keys, words, and the shared folder for written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z, lower-cased alone; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words in the space-delimited sense, and of words of letters and digits.
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text as ``_id``, ``_text`` (null: empty) and a content key ``_key``, besides the columns in ``more`` as ``_<name>``.

    ``_id`` (null-safe) with ``_key`` names a row for joins: rows that agree in both have the same text (but for a hash
    collision within one id), so any per-row result holds for all of them. Other columns are dropped, so their names can't clash.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("_id"), text.alias("_text"), *(docs[c].alias(f"_{c}") for c in more)).withColumn("_key", F.xxhash64("_text"))


#: Rows of an id and a key (some 16 bytes each) that are sent to every executor at most.
FEW_ROWS = 1_000_000


def without(docs: DataFrame, verdicts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, but those whose id and content key are in ``verdicts``.

    Up to FEW_ROWS of them, which are counted first, go to the documents, so that no text is shuffled; more meet the
    documents by id and key.
    """
    gone = stored(verdicts.select(verdicts[id_col].alias("_gone_id"), verdicts["_key"].alias("_gone_key")), "gone")
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(few(gone, FEW_ROWS), docs[id_col].eqNullSafe(gone["_gone_id"]) & (key == gone["_gone_key"]), "left_anti")


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column, separators: str) -> Column:
    """The array of words between runs of ``separators``; none for an empty text."""
    return F.filter(F.split(c, separators), lambda w: w != "")


def at_most(df: DataFrame, n: int) -> bool:
    """Whether it has at most n rows; reads no more than it needs to tell."""
    return df.limit(n + 1).count() <= n


def few(df: DataFrame, n: int) -> DataFrame:
    """``df``, a stored table, marked to be sent to every executor if it has at most n rows; else as it is, to be dealt out."""
    return F.broadcast(df) if at_most(df, n) else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the session names none, a local one is set, but on a local master alone."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='lexmill-')}")
        current = sc.getCheckpointDir()
    return named or current


#: Removes a query's shuffle files once its result is written; nothing reads them again.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexmill-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._lexmill_path)


def sweep(spark: SparkSession) -> None:
    """Deletes every table that this application has stored; for the end, when all results have been written."""
    _delete(spark, _folder(spark))
