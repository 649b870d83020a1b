"""Text files as rows: UTF-8 without its byte order mark, Latin-1 where that fails; and labelled JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXTENSIONS = ("txt", "md", "markdown", "rtf", "html", "htm", "xml", "json", "csv")
SAMPLES = "document_id string, text string, spans array<struct<start:int,end:int,label:string>>, entities array<struct<start:int,end:int,label:string>>, annotations array<struct<start:int,end:int,label:string>>, metadata map<string,string>"


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(ordinal, path, text) of the files below a folder, ordered by lower-cased path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    order = F.row_number().over(Window.orderBy(F.lower("path"), "path"))
    return wanted.select("path", F.regexp_replace(text, "^\\x{FEFF}", "").alias("text")).withColumn("ordinal", order)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text, spans, metadata) of labelled JSON lines; spans may stand under three names. Blank lines are skipped."""
    raw = spark.read.schema(SAMPLES).option("mode", "FAILFAST").json(path)
    return raw.select("document_id", "text", F.coalesce("spans", "entities", "annotations").alias("spans"), "metadata")


def bad_samples(samples: DataFrame) -> DataFrame:
    """Samples that break a constraint: bounds, order or overlap of spans, or an id that occurs again."""
    n = F.length("text")
    wrong = F.exists("spans", lambda s: (s["start"] < 0) | (s["end"] > n) | (s["start"] >= s["end"]))
    ordered = F.array_sort("spans")
    overlap = F.exists(F.arrays_zip(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))).alias("a"), F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))).alias("b")), lambda p: p["b"]["start"] < p["a"]["end"])
    again = F.count(F.lit(1)).over(Window.partitionBy("document_id")) > 1
    return samples.withColumn("_again", again).where(wrong | overlap | F.col("_again")).drop("_again")


def write_samples(samples: DataFrame, path: str) -> None:
    samples.select("document_id", "text", "spans", "metadata").write.mode("overwrite").json(path)
