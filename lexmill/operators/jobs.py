"""Job-state operators over append-only tables of jobs, stages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMINAL = ("succeeded", "failed", "cancelled", "partial_failed")


def with_sequence(events: DataFrame, job: str, at: str, event: str) -> DataFrame:
    """Adds ``sequence`` from 1 and ``relative_ms`` since the job's first event."""
    w = Window.partitionBy(job).orderBy(at, event)
    first = F.min(at).over(Window.partitionBy(job))
    ms = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1000
    return events.withColumn("sequence", F.row_number().over(w)).withColumn("relative_ms", ms)


def ordered_stages(stages: DataFrame) -> DataFrame:
    """Item stages first, job-level ones (item '') last, then by item and name; ``place`` says where within the job."""
    w = Window.partitionBy("job_id").orderBy(F.when(F.col("item_id") == "", 1).otherwise(0), "item_id", "stage_name")
    return stages.withColumn("place", F.row_number().over(w))


def job_progress(stages: DataFrame) -> DataFrame:
    return stages.groupBy("job_id").agg(F.round(F.avg("progress"), 4).alias("progress"))


def stale(jobs: DataFrame, cutoff: str) -> DataFrame:
    """Running jobs whose heartbeat can't be read or lies before the cutoff, as interrupted."""
    beat = F.try_to_timestamp("heartbeat")
    return jobs.where((F.col("status") == "running") & (beat.isNull() | (beat < F.lit(cutoff).cast("timestamp")))).withColumn("status", F.lit("interrupted"))


def newest(jobs: DataFrame, limit: int, at: str = "created_at", job: str = "job_id", status: str | None = None) -> DataFrame:
    """The newest jobs, of one status if it is given; the limit is held between 1 and 500."""
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(F.col(at).desc(), F.col(job).desc()).limit(min(max(limit, 1), 500))


def final_status(items: DataFrame) -> DataFrame:
    """Per job: partial_failed if an item failed, attention if the audit found anything, else succeeded."""
    return items.groupBy("job_id").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("audit_issues"), F.lit(0)).alias("issues")).withColumn("status", F.when(F.col("failed") > 0, "partial_failed").when(F.col("issues") > 0, "attention").otherwise("succeeded"))


def parts(jobs: DataFrame, per_part: int = 50_000) -> int:
    """Into how many parts rows are dealt by their job, so that a part's jobs stay as many when the table grows."""
    return max(1, -(-jobs.count() // per_part))


def snapshot(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """One row per job with its stages, in order, and their counts by state.

    A job's stages are sorted within its row. Stages that are dealt out by ``job_id`` already are not shuffled again.
    """
    row = F.struct((F.col("item_id") == "").alias("own"), "item_id", "stage_name", "status")
    held = stages.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("_s"), F.count(F.lit(1)).alias("n_stages"), F.count_if(F.col("status") == "succeeded").alias("n_done"))
    names = F.array_join(F.transform("_s", lambda s: F.concat_ws(":", s["stage_name"], s["status"])), ",")
    return jobs.join(held, "job_id", "left").withColumn("stages", F.coalesce(names, F.lit(""))).na.fill(0, ["n_stages", "n_done"]).drop("_s")


def stage_plan(items: DataFrame, *, ocr: bool, organize: bool, merge: bool, mask: bool, audit: bool) -> DataFrame:
    """(job_id, item_id, stage_name): an item's stages, with mask and audit moved to the job (item '') by merge."""
    own = ["ocr" if ocr else "input", *(["organize"] if organize else [])]
    tail = [n for n, on in (("mask", mask), ("audit", audit)) if on]
    per_item = items.select("job_id", "item_id", F.explode(F.array(*map(F.lit, own + ([] if merge else tail)))).alias("stage_name"))
    if not merge:
        return per_item
    return per_item.unionByName(items.select("job_id").distinct().select("job_id", F.lit("").alias("item_id"), F.explode(F.array(*map(F.lit, ["merge", *tail]))).alias("stage_name")))


def merged_texts(docs: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """One text per group: the parts in order, a blank line between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    return docs.groupBy(group).agg(F.array_join(parts, "\n\n").alias("merged"), F.count(F.lit(1)).alias("n_parts"))


def rename_plan(files: DataFrame, original: str, order: str) -> DataFrame:
    """Original names told apart where they clash but for case: the nth of a name gets ``-n`` from the second on."""
    w = Window.partitionBy(F.lower(original))
    nth = F.row_number().over(w.orderBy(order))
    stem, ext = F.regexp_replace(original, r"\.[^.]*$", ""), F.regexp_extract(original, r"\.[^.]*$", 0)
    return files.withColumn("target", F.when(nth == 1, F.col(original)).otherwise(F.concat(stem, F.lit("-"), nth.cast("string"), ext))).withColumn("clashes", F.count(F.lit(1)).over(w))


def page_needs_ocr(text_chars: Column, bitmap_area: Column, page_area: Column, least_chars: int = 64, least_share: float = 0.05) -> Column:
    """Whether a page goes to OCR: its text layer is too short and bitmaps cover more than the share of it. Unknown areas: no."""
    share = F.greatest(bitmap_area, F.lit(0.0)) / F.greatest(page_area, F.lit(1.0))
    return (F.coalesce(text_chars, F.lit(0)) < max(1, least_chars)) & F.coalesce(share > max(0.0, least_share), F.lit(False))


def page_route(pages: DataFrame, least_chars: int = 64, least_area: float = 0.6) -> DataFrame:
    """Per document whether it is a scan: no page has enough text, and at least 80 % (and one) hold a large bitmap."""
    large = F.col("image_area_fraction") >= least_area
    return pages.groupBy("doc_id").agg((~F.bool_or(F.col("text_chars") >= least_chars) & F.bool_or(large) & (F.avg(F.when(large, 1.0).otherwise(0.0)) >= 0.8)).alias("scan"))
