"""Span algebra: components of overlapping spans, greedy resolution, deduplication, nesting filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def components(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``component``: spans of a document in start order, a new one where a start reaches no end before it."""
    w = Window.partitionBy(id_col).orderBy("start", "end", "seq")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    return spans.withColumn("_fresh", fresh).withColumn("component", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def resolve(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The accepted spans: within a component by priority, score, length, start, end and order, each that overlaps none accepted.

    Components of one span, nearly all, pass without the fold. One shuffle by document serves all steps.
    """
    grouped = components(spans, id_col)
    fields = [c for c in spans.columns if c != id_col]
    row = F.struct((-F.col("priority")).alias("_p"), (-F.col("score")).alias("_s"), (F.col("start") - F.col("end")).alias("_l"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("seq").alias("_q"), F.struct(*fields).alias("span"))
    held = grouped.groupBy(id_col, "component").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    spans_of = F.transform("_rows", lambda r: r["span"])
    empty = F.slice(spans_of, 1, 0)
    accepted = F.aggregate("_rows", empty, lambda acc, r: F.when(F.exists(acc, lambda s: (s["start"] < r["_b"]) & (r["_a"] < s["end"])), acc).otherwise(F.array_append(acc, r["span"])))
    return held.select(id_col, F.inline(F.when(F.size("_rows") == 1, spans_of).otherwise(accepted)))


def longest_first(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Disjoint spans: in order of start, then the longest, then by type, each that begins where the one before has ended or later.

    Spans have at least one character. One shuffle by document; each document's spans are folded once.
    """
    fields = [c for c in spans.columns if c != id_col]
    row = F.struct(F.col("start").alias("_a"), (F.col("start") - F.col("end")).alias("_l"), F.col("entity_type").alias("_t"), F.struct(*fields).alias("span"))
    held = spans.groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    begun = F.struct(F.slice(F.transform("_rows", lambda r: r["span"]), 1, 0).alias("kept"), F.lit(0).alias("end"))
    kept = F.aggregate("_rows", begun, lambda a, r: F.when(r["_a"] >= a["end"], F.struct(F.array_append(a["kept"], r["span"]).alias("kept"), r["span"]["end"].alias("end"))).otherwise(a), lambda a: a["kept"])
    return held.select(id_col, F.inline(kept))


def dedup_positions(spans: DataFrame, keep: str = "first", id_col: str = "doc_id") -> DataFrame:
    """Of spans at one position the first, the last, or the best-scored stays."""
    order = {"first": [F.col("seq")], "last": [F.col("seq").desc()], "best": [F.col("score").desc(), F.col("seq")]}[keep]
    w = Window.partitionBy(id_col, "start", "end").orderBy(*order)
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def drop_nested(inner: DataFrame, outer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``inner`` spans that no ``outer`` span of the document properly contains."""
    a, b = inner.alias("a"), outer.alias("b")
    wider = (F.col("b.start") < F.col("a.start")) | (F.col("a.end") < F.col("b.end"))
    return a.join(b, (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end")) & wider, "left_anti")


def merge_windows(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans of one type found in overlapping windows: those inside a longer one go, equal ones stay once, partial overlaps both."""
    once = spans.groupBy(id_col, "entity_type", "start", "end").agg(F.max("score").alias("score"))
    a, b = once.alias("a"), once.alias("b")
    same = (F.col(f"a.{id_col}") == F.col(f"b.{id_col}")) & (F.col("a.entity_type") == F.col("b.entity_type"))
    inside = (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end")) & (F.col("b.end") - F.col("b.start") > F.col("a.end") - F.col("a.start"))
    return a.join(b, same & inside, "left_anti")


def overlapping(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Violations of the disjointness constraint: spans that start before the greatest end so far."""
    w = Window.partitionBy(id_col).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(w)).where(F.col("start") < F.col("_reach")).drop("_reach")
