"""Benchmark decontamination by winnowing, in DataFrame expressions.

Of every 10 consecutive words the least 5-word hash is a fingerprint, on either side, so a shared run of 10 words shares
one. Documents' windows whose fingerprint the benchmark may have (a bitmap of bounded size tells) are extended to the
whole 10 words and joined with the benchmark's windows as text, which decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, WINDOW = 5, 10
#: Benchmark windows are broadcast up to this size in all; beyond it both sides are dealt out by window and salt.
BROADCAST_ROWS, BROADCAST_CHARS, SALTS = 50_000, 8_000_000, 32
#: The bitmap has 16 bits for each fingerprint, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 22


def _grams(words: str, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: str) -> Column:
    """For each run of 10 words its least 5-word hash."""
    m, n = WINDOW - GRAM + 1, F.size(grams)
    return F.when(n >= m, F.transform(F.sequence(F.lit(0), n - m), lambda i: F.least(*(F.get(grams, i + j) for j in range(m))))).otherwise(F.array().cast("array<bigint>"))


def _probes(df: DataFrame, short: dict[int, list[int]]) -> DataFrame:
    """Adds ``_p10``, the fingerprint of each 10-word window, and for shorter items ``_p5``, ``_p1``: hashes of 5 and 1 words."""
    df = df.withColumn("_g", _grams("_w", GRAM)).withColumn("_p10", _minima("_g"))
    df = df.withColumn("_p5", F.col("_g")) if short[5] else df
    return (df.withColumn("_p1", _grams("_w", 1)) if short[1] else df).drop("_g")


def _windows(short: dict[int, list[int]], wanted) -> Column:
    """Structs (at, n, win) of the windows of ``_w`` whose probe is ``wanted``, of 10 words and of the shorter lengths."""
    def of(probe: int, n: int) -> Column:
        at = F.filter(F.transform(f"_p{probe}", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda s: wanted(s["h"]) & (s["i"] + n <= F.size("_w")))
        return F.transform(at, lambda s: F.struct(s["i"].alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("_w", s["i"] + 1, n), " ").alias("win")))

    found = [of(probe, n) for probe, lengths in ((10, [WINDOW]), (5, short[5]), (1, short[1])) for n in lengths]
    return F.concat(*found)


def _bitmap(prints: DataFrame, bits: int) -> DataFrame:
    """One row with an array of bits / 64 longs in which each fingerprint's bit is set; its size is bounded by MOST_BITS."""
    slot = prints.select(F.col("_h").bitwiseAND(F.lit(bits - 1)).alias("_b")).select(F.shiftright("_b", 6).alias("_slot"), F.expr("shiftleft(1L, cast(_b & 63 AS int))").alias("_bit"))
    held = slot.groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    full = prints.sparkSession.range(bits // 64).join(held, F.col("id") == F.col("_slot"), "left")
    return full.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("b")))).alias("_all")).select(F.transform("_all", lambda s: s["b"]).alias("_bitmap"))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: the id, the content key of common.rows, n_words, n_hit, n_items, items (their ids as sorted strings), hits (structs at, n).

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. An item's windows are its runs of 10
    words, or all its words if they are fewer; a document's word is hit if it stands in an occurrence of any window. Null
    and blank texts have no words: such a document has no hits, such an item no windows. Repeated rows get a result each;
    repeated item ids count once; a null item id counts as ''. Empty tables on either side are fine; extra columns are ignored.
    """
    w = C.split_words(C.ascii_lower("_text"), C.NON_WORD)
    bench = C.rows(items, id_col=item_col, text_col=item_text_col).select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_item"), w.alias("_w"))
    bench = C.stored(bench.where(F.size("_w") > 0), "bench-words")
    lengths = sorted(r[0] for r in bench.where(F.size("_w") < WINDOW).select(F.size("_w")).distinct().collect())  # 9 at most
    short = {5: [n for n in lengths if n >= GRAM], 1: [n for n in lengths if n < GRAM]}
    probed = _probes(bench, short)
    long_item, mid_item = F.size("_w") >= WINDOW, F.size("_w") >= GRAM
    first = lambda p: F.slice(p, 1, 1)
    prints = F.when(long_item, F.col("_p10"))
    prints = prints.when(mid_item, first("_p5")) if short[5] else prints
    prints = prints.otherwise(first("_p1")) if short[1] else prints
    prints = probed.select(F.explode(prints).alias("_h")).distinct()
    own = F.when(long_item, F.transform(F.sequence(F.lit(1), F.size("_w") - WINDOW + 1), lambda i: F.array_join(F.slice("_w", i, WINDOW), " "))).otherwise(F.array(F.array_join("_w", " ")))
    windows = C.stored(bench.select("_item", F.explode(own).alias("_win")).groupBy("_win").agg(F.array_sort(F.collect_set("_item")).alias("_items")), "bench-windows")
    size = windows.agg(F.count(F.lit(1)), F.sum(F.length("_win") + F.length(F.array_join("_items", ",")))).first()
    bits = LEAST_BITS
    while bits < min(16 * prints.count(), MOST_BITS):
        bits *= 2

    t = C.rows(docs, id_col=id_col, text_col=text_col)
    worded = t.select("_id", "_key", w.alias("_w"))
    bitmap = _bitmap(prints, bits)
    marked = _probes(worded, short).withColumn("_bitmap", bitmap.scalar())
    wanted = lambda h: F.getbit(F.get("_bitmap", F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    found = marked.select("_id", "_key", F.explode(_windows(short, wanted)).alias("_f")).select("_id", "_key", F.col("_f.at").alias("_at"), F.col("_f.n").alias("_n"), F.col("_f.win").alias("_win"))
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_CHARS:
        hits = found.join(F.broadcast(windows), "_win")
    else:
        salted = windows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("_salt", F.pmod(F.xxhash64("_key", "_id", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["_win", "_salt"])
    per = hits.groupBy(F.col("_id").alias("_hid"), F.col("_key").alias("_hkey")).agg(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_n").alias("n"))).alias("_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"))
    base = worded.select("_id", "_key", F.size("_w").cast("long").alias("n_words"))
    joined = base.join(per, base["_id"].eqNullSafe(per["_hid"]) & (base["_key"] == per["_hkey"]), "left")
    none = F.array().cast("array<string>")
    covered = F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))))
    return joined.select(
        F.col("_id").alias(id_col),
        "_key",
        "n_words",
        F.when(F.col("_hits").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"),
        F.size(F.coalesce("_items", none)).cast("long").alias("n_items"),
        F.coalesce("_items", none).alias("items"),
        F.array_sort(F.coalesce("_hits", F.array().cast("array<struct<at:int,n:int>>"))).alias("hits"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql_words(text: str) -> str:
    return rf"list_filter(string_split_regex(translate(coalesce({text}, ''), '{C.UPPER}', '{C.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words('text')} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
