"""Quality rules: per-document word statistics, and cross-document line frequency within a host.

Lines are normalised and hashed, distinct documents are counted per (host, line), lines above the limit are removed, and
documents that the removal depletes are rejected. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows of one line are dealt to so many salts before they meet the table of frequent lines.
SALTS = 32
#: Frequent lines (a host's name and a hash each) that are sent to every executor at most.
FEW_LINES = 200_000


def _repeat_words(w: str) -> Column:
    """Words of the array ``w`` in 5-word windows that occur twice or more in it; needs ``_w5``, the windows' hashes.

    Most documents repeat no window, which the distinct count tells. Else the windows are sorted by hash with their
    positions, neighbours compared, and the words that the found positions cover counted.
    """
    ordered = F.sort_array(F.transform("_w5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size("_w5")
    pairs = F.arrays_zip(F.slice(ordered, 1, n - 1).alias("a"), F.slice(ordered, 2, n - 1).alias("b"))
    same = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    at = F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    covered = F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct("_w5")) == n, F.lit(0).cast("long")).otherwise(covered)


def base_statistics(t: DataFrame) -> DataFrame:
    """The columns of ``t`` (``_text`` included, which goes) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    ``_lines`` has a struct (h, n) for each line with a word: the hash of the normalised line and its words. Lines are
    normalised by lower-casing A-Z, making runs of digits 0 and spaces single.
    """
    others = [c for c in t.columns if c != "_text"]
    words = t.withColumn("_w", C.split_words(F.col("_text"), C.SPACES))
    n = F.size("_w")
    window = lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(5)))
    hashed = words.withColumn("_w5", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>")))
    raw = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    normal = F.transform("_raw", lambda x: F.trim(F.regexp_replace(F.regexp_replace(C.ascii_lower(x), "[0-9]+", "0"), C.SPACES, " ")))
    return hashed.withColumn("_raw", raw).withColumn("_normal", normal).select(
        *others,
        n.cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        _repeat_words("_w").alias("n_repeat_words"),
        F.transform("_normal", lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n"))).alias("_lines"),
    )


def frequent_lines(split: DataFrame, max_documents: int) -> DataFrame:
    """(_host, _line) of the lines that over ``max_documents`` distinct documents of their host have.

    ``split`` has _host, _key and _lines. Exact copies of one text are one document; other texts count each.
    """
    held = split.select("_host", "_key", F.explode(F.array_distinct("_lines.h")).alias("_line")).distinct()
    return held.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > max_documents).select("_host", "_line")


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20, max_documents: int = 10, min_left: float = 0.25) -> DataFrame:
    """One row per input row: the id, the content key of common.rows, the base statistics, n_removed_words, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` % of them in repeated 5-word windows.
    A line is over the limit when over ``max_documents`` distinct documents of its host have it (``frequent_lines`` says
    what counts); a document keeps if it did not base-fail and at least ``min_left`` of its words stand in other
    lines. A null or blank text has no words and base-fails; null hosts are one host with those named ''. Repeated rows each get
    their own result; two rows of one id with different texts too. An empty table gives an empty result. Extra columns
    are ignored. Texts of any length are read whole; each is split once, and only hashes of its lines go further.
    """
    t = C.rows(docs, host_col, id_col=id_col, text_col=text_col).withColumn("_host", F.coalesce(F.col(f"_{host_col}").cast("string"), F.lit(""))).select("_id", "_text", "_key", "_host")
    split = C.stored(base_statistics(t), "lines")
    frequent = C.stored(frequent_lines(split, max_documents), "frequent")
    lines = split.select("_id", "_key", "_host", F.posexplode("_lines").alias("_at", "_l")).select("_id", "_key", "_host", "_at", F.col("_l.h").alias("_line"), F.col("_l.n").alias("_n"))
    if C.at_most(frequent, FEW_LINES):
        hits = lines.join(F.broadcast(frequent), ["_host", "_line"])
    else:
        salted = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("_salt", F.pmod(F.xxhash64("_key", "_id", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_line", "_salt"])
    removed = hits.groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(F.collect_set(F.struct("_at", "_n")).alias("_set")).select("_rid", "_rkey", F.aggregate("_set", F.lit(0).cast("long"), lambda a, s: a + s["_n"]).alias("_removed"))
    base = split.drop("_lines", "_host")
    joined = base.join(removed, base["_id"].eqNullSafe(removed["_rid"]) & (base["_key"] == removed["_rkey"]), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    gone = F.coalesce("_removed", F.lit(0).cast("long"))
    return joined.select(
        F.col("_id").alias(id_col), "_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("n_removed_words"), failed.alias("base_failed"), (~failed & (F.col("n_words") - gone >= min_left * F.col("n_words"))).alias("kept")
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return quality_rules(C.table(spark, sf_dir, "documents")).drop("_key")


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP4_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, {_WORDS} AS w FROM documents),
lines AS (
  SELECT doc_id, host, md5(text) AS copy, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(translate(text, '{C.UPPER}', '{C.LOWER}'), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line
  FROM t),
frequent AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT copy) > 10),
removed AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS removed FROM lines JOIN frequent USING (host, line) GROUP BY doc_id),
raw AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM wins GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM wins JOIN twice USING (doc_id, g)) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed_words
  FROM t JOIN raw USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 0.25 * n_words AS kept
FROM base
"""
