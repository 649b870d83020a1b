"""Substring dedup by paragraphs: MinHash banding for high recall, exact Jaccard, removals clustered by components.

Paragraphs of a text are compared by similarity. Passages of ``passage`` words or more that stand inside other paragraphs
or across them are found by content-chosen anchors, of which every window of that many words holds one: anchors with
equal words around have equal windows throughout; where only some agree, the windows are compared one by one. Of each
cluster of paragraphs and of equal windows all but the first, by document id and place, are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.ship import ship

from . import common as C
from .components import components
from .minhash_dedup import star_links

#: 9 bands of 2 rows: a pair at 0.8 shares no band with probability 1e-4.
BANDS, ROWS = 9, 2
#: Words of the gram that chooses a passage's anchors.
GRAM = 12


def words_of(text: str):
    """(words, starts, ends, line): word hashes, their code point ranges, and the line that each stands in."""
    import numpy as np

    from .shingles import words_in

    raw = text.encode()
    words, starts, ends = words_in(raw)
    data = np.frombuffer(raw, np.uint8)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    if len(raw) != len(text):
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        starts, ends = points[starts], points[ends]
    return words, starts, ends, line


def paragraphs(line, min_words: int) -> list[tuple[int, int]]:
    """Word ranges of the paragraphs, from each word's line: a line of ``min_words`` or more is one of its own; shorter lines that
    follow each other with no blank line between, as hard-wrapped text has them, are one together if they have so many."""
    import numpy as np

    if not len(line):
        return []
    cut = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))).tolist()
    found, open_from, last = [], None, None
    for a, b in zip(cut, [*cut[1:], len(line)], strict=True):
        at = line[a]
        if open_from is not None and (b - a >= min_words or at != last + 1):
            if a - open_from >= min_words:
                found.append((open_from, a))
            open_from = None
        if b - a >= min_words:
            found.append((a, b))
        elif open_from is None:
            open_from = a
        last = at
    if open_from is not None and len(line) - open_from >= min_words:
        found.append((open_from, len(line)))
    return found


def _parsed(t: DataFrame, min_words: int, k: int, passage: int, bands: int, rows: int) -> DataFrame:
    """One row per paragraph (a, b name its words; ``bands``) and per anchor (a: its gram, b: all words of its windows; no bands).

    from and to: the paragraph's word range, or the first and the last start of the anchor's windows; p: its place; s, e: code points.
    """
    schema = T.StructType([t.schema["_id"], t.schema["_key"], *(T.StructField(c, T.LongType()) for c in ("a", "b")), *(T.StructField(c, T.IntegerType()) for c in ("from", "to", "p", "s", "e")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .shingles import Ranges, band_keys_of
        from .suffixes import anchors

        out = to_arrow_schema(schema)

        def rows_of(batch, at, columns, keys):
            at = pa.array(np.concatenate(at))
            held = [np.concatenate(c) for c in columns]
            made = [batch.column(0).take(at), batch.column(1).take(at)] + [pa.array(c.astype(np.int64 if f.type == pa.int64() else np.int32), f.type) for c, f in zip(held, list(out)[2:-1], strict=True)]
            last = pa.nulls(len(at), out[-1].type) if keys is None else pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands), pa.array(keys.astype(np.int64).ravel())).cast(out[-1].type)
            return pa.RecordBatch.from_arrays([*made, last], schema=out)

        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                at, columns, shingled, lengths = [], [[] for _ in range(7)], [], []
                at_a, columns_a = [], [[] for _ in range(7)]
                for i, text in enumerate(batch.column(2).to_pylist()):
                    words, starts, ends, line = words_of(text)
                    found = np.array(paragraphs(line, min_words), np.int64).reshape(-1, 2)
                    n = len(words)
                    if not len(found) and n < passage:
                        continue
                    names = Ranges(words)
                    if len(found):
                        x, y = found[:, 0], found[:, 1]
                        at.append(np.full(len(found), i))
                        for c, v in zip(columns, (names.of(x, y), names.of(x, y, 1), x, y, x, starts[x], ends[y - 1]), strict=True):
                            c.append(v)
                        sizes = y - x - k + 1
                        each = np.repeat(x, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                        shingled.append(names.of(each, each + k))
                        lengths.append(sizes)
                    if n >= passage:
                        g = np.arange(n - GRAM + 1)
                        h = names.of(g, g + GRAM)
                        p, lo, hi = anchors(h, passage, GRAM)
                        reach = names.of(lo, hi + passage, 1) + (p - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        at_a.append(np.full(len(p), i))
                        for c, v in zip(columns_a, (h[p], reach, lo, hi, p, starts[lo], ends[hi + passage - 1]), strict=True):
                            c.append(v)
                if at:
                    yield rows_of(batch, at, columns, band_keys_of(np.concatenate(shingled), np.concatenate(lengths), bands, rows))
                if at_a:
                    yield rows_of(batch, at_a, columns_a, None)

    return t.select("_id", "_key", "_text").mapInArrow(run, schema)


def _unit_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, set) of rows (_text, at), at an array of (node, from, to)."""
    schema = T.StructType([texts.schema["at"].dataType.elementType["node"], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .shingles import Ranges, words_in

        out = to_arrow_schema(schema)
        for batch in batches:
            names, sets = [], []
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ranges = Ranges(words_in(text.encode())[0])
                for unit in at:
                    each = np.arange(unit["from"], unit["to"] - k + 1)
                    names.append(unit["node"])
                    sets.append(np.unique(ranges.of(each, each + k)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, out.field("node").type), pa.array(sets, out.field("set").type)], schema=out)

    return texts.mapInArrow(run, schema)


def _window_rows(t: DataFrame, places: DataFrame, passage: int) -> DataFrame:
    """A row for each window of the anchors ``places`` (_id, _key, a, from, to): a, w (its name), at, s, e."""
    per = places.groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(F.collect_set(F.struct("a", "from", "to")).alias("_at"))
    texts = t.join(per, t["_id"].eqNullSafe(per["_rid"]) & (t["_key"] == per["_rkey"])).select("_id", "_key", "_text", "_at")
    schema = T.StructType([t.schema["_id"], t.schema["_key"], T.StructField("a", T.LongType()), T.StructField("w", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("at", "s", "e"))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .shingles import Ranges

        out = to_arrow_schema(schema)
        for batch in batches:
            for i, (text, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words, starts, ends, _ = words_of(text)
                a, lo, hi = (np.array([x[c] for x in places], np.int64) for c in ("a", "from", "to"))
                sizes = hi - lo + 1
                at = np.repeat(lo, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = (np.repeat(a, sizes), Ranges(words).of(at, at + passage).astype(np.int64), at, starts[at], ends[at + passage - 1])
                own = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c.astype(np.int64 if f.type == pa.int64() else np.int32), f.type) for c, f in zip(columns, list(out)[2:], strict=True))], schema=out)

    return texts.mapInArrow(run, schema)


def _passages(t: DataFrame, anchored: DataFrame, passage: int) -> DataFrame:
    """(_id, _key, s, e, first) of the words whose ``passage``-word windows stand elsewhere before; ``first`` is where."""
    place = lambda at: F.struct("_id", "_key", F.col(at).alias("at"))
    same = lambda size: ~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_key") == F.col("first._key")) & (F.col("at") < F.col("first.at") + size))
    whole = anchored.groupBy("a", "b").agg(F.min(F.struct("_id", "_key", F.col("from").alias("at"), "to")).alias("_first"), F.max(place("from")).alias("_last"))
    whole = C.stored(whole, "reaches")
    copied = whole.select("a", "b", F.struct("_first._id", "_first._key", "_first.at").alias("first"), "_last").where("first <> _last").drop("_last")
    gone = anchored.withColumn("at", F.col("from")).join(copied, ["a", "b"]).where(same(F.col("to") - F.col("at") + passage)).select("_id", "_key", "s", "e", F.col("first._id").alias("first"))
    mixed = whole.groupBy("a").agg(F.min("b").alias("_x"), F.max("b").alias("_y")).where("_x <> _y").select("a")
    places = whole.join(mixed, "a").select("_first._id", "_first._key", "a", F.col("_first.at").alias("from"), "_first.to")
    windows = C.stored(_window_rows(t, places, passage), "windows")
    # A place is in here once, so a window that counts twice stands in two.
    twice = windows.groupBy("a", "w").agg(F.min(place("at")).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    more = windows.join(twice, ["a", "w"]).where(same(passage)).select("_id", "_key", "s", "e", F.col("first._id").alias("first"))
    found = C.stored(gone.unionByName(more), "passages")
    C.discard(whole, windows)
    return found


def dedup_paragraphs(docs: DataFrame, *, min_words: int = 20, k: int = 5, percent: int = 80, passage: int = 51, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the content key of common.rows, n_chars, n_units, n_removed (code points), spans, first_ids.

    Paragraphs (``paragraphs`` says what they are; n_units counts them) are linked when their ``k``-word shingle sets, A-Z lower-cased, have 100 *
    intersection >= percent * union; a pair at 0.8 shares no band with probability 1e-4. Passages are runs of ``passage`` words or more that
    stand elsewhere too, wherever they begin; none is missed (but for collisions of 64-bit hashes). Of each cluster of paragraphs, and of equal windows, that
    of the least (id, content key, place) stays, and the others' code point ranges, merged, are ``spans`` (structs s, e); ``first_ids`` has
    the ids of the documents with what stayed for them. A window that overlaps its own first stays. Null and empty texts have no
    units. Rows that repeat an id and its text are one document and get the same result. An empty table gives no rows; extra columns are ignored.
    """
    if min_words < k or passage < GRAM:
        raise ValueError("a paragraph holds a shingle, and a passage a gram")
    ship(docs.sparkSession)
    t = C.rows(docs, id_col=id_col, text_col=text_col)
    parsed = C.stored(_parsed(t, min_words, k, passage, bands, rows), "parsed")
    place = F.struct("_id", "_key", F.col("s").alias("at"))
    one = F.struct("_id", "_key", F.col("s").alias("at"), "from", "to")
    found = C.stored(parsed.where("bands IS NOT NULL").select("_id", "_key", F.struct("a", "b").alias("node"), "s", "e"), "units")
    held = C.stored(parsed.where("bands IS NOT NULL").groupBy(F.struct("a", "b").alias("node")).agg(F.min(one).alias("_one"), F.max(place).alias("_last"), F.first("bands").alias("bands")), "paragraphs")
    # Nearly all anchors stand alone by their gram.
    anchored = parsed.where("bands IS NULL").select("_id", "_key", "a", "b", "from", "to", "s", "e")
    anchored = C.stored(anchored.join(anchored.groupBy("a").count().where("count > 1").select("a"), "a"), "anchors")
    C.discard(parsed)
    passages = _passages(t, anchored, passage)
    C.discard(anchored)

    def full_sets(wanted: DataFrame) -> DataFrame:
        per = wanted.join(held, "node").groupBy(F.col("_one._id").alias("_rid"), F.col("_one._key").alias("_rkey")).agg(F.collect_set(F.struct("node", F.col("_one.from").alias("from"), F.col("_one.to").alias("to"))).alias("at"))
        texts = t.join(per, t["_id"].eqNullSafe(per["_rid"]) & (t["_key"] == per["_rkey"])).select("_text", "at")
        return _unit_sets(texts, k).dropDuplicates(["node"])

    near = components(star_links(held.select(F.explode("bands").alias("bucket"), "node"), full_sets, percent), "node", "hub")
    named = held.select("node", F.struct("_one._id", "_one._key", "_one.at").alias("_first"), "_last").join(near, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    clusters = named.groupBy("cluster").agg(F.min("_first").alias("first"), F.max("_last").alias("_end")).where("first <> _end").drop("_end")
    copied = C.stored(named.join(clusters, "cluster").select("node", "first"), "copied")
    gone = C.stored(found.join(copied, "node").where(place != F.col("first")).select("_id", "_key", "s", "e", F.col("first._id").alias("first")), "gone")
    C.discard(held, copied)
    gone = gone.unionByName(passages)
    per = gone.groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("_spans"), F.sort_array(F.collect_set("first")).alias("first_ids"))
    start = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    closed = lambda a: F.when(a["s"] >= 0, F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["done"])
    step = lambda a, x: F.when((a["s"] >= 0) & (x["s"] <= a["e"]), F.struct(a["done"].alias("done"), a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"))).otherwise(F.struct(closed(a).alias("done"), x["s"].alias("s"), x["e"].alias("e")))
    merged = F.aggregate("_spans", start, step, closed)
    counts = found.select("_id", "_key", "s").distinct().groupBy(F.col("_id").alias("_uid"), F.col("_key").alias("_ukey")).agg(F.count(F.lit(1)).alias("_units"))
    base = t.select("_id", "_key", F.length("_text").cast("long").alias("n_chars"))
    base = base.join(counts, base["_id"].eqNullSafe(counts["_uid"]) & (base["_key"] == counts["_ukey"]), "left")
    done = base.join(per, base["_id"].eqNullSafe(per["_rid"]) & (base["_key"] == per["_rkey"]), "left").withColumn("spans", F.coalesce(merged, F.array().cast("array<struct<s:int,e:int>>")))
    none = F.array().cast(T.ArrayType(t.schema["_id"].dataType))
    return done.select(F.col("_id").alias(id_col), "_key", "n_chars", F.coalesce("_units", F.lit(0).cast("long")).alias("n_units"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"])).alias("n_removed"), "spans", F.coalesce("first_ids", none).alias("first_ids"))


def op8(spark, sf_dir: str) -> DataFrame:
    return dedup_paragraphs(C.table(spark, sf_dir, "documents")).drop("_key")
