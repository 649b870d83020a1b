"""Exact substring dedup with a sparse suffix array.

Of every window of ``length`` bytes one place, chosen by content, is an anchor; equal windows have equal anchors, so the
suffixes at anchors are enough. Sampled splitters range-partition them by their leading bytes, buckets are sorted, and
neighbours compared, the last of a bucket with the first of the next. Anchors whose whole reach has a copy are done.
Those that share their leading bytes with others but not the whole reach are sorted once more with their text, forwards
and backwards; neighbours' common prefixes give the windows that have a copy, and bounds beyond which none can have.
Windows between the two are compared by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.functions.ship import ship

from . import common as C

#: Windows of a text that are handled at once.
PART = 1 << 20


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _int(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


def _suffixes(t: DataFrame, length: int) -> DataFrame:
    """One row per anchor: its leading 8 bytes, hashes of its gram (h) and of its whole reach (f), its place p and windows lo to hi."""
    schema = T.StructType([t.schema["_id"], t.schema["_key"], _long("lead"), _long("h"), _long("f"), _int("p"), _int("lo"), _int("hi")])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .suffixes import pieces, suffix_rows

        out = to_arrow_schema(schema)
        for batch in pieces(batches):
            texts = batch.column(2).to_pylist()
            held, counts = [], np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                found = suffix_rows(text.encode(), length, PART)
                counts[i] = len(found[0])
                if counts[i]:
                    held.append(found)
            at = pa.array(np.repeat(np.arange(len(texts)), counts))
            columns = [batch.column(0).take(at), batch.column(1).take(at)] + [pa.array(np.concatenate([x[k] for x in held]) if held else [], f.type) for k, f in enumerate(list(out)[2:])]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return t.select("_id", "_key", "_text").mapInArrow(run, schema)


def _flags(suffixes: DataFrame) -> DataFrame:
    """The rows that share their leading gram with another, with ``fine`` (no other has the whole reach) and ``rep``.

    Neighbours in sorted order tell: a copy of the whole reach is next to a row or nowhere. ``rep`` rows stand for their
    copies where a group has other rows too.
    """
    order = ["lead", "h", "f", "_id", "_key", "p"]
    schema = T.StructType([*suffixes.schema.fields, *(T.StructField(c, T.BooleanType()) for c in ("ph", "pf", "nh", "nf")), _int("part"), _int("end")])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, part = to_arrow_schema(schema), TaskContext.get().partitionId()

        def keys(batch):
            return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("lead", "h", "f")]

        def same(a, b):
            g = (a[0] == b[0]) & (a[1] == b[1])
            return g, g & (a[2] == b[2])

        held, ph, pf, begun = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            k = keys(batch)
            g, f = same([x[:-1] for x in k], [x[1:] for x in k])
            # The flags of all rows but the last, which waits for its next.
            before_h, before_f = np.concatenate(([ph], g[:-1])) if len(g) else np.array([], object), np.concatenate(([pf], f[:-1])) if len(f) else np.array([], object)
            if len(g):
                yield from emit(pa, out, batch.slice(0, batch.num_rows - 1), before_h, before_f, g, f, part, 0 if not begun else None, None)
                begun = True
                ph, pf = bool(g[-1]), bool(f[-1])
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield from emit(pa, out, held, np.array([ph], object), np.array([pf], object), np.array([None], object), np.array([None], object), part, 0 if not begun else None, 1)

    def emit(pa, out, rows, ph, pf, nh, nf, part, first, last):
        import numpy as np

        n = rows.num_rows
        ends = np.full(n, None, object)
        if first is not None:
            ends[0] = 0
        if last is not None:
            ends[-1] = 1 if first is None else 0
        ph, pf, nh, nf = (np.asarray(x, object) for x in (ph, pf, nh, nf))
        kept = np.flatnonzero((ph == True) | (nh == True) | np.array([e is not None for e in ends]))  # noqa: E712
        if len(kept):
            rows = rows.take(pa.array(kept))
            extra = [pa.array(x[kept].tolist(), pa.bool_()) for x in (ph, pf, nh, nf)]
            e = ends[kept].tolist()
            extra += [pa.array([None if x is None else part for x in e], pa.int32()), pa.array(e, pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *extra], schema=out)

    found = C.stored(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "neighbours")
    # The ends of buckets: two rows of each at most, whose missing neighbours are the ends of the buckets beside.
    w, key = Window.orderBy("part", "end"), F.struct("lead", "h", "f")
    ends = found.where("part IS NOT NULL").withColumn("_before", F.lag(key).over(w)).withColumn("_after", F.lead(key).over(w))

    def met(flag: str, side: str, *names: str):
        equal = F.lit(True)
        for n in names:
            equal &= F.col(n) == F.col(f"{side}.{n}")
        return F.coalesce(F.col(flag), equal, F.lit(False)).alias(flag)

    others = [c for c in found.columns if c not in ("ph", "pf", "nh", "nf")]
    ends = ends.select(*others, met("ph", "_before", "lead", "h"), met("pf", "_before", "lead", "h", "f"), met("nh", "_after", "lead", "h"), met("nf", "_after", "lead", "h", "f"))
    both = found.where("part IS NULL").select(*ends.columns).unionByName(ends).where("ph OR nh")
    whole = F.col("pf") | F.col("nf")
    return both.select("_id", "_key", "lead", "h", "p", "lo", "hi", (~whole).alias("fine"), (whole & (F.col("ph") & ~F.col("pf") | F.col("nh") & ~F.col("nf"))).alias("rep"))


def _records(t: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The rows with their reach: ``fwd`` from the anchor on, ``back`` from before it in reverse."""
    per = rows.groupBy(F.col("_id").alias("_rid"), F.col("_key").alias("_rkey")).agg(F.collect_set(F.struct("lead", "h", "p", "lo", "hi", "fine")).alias("_at"))
    texts = t.join(per, t["_id"].eqNullSafe(per["_rid"]) & (t["_key"] == per["_rkey"])).select("_id", "_key", "_text", "_at")
    schema = T.StructType([t.schema["_id"], t.schema["_key"], _long("lead"), _long("h"), _int("p"), _int("lo"), _int("hi"), T.StructField("fine", T.BooleanType()), T.StructField("fwd", T.BinaryType()), T.StructField("back", T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .suffixes import pieces

        out = to_arrow_schema(schema)
        for batch in pieces(batches):
            rows = []
            for key, kind, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for s in at:
                    p, lo, hi = s["p"], s["lo"], s["hi"]
                    rows.append((key, kind, s["lead"], s["h"], p, lo, hi, s["fine"], data[p : hi + length], data[lo:p][::-1]))
                    if len(rows) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return texts.mapInArrow(run, schema)


def _compare(records: DataFrame, by: str, length: int) -> DataFrame:
    """Per row and neighbour in the order of (lead, h, ``by``): the common bytes on both sides and the windows they cover."""
    order = ["lead", "h", by, "_id", "_key", "p"]
    result = T.StructType([records.schema["_id"], records.schema["_key"], _int("p"), _int("lo"), _int("hi"), _long("h"), _int("fwd_n"), _int("back_n")])
    schema = T.StructType([*result.fields, T.StructField("edge", records.schema)])
    names = records.columns

    def pairs(table):
        """(row, forward, backward) of each row with its next or its one before, where they share h."""
        import numpy as np
        import pyarrow as pa

        lead, h = (table.column(c).to_numpy() for c in ("lead", "h"))
        at = np.flatnonzero((lead[1:] == lead[:-1]) & (h[1:] == h[:-1]))
        if not len(at):
            return at, at, at
        both = []
        for c in ("fwd", "back"):
            col = table.column(c).combine_chunks()
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
            n = np.minimum(offsets[at + 1] - offsets[at], offsets[at + 2] - offsets[at + 1])
            width = int(n.max(initial=0))
            lcp = n.copy()
            for s in range(0, len(at), 4096):  # in blocks: rows by width bytes
                a, k = at[s : s + 4096], n[s : s + 4096]
                span = np.arange(width)
                inside = span < k[:, None]
                x = data[np.where(inside, offsets[a][:, None] + span, 0)] if width else np.zeros((len(a), 0), np.uint8)
                y = data[np.where(inside, offsets[a + 1][:, None] + span, 0)] if width else x
                differ = inside & (x != y)
                hit = differ.any(axis=1) if width else np.zeros(len(a), bool)
                lcp[s : s + 4096] = np.where(hit, differ.argmax(axis=1) if width else 0, k)
            both.append(lcp)
        return at, both[0], both[1]

    def rows_of(table, out):
        import numpy as np
        import pyarrow as pa

        at, fwd, back = pairs(table)
        ids = np.concatenate((at, at + 1))
        fine = table.column("fine").to_numpy(zero_copy_only=False)[ids].astype(bool) if len(ids) else np.zeros(0, bool)
        ids, fwd, back = ids[fine], np.concatenate((fwd, fwd))[fine], np.concatenate((back, back))[fine]
        taken = table.select(["_id", "_key", "p", "lo", "hi", "h"]).take(pa.array(ids, pa.int64())).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in columns]
        columns = [c if not isinstance(c, pa.ChunkedArray) else pa.array([], c.type) for c in columns]
        return [*columns, pa.array(fwd, pa.int32()), pa.array(back, pa.int32())]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        kept, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch])
            columns = rows_of(table, out)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, list(out)[:-1], strict=True)] + [pa.nulls(len(columns[0]), out.field("edge").type)], schema=out)
            first = batch.slice(0, 1) if first is None else first
            kept = batch.slice(batch.num_rows - 1)
        if kept is not None:
            edges = [*first.to_pylist(), *kept.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.nulls(2, f.type) for f in list(out)[:-1]] + [pa.array([{n: e[n] for n in names} for e in edges], out.field("edge").type)], schema=out)

    def run_edges(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out, kept = to_arrow_schema(result), None
        for batch in batches:
            if batch.num_rows:
                columns = rows_of(pa.Table.from_batches([batch] if kept is None else [kept, batch]), out)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)
                kept = batch.slice(batch.num_rows - 1)

    found = C.stored(records.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), f"compared-{by}")
    # The ends of buckets, two rows of each: neighbours across boundaries meet in their common order.
    edges = found.where("edge IS NOT NULL").select("edge.*").distinct().repartition(1).sortWithinPartitions(*order).mapInArrow(run_edges, result)
    return found.where("edge IS NULL").drop("edge").unionByName(edges)


def _window_hashes(records: DataFrame, length: int) -> DataFrame:
    """(h, d, w, _id, _key, at, asked) of every window of the records; ``asked`` holds the starts that are asked for."""
    schema = T.StructType([_long("h"), _int("d"), T.StructField("w", T.BinaryType()), records.schema["_id"], records.schema["_key"], _int("at"), T.StructField("asked", T.BooleanType())])

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .suffixes import pieces

        out = to_arrow_schema(schema)
        for batch in pieces(batches):
            rows = []
            for r in batch.to_pylist():
                data, asked = r["back"][::-1] + r["fwd"], set(r["asked"] or ())
                for i in range(r["lo"], r["hi"] + 1):
                    piece = data[i - r["lo"] : i - r["lo"] + length]
                    rows.append((r["h"], r["p"] - i, hashlib.blake2b(piece, digest_size=16).digest(), r["_id"], r["_key"], i, i in asked))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return records.mapInArrow(run, schema)


def copied_ranges(t: DataFrame, length: int) -> DataFrame:
    """(_id, _key, ranges) of the rows (_id, _key, _text) with byte ranges (s, e) whose windows have a copy elsewhere."""
    suffixes = C.stored(_suffixes(t, length), "suffixes")
    flags = C.stored(_flags(suffixes), "flags")
    C.discard(suffixes)
    whole = flags.where("NOT fine").select("_id", "_key", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    # Records of groups that have a fine row; a group's whole copies stand for themselves by their first and last rows.
    records = C.stored(_records(t, flags.where("fine OR rep"), length), "records")
    met = C.stored(_compare(records, "fwd", length).unionByName(_compare(records, "back", length)), "met")
    covered = met.select("_id", "_key", F.greatest("lo", F.col("p") - F.col("back_n")).alias("s"), F.least("hi", F.col("p") + F.col("fwd_n") - length).alias("l")).where("s <= l").select("_id", "_key", "s", (F.col("l") + length).alias("e"))
    cover = F.struct(F.greatest("lo", F.col("p") - F.col("back_n")).alias("a"), F.least("hi", F.col("p") + F.col("fwd_n") - length).alias("b"))
    per = met.groupBy("_id", "_key", "p", "lo", "hi", "h").agg(F.max("fwd_n").alias("_f"), F.max("back_n").alias("_b"), F.collect_set(cover).alias("_covers"))
    per = per.withColumn("_from", F.greatest("lo", F.col("p") - F.col("_b"))).withColumn("_to", F.least("hi", F.col("p") + F.col("_f") - length)).where("_from <= _to")
    per = per.where(~F.exists("_covers", lambda c: (c["a"] <= F.col("_from")) & (c["b"] >= F.col("_to"))))
    open_starts = F.filter(F.sequence("_from", "_to"), lambda i: ~F.exists("_covers", lambda c: (c["a"] <= i) & (c["b"] >= i)))
    asked = C.stored(per.select("_id", "_key", "p", "h", open_starts.alias("asked")).where(F.size("asked") > 0), "asked")
    ranges = whole.unionByName(covered)
    if not asked.isEmpty():
        groups = asked.select("h").distinct()
        mine = asked.select(F.col("_id").alias("_aid"), F.col("_key").alias("_akey"), F.col("p").alias("_ap"), "asked")
        r = records.join(groups, "h", "left_semi")
        r = r.join(mine, r["_id"].eqNullSafe(mine["_aid"]) & (r["_key"] == mine["_akey"]) & (r["p"] == mine["_ap"]), "left").drop("_aid", "_akey", "_ap")
        windows = C.stored(_window_hashes(r, length), "windows")
        twice = windows.groupBy("h", "d", "w").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        ranges = ranges.unionByName(windows.where("asked").join(twice, ["h", "d", "w"]).select("_id", "_key", F.col("at").alias("s"), (F.col("at") + length).alias("e")))
    return ranges.groupBy("_id", "_key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("ranges"))


def remove_copied(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text", emit_text: bool = True) -> DataFrame:
    """One row per input row: the id, n_bytes, n_removed, n_spans, spans (s, e in bytes), kept_sha256, kept (bytes).

    Texts are UTF-8 bytes. Each byte that a ``length``-byte string covers which starts anywhere else too, in the same
    text or another, is removed; strings are judged on the input. A null text is empty. A repeated row is one more place
    for its strings. Texts under ``length`` bytes stay. An empty table gives no rows; extra columns are ignored.
    ``emit_text=False`` leaves the kept bytes out.
    """
    ship(docs.sparkSession)
    t = C.rows(docs, id_col=id_col, text_col=text_col)
    found = copied_ranges(t, length).withColumnsRenamed({"_id": "_rid", "_key": "_rkey"})
    joined = t.join(found, t["_id"].eqNullSafe(found["_rid"]) & (t["_key"] == found["_rkey"]), "left").select("_id", "_text", "ranges")
    spans = T.ArrayType(T.StructType([_int("s"), _int("e")]))
    schema = T.StructType([t.schema["_id"], _long("n_bytes"), _long("n_removed"), _long("n_spans"), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", spans), *([T.StructField("kept", T.BinaryType())] if emit_text else [])])

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .suffixes import pieces

        out = to_arrow_schema(schema)
        for batch in pieces(batches):
            rows = []
            for key, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, runs = text.encode(), []
                for r in ranges or ():
                    if runs and r["s"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r["e"])
                    else:
                        runs.append([r["s"], r["e"]])
                parts, at = [], 0
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                rows.append((key, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"s": a, "e": b} for a, b in runs], *([kept] if emit_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return joined.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    return remove_copied(C.table(spark, sf_dir, "documents"), emit_text=False).drop("spans")
