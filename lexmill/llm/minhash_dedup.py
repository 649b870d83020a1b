"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

Documents with one shingle set are one node from the start. Each bucket of a band proposes edges to its hub alone, the
member that shares buckets with most others, so a bucket of n nodes makes n - 1 pairs. Pairs are confirmed on the full
sets. Members of a bucket that are not in one component then are met in full, so that no link within a bucket is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.functions.ship import ship

from . import common as C
from .components import components

#: 40 bands of 6 rows: a pair at 0.8 shares no band with probability 5e-6, one at 0.3 shares one with 3 %.
BANDS, ROWS = 40, 6
#: Pairs that are compared at once, and shingles (8 bytes each) of their sets.
AT_ONCE, SHINGLES_AT_ONCE = 4_000, 4_000_000
#: Buckets up to this size compare pair by pair what the stars left apart; members of larger ones meet in blocks of so many.
SMALL, BLOCK = 8, 512
SALTS = 16


def _sets(texts: list[str], k: int):
    import numpy as np

    from .shingles import sequences, words_in

    for text in texts:
        yield np.unique(sequences(words_in(text.encode())[0], k))


def signatures(t: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Per row of ``t``: _id, _key, n (shingles), node (the set's name; null without words), bands (their keys)."""
    schema = T.StructType([t.schema["_id"], t.schema["_key"], T.StructField("n", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from .shingles import band_keys, set_name

        out = to_arrow_schema(schema)
        for batch in batches:
            n, a, b, keys = [], [], [], []
            for s in _sets(batch.column(2).to_pylist(), k):
                x, y = set_name(s) if len(s) else (None, None)
                n.append(len(s)), a.append(x), b.append(y)
                keys.append(band_keys(s, bands, rows).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, f.type) for v, f in zip((n, a, b, keys), list(out)[2:], strict=True))], schema=out)

    found = t.select("_id", "_key", "_text").mapInArrow(run, schema)
    return found.select("_id", "_key", "n", F.when(F.col("n") > 0, F.struct("a", "b")).alias("node"), "bands")


def _full_sets(t: DataFrame, k: int) -> DataFrame:
    """Per row of ``t`` (node, _text): the node and its whole set."""
    schema = T.StructType([t.schema["node"], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            found = [s.astype(np.int64) for s in _sets(batch.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out.field("set").type)], names=["node", "set"])

    return t.select("node", "_text").mapInArrow(run, schema)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (node, hub), stored, whose ``sets`` (node, set, n) are linked.

    Pairs are dealt to a square of cells by the hashes of both nodes, so that a set goes to a cell once for all its pairs
    there and a hub's many pairs go to many cells. The square grows with the pairs and with the ids in their sets. The
    sets wait where they are for the cells of up to FEW_ROWS // 2 names, and are dealt out by name for more.
    """
    sizes = sets.select("node", "n")
    count, held = pairs.join(sizes, "node").agg(F.count(F.lit(1)), F.sum("n")).first()
    side = max(1, math.ceil(math.sqrt(max(count / AT_ONCE, 2 * (held or 0) / SHINGLES_AT_ONCE))))
    row, column = (F.pmod(F.xxhash64(c), F.lit(side)) for c in ("node", "hub"))
    dealt = pairs.select((row * side + column).alias("cell"), "node", "hub")
    wanted = dealt.select(F.col("cell").alias("at"), F.col("node").alias("name")).unionByName(dealt.select(F.col("cell").alias("at"), F.col("hub").alias("name"))).distinct()
    wanted = F.broadcast(wanted) if 2 * count <= C.FEW_ROWS // 2 else wanted
    held = wanted.join(sets.select(F.col("node").alias("name"), "set"), "name").select("at", "name", "set")
    schema = pairs.schema

    def run(found, known):
        import numpy as np
        import pyarrow as pa

        names = [(x["a"], x["b"]) for x in known.column("name").to_pylist()]
        of = dict(zip(names, (np.asarray(x.values) for x in known.column("set")), strict=True))
        keep = []
        for x, y in zip(found.column("node").to_pylist(), found.column("hub").to_pylist(), strict=True):
            x, y = of[x["a"], x["b"]], of[y["a"], y["b"]]
            both = np.concatenate((x, y))
            both.sort()
            both = int((both[1:] == both[:-1]).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return found.select(["node", "hub"]).filter(pa.array(keep, pa.bool_()))

    return dealt.groupBy("cell").cogroup(held.groupBy("at")).applyInArrow(run, schema)


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (node, hub), node < hub, in a small bucket of ``members`` (bucket, node, component, n) but not in a component."""
    other = members.select("bucket", F.col("node").alias("hub"), F.col("component").alias("_c"), F.col("n").alias("_n"))
    apart = (F.col("node") < F.col("hub")) & (F.col("component") != F.col("_c")) & (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n"))
    return members.join(other, "bucket").where(apart).select("node", "hub").distinct()


def _met_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (node, hub) between the components of groups ``members`` (group, node, component, n): each linked pair has a path.

    A group is dealt to blocks of some BLOCK members, fewer where sets are large, and any two blocks meet in one cell,
    where a matrix product counts common shingles. Pairs are no rows: a cell gives the edges of a forest of its links.
    """
    by = members.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES_AT_ONCE)).alias("_blocks"))
    own = members.join(by, "group").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    cells = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cells = cells.select("group", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), F.col("_own"), "node", "component")
    held = cells.join(sets.select("node", "set"), "node")
    schema = T.StructType([T.StructField(c, members.schema["node"].dataType) for c in ("node", "hub")])

    def run(table):
        import numpy as np
        import pyarrow as pa

        from .shingles import common_counts

        lengths = np.asarray(table.column("set").combine_chunks().value_lengths()).astype(np.int64)
        values = np.asarray(table.column("set").combine_chunks().flatten())
        part = table.column("component").to_pylist()
        of = {c: i for i, c in enumerate(dict.fromkeys((c["a"], c["b"]) for c in part))}
        label = np.array([of[c["a"], c["b"]] for c in part])
        if len(of) < 2:  # all in one component
            return table.select(["node", "node"]).rename_columns(["node", "hub"]).slice(0, 0)
        left, right = [], []
        block = table.column("_own").to_numpy()
        crossed = block.min(initial=0) != block.max(initial=0)
        for i, both in common_counts(values, lengths):
            linked = 100 * both >= percent * (lengths[i] + lengths - both)
            if crossed:
                linked &= block != block[i]  # a block's own pairs meet where it meets itself
            while True:
                apart = np.flatnonzero(linked & (label != label[i]))
                if not len(apart):
                    break
                left.append(i), right.append(apart[0])
                label[label == label[apart[0]]] = label[i]
        nodes = table.column("node").combine_chunks()
        take = lambda at: nodes.take(pa.array(np.array(at, np.int64)))
        return pa.Table.from_arrays([take(left), take(right)], names=["node", "hub"])

    return held.groupBy("group", "_lo", "_hi").applyInArrow(run, schema)


def star_links(members: DataFrame, full_sets, percent: int) -> DataFrame:
    """Edges (node, hub) between the distinct ``members`` (bucket, node): all linked pairs within a bucket have a path of them.

    ``full_sets`` gives (node, set) for a table of nodes. A node's score is the number of nodes that its buckets hold, so
    that the text which most copies still resemble becomes the hub of its buckets. Components of the stars' links follow.
    Buckets with members of more than one component are not done: in those of up to SMALL members the pairs that are in no common component are
    compared; the members of larger ones are gathered by hub, as all of a bucket have met its hub, and met in blocks.
    """
    # Counted where they are, so that the members go to their buckets once and no table of counts goes beside them.
    size = F.count(F.lit(1)).over(Window.partitionBy("bucket"))
    crowded = C.stored(members.select("bucket", "node", size.alias("_size")).where("_size > 1"), "buckets")
    score = C.stored(crowded.groupBy("node").agg(F.sum("_size").alias("score")), "scores")
    sets = C.stored(full_sets(score.select("node")).withColumn("n", F.size("set").cast("long")), "sets")
    top = crowded.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("_top"), F.max("_size").alias("_size"))
    top = C.stored(top.select("bucket", F.col("_top.node").alias("hub"), "_size"), "hubs")
    named = crowded.select("bucket", "node").join(top, "bucket")
    pairs = C.stored(named.where("node <> hub").select("node", "hub").distinct(), "stars")
    links = C.stored(_linked(pairs, sets, percent), "star-links")
    found = components(links, "node", "hub")
    placed = sets.select("node", "n").join(found, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    held = C.stored(named.where("_size > 2").join(placed, "node"), "placed")
    mixed = held.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select("bucket")
    apart = C.stored(held.join(mixed, "bucket"), "apart")
    few = C.stored(_small_pairs(apart.where(F.col("_size") <= SMALL).select("bucket", "node", "component", "n"), percent).join(pairs.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")), ["node", "hub"], "left_anti"), "few")
    groups = apart.where(F.col("_size") > SMALL).select(F.col("hub").alias("group"), "node", "component", "n").distinct()
    # The sets that these pairs and groups need, most often a small part, are set aside, so that the others are not dealt out again.
    named = C.stored(few.select("node").unionByName(few.select(F.col("hub").alias("node"))).unionByName(groups.select("node")).distinct(), "needed")
    needed = C.stored(sets.join(C.few(named, C.FEW_ROWS // 2), "node", "left_semi"), "needed-sets")
    C.discard(crowded, score, sets, top, pairs, held, named)
    more = C.stored(_linked(few, needed, percent).unionByName(_met_in_blocks(groups, needed, percent)), "links")
    C.discard(apart, few, needed)
    return found.select("node", F.col("component").alias("hub")).unionByName(more)


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the content key of common.rows, n_shingles, component_id, kept.

    A text's set: its distinct ``k``-word shingles after lower-casing A-Z, or all its words as one if they are fewer. Texts
    with 100 * intersection >= percent * union are linked; component_id is the least id reachable, and kept says whether
    the id is that. Every link between texts that share a band is in the result; a pair at 0.8 shares none of the 40 bands
    of 6 rows with probability 5e-6, and such a pair is linked only if others connect it. A null or blank text has an
    empty set and is linked with nothing. Texts are read whole, however long. Rows that repeat an id share its
    fate; a null id is never the least unless all are null. An empty table gives no rows; extra columns are ignored.
    """
    ship(docs.sparkSession)
    t = C.rows(docs, id_col=id_col, text_col=text_col)
    signed = C.stored(signatures(t, k, bands, rows), "minhash")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("least"), F.min(F.struct("_id", "_key")).alias("one"), F.count(F.lit(1)).alias("_rows"))

    def full_sets(wanted: DataFrame) -> DataFrame:
        involved = C.stored(wanted.join(nodes, "node").select("node", F.col("one._id").alias("_rid"), F.col("one._key").alias("_rkey"), "_rows"), "involved")

        def texts(which: DataFrame) -> DataFrame:
            return t.join(C.few(which, C.FEW_ROWS // 2), t["_id"].eqNullSafe(which["_rid"]) & (t["_key"] == which["_rkey"])).select("node", "_text")

        # Only a node of several rows can meet its id and key twice.
        alone, copied = (involved.where(x) for x in ("_rows = 1", "_rows > 1"))
        found = texts(alone)
        return _full_sets(found if copied.isEmpty() else found.unionByName(texts(copied).dropDuplicates(["node"])), k)

    # Copies of a set fall together here, before anything is dealt out by bucket.
    once = signed.where("node IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    edges = star_links(once.select(F.explode("bands").alias("bucket"), "node"), full_sets, percent)
    found = components(edges, "node", "hub")

    of = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # A component can hold very many nodes: its least id is copied to so many salts.
    least = of.groupBy("component").agg(F.min("least").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = of.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(least, ["component", "_salt"]).select(F.col("node").alias("_node"), "component_id")
    done = signed.join(named, signed["node"] == named["_node"], "left")
    component = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return done.select(F.col("_id").alias(id_col), F.col("_key"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), k=2).drop("_key")
