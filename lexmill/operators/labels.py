"""Sequence labels, chunks, splits and exact-span metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMES = {"BIO": "BI", "BIOES": "BIOES", "BILOU": "BILOU"}


def spans_to_labels(length: Column, spans: str, scheme: str = "BIO") -> Column:
    """One label for each code point, of an array column of disjoint (start, end, label)."""
    single, last = {"BIO": ("B", "I"), "BIOES": ("S", "E"), "BILOU": ("U", "L")}[scheme]

    def at(i):
        over = F.get(F.filter(spans, lambda s: (s["start"] <= i) & (i < s["end"])), 0)
        mark = F.when(over["end"] - over["start"] == 1, single).when(i == over["start"], "B").when(i == over["end"] - 1, last).otherwise("I")
        return F.when(over.isNull(), "O").otherwise(F.concat(mark, F.lit("-"), over["label"]))

    return F.when(length > 0, F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), at)).otherwise(F.array().cast("array<string>"))


#: The grammar of labels and the schemes by their names, letters in either case and without hyphens.
LABEL = r"^(?:O|([BILUES])-([A-Za-z][A-Za-z0-9_.:\-]*))\z"
SCHEMES = {"BIO": "BIO", "BIOES": "BIOES", "BILOU": "BILOU", "BIOUL": "BILOU"}


def scheme_name(scheme: str) -> str:
    """The scheme that a name means; an unknown one is an error."""
    try:
        return SCHEMES[scheme.upper().replace("-", "")]
    except KeyError:
        raise ValueError(f"no label scheme: {scheme}") from None


def label_parts(label: Column, strict: bool = True) -> Column:
    """(prefix, entity) of a label, O without an entity; of another string an error, or null unless ``strict``."""
    entity = F.nullif(F.regexp_extract(label, LABEL, 2), F.lit(""))
    parts = F.struct(F.left(label, F.lit(1)).alias("prefix"), entity.alias("entity"))
    wrong = F.raise_error(F.concat(F.lit("invalid label: "), F.coalesce(label, F.lit("null")))) if strict else F.lit(None)
    return F.when(label.rlike(LABEL), parts).otherwise(wrong.cast("struct<prefix:string,entity:string>"))


def labels_to_spans(docs: DataFrame, labels: str = "labels", id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, label) of label arrays of any scheme: B, S and U begin a span, O ends one.

    One fold over each row's labels, which are neither exploded nor shuffled. Labels that go on under another name, which no
    scheme has, are a span of that name from its first place to its last before the next beginning.
    """
    kind = "array<struct<label:string,start:int,end:int>>"
    none = F.array().cast(kind)
    each = F.filter(F.transform(labels, lambda l, i: F.struct(l.alias("l"), i.alias("at"))), lambda x: x["l"].isNotNull())

    def step(a: Column, x: Column) -> Column:
        begins, name = F.left(x["l"], F.lit(1)).isin("B", "S", "U", "O"), F.substring(x["l"], F.lit(3), F.length(x["l"]))
        span = lambda start: F.struct(name.alias("label"), start.alias("start"), (x["at"] + 1).alias("end"))
        longer = F.when(F.exists(a["open"], lambda s: s["label"] == name), F.transform(a["open"], lambda s: F.when(s["label"] == name, span(s["start"])).otherwise(s))).otherwise(F.array_append(a["open"], span(x["at"])))
        closed = F.struct(F.concat(a["done"], a["open"]).alias("done"), F.when(x["l"] == "O", none).otherwise(F.array(span(x["at"]))).cast(kind).alias("open"))
        return F.when((x["l"] == "O") & (F.size(a["open"]) == 0), a).when(begins, closed).otherwise(F.struct(a["done"].alias("done"), longer.cast(kind).alias("open")))

    found = F.aggregate(each, F.struct(none.alias("done"), none.alias("open")), step, lambda a: F.concat(a["done"], a["open"]))
    return docs.select(id_col, F.inline_outer(found)).where(F.col("start").isNotNull()).select(id_col, "start", "end", "label")


def parse_tags(text: Column) -> Column:
    """Text with its <TYPE>...</TYPE> marks taken out."""
    return F.regexp_replace(text, "</?[A-Z_]+>", "")


def chunks(docs: DataFrame, size: int, overlap: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start, end): windows of ``size`` code points that share ``overlap`` with the next, none after one that reaches the end."""
    step = size - overlap
    n = F.length(text_col)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0))
    each = docs.where(n > 0).select(id_col, n.alias("_len"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return each.select(id_col, "chunk", (F.col("chunk") * step).alias("start"), F.least(F.col("chunk") * step + size, F.col("_len")).alias("end"))


def grouped_split(groups: DataFrame, group: str, shares: dict[str, float]) -> DataFrame:
    """(group, split): whole groups dealt by largest remainder, in group order."""
    ordered = groups.select(group).distinct().withColumn("_n", F.row_number().over(Window.orderBy(group)))
    total = ordered.count()
    exact = {k: total * v for k, v in shares.items()}
    counts = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - counts[k]), list(shares).index(k)))[: total - sum(counts.values())]:
        counts[k] += 1
    bound, split = 0, None
    for k, c in counts.items():
        bound += c
        split = F.when(F.col("_n") <= bound, k) if split is None else split.when(F.col("_n") <= bound, k)
    return ordered.select(group, split.alias("split"))


def window_owners(spans: DataFrame, windows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each span with the first window that holds the whole of it."""
    s, w = spans.alias("s"), windows.alias("w")
    held = s.join(w, (F.col(f"s.{id_col}") == F.col(f"w.{id_col}")) & (F.col("w.start") <= F.col("s.start")) & (F.col("s.end") <= F.col("w.end")))
    return held.groupBy(F.col(f"s.{id_col}").alias(id_col), F.col("s.start").alias("start"), F.col("s.end").alias("end")).agg(F.min("w.chunk").alias("owner"))


def exact_metrics(expected: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn per ``by`` of the set comparison on ``keys``, which include ``by``."""
    e, p = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = e.join(p, keys, "full_outer")
    e1, p1 = F.col("_e").isNotNull(), F.col("_p").isNotNull()
    return both.groupBy(*by).agg(F.count_if(e1 & p1).alias("tp"), F.count_if(~e1 & p1).alias("fp"), F.count_if(e1 & ~p1).alias("fn"))


def metrics_report(counts: DataFrame, by: str) -> DataFrame:
    """Per group and, under 'overall', in all: precision, recall, f1, miss and false-detection rates, 0 where undefined."""
    rolled = counts.rollup(by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).withColumn(by, F.coalesce(F.col(by), F.lit("overall")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    rates = {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "miss_rate": ratio(fn, tp + fn), "false_rate": ratio(fp, tp + fp)}
    return rolled.select(by, "tp", "fp", "fn", *(F.round(v, 6).alias(k) for k, v in rates.items()))
