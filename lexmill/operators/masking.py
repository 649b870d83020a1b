"""Masking: token numbering, one-pass replacement, report, hashes and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .parties import recognize_policy
from .recognize import Rule, exploded, recognize
from .spans import resolve

#: The label of each entity type in its tokens; other types have the last.
LABELS = {
    "ORG": "机构",
    "ORG_ALIAS": "机构",
    "ORG_SUBSIDIARY": "机构",
    "ORG_BRANCH": "机构",
    "PERSON": "人员",
    "PHONE": "电话",
    "EMAIL": "邮箱",
    "BANK_ACCOUNT": "账号",
    "ID_CARD": "证件",
    "ADDRESS": "地址",
    "PROJECT": "项目",
    "PROJECT_FIELD": "项目",
    "DEPARTMENT": "部门",
    "CONTRACT_ID": "合同",
    "DATE": "日期",
    "AMOUNT": "金额",
    "NUMBER": "数字",
}
OTHER_LABEL = "实体"


def label_of(entity_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, entity_type), F.lit(OTHER_LABEL))


def tokens(accepted: DataFrame, texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity_type, surface, n, token) of the masked surfaces of each document.

    n counts the distinct surfaces of a type by first appearance. A token that the text holds, or that another has taken,
    gets the least suffix from 2 on that is free, which one fold over each document's tokens finds.
    """
    masked = accepted.where(F.col("anonymize") & ~F.col("protect"))
    first = masked.groupBy(id_col, "entity_type", "surface").agg(F.min("start").alias("_first"))
    w = Window.partitionBy(id_col, "entity_type").orderBy("_first", "surface")
    numbered = first.withColumn("n", F.row_number().over(w)).withColumn("_base", F.concat(label_of(F.col("entity_type")), F.col("n").cast("string")))
    per = numbered.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_first", "entity_type", "surface", "n", "_base"))).alias("_t"))
    per = per.join(texts.select(id_col, F.col(text_col).alias("_text")), id_col).dropDuplicates([id_col])  # repeated rows have one mapping
    start = F.array().cast("array<struct<entity_type:string,surface:string,n:int,token:string>>")

    def step(acc, x):
        plain = F.concat(F.lit("⟦"), x["_base"], F.lit("⟧"))
        # Clashes of a base come one after another, so suffixes up to one more than the tokens so far are enough.
        tries = F.concat(F.array(plain), F.transform(F.sequence(F.lit(2), F.size(acc) + 2 + F.size(F.split(F.col("_text"), "⟦"))), lambda k: F.concat(F.lit("⟦"), x["_base"], F.lit("-"), k.cast("string"), F.lit("⟧"))))
        free = F.filter(tries, lambda t: ~F.contains(F.col("_text"), t) & ~F.exists(acc, lambda a: a["token"] == t))
        taken = F.contains(F.col("_text"), plain) | F.exists(acc, lambda a: a["token"] == plain)
        return F.array_append(acc, F.struct(x["entity_type"].alias("entity_type"), x["surface"].alias("surface"), x["n"].alias("n"), F.when(taken, F.get(free, 0)).otherwise(plain).alias("token")))

    return per.select(id_col, F.inline(F.aggregate("_t", start, step)))


def replace_spans(texts: DataFrame, accepted: DataFrame, mapping: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts with ``masked``: gaps and tokens joined in one pass; documents without masked spans keep their text."""
    masked = accepted.where(F.col("anonymize") & ~F.col("protect")).join(mapping.select(id_col, "entity_type", "surface", "token"), [id_col, "entity_type", "surface"])
    per = masked.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("_s"))
    joined = texts.join(per, id_col, "left")
    text = F.col(text_col)
    before = F.transform("_s", lambda s, i: F.concat(F.substring(text, F.when(i == 0, 1).otherwise(F.get("_s", i - 1)["end"] + 1), s["start"] - F.when(i == 0, 0).otherwise(F.get("_s", i - 1)["end"])), s["token"]))
    rest = F.substring(text, F.element_at("_s", -1)["end"] + 1, F.length(text))
    return joined.withColumn("masked", F.when(F.col("_s").isNull(), text).otherwise(F.concat(F.array_join(before, ""), rest))).drop("_s")


def report(candidates: DataFrame, accepted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document and type: detected, accepted and masked counts."""
    found = candidates.groupBy(id_col, "entity_type").agg(F.count(F.lit(1)).alias("detected"))
    taken = accepted.groupBy(id_col, "entity_type").agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("anonymize") & ~F.col("protect")).alias("masked"))
    return found.join(taken, [id_col, "entity_type"], "left").na.fill(0, ["accepted", "masked"])


def row_of(id_col: str, text_col: str) -> Column:
    """What names a row: its id, which may be null or repeated, and a hash of its text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))


def mask(docs: DataFrame, rules: tuple[Rule, ...] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """The whole of it: candidates, accepted, mapping and masked, as DataFrames with the id and ``_row``, which names the row.

    Without ``rules`` the whole default policy is taken, with persons, organisations and what texts declare of them.
    Rows with a null id and rows that repeat an id under other texts each have spans and tokens of their own; rows that
    repeat an id and its text share them. A null text has no spans and stays null. Other columns are dropped, so none clashes.
    """
    texts = docs.select(row_of(id_col, text_col).alias("_row"), F.col(id_col), F.col(text_col))
    found = recognize_policy(texts, text_col=text_col) if rules is None else recognize(texts, rules, text_col=text_col)
    candidates = exploded(found, "_row")
    accepted = resolve(candidates, "_row")
    mapping = tokens(accepted, texts, id_col="_row", text_col=text_col)
    masked = replace_spans(texts, accepted, mapping, id_col="_row", text_col=text_col)
    named = lambda df: df.withColumn(id_col, F.col("_row.id"))
    return {"candidates": named(candidates), "accepted": named(accepted), "mapping": named(mapping), "masked": masked}


def restore(masked: DataFrame, mapping: DataFrame, *, id_col: str = "doc_id", masked_col: str = "masked", strict: bool = False) -> DataFrame:
    """Adds ``restored``: known tokens replaced by their surfaces in one pass. Unknown ones stay; with ``strict`` they are an error.

    Tables of ``mask`` are joined by ``_row``, others by the id, which then has to be unique.
    """
    by = "_row" if "_row" in masked.columns and "_row" in mapping.columns else id_col
    per = mapping.groupBy(by).agg(F.map_from_entries(F.collect_set(F.struct("token", "surface"))).alias("_map"))
    joined = masked.join(per, by, "left")
    pattern = "⟦[^\\n⟧]*⟧"
    found, gaps = F.regexp_extract_all(masked_col, F.lit(pattern), F.lit(0)), F.split(masked_col, pattern, -1)
    unknown = (lambda t: F.raise_error(F.concat(F.lit("no mapping for "), t)).cast("string")) if strict else (lambda t: t)
    parts = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("t")), lambda x: F.concat(x["g"], F.when(x["t"].isNull(), "").otherwise(F.coalesce(F.try_element_at("_map", x["t"]), unknown(x["t"])))))
    if strict:
        return joined.withColumn("restored", F.array_join(parts, "")).drop("_map")
    return joined.withColumn("restored", F.when(F.col("_map").isNull(), F.col(masked_col)).otherwise(F.array_join(parts, ""))).drop("_map")


def artifact_stem(job_id: Column, name: Column) -> Column:
    """The stem of a document's artifacts: a hash of the job and the source's name, a NUL between."""
    return F.concat(F.lit("document-"), safe_id(F.concat(job_id.cast("string"), F.lit("\0"), name.cast("string"))))


def token_type_name(entity_type: Column) -> Column:
    """A configured type's name as tokens may have it: capitals, digits and underscores, none at the ends, no digit first."""
    name = F.regexp_replace(F.regexp_replace(F.upper(entity_type), "[^A-Z0-9_]", "_"), "^_+|_+$", "")
    return F.when(name == "", "ENTITY").when(name.rlike("^[0-9]"), F.concat(F.lit("E_"), name)).otherwise(name)


def safe_id(c: Column, n: int = 12) -> Column:
    """The first n hex digits of a value's SHA-256."""
    return F.left(F.sha2(c.cast("string"), 256), F.lit(n))
