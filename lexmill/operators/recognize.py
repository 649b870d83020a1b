"""Rules that find sensitive spans: each is a row of data, from which one expression per rule is built.

Priorities, scores and rule names are fixed values of the policy; the shapes are described beside them. Full-width letters,
digits and their marks are read as the plain ones, place by place; surfaces are those of the text itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.px import positions
from lexmill.schema import SPAN


@dataclass(frozen=True)
class Rule:
    """``pattern`` with the value in ``group`` (0: the whole match; else group - 1 is the text before it in the match).

    ``hint`` is a cheap test that a text with a match passes; ``valid`` a further test on the surface; ``dedup`` says which
    rule of a family keeps a position: the ``first`` or the ``last``; ``family`` rules are deduplicated together. ``parts``
    gives the entities within a value, as (start, surface), where the value is not one itself; ``valid`` then tests those.
    """

    rule_id: str
    entity_type: str
    pattern: str
    priority: int
    score: float = 1.0
    group: int = 0
    hint: str | None = None
    valid: object = None
    family: str | None = None
    dedup: str = "first"
    anonymize: bool = True
    protect: bool = False
    parts: object = None


def id18_valid(s: Column) -> Column:
    """A real birth date and the MOD 11-2 check character of an 18-character identity number."""
    weights, checks = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], "10X98765432"
    total = F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.lit(0), lambda a, i: a + F.substring(s, i, F.lit(1)).cast("int") * F.element_at(F.array(*map(F.lit, weights)), i))
    real = F.try_to_timestamp(F.substring(s, 7, 8), F.lit("yyyyMMdd")).isNotNull()
    return real & (F.substring(F.lit(checks), total % 11 + 1, F.lit(1)) == F.upper(F.substring(s, 18, 1)))


def id15_valid(s: Column) -> Column:
    return F.try_to_timestamp(F.concat(F.lit("19"), F.substring(s, 7, 6)), F.lit("yyyyMMdd")).isNotNull()


#: One separator that recognition leaves between digits of an account, phone or identity number.
SEP = r"[ \t\-－—]"
PHONE_LABEL = "(?:电话|联系电话|传真|手机|移动电话|联系电话号码)"
ACCOUNT_LABEL = "(?:银行账号|银行账户|账号|帐号|账户(?:号|号码)?|卡号|持有人账号|持有人账户(?:号|号码)?)"
OPEN = r"\s*[:：]?\s*[【\[]?"
UNITS = "万亿元|亿元|万元|人民币|美元|港币|元|万|亿"
#: The rules of the default policy, in candidate order.
RULES: tuple[Rule, ...] = (
    Rule("cn_id_18", "ID_CARD", r"(?<!\d)[1-9]\d{5}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", 100, 1.0, hint=r"\d{17}", valid=id18_valid, family="id"),
    Rule("id_card_context", "ID_CARD", rf"((?:身份证(?:号码|号)?|证件(?:号码|号)?){OPEN})((?:[0-9Xx]{SEP}?){{14,17}}[0-9Xx])", 100, 0.99, group=2, hint="身份证|证件", family="id"),
    Rule("mobile", "PHONE", rf"(?<![A-Za-z0-9])1[3-9](?:{SEP}?\d){{9}}(?!{SEP}?\d)", 97, family="phone", dedup="last", hint=r"1[3-9]"),
    Rule("landline", "PHONE", rf"(?<![A-Za-z0-9])0\d{{2,4}}(?:{SEP}?\d){{7,8}}(?!{SEP}?\d)", 97, family="phone", dedup="last", hint=r"0\d\d"),
    Rule("phone_context", "PHONE", rf"({PHONE_LABEL}{OPEN})(1[3-9](?:{SEP}?\d){{9}}|0\d{{2,4}}(?:{SEP}?\d){{7,8}}|0(?:{SEP}?\d){{9,10}})", 97, 1.02, group=2, family="phone", dedup="last", hint="电话|传真|手机"),
    Rule("email", "EMAIL", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+[ \t]*@[ \t]*[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}(?![A-Za-z0-9._%+\-])", 96, hint="@"),
    Rule("unified_social_credit_code", "BANK_ACCOUNT", r"(?i)(?<![0-9A-Z])[0-9A-Z]{18}(?![0-9A-Z])", 98, 1.03, family="account", hint=r"[0-9A-Za-z]{18}", valid=lambda s: s.rlike("[A-Za-z]") & s.rlike("[0-9]")),
    Rule("account_context", "BANK_ACCOUNT", rf"({ACCOUNT_LABEL}{OPEN})((?:\d{SEP}?){{9,18}}\d)", 96, 1.02, group=2, family="account", hint="[账帐卡]"),
    Rule("long_numeric_identifier", "BANK_ACCOUNT", r"(?<![A-Za-z0-9])\d{12,19}(?![A-Za-z0-9])", 94, 0.92, family="account", hint=r"\d{12}"),
    Rule("grouped_numeric_identifier", "BANK_ACCOUNT", rf"(?<![A-Za-z0-9])(?:\d{SEP}?){{15,18}}\d(?!{SEP}?\d)", 94, 0.92, family="account", hint=r"\d{SEP}?\d{SEP}?\d{SEP}?\d{SEP}?\d".replace("{SEP}", SEP)),
    Rule("contract_id", "CONTRACT_ID", r"(?i)(?<![A-Za-z0-9])(?:HT|HT号|合同号|协议号)[ \t]*[-－—:/]?[ \t]*(?:19|20)?\d{2,4}[ \t]*[-－—/]\s*\d+(?![A-Za-z0-9])", 95, family="contract", hint="(?i)HT|合同号|协议号"),
    Rule("contract_id_label", "CONTRACT_ID", r"((?:合同编号|合同号|协议编号|协议号)\s*[:：#]?\s*)((?!⟦)[A-Za-z0-9][A-Za-z0-9._/－—\-]{2,})", 95, group=2, family="contract", hint="合同|协议"),
    Rule("date_cn", "DATE", r"(?<!\d)(?:19|20)\d{2}年(?:0?[1-9]|1[0-2])月(?:0?[1-9]|[12]\d|3[01])日?", 88, hint="年", anonymize=False, protect=True),
    Rule("date_iso", "DATE", r"(?<!\d)(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])(?!\d)", 88, hint=r"\d{4}[-/.]\d", anonymize=False, protect=True),
    Rule("date_compact", "DATE", r"(?<!\d)(?:19|20)\d{6}(?!\d)", 88, hint=r"\d{8}", anonymize=False, protect=True),
    Rule("amount_with_unit", "AMOUNT", rf"(?<!\d)(?:[¥￥$€]\s*)?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?\s*(?:{UNITS})(?!\d)", 80, hint="[元万亿币]", anonymize=False, protect=True),
    Rule("number", "NUMBER", r"(?<!\d)(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?!\d)", 10, 0.8, hint=r"\d", anonymize=False),
)
ID15 = Rule("cn_id_15", "ID_CARD", r"(?<!\d)[1-9]\d{7}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}(?!\d)", 100, 0.98, hint=r"\d{15}", valid=id15_valid)


HAN = r"[\u3400-\u9fff]"


#: A dictionary up to this many names and code points is sent to every task; of a larger one each name goes to so many places.
FEW_NAMES, FEW_POINTS, SALTS = 100_000, 2_000_000, 16


def dictionary_spans(docs: DataFrame, names: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: int = 2) -> DataFrame:
    """(id, start, end, surface) of the rows of ``names`` (name) in the texts, for dictionaries of any size.

    Each text's distinct runs of ``key`` code points meet the names that begin so by a join; the name then has to stand
    there whole. Names shorter than ``key`` are not found. Texts stay where they are beside a small dictionary; with a
    large one runs are dealt out, those that stand in many texts over several tasks.
    """
    # Cut after every code point: the k-th pieces, joined, are the leads, without a substring from the start for each.
    points = F.split(F.col(text_col), "")
    leads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text_col) - key + 1, F.lit(1))), lambda i: F.array_join(F.slice("_points", i, key), "")))
    each = docs.where(F.length(text_col) >= key).select(id_col, text_col, points.alias("_points")).select(id_col, text_col, F.explode(leads).alias("lead"))
    wanted = names.where(F.length("name") >= key).select("name", F.left("name", F.lit(key)).alias("lead")).distinct()
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    if n <= FEW_NAMES and size <= FEW_POINTS:
        met = each.join(F.broadcast(wanted), "lead")
    else:
        salt = F.pmod(F.xxhash64(F.col(text_col)), F.lit(SALTS)).cast("int").alias("_salt")
        met = each.select("*", salt).join(wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")), ["lead", "_salt"])
    hits = met.where(F.col(text_col).contains(F.col("name")))
    pieces = F.split(F.col(text_col), F.concat(F.lit("(?=\\Q"), F.col("name"), F.lit("\\E)")), -1)
    first = F.when(F.startswith(F.col(text_col), F.col("name")), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(F.lit(0).alias("o"), first.alias("r"))
    at = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), zero, lambda a, x: F.struct((a["o"] + F.length(x)).alias("o"), F.array_append(a["r"], a["o"] + F.length(x)).alias("r")), lambda a: a["r"])
    return hits.select(id_col, F.explode(at).alias("start"), "name").select(id_col, "start", (F.col("start") + F.length("name")).alias("end"), F.col("name").alias("surface"))


def rules_named(*names: str) -> tuple[Rule, ...]:
    return tuple(r for r in (*RULES, ID15) if r.rule_id in names)


def field_rule(name: str, labels: list[str], entity_type: str = "CUSTOM", priority: int = 95) -> Rule:
    """A custom rule: the value after one of the labels and a colon, up to a newline, pipe or semicolon."""
    either = "|".join(rf"\Q{x}\E" for x in sorted(labels, key=len, reverse=True))
    return Rule(name, entity_type, rf"((?:{either})\s*[:：]\s*)([^\n|；;]*[^\n|；;\s])", priority, group=2)


def regex_rule(name: str, pattern: str, entity_type: str = "CUSTOM", priority: int = 95) -> Rule:
    return Rule(name, entity_type, pattern, priority)


#: Full-width letters, digits and marks of numbers and addresses, and the plain ones for them.
WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz@.-_+%")
PLAIN = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)


def _candidates(text: Column, rule: Rule, seq: int) -> Column:
    found = positions(text, rule.pattern, rule.group)
    if rule.parts is not None:
        inner = lambda x: F.transform(rule.parts(x["surface"]), lambda y: F.struct((x["start"] + y["start"]).alias("start"), y["surface"].alias("surface")))
        found = F.flatten(F.transform(found, inner))
    if rule.valid is not None:
        found = F.filter(found, lambda x: rule.valid(x["surface"]))
    spans = F.transform(
        found,
        lambda x, i: F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(x["surface"])).alias("end"),
            F.lit(rule.entity_type).alias("entity_type"),
            F.when(F.col("_wide"), F.substring(F.col("_given"), x["start"] + 1, F.length(x["surface"]))).otherwise(x["surface"]).alias("surface"),
            F.lit(float(rule.score)).alias("score"),
            F.lit(rule.priority).alias("priority"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.anonymize).alias("anonymize"),
            F.lit(rule.protect).alias("protect"),
            (F.lit(seq * 1_000_000) + i).cast("int").alias("seq"),
        ),
    ).cast(f"array<{SPAN}>")
    empty = F.array().cast(f"array<{SPAN}>")
    return spans if rule.hint is None else F.when(text.rlike(rule.hint), spans).otherwise(empty)


def _by_place(spans: Column, last: bool) -> Column:
    """The spans of a family by position, at equal positions the rule first that keeps it."""
    nth = lambda s: -F.floor(s["seq"] / 1_000_000) if last else s["seq"]
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), nth(s).cast("long").alias("nth"), s.alias("span"))))


def _one_each(name: str) -> Column:
    """Of the spans of ``_by_place`` the first of each position."""
    before = lambda i: F.get(name, i - 1)
    new = lambda x, i: (i == 0) | (x["start"] != before(i)["start"]) | (x["end"] != before(i)["end"])
    return F.transform(F.filter(name, new), lambda x: x["span"])


def recognize(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", into: str = "candidates") -> DataFrame:
    """Adds the candidates of all rules, in rule order, as an array of spans. A null text has none. No shuffle."""
    families: dict[str, list[tuple[int, Rule]]] = {}
    for seq, rule in enumerate(rules):
        families.setdefault(rule.family or rule.rule_id, []).append((seq, rule))
    given = docs.withColumn("_given", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_wide", F.col("_given").rlike(f"[{WIDE}]"))
    read = given.withColumn("_read", F.when(F.col("_wide"), F.translate("_given", WIDE, PLAIN)).otherwise(F.col("_given")))
    text, held, parts = F.col("_read"), {}, []
    for n, family in enumerate(families.values()):
        spans = [_candidates(text, rule, seq) for seq, rule in family]
        if len(family) == 1:
            parts.append(spans[0])
        else:
            held[f"_family{n}"] = _by_place(F.concat(*spans), family[0][1].dedup == "last")
            parts.append(_one_each(f"_family{n}"))
    return read.withColumns(held).withColumn(into, F.concat(*parts)).drop("_given", "_wide", "_read", *held) if held else read.withColumn(into, F.concat(*parts)).drop("_given", "_wide", "_read")


def exploded(docs: DataFrame, id_col: str = "doc_id", column: str = "candidates") -> DataFrame:
    """One row per span: the id and the span's fields.

    The outer form, with its empty rows left after it: a plain one lets the optimiser put a filter on the array below the
    recognition, which would then run once more for each column that it reads.
    """
    return docs.select(id_col, F.inline_outer(column)).where(F.col("start").isNotNull())


def keyword_spans(docs: DataFrame, keywords: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every occurrence of every keyword, overlapping ones too: (id, start, end, keyword), each once."""
    words = F.array(*map(F.lit, sorted(set(keywords))))
    hits = docs.select(id_col, text_col, F.explode(words).alias("keyword")).where(F.col(text_col).contains(F.col("keyword")))
    # Cut before every occurrence, so that occurrences that overlap cut too; the pieces' lengths add up to the places.
    pieces = F.split(F.col(text_col), F.concat(F.lit("(?=\\Q"), F.col("keyword"), F.lit("\\E)")), -1)
    first = F.when(F.startswith(F.col(text_col), F.col("keyword")), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(F.lit(0).alias("o"), first.alias("r"))
    starts = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), zero, lambda a, x: F.struct((a["o"] + F.length(x)).alias("o"), F.array_append(a["r"], a["o"] + F.length(x)).alias("r")), lambda a: a["r"])
    return hits.select(id_col, F.explode(starts).alias("start"), "keyword").select(id_col, "start", (F.col("start") + F.length("keyword")).alias("end"), "keyword")


def with_policy(rules: tuple[Rule, ...], selected: set[str]) -> tuple[Rule, ...]:
    """Selected types anonymise; all others are found and protected."""
    return tuple(replace(r, anonymize=r.entity_type in selected, protect=r.entity_type not in selected) for r in rules)
