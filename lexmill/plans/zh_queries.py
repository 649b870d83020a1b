"""Queries of the rules for Chinese texts over a corpus that both engines make from ``customer`` by the same arithmetic.

The expected spans follow from string lengths, so the SQL holds no pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import audit, masking, parties, recognize


#: Texts of a task.
PER_TASK = 5000


def _lpad(c, n):
    return F.lpad(c.cast("string"), n, "0")


def customers(spark, d):
    """(k): the keys of the customers, dealt out. Their file is small and would be one task or few, but rules run over a text of each."""
    keys = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return keys.repartition(max(1, -(-keys.count() // PER_TASK)), "k")


def zh_docs(spark, d):
    """(doc_id, text): one record per customer, its label, name, phone, identity number, account, date, amount and contract."""
    c = customers(spark, d)
    body = F.concat(F.lit("11010119"), _lpad(F.col("k") % 30 + 60, 2), _lpad(F.col("k") % 12 + 1, 2), _lpad(F.col("k") % 28 + 1, 2), _lpad(F.col("k") % 1000, 3))
    weights = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
    total = sum((F.substring("body", i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    c = c.withColumn("body", body).withColumn("check", F.substring(F.lit("10X98765432"), total % 11 + 1, F.lit(1)))
    text = F.concat(
        F.lit("编号"), F.col("k").cast("string"), F.lit("：手机 138"), _lpad(F.col("k"), 8), F.lit("，证件 "), "body", "check", F.lit("。\n日期20"), _lpad(F.col("k") % 100, 2), F.lit("年"), (F.col("k") % 12 + 1).cast("string"), F.lit("月"), (F.col("k") % 28 + 1).cast("string"),
        F.lit("日 合计"), (F.col("k") * 7).cast("string"), F.lit("万元 合同编号：HT-"), _lpad(F.col("k"), 6), F.lit("，账号：6222"), _lpad(F.col("k"), 12), F.lit("；邮箱 u"), F.col("k").cast("string"), F.lit("@例.test 传真：010-8"), _lpad(F.col("k") % 1000000, 7),
    )
    return c.select(F.col("k").alias("doc_id"), text.alias("text"))


SURNAMES, GIVEN = "张王李赵陈", "伟芳娜敏静强磊洋"
#: Companies of the dictionary query.
COMPANIES = ("甲乙丙科技有限公司", "丁戊银行", "乙丙科技")


def zh_people(spark, d):
    c = customers(spark, d)
    name = F.concat(F.substring(F.lit(SURNAMES), (F.col("k") % 5 + 1).cast("int"), F.lit(1)), F.substring(F.lit(GIVEN), (F.col("k") % 8 + 1).cast("int"), F.lit(1)))
    text = F.concat(F.lit("单"), F.col("k").cast("string"), F.lit(" 联系人："), name, F.lit("；注册地址："), (F.col("k") % 90).cast("string"), F.lit("号楼"), F.lit("；"), F.lit("甲乙丙科技有限公司与丁戊银行"))
    return c.select(F.col("k").alias("doc_id"), text.alias("text"))


def found_in(rules):
    return lambda spark, d: recognize.exploded(recognize.recognize(zh_people(spark, d), rules)).select("doc_id", "start", "end", "surface")


def q_dictionary(spark, d):
    names = spark.createDataFrame([(c,) for c in COMPANIES], "name string")
    return recognize.dictionary_spans(zh_people(spark, d), names)


def found(*names):
    rules = recognize.rules_named(*names)
    return lambda spark, d: recognize.exploded(recognize.recognize(zh_docs(spark, d), rules)).select("doc_id", "start", "end", "surface")


def leaky(spark, d):
    """Masked texts, by the remainder of the key: three with faults of tables, addresses, tokens and separators, one without, and tables of uneven rows."""
    k = F.col("k")
    n = k.cast("string")
    table = F.concat(F.lit("|"), F.repeat(F.lit(" h |"), (k % 2 + 1).cast("int")), F.lit("\n| --- | --- |\n|"), F.repeat(F.lit(" c |"), (k % 3 + 1).cast("int")), F.lit("\n\n| free | row | here |"))
    kinds = [
        F.concat(F.lit("| 注册地址 | 上海市"), n, F.lit("号 |\n通讯地址：\n\n广东"), n, F.lit("号")),
        F.lit("| 地址 | ： | ⟦地址1⟧ |\n住址：⟦地址2⟧；地址：保密\n```\n| 地址 | x |\n```\n通讯地址：\n电话：已脱敏"),
        F.concat(F.lit("住所地：北京"), n, F.lit("号 电话：⟦电话1⟧\n座机 010 - 8\n⟦PHONE:1⟧ 传真 010-8"), _lpad(k % 10000000, 7), F.lit("\n金额6222021234567890123元，电话138-0013-"), _lpad(k % 10000, 4), F.lit("\nID 110105 1949-12-31 002X")),
    ]
    text = F.when(k % 4 == 0, table)
    for i, t in enumerate(kinds, 1):
        text = text.when(k % 4 == i, t)
    return customers(spark, d).select(k.alias("doc_id"), text.alias("text"))


# An identity number whose second group begins like a mobile number is both.
LEAKS = """SELECT c_custkey AS doc_id, CAST(1 AS INT) AS line, 'TABLE_PIPE' AS category FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 3, 'TABLE_PIPE' FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 <> 1
UNION ALL SELECT c_custkey, unnest([1, 4]), 'ADDRESS' FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, unnest([1, 3, 3, 4, 5, 5]), unnest(['ADDRESS', 'TOKEN', 'LANDLINE', 'PHONE', 'ID_CARD', 'PHONE']) FROM customer WHERE c_custkey % 4 = 3"""


#: Start of each field: what stands before it is of known length.
_K = "length(CAST(c_custkey AS VARCHAR))"
_P = f"2 + {_K} + 4"  # the phone
_I = f"{_P} + 11 + 4"  # the identity number
_D = f"{_I} + 18 + 4"  # the date
_DL = "(4 + 1 + length(CAST(c_custkey % 12 + 1 AS VARCHAR)) + 1 + length(CAST(c_custkey % 28 + 1 AS VARCHAR)) + 1)"
_M = f"{_D} + {_DL} + 3"  # the amount
_ML = "(length(CAST(c_custkey * 7 AS VARCHAR)) + 2)"
_C = f"{_M} + {_ML} + 6"  # the contract number
_A = f"{_C} + 9 + 4"  # the account


def _sql(start, length, surface):
    return f'SELECT c_custkey AS doc_id, CAST({start} AS INT) AS start, CAST({start} + {length} AS INT) AS "end", {surface} AS surface FROM customer'


_KV = "CAST(c_custkey AS VARCHAR)"
_BODY = "'11010119' || lpad(CAST(c_custkey % 30 + 60 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')"
_CHECK = "('10X98765432')[CAST(list_sum(list_transform(range(1, 18), lambda i: CAST(b[i] AS INT) * ([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])[i])) % 11 + 1 AS BIGINT)]"
ID_SQL = f'SELECT c_custkey AS doc_id, CAST({_I} AS INT) AS start, CAST({_I} + 18 AS INT) AS "end", b || {_CHECK} AS surface FROM (SELECT c_custkey, {_BODY} AS b FROM customer)'

# The rule takes a day of one digit first and 日 if it follows: of the 27th it has the 2.
_DATE = "('20' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '年' || (c_custkey % 12 + 1) || '月' || CASE WHEN c_custkey % 28 + 1 < 10 THEN (c_custkey % 28 + 1) || '日' ELSE left(CAST(c_custkey % 28 + 1 AS VARCHAR), 1) END)"

#: Texts about persons, organisations and places, and what is to be found in each: (surface, which occurrence, rule).
PARTIES = (
    ("法定代表人：张伟，会务联系人：李娜、王芳。李娜与某人，联系人：电话：无", [("张伟", 1, "person_context_label"), ("李娜", 1, "person_context_label"), ("王芳", 1, "person_list_label")]),
    ("| 经办人姓名 | 陈静 |\n| 赵强 | 财务负责人 |\n列席 陈静", [("陈静", 1, "person_table_label"), ("赵强", 1, "person_role_value"), ("陈静", 2, "person_repeated_surface")]),
    ("签字人 王磊；投资总监李洋汇报；本集团张敏主任；某某主任", [("王磊", 1, "person_signature_label"), ("李洋", 1, "person_role_prose"), ("张敏", 1, "person_job_title")]),
    ("共有3名参会董事：张伟、李娜（女），王芳参加会议", [("张伟", 1, "person_meeting_list"), ("李娜", 1, "person_meeting_list"), ("王芳", 1, "person_meeting_list")]),
    ("由北京甲乙科技有限公司与丙丁集团签署。开户银行，审议丁有限公司，中国银行北京海淀支行", [("北京甲乙科技有限公司", 1, "org_suffix"), ("丙丁集团", 1, "org_suffix"), ("中国银行", 1, "org_suffix"), ("北京海淀支行", 1, "org_bank_branch")]),
    ("上海戊己股份有限公司（以下简称“庚辛公司”）。庚辛的，庚辛公司", [("上海戊己股份有限公司", 1, "org_suffix"), ("上海戊己股份有限公司", 1, "org_registry_canonical"), ("庚辛公司", 1, "org_alias"), ("庚辛公司", 2, "org_alias"), ("庚辛", 1, "org_alias"), ("庚辛", 2, "org_alias"), ("庚辛", 3, "org_alias")]),
    ("\n无\n| 地址 | 北京市海淀区中关村路1号 | 110105194912310021 上海路2号 |\n| 广东省深圳市福田区1号 | 注册地址 |\n住所为南京路3号，无", [("北京市海淀区中关村路1号", 1, "address_forward_table"), ("上海路2号", 1, "address_forward_table"), ("广东省深圳市福田区1号", 1, "address_reverse_table"), ("南京路3号", 1, "address_as_clause")]),
)


def zh_parties(spark, d):
    k = F.col("k")
    text = F.element_at(F.array(*(F.lit(t) for t, _ in PARTIES)), (k % len(PARTIES) + 1).cast("int"))
    return customers(spark, d).select(k.alias("doc_id"), F.concat(F.lit("单"), k.cast("string"), F.lit(" "), text).alias("text"))


def q_parties(spark, d):
    found = recognize.exploded(parties.recognize_policy(zh_parties(spark, d)))
    return found.where(F.col("entity_type").isin("PERSON", "ORG", "ORG_ALIAS", "ADDRESS")).select("doc_id", "start", "end", "surface", "rule_id")


def _place(text, surface, nth):
    at = -1
    for _ in range(nth):
        at = text.index(surface, at + 1)
    return at


def _quoted(t):
    return "'" + t.replace("'", "''") + "'"


_ROWS = ", ".join(f"({i}, {_place(t, s, n)}, {_quoted(s)}, {_quoted(r)})" for i, (t, found) in enumerate(PARTIES) for s, n, r in found)
PARTIES_SQL = f"""SELECT c_custkey AS doc_id, CAST(2 + length(CAST(c_custkey AS VARCHAR)) + at_ AS INT) AS start, CAST(2 + length(CAST(c_custkey AS VARCHAR)) + at_ + length(surface) AS INT) AS "end", surface, rule_id
FROM customer JOIN (VALUES {_ROWS}) v(i, at_, surface, rule_id) ON i = c_custkey % {len(PARTIES)}"""

#: The same texts masked.
MASKED = (
    "法定代表人：⟦人员1⟧，会务联系人：⟦人员2⟧、⟦人员3⟧。李娜与某人，联系人：电话：无",
    "| 经办人姓名 | ⟦人员1⟧ |\n| ⟦人员2⟧ | 财务负责人 |\n列席 ⟦人员1⟧",
    "签字人 ⟦人员1⟧；投资总监⟦人员2⟧汇报；本集团⟦人员3⟧主任；某某主任",
    "共有3名参会董事：⟦人员1⟧、⟦人员2⟧（女），⟦人员3⟧参加会议",
    "由⟦机构1⟧与⟦机构2⟧签署。开户银行，审议丁有限公司，⟦机构3⟧⟦机构4⟧",
    "⟦机构1⟧（以下简称“⟦机构1-2⟧”）。⟦机构2⟧的，⟦机构1-2⟧",
    "\n无\n| 地址 | ⟦地址1⟧ | ⟦账号1⟧ ⟦地址2⟧ |\n| ⟦地址3⟧ | 注册地址 |\n住所为⟦地址4⟧，无",
)


def q_mask_parties(spark, d):
    return masking.mask(zh_parties(spark, d))["masked"].select("doc_id", "masked")


MASK_SQL = f"SELECT c_custkey AS doc_id, '单' || c_custkey || ' ' || masked AS masked FROM customer JOIN (VALUES {', '.join(f'({i}, {_quoted(t)})' for i, t in enumerate(MASKED))}) v(i, masked) ON i = c_custkey % {len(MASKED)}"

QUERIES = {
    "rec_idcard18": (found("cn_id_18"), ID_SQL),
    "rec_phone": (found("mobile"), _sql(_P, "11", f"'138' || lpad({_KV}, 8, '0')")),
    "rec_date": (found("date_cn"), _sql(_D, f"length({_DATE})", _DATE)),
    "rec_amount": (found("amount_with_unit"), _sql(_M, _ML, "c_custkey * 7 || '万元'")),
    "rec_contract": (found("contract_id_label"), _sql(_C, "9", f"'HT-' || lpad({_KV}, 6, '0')")),
    "rec_account_label": (found("account_context"), _sql(_A, "16", f"'6222' || lpad({_KV}, 12, '0')")),
    "rec_person_ctx": (found_in(parties.person_rules(SURNAMES)[:1]), _sql(f"1 + {_K} + 5", "2", "('张王李赵陈')[c_custkey % 5 + 1] || ('伟芳娜敏静强磊洋')[c_custkey % 8 + 1]")),
    "rec_address": (found_in(parties.address_rules()[:2]), _sql(f"1 + {_K} + 5 + 2 + 6", "(length(CAST(c_custkey % 90 AS VARCHAR)) + 2)", "c_custkey % 90 || '号楼'")),
    "rec_org_dict": (
        q_dictionary,
        " UNION ALL ".join(_sql(f"1 + {_K} + 5 + 2 + 6 + length(CAST(c_custkey % 90 AS VARCHAR)) + 3 + {off}", str(len(n)), f"'{n}'") for n, off in (("甲乙丙科技有限公司", 0), ("乙丙科技", 1), ("丁戊银行", 10))),
    ),
    "audit_shapes": (
        lambda s, d: audit.findings(zh_docs(s, d), ("PHONE", "ID_CARD", "BANK_ACCOUNT")).select("doc_id", "line", "category"),
        "SELECT c_custkey AS doc_id, CAST(unnest([1, 1, 2]) AS INT) AS line, unnest(['PHONE', 'ID_CARD', 'BANK_ACCOUNT']) AS category FROM customer",
    ),
    "audit_blocks": (lambda s, d: audit.findings(leaky(s, d)), LEAKS),
    "audit_reports": (
        lambda s, d: audit.reports(audit.findings(leaky(s, d))),
        f"""WITH f AS ({LEAKS}), c AS (SELECT doc_id, category, count(*) AS n FROM f GROUP BY ALL), g AS (SELECT doc_id, string_agg('"' || category || '":' || n, ',' ORDER BY category) AS counts, sum(n) AS total FROM c GROUP BY doc_id),
l AS (SELECT doc_id, string_agg('{{"line":' || line || ',"category":"' || category || '"}}', ',' ORDER BY line, list_position({list(audit.CATEGORIES)}, category)) AS listed FROM f GROUP BY doc_id)
SELECT doc_id, '{{"total":' || CAST(total AS BIGINT) || ',"counts":{{' || counts || '}},"findings":[' || listed || ']}}' AS report FROM g JOIN l USING (doc_id)""",
    ),
    "rec_parties": (q_parties, PARTIES_SQL),
    "mask_parties": (q_mask_parties, MASK_SQL),
}
