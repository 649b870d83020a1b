"""Recognition, span algebra, masking, audit and normalisation against plain Python."""

import random
import re

import pytest
from lexmill.functions.px import positions
from lexmill.operators import audit, labels, masking, normalize, recognize, spans
from pyspark.sql import functions as F

MEMO = "姓名：张三，手机 138 1234 5678，身份证号：11010519491231002X\n账号 6222021234567890123 合同编号：HT-2024-01 邮箱 a.b@例 x.y+z@mail.example.com 金额 1,200.50万元 日期2024年3月5日 编号 42"


def by_type(spark, text, rules=recognize.RULES):
    df = recognize.exploded(recognize.recognize(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules))
    return df, {(r.rule_id, r.surface) for r in df.collect()}


def test_positions_are_those_of_finditer(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab1😀é \n") for _ in range(rnd.randint(0, 30))) for _ in range(200)] + ["", "1", "11", "a1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for pattern in ("[0-9]+", "a(?=b)", "😀b?", "[ab]{2}"):
        got = df.select("id", positions(F.col("text"), pattern).alias("p")).collect()
        assert {r.id: [(x.start, x.surface) for x in r.p] for r in got} == {i: [(m.start(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_rules(spark):
    found = by_type(spark, MEMO)[1]
    assert {("phone_context", "138 1234 5678"), ("cn_id_18", "11010519491231002X"), ("account_context", "6222021234567890123"), ("contract_id", "HT-2024-01"), ("email", "x.y+z@mail.example.com"), ("amount_with_unit", "1,200.50万元"), ("date_cn", "2024年3月5日")} <= found
    assert ("cn_id_18", "110105194912310021") not in by_type(spark, "110105194912310021")[1]
    assert by_type(spark, "电话：13812345678")[1] >= {("phone_context", "13812345678")}
    assert by_type(spark, None)[1] == set()


def test_custom_rules_and_keywords(spark):
    rules = (recognize.field_rule("case", ["案号"]), recognize.regex_rule("code", "[A-Z]{3}-[0-9]+"))
    assert by_type(spark, "案号： X-1 乙 ；ABC-12", rules)[1] == {("case", "X-1 乙"), ("code", "ABC-12")}
    df = spark.createDataFrame([(1, "aaa.b"), (2, "")], "doc_id long, text string")
    got = sorted((r.start, r.end, r.keyword) for r in recognize.keyword_spans(df, ["aa", "a.", ".", "b"]).collect())
    assert got == [(0, 2, "aa"), (1, 3, "aa"), (2, 4, "a."), (3, 4, "."), (4, 5, "b")]


@pytest.mark.parametrize("seed", range(3))
def test_resolution(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for d in range(30):
        for q in range(rnd.randint(0, 12)):
            a = rnd.randrange(40)
            rows.append((d, a, a + rnd.randint(1, 9), "T", "s", float(rnd.choice([0.8, 1.0, 1.02])), rnd.choice([10, 90, 96]), "r", True, False, q))
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, entity_type string, surface string, score double, priority int, rule_id string, anonymize boolean, protect boolean, seq int")
    want = set()
    for d in range(30):
        taken = []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[6], -r[5], r[1] - r[2], r[1], r[2], r[10])):
            if all(r[2] <= t[1] or t[2] <= r[1] for t in taken):
                taken.append(r)
        want |= {(d, r[1], r[2], r[10]) for r in taken}
    got = spans.resolve(df)
    assert {(r.doc_id, r.start, r.end, r.seq) for r in got.collect()} == want
    assert spans.overlapping(got).count() == 0


def test_masking_round_trip_and_token_clash(spark):
    texts = [MEMO, "⟦邮箱1⟧ stays, a@b.com and a@b.com, c@d.org", "nothing here", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = masking.mask(df)
    rows = {r.doc_id: r for r in masking.restore(out["masked"], out["mapping"]).collect()}
    assert all(rows[i].restored == t for i, t in enumerate(texts))
    assert rows[1].masked == "⟦邮箱1⟧ stays, ⟦邮箱1-2⟧ and ⟦邮箱1-2⟧, ⟦邮箱2⟧"
    assert "138" not in rows[0].masked and "1,200.50万元" in rows[0].masked
    assert {r.category for r in audit.findings(out["masked"].select("doc_id", F.col("masked").alias("text"))).collect()} == set()
    counts = {(r.doc_id, r.entity_type): (r.detected, r.accepted, r.masked) for r in masking.report(out["candidates"], out["accepted"]).collect()}
    assert counts[1, "EMAIL"] == (3, 3, 3)


def test_audit(spark):
    text = "13812345678\n010-81234567\na@b.com\n11010519491231002X\n6222021234567890\n合同编号：HT-1-22\n⟦坏⟧\n| a | b |\n| --- | --- |\n| 1 | 2 | 3 |\n| x `|` | y\\|z |\n```\n| q |\n"
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = sorted((r.line, r.category) for r in audit.findings(df).collect())
    assert got == [(1, "PHONE"), (2, "LANDLINE"), (3, "EMAIL"), (4, "ID_CARD"), (5, "BANK_ACCOUNT"), (6, "CONTRACT_ID"), (7, "TOKEN"), (10, "TABLE_PIPE")]


def test_lines(spark):
    one = spark.range(1)
    plain = lambda t: one.select(normalize.plain_line(F.lit(t)).alias("x")).first().x
    assert plain("中 文  ，（ 好 ） 138 1234 5678") == "中文，（好） 13812345678"
    assert plain("110105 1949 1231 002X 共 1 2,3 00 . 5 万元") == "11010519491231002X 共 12,300.5万元"
    assert plain(plain("a   b ,c")) == "a b,c"
    text = "# h\r\n<!-- image -->\n\n\n\n第 3 页\n|  a |  b  c |\n```\n  x   y  \n```\n"
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in normalize.organize(df, 1).collect()}
    assert got == {1: "# h\n\n---\n|a|b c|\n```\n  x   y\n```\n", 2: ""}


def test_labels(spark):
    df = spark.createDataFrame([(1, 6, [(1, 3, "A"), (4, 5, "B")]), (2, 0, [])], "doc_id long, n int, spans array<struct<start:int,end:int,label:string>>")
    want = {"BIO": ["O", "B-A", "I-A", "O", "B-B", "O"], "BIOES": ["O", "B-A", "E-A", "O", "S-B", "O"], "BILOU": ["O", "B-A", "L-A", "O", "U-B", "O"]}
    for scheme, labelled in want.items():
        made = df.select("doc_id", labels.spans_to_labels(F.col("n"), "spans", scheme).alias("labels"))
        assert {r.doc_id: r.labels for r in made.collect()} == {1: labelled, 2: []}
        assert sorted((r.start, r.end, r.label) for r in labels.labels_to_spans(made).collect()) == [(1, 3, "A"), (4, 5, "B")]
    e = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 5, "A"), (2, 0, 1, "B"), (2, 4, 5, "B"), (3, 0, 1, "B")], "d long, start int, end int, label string")
    p = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 5, "A"), (2, 0, 1, "B"), (9, 0, 1, "B")], "d long, start int, end int, label string")
    r = {x.label: x for x in labels.metrics_report(labels.exact_metrics(e, p, ["d", "start", "end", "label"], ["label"]), "label").collect()}["overall"]
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (3, 1, 2, 0.75, 0.6)


def test_mask_leaves_nothing_behind(spark):
    phone, other = "call 13812345678 now", "id 12: write to a.b@mail.example.com or 13912345678"
    rows = [(None, phone, 1), (None, other, 2), (1, phone, 3), (1, other, 4), (1, other, 4), (2, None, 5), (3, "", 6), (4, "电话：１３８１２３４５６７８，账号 6222021234567890123", 7)]
    m = masking.mask(spark.createDataFrame(rows, "doc_id long, text string, start int"))
    got = sorted(((r.doc_id, r.text, r.masked) for r in m["masked"].collect()), key=repr)
    want = {phone: "call ⟦电话1⟧ now", other: "id 12: write to ⟦邮箱1⟧ or ⟦电话1⟧", None: None, "": "", rows[-1][1]: "电话：⟦电话1⟧，账号 ⟦账号1⟧"}
    assert got == sorted(((i, t, want[t]) for i, t, _ in rows), key=repr)
    back = masking.restore(m["masked"], m["mapping"], strict=True)
    assert all(r.restored == r.text for r in back.collect())
    with pytest.raises(Exception, match="no mapping"):
        masking.restore(m["masked"], m["mapping"].where("surface <> '13812345678'"), strict=True).collect()
    assert masking.mask(spark.createDataFrame([], "doc_id long, text string"))["masked"].count() == 0


def test_small_predicates(spark):
    import unicodedata

    words = ["ﬁne １２", "Å", "plain", "", None, "㎏ ℡", "ｶﾞ"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", normalize.nfkc(F.col("t")).alias("n")).collect()
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t)) for r in got)
    names = {"bank-account": "BANK_ACCOUNT", "__": "ENTITY", "": "ENTITY", "9 lives": "E_9_LIVES", "实体x": "X"}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r.t: r.n for r in df.select("t", masking.token_type_name(F.col("t")).alias("n")).collect()} == names
    assert labels.scheme_name("bio-ul") == "BILOU"
    with pytest.raises(ValueError, match="scheme"):
        labels.scheme_name("IOB2")
    made = spark.createDataFrame([("B-" + "X" * 2000,), ("O",)], "t string").select(labels.label_parts(F.col("t")).alias("p")).collect()
    assert made[0].p.entity == "X" * 2000 and made[1].p.entity is None
    for wrong in ("O-X", "B", "B-1", "Q-X", None):
        with pytest.raises(Exception, match="invalid label"):
            spark.createDataFrame([(wrong,)], "t string").select(labels.label_parts(F.col("t"))).collect()
    spanned = spark.createDataFrame([(1, 0, 3, "B"), (1, 0, 3, "A"), (1, 0, 2, "A"), (1, 2, 5, "A"), (1, 3, 4, "A"), (2, 1, 2, "A")], "doc_id long, start int, end int, entity_type string")
    assert sorted(map(tuple, spans.longest_first(spanned).collect())) == [(1, 0, 3, "A"), (1, 3, 4, "A"), (2, 1, 2, "A")]


def test_audit_of_blocks(spark):
    clean = "| 字段 | 值 |\n| --- | --- |\n| 手机 | ⟦PHONE:000001:abcdef012345⟧ |\n\n| 地址 | ： | ⟦地址1⟧ |\n"
    prose = "| 说明 | 甲 - 乙 |\n| 另一行 | 文本 |\n| 字段 | 值 |\n| --- | --- |\n| 手机 | 已脱敏 |"
    open_ = "| 注册地址 | 上海市1号 |\n通讯地址：\n\n# 标题\n住址：\n广东1号\n账号：６２２２ ０２１２ ３４５６ ７８９０ １２３\n合计6222021234567890元"
    rows = [(1, clean), (2, prose), (3, open_), (4, None), (5, ""), (3, open_)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.line, r.category) for r in audit.findings(df).collect()) == [(3, 1, "ADDRESS"), (3, 6, "ADDRESS"), (3, 7, "BANK_ACCOUNT")]
    assert audit.findings(df, ("EMAIL",)).count() == 0
    assert [r.report for r in audit.reports(audit.findings(df)).collect()] == ['{"total":3,"counts":{"ADDRESS":2,"BANK_ACCOUNT":1},"findings":[{"line":1,"category":"ADDRESS"},{"line":6,"category":"ADDRESS"},{"line":7,"category":"BANK_ACCOUNT"}]}']
