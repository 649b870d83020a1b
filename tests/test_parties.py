"""The default policy on texts whose names are known."""

from lexmill.operators import masking, parties, recognize


def test_policy(spark):
    rows = [
        (1, "姓名：欧阳明，公开集团与北京公开集团有限公司，公开集团。项目天河二期由王某某负责"),
        (2, "甲乙有限公司（简称：）。甲一丙有限公司（简称“星辰”），丁二戊有限公司（简称“星辰”），星辰"),
        (3, None),
        (4, ""),
        (None, "联系人：张三"),
        (1, "联系人：张三"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = parties.default_policy(parties.SURNAMES + "欧", whitelist=["公开集团"], projects=["天河二期"])
    got = {(r.doc_id, r.surface, r.start, r.rule_id) for r in recognize.exploded(parties.recognize_policy(df, rules)).collect()}
    assert (1, "欧阳明", 3, "person_context_label") in got and (1, "天河二期", 30, "project_dictionary") in got
    assert sorted(s for d, _, s, r in got if r == "organization_whitelist") == [7, 23]
    assert (1, "北京公开集团有限公司", 12, "org_suffix") in got
    assert {(s, r) for d, w, s, r in got if w == "星辰"} == {(23, "org_alias_ambiguous"), (39, "org_alias_ambiguous"), (44, "org_alias_ambiguous")}
    assert {(d, s) for d, w, s, r in got if w == "张三"} == {(None, 4), (1, 4)}
    masked = sorted((r.masked for r in masking.mask(df)["masked"].where("text like '联系人%'").collect()))
    assert masked == ["联系人：⟦人员1⟧"] * 2
    assert parties.recognize_policy(spark.createDataFrame([], "doc_id long, text string")).count() == 0
