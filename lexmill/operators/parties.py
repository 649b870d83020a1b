"""Persons, organisations and addresses: rules from lists of words, and what a text tells about its own names.

Word lists, priorities and scores are fixed values of the policy. Each rule says where a value begins (words and what joins
them to it) and what follows; everything else is a predicate on the value. All of it is local to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.px import literal_positions, positions
from lexmill.schema import SPAN

from .recognize import HAN, RULES, Rule, recognize

#: Words that stand by a person's name.
FIELD_LABELS = ("经办/代理人姓名", "法定代表人/负责人或授权代表", "法定代表人或授权代表", "法定代表人/负责人", "法定代表人", "姓名", "负责人", "联系人", "经办人", "代理人", "董事长", "总经理", "被保险人", "投保人", "受益人")
CELL_LABELS = ("法定代表人", "负责人", "联系人", "经办/代理人姓名", "经办人姓名")
CELL_ROLES = ("财务负责人", "风险管理部负责人", "公司分管风险管理负责人", "法律合规部部门负责人", "股权与实物资产投资部分部负责人", "股权与不动产投资部分部负责人", "部门负责人", "法定代表人", "负责人", "董事长", "总经理", "投资总监", "分部负责人", "经理", "监事", "合伙人")
LIST_LABELS = ("会务联系人", "联系人", "经办人", "代理人")
SIGN_LABELS = ("法定代表人/负责人或授权代表", "法定代表人或授权代表", "法定代表人/负责人", "签字人", "签署人")
PROSE_ROLES = ("负责人", "董事长", "总经理", "投资总监", "分部负责人", "部门负责人", "法定代表人", "授权代表", "联系人", "经办人", "代理人")
PROSE_NEXT = ("的", "、", "，", ",", "担任", "签字", "签章", "出席", "参加", "负责", "汇报", "列席")
TITLES = ("总裁", "副总裁", "董事长", "副董事长", "总经理", "副总经理", "投资总监", "部长", "主任", "经理", "监事", "行长", "局长", "书记", "先生", "女士")
TITLE_OWNERS = ("公司领导", "本集团", "集团", "公司")
MEETING_WORDS = ("董事会成员", "参会董事", "出席人员", "参会人员", "与会人员", "董事")
DEPARTMENTS = ("投资管理部", "投后管理部", "股权投资部", "不动产投资部", "实物资产投资部", "风险管理部", "法律合规部", "财务部", "审计部", "运营部", "研究部", "市场部", "人力资源部", "战略发展部", "董事会办公室", "监事会办公室", "办公室", "投资部")
LIST_ROLES = ("总经理", "监事", "投资总监", "分部负责人", "部门负责人", "签字人", "签署人")
LIST_NEXT = ("（", "(", "等", "参加", "出席", "列席", "担任", "负责", "签字", "签章", "先生", "女士")
#: The hundred most frequent surnames of the census; a fuller table is a parameter, as its characters.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常"

#: Legal forms, words before an organisation, words no organisation has, and names that are none.
FORMS = ("股份有限公司", "有限责任公司", "有限公司", "集团公司", "集团", "保险公司", "证券公司", "银行", "基金管理公司", "合伙企业（有限合伙）", "合伙企业(有限合伙)", "合伙企业", "研究院", "医院", "大学")
OPENERS = ("受托人", "受益人", "委托人", "发起人", "根据", "按照", "由于", "与", "及", "和", "或", "向", "由", "在", "将", "对", "为", "本", "该", "其", "等", "经", "被", "同", "于", "受", "故", "自", "原", "认定", "通过", "依据", "以")
JOINERS = ("受托人", "受益人", "委托人", "发起人", "根据", "按照", "由于", "与", "及", "和", "向", "由", "在", "将", "对", "为", "经", "被", "于", "等", "受", "故", "自", "原", "认定", "通过", "依据", "以", "或")
NOT_ORG = ("审议", "批准", "承受能力", "托管账户", "缴纳", "符合", "推进", "获得", "认购", "处分", "收到", "接收", "合计", "所有", "届时", "分红", "认定", "通过", "依据", "聘用", "完成", "提交", "尚待", "抽水蓄能", "抽蓄", "的约定", "背靠", "召开", "汇报", "部分", "查阅", "代表", "保障", "保证", "缩短", "原", "根据", "聘请", "包括", "关联方")
BARE_FORMS = ("合伙企业", "有限合伙企业", "有限责任公司", "有限公司", "股份有限公司", "保险公司", "集团公司", "商业银行", "投资银行", "政策性银行", "开户银行", "受益人银行", "持有人银行", "付款人银行", "收款人银行", "托管银行", "托管人银行", "关联方银行", "代理人银行", "对方银行", "相关银行")
BANKS = ("中国银行", "招商银行", "中信银行", "工商银行", "建设银行", "农业银行", "交通银行", "浦发银行", "兴业银行", "民生银行", "光大银行", "华夏银行", "平安银行", "北京银行", "上海银行")
ALIAS_WORDS = ("以下简称", "简称", "下称", "以下称", "简称为")
NO_ALIAS = ("公司", "本公司", "我公司", "该公司", "银行", "基金", "协会", "计划", "本计划", "本股权计划", "受托人", "管理人", "委托人", "受益人")
ORG_CHAR = r"[㐀-鿿A-Za-z0-9·（）()\-]"

#: Labels of addresses, fields after one, and words of places.
ADDRESS_LABELS = ("住所地/通信地址", "通讯地址", "联系地址", "注册地址", "办公地址", "通信地址", "送达地址", "收件地址", "住所地", "住址", "住所", "地址")
AFTER_ADDRESS = ("电话", "联系电话", "手机", "邮箱", "电子邮箱", "传真", "法定代表人", "联系人", "经办/代理人姓名", "经办人姓名")
AFTER_CLAUSE = ("已通过", "法定代表人", "负责人", "登记机关", "经营范围", "联系人", "联系电话", "电话", "邮箱", "电子邮箱")
REGIONS, ROADS = ("省", "市", "区", "县"), ("路", "街", "道", "镇", "乡", "村", "号", "院", "楼", "层", "室")
PLACES = ("号", "院", "楼", "层", "室", "大厦", "大楼", "园区", "基地", "栋", "座")


def either(words) -> str:
    return "(?:" + "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True)) + ")"


def literal_rules(rule_id: str, entity_type: str, names, priority: int, **more) -> tuple[Rule, ...]:
    """A rule for each name of a small dictionary, so that names within names are found too; large ones are joined."""
    return tuple(Rule(rule_id, entity_type, rf"\Q{n}\E", priority, **more) for n in sorted(set(names)) if n)


def _items(value: Column) -> Column:
    """Names at the start of the items of a roster, the longest that ends the item or stands before a word that may follow."""
    return positions(value, rf"((?:^|[、,，|])[ \t:：【\[（(]*)({HAN}{{2,4}})(?=[ \t]*(?:\z|[、,，|]|{either(LIST_NEXT)}))", 2)


def person_rules(surnames: str = SURNAMES, priority: int = 70) -> tuple[Rule, ...]:
    """Names by their labels, cells, signatures, roles, titles and rosters; each begins with one of the ``surnames``."""
    known = lambda s: F.lit(surnames).contains(F.substring(s, 1, 1))
    name, no_label, shut = f"{HAN}{{2,4}}", rf"(?!{HAN}{{2,8}}\s*[:：])", r"[】\]]?"
    end = r"\s*(?:[|]|$)"

    def rule(rule_id: str, before: str, value: str, after: str, score: float, words, **more) -> Rule:
        return Rule(rule_id, "PERSON", f"({before})({value}){after}", priority, score, group=2, hint=either(words), valid=known, family="person", **more)

    roster = r"[^\n。；;]{2,160}"
    return (
        rule("person_context_label", rf"{either(FIELD_LABELS)}\s*[:：为]\s*{no_label}[【\[]?", name, shut, 0.96, FIELD_LABELS),
        rule("person_table_label", rf"{either(CELL_LABELS)}\s*(?:\|\s*){{1,2}}(?:类型|姓名|名称)?\s*[【\[]?", f"{HAN}{{2,6}}", f"{shut}(?={end})", 0.98, CELL_LABELS),
        rule("person_role_value", r"\|\s*", name, rf"(?=\s*\|\s*{either(CELL_ROLES)}(?:\s*[：:]|{end}))", 0.97, CELL_ROLES),
        rule("person_signature_label", rf"{either(SIGN_LABELS)}\s*[:：]?\s*{no_label}[【\[]?", name, rf"{shut}(?=\s*(?:[:：|，,；;]|$))", 0.97, SIGN_LABELS),
        rule("person_role_prose", either(PROSE_ROLES), name, rf"(?=\s*(?:{either(PROSE_NEXT)}|$))", 0.95, PROSE_ROLES),
        rule("person_job_title", either(TITLE_OWNERS), f"{HAN}{{2,3}}", f"(?={either(TITLES)})", 0.91, TITLES),
        rule("person_job_title", f"(?<!{HAN})", f"{HAN}{{2,3}}", f"(?={either(TITLES)})", 0.91, TITLES),
        rule("person_list_label", rf"{either(LIST_LABELS)}\s*[:：]\s*", rf"{name}(?:\s*[、,，]\s*{name})+", "", 0.95, LIST_LABELS, parts=lambda v: positions(v, name)),
        rule("person_meeting_list", rf"{either(MEETING_WORDS)}[ \t]*[：:、，,|]?[ \t]*", roster, "", 0.96, MEETING_WORDS, parts=_items),
        rule("person_department_list", rf"{either(DEPARTMENTS)}[ \t]*[：:、，,|]?[ \t]*", roster, "", 0.94, DEPARTMENTS, parts=_items),
        rule("person_role_list", rf"{either(LIST_ROLES)}[ \t]*[：:、，,|][ \t]*", roster, "", 0.94, LIST_ROLES, parts=_items),
    )


def _org_names(run: Column) -> Column:
    """Candidates in a run of characters that names may have: for each legal form what stands before it, from the last word that no name begins with."""
    begin, join = f"^{either(OPENERS)}+", f"^.*{either(JOINERS)}(?=.)"

    def one(form: Column) -> Column:
        end = form["start"] + F.length(form["surface"])
        whole = F.right(F.left(run, end), F.lit(80))
        cut = F.regexp_replace(F.regexp_replace(whole, begin, ""), join, "")
        name = F.regexp_replace(F.when(cut == "", whole).otherwise(cut), r"^[(（]", "")
        return F.struct((end - F.length(name)).alias("start"), name.alias("surface"))

    return F.transform(positions(run, either(FORMS)), one)


def _is_org(name: Column) -> Column:
    """What a name by its legal form must not be: a form alone, a clause, a numbered item or a bank's address."""
    short = rf"^.?{either(('集团', '集团公司', '合伙企业', '有限合伙企业', '保险公司', '银行', '有限公司', '股份有限公司'))}$"
    bank = name.endswith("银行") & name.rlike("[市区县路街道号]")
    return (F.length(name) >= 3) & ~name.rlike(short) & ~name.isin(*BARE_FORMS) & ~name.rlike(either(NOT_ORG)) & ~name.rlike(r"^(?:[0-9]|[一二三四五六七八九十]+[)）])") & ~bank


def organization_rules(banks=BANKS, priority: int = 85) -> tuple[Rule, ...]:
    """Branches of banks, without the bank, and names that end in a legal form."""
    return (
        Rule("org_bank_branch", "ORG", rf"({either(banks)})([㐀-鿿A-Za-z0-9·()（）]{{2,24}}(?:分行|支行))", priority + 1, 0.96, group=2, hint="[分支]行"),
        Rule("org_suffix", "ORG", r"[㐀-鿿A-Za-z0-9·&（）()\-]{3,}", priority, 0.9, hint=either(FORMS), parts=_org_names, valid=_is_org),
    )


def _address_parts(cells: Column) -> Column:
    """Cells without blanks about them, cut around identifiers of 15 to 19 characters, which other rules find."""
    code = "(?i)(?<![0-9A-Z])(?:[0-9A-Z]{18}|[0-9]{15,19})(?![0-9A-Z])"
    runs = positions(cells, rf"{code}|(?:(?!{code})[^|])+")
    bare = F.transform(F.filter(runs, lambda r: ~r["surface"].rlike(f"^{code}$")), lambda r: F.struct((r["start"] + F.length(r["surface"]) - F.length(F.ltrim(r["surface"]))).alias("start"), F.trim(r["surface"]).alias("surface")))
    return F.filter(bare, lambda r: F.length(r["surface"]) >= 2)


def _place_like(cell: Column) -> Column:
    """A region, then a road or number, and a building or number near the end."""
    return cell.rlike(rf"{either(REGIONS)}.{{0,40}}{either(ROADS)}") & cell.rlike(rf"{either(PLACES)}.{{0,20}}$")


def address_rules(priority: int = 100) -> tuple[Rule, ...]:
    """Labelled addresses, those of a clause, cells after or before a label, cells and runs shaped like a place, and what follows a company's name."""
    label, close = either(ADDRESS_LABELS), r"(?=\s*(?:\||\n|\z))"

    def rule(rule_id: str, before: str, value: str, after: str, score: float, hint: str, **more) -> Rule:
        return Rule(rule_id, "ADDRESS", f"({before})({value}){after}", priority, score, group=2, hint=hint, family="address", **more)

    return (
        rule("address_label", rf"{label}\s*[:：]\s*[【\[]?", r"[^\s\n|；;】\]【\[][^\n|；;】\]]*?", rf"(?=\s*{either(AFTER_ADDRESS)}\s*[:：]|\s*[|\n；;】\]]|\s*\z)", 1.0, "[址住]"),
        rule("address_as_clause", rf"{label}\s*为\s*", r"[^\s\n|；;，,。][^\n|；;，,。]*?", rf"(?=\s*{either(AFTER_CLAUSE)}|\s*[；;，,。\n|]|\s*\z)", 0.96, "[址住]"),
        rule("address_forward_table", rf"(?m:^)[^\n]*?\|\s*{label}\s*[:：]?\s*\|", r"[^\n]+", "", 0.91, r"[址住][^\n]*\|", parts=_address_parts),
        rule("address_reverse_table", r"(?:(?m:^)|\|)\s*", r"[^\s\n|][^\n|]{3,118}[^\s\n|]", rf"(?=\s*\|\s*{label}\s*[:：]?{close})", 0.94, r"\|\s*\S*[址住]"),
        rule("address_table_value", r"\|\s*", r"[^\s\n|][^\n|]{3,138}[^\s\n|]", close, 0.92, r"\|", valid=_place_like),
        rule("address_city_shape", "", rf"(?:{HAN}{{2,5}}省(?!级)(?={HAN}{{1,8}}(?:[市区县]|自治州))|{HAN}{{2,6}}市(?!公司)(?={HAN}{{1,10}}[区县市镇乡路街道村]))[^\n|]{{3,100}}{either((*PLACES, '村'))}", "", 0.9, "[省市]"),
        rule("address_company_tail", rf"(?:公司|企业)名称\s*[:：]\s*[^\n|]*(?:公司|集团)", rf"{ORG_CHAR}{{2,40}}{either(p for p in PLACES if p not in '号院')}[^\n|]{{0,20}}?", close, 0.93, "(?:公司|企业)名称"),
    )


def default_policy(surnames: str = SURNAMES, *, whitelist=(), persons=(), organizations=(), projects=(), departments=()) -> tuple[Rule, ...]:
    """The rules of the default policy in candidate order; small dictionaries and the whitelist are rules too."""
    ids = tuple(r for r in RULES if r.family == "id")
    others = tuple(r for r in RULES if r.family != "id")
    before = ("PHONE", "EMAIL", "BANK_ACCOUNT")
    return (
        *literal_rules("organization_whitelist", "ORG", whitelist, 1000, anonymize=False, protect=True),
        *literal_rules("person_dictionary", "PERSON", persons, 72),
        *person_rules(surnames),
        *ids,
        *literal_rules("org_dictionary", "ORG", organizations, 90),
        *organization_rules((*BANKS, *(o[: o.index("银行") + 2] for o in organizations if "银行" in o))),
        *literal_rules("project_dictionary", "PROJECT", projects, 84),
        *literal_rules("department_dictionary", "DEPARTMENT", departments, 78),
        *(r for r in others if r.entity_type in before),
        *address_rules(),
        *(r for r in others if r.entity_type not in before),
    )


def _spans(found: Column, entity_type: str, rule_id: str, priority: int, score: float, seq: int) -> Column:
    lit = F.lit
    return F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["surface"])).alias("end"), lit(entity_type).alias("entity_type"), x["surface"].alias("surface"), lit(score).alias("score"), lit(priority).alias("priority"), lit(rule_id).alias("rule_id"), lit(True).alias("anonymize"), lit(False).alias("protect"), (lit(seq * 1_000_000) + i).cast("int").alias("seq"))).cast(f"array<{SPAN}>")


def _everywhere(text: Column, words: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: literal_positions(text, w)))


#: Rules whose names are looked for in the whole text.
SPREADING = ("person_table_label", "person_list_label", "person_meeting_list", "person_department_list", "person_role_list")


def aliases(text: Column) -> Column:
    """(alias, canonical) that a text declares: in brackets after an organisation, or by labels for both. Variants without 公司 count too."""
    full, short = rf"{ORG_CHAR}{{3,80}}{either(FORMS)}", r"[㐀-鿿A-Za-z0-9·]{2,24}"
    forms = (rf"({full})\s*[（(]\s*{either(ALIAS_WORDS)}\s*[“\"「『]?({short})", rf"(?:全称|主体|公司名称)\s*[:：]\s*({full})[^\n；;。]{{0,30}}?(?:简称|别名)\s*[:：为是]\s*[“\"「『]?({short})")
    every = lambda p: F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("alias"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("canonical"))
    own = F.filter(F.concat(*map(every, forms)), lambda a: ~a["alias"].isin(*NO_ALIAS))
    stem = lambda a: F.regexp_replace(a["alias"], "^(..+?)(?:本公司|公司)$", "$1")
    both = F.flatten(F.transform(own, lambda a: F.array(a, F.struct(stem(a).alias("alias"), a["canonical"].alias("canonical")))))
    none = F.array().cast("array<struct<alias:string,canonical:string>>")
    return F.when(text.rlike("简称|下称|以下称|别名"), F.array_distinct(both)).otherwise(none)


def learned(found: DataFrame, *, text_col: str = "text", into: str = "candidates") -> DataFrame:
    """Adds to the candidates what the text itself teaches: names of rosters and cells wherever they stand again, declared
    organisations and their aliases. An alias of several organisations is masked but not linked to one."""
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col(into)
    names = F.array_distinct(F.transform(F.filter(spans, lambda s: s["rule_id"].isin(*SPREADING) & s["surface"].rlike(f"^{HAN}{{2,4}}$")), lambda s: s["surface"]))
    known = found.withColumn("_names", names).withColumn("_aliases", aliases(text))
    own = F.col("_aliases")
    fulls = lambda w: F.size(F.array_distinct(F.transform(F.filter(own, lambda a: a["alias"] == w), lambda a: a["canonical"])))
    words = F.array_distinct(F.transform(own, lambda a: a["alias"]))
    twice = F.filter("_names", lambda n: F.size(literal_positions(text, n)) >= 2)
    made = [
        _spans(_everywhere(text, twice), "PERSON", "person_repeated_surface", 70, 0.88, 901),
        _spans(_everywhere(text, F.array_distinct(F.transform(own, lambda a: a["canonical"]))), "ORG", "org_registry_canonical", 89, 0.995, 902),
        _spans(_everywhere(text, F.filter(words, lambda w: fulls(w) == 1)), "ORG_ALIAS", "org_alias", 84, 0.93, 903),
        _spans(_everywhere(text, F.filter(words, lambda w: fulls(w) > 1)), "ORG_ALIAS", "org_alias_ambiguous", 84, 0.88, 904),
    ]
    # A name's place that a rule found already is not found anew.
    again = F.filter(made[0], lambda m: ~F.exists(spans, lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"]) & (s["entity_type"] == "PERSON")))
    extra = F.when(F.size("_names") > 0, F.concat(spans, again)).otherwise(spans)
    return known.withColumn(into, F.when(F.size("_aliases") > 0, F.concat(extra, *made[1:])).otherwise(extra)).drop("_names", "_aliases")


def outside_larger(found: DataFrame, into: str = "candidates") -> DataFrame:
    """Drops whitelisted names that lie properly within an organisation that is masked: the public part of a private name is no exception."""
    larger = F.filter(into, lambda s: (s["rule_id"] != "organization_whitelist") & s["anonymize"] & s["entity_type"].startswith("ORG"))
    within = lambda w: F.exists("_larger", lambda o: (o["start"] <= w["start"]) & (w["end"] <= o["end"]) & (o["end"] - o["start"] > w["end"] - w["start"]))
    return found.withColumn("_larger", larger).withColumn(into, F.filter(into, lambda w: (w["rule_id"] != "organization_whitelist") | ~within(w))).drop("_larger")


def recognize_policy(docs: DataFrame, rules: tuple[Rule, ...] | None = None, *, text_col: str = "text", into: str = "candidates") -> DataFrame:
    """The candidates of the whole policy, with what each text teaches and without whitelisted parts of larger names."""
    rules = default_policy() if rules is None else rules
    found = learned(recognize(docs, rules, text_col=text_col, into=into), text_col=text_col, into=into)
    return outside_larger(found, into) if any(r.rule_id == "organization_whitelist" for r in rules) else found
