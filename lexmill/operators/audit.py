"""An independent scan of masked texts for what is still visible; it shares no rule with recognition on purpose.

Numbers are read as runs of digit groups: what a run is follows from its groups put together, by length and first digits,
not from a pattern for each way to write it. All of it is local to a row: texts are exploded, never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = r"[ \t\-－—]"
#: Line ends in Python's sense.
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
#: Categories in report order, the form of tokens, labels of fields, units, and words that stand for a hidden value.
CATEGORIES = ("TOKEN", "TABLE_PIPE", "ID_CARD", "PHONE", "LANDLINE", "EMAIL", "BANK_ACCOUNT", "CONTRACT_ID", "ADDRESS")
TOKEN = "⟦(?:[A-Z][A-Z0-9_]*:[0-9]{6}(?::[0-9a-f]{12})?|机构[0-9]+(?:-(?:别名|子公司|分公司)[0-9]+)?(?:-[0-9]+)?|(?:人员|电话|邮箱|账号|证件|地址|项目|部门|合同|日期|金额|数字|实体)[0-9]+(?:-[0-9]+)?)⟧"
ACCOUNT_LABELS = ("银行账号", "银行账户", "开户账号", "开户账户", "账号", "帐号", "账户号码", "账户号", "账户", "卡号")
CONTRACT_LABELS = ("合同编号", "合同号", "协议编号", "协议号")
ADDRESS_LABELS = ("住所地/通信地址", "注册地址", "通讯地址", "联系地址", "办公地址", "通信地址", "送达地址", "收件地址", "住所地", "住址", "地址")
NEXT_LABELS = ("电话", "联系电话", "座机", "传真", "手机", "邮箱", "电子邮箱", "联系地址", "通讯地址", "注册地址", "办公地址", "法定代表人", "联系人", "经办/代理人姓名", "经办人姓名")
UNITS = ("万亿元", "亿元", "万元", "人民币", "美元", "港币", "元", "万", "亿")
HIDDEN = ("保密", "已脱敏", "已隐藏", "REDACTED", "redacted", "脱敏")
MARKED = "⟦[^\\n⟧]*⟧"
#: Full-width forms of ASCII as ASCII, in the view that is scanned.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "
#: A text without any of these has no finding of the category.
HINTS = {"TOKEN": "[⟦⟧]", "TABLE_PIPE": r"-{3}", "EMAIL": "[@＠]", "CONTRACT_ID": "[HhＨｈ][TtＴｔ]|合同|协议", "ADDRESS": "[址住]"}
DIGITS = rf"[0-9０-９](?:{SEP}*[0-9Xx０-９]){{9}}"


def _either(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _lines(text: Column) -> Column:
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def audit_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line from 1, text); an empty text has no line and a final line end makes none."""
    return docs.select(id_col, F.posexplode(_lines(F.col(text_col))).alias("_n", "line_text")).select(id_col, (F.col("_n") + 1).alias("line"), "line_text")


def _view(line: Column) -> Column:
    return F.translate(line, WIDE, NARROW)


def _tails(run: Column) -> Column:
    """The run from each of its digit groups on, with dashes between the groups."""
    groups = F.split(run, SEP)
    return F.transform(groups, lambda g, i: F.array_join(F.slice(groups, i + 1, F.size(groups)), "-"))


def _joined(tail: Column) -> Column:
    return F.replace(tail, F.lit("-"), F.lit(""))


def _id_like(digits: Column) -> Column:
    """15 or 18 digits, the last of 18 perhaps an X, with a real birth date; the check digit is not asked for."""
    real = lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd")).isNotNull()
    born = F.when(digits.rlike("^[0-9]{17}[0-9Xx]$"), F.substring(digits, 7, 8)).when(digits.rlike("^[0-9]{15}$"), F.concat(F.lit("19"), F.substring(digits, 7, 6)))
    return F.coalesce(real(born), F.lit(False))


def _is_phone(tail: Column) -> Column:
    return tail.rlike("^1[3-9]") & _joined(tail).rlike("^[0-9]{11}[A-Za-z]?$")


def _is_landline(tail: Column) -> Column:
    return tail.rlike("^0[0-9]{2}") & _joined(tail).rlike("^[0-9]{10,12}[A-Za-z]?$")


def _is_account(digits: Column) -> Column:
    return digits.rlike("^[0-9]{16,19}[Xx]?$") & ~_id_like(digits)


def _safe(value: Column) -> Column:
    """Whether a field's value is hidden: a word or marks that say so, or tokens with nothing but marks about them."""
    bare = F.regexp_replace(value, r"^[\s;；,，。．.:：|()（）\[\]【】]+|[\s;；,，。．.:：|()（）\[\]【】]+$", "")
    left = F.regexp_replace(F.regexp_replace(bare, TOKEN, ""), r"[\s,，、;；。．.:：|()（）\[\]【】<>《》/\\'\"“”‘’—–_-]", "")
    return bare.rlike(r"^[*#Xx_—–-]+$") | bare.isin(*HIDDEN) | (bare.rlike(TOKEN) & (left == ""))


def _field_open(view: Column) -> Column:
    """Whether a labelled address stands in the line with a value, up to the next field or clause, that is not hidden."""
    values = F.regexp_extract_all(view, F.lit(rf"{_either(ADDRESS_LABELS)}\s*[:为是]\s*([^|;,。]+)"), F.lit(1))
    own = F.transform(values, lambda v: F.regexp_replace(v, rf"\s*(?:已通过|{_either(NEXT_LABELS)}\s*[:为是]).*$", ""))
    return F.exists(own, lambda v: (F.trim(v) != "") & ~_safe(v))


def findings(docs: DataFrame, categories: tuple[str, ...] = CATEGORIES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, category): each kind of residue once for each line; no matched text leaves. A null text has none.

    Texts without a hint of an asked category are left before they are cut to lines, and categories not asked for cost nothing.
    """
    hint = "|".join(sorted({HINTS.get(c, DIGITS) for c in categories}))
    texts = docs.where(F.col(text_col).rlike(hint))
    rows = audit_lines(texts, id_col=id_col, text_col=text_col).withColumn("_view", _view(F.col("line_text")))
    plain = F.regexp_replace("_view", MARKED, "  ")
    # A letter before a run, and a letter or unit after it, belong to it, so that neither is read as a number alone.
    run = rf"[A-Za-z]?[0-9](?:{SEP}?[0-9])*(?:{SEP}?[Xx])?(?:\s*{_either(UNITS)}|[A-Za-z])?"
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_plain", plain).withColumn("_runs", F.when(F.col("_plain").rlike(DIGITS), F.regexp_extract_all("_plain", F.lit(run), F.lit(0))).otherwise(none))
    t, runs = F.col("_plain"), F.col("_runs")
    # Identity numbers may have more than one separator between their groups.
    spaced = F.when(t.rlike(DIGITS), F.regexp_extract_all(F.regexp_replace(t, f"{SEP}+", "-"), F.lit("[0-9Xx](?:-?[0-9Xx])*"), F.lit(0))).otherwise(none)
    amount = rf"\s*{_either(UNITS)}$"
    labelled = rf"{_either(ACCOUNT_LABELS)}\s*:?\s*[【\[]?[0-9](?:{SEP}?[0-9]){{9,18}}"
    code = rf"{_either(CONTRACT_LABELS)}\s*[:#]?\s*[A-Za-z0-9][A-Za-z0-9._/－—-]{{2,}}"
    prefixed = r"(?i)(?<![a-z0-9])HT号?[\s:/－—-]*[0-9]{2,6}(?:\s*[-－—/]\s*[0-9]+)+(?![a-z0-9])"
    every = lambda r: F.concat(_tails(r), F.split(r, SEP))
    brackets = lambda c: F.length(F.regexp_replace("line_text", f"[^{c}]", ""))
    tests = {
        "TOKEN": F.exists(F.regexp_extract_all("line_text", F.lit(MARKED), F.lit(0)), lambda x: ~x.rlike(f"^{TOKEN}$")) | (brackets("⟦") != brackets("⟧")),
        "ID_CARD": F.exists(spaced, lambda r: F.exists(every(r), lambda x: _id_like(_joined(x)))),
        "PHONE": F.exists(runs, lambda r: F.exists(_tails(r), _is_phone)),
        "LANDLINE": F.exists(runs, lambda r: F.exists(_tails(r), _is_landline)),
        "EMAIL": t.rlike(r"[A-Za-z0-9._%+-]\s*@\s*[A-Za-z0-9.-]+\.[A-Za-z]{2,63}(?![A-Za-z0-9._%+-])"),
        "BANK_ACCOUNT": t.rlike(labelled) | F.exists(runs, lambda r: ~r.rlike(amount) & F.exists(every(r), lambda x: _is_account(_joined(x)))),
        "CONTRACT_ID": t.rlike(code) | t.rlike(prefixed),
        "ADDRESS": F.when(F.col("_view").rlike("[址住]"), _field_open(F.col("_view"))).otherwise(False),
    }
    asked = [F.when(test, F.lit(name)) for name, test in tests.items() if name in categories]
    both = {"TABLE_PIPE", "ADDRESS"} & set(categories)
    found = rows.select(id_col, "line", F.explode(F.array_compact(F.array(*asked))).alias("category")) if asked else None
    if not both:
        return found
    across = block_findings(docs, id_col=id_col, text_col=text_col).where(F.col("category").isin(*both))
    # A line that is both a field and a cell counts once.
    return across if found is None else found.unionByName(across).distinct()


def cells(line: Column) -> Column:
    """Cells of a pipe row: escaped pipes and inline code do not part cells, outer pipes hold none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), "`[^`]*`", "c"), r"\\\|", "p")
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(bare, "^\\|", ""), "\\|$", ""), "\\|", -1), lambda c: F.trim(c))


def _cell_open(row: Column) -> Column:
    """Whether an address label's cell is followed, but for cells of a colon, by a value that is not hidden."""
    held = F.filter(row, lambda c: ~c.isin(":", "："))
    label = lambda c: F.regexp_replace(c, "[:：]+$", "").isin(*ADDRESS_LABELS)
    return F.exists(F.zip_with(held, F.slice(held, 2, F.size(held)), lambda a, b: label(a) & (b != "") & ~_safe(b)), lambda x: F.coalesce(x, F.lit(False)))


def block_findings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, category) of what lines mean together, by one fold over the lines of a text.

    TABLE_PIPE: a header or row with another number of cells than the separator below the header; a line without a pipe
    ends the table. ADDRESS: a visible value in the cell after a label's, or on the next line with words after an empty
    field. Code blocks hold neither tables nor cells.
    """
    separator = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?$"
    empty_field = rf"{_either(ADDRESS_LABELS)}\s*:\s*$"
    is_sep = lambda x: F.coalesce(x.contains("|") & F.trim(x).rlike(separator), F.lit(False))
    next_label = rf"^{_either(NEXT_LABELS)}\s*:"

    def read(x: Column, i: Column) -> Column:
        t, after = F.trim(x), F.get("_lines", i + 1)
        pipe, row = x.contains("|"), cells(x)
        return F.struct(
            (i + 1).alias("n"),
            t.startswith("```").alias("fence"),
            pipe.alias("pipe"),
            is_sep(x).alias("sep"),
            F.when(pipe, F.size(row)).otherwise(0).alias("width"),
            F.when(pipe & is_sep(after) & ~is_sep(x), F.size(cells(after))).otherwise(0).alias("head"),
            (pipe & _cell_open(row)).alias("cell"),
            (t == "").alias("blank"),
            (~pipe & _view(x).rlike(empty_field)).alias("empty"),
            (~t.rlike("^(?:[#*>-]|```)") & ~_view(t).rlike(next_label) & ~_safe(t)).alias("open"),
        )

    state = "struct<code:boolean,width:int,wants:boolean,found:array<struct<line:int,category:string>>>"
    start = F.struct(F.lit(False).alias("code"), F.lit(0).alias("width"), F.lit(False).alias("wants"), F.array().alias("found")).cast(state)

    def step(s: Column, x: Column) -> Column:
        inside = s["code"] | x["fence"]
        width = F.when(inside | ~x["pipe"], 0).when(x["head"] > 0, x["head"]).otherwise(s["width"])
        uneven = (width > 0) & ~x["sep"] & (x["width"] != width)
        shown = (~inside & x["cell"]) | (s["wants"] & ~x["blank"] & x["open"])
        hit = lambda test, name: F.when(test, F.array(F.struct(x["n"].alias("line"), F.lit(name).alias("category")))).otherwise(F.array().cast("array<struct<line:int,category:string>>"))
        found = F.when(uneven | shown, F.concat(s["found"], hit(uneven, "TABLE_PIPE"), hit(shown, "ADDRESS"))).otherwise(s["found"])
        return F.struct((s["code"] != x["fence"]).alias("code"), width.alias("width"), (x["empty"] | (s["wants"] & x["blank"])).alias("wants"), found.alias("found")).cast(state)

    texts = docs.where(F.col(text_col).rlike(r"-{3}|[址住]")).select(id_col, _lines(F.col(text_col)).alias("_lines"))
    return texts.select(id_col, F.inline(F.aggregate(F.transform("_lines", read), start, step)["found"]))


def rollup(found: DataFrame) -> DataFrame:
    """Counts by category and, under 'total', of all."""
    return found.rollup("category").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("category", F.lit("total")).alias("category"), "n")


def rank(category: Column) -> Column:
    """The place of a category in reports; other categories come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), category), F.lit(0)), F.lit(len(CATEGORIES) + 1))


def reports(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, report): JSON with the total, counts by category in alphabetical order, and the findings by line and rank.

    A document's findings are at most its lines times the categories; documents without any have no row.
    """
    row = F.struct("line", rank(F.col("category")).alias("rank"), "category")
    per = found.dropDuplicates([id_col, "line", "category"]).groupBy(id_col).agg(F.array_sort(F.collect_list(row)).alias("_f"))
    names = F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["category"])))
    counts = F.map_from_arrays(names, F.transform(names, lambda c: F.size(F.filter("_f", lambda x: x["category"] == c))))
    listed = F.transform("_f", lambda x: F.struct(x["line"].alias("line"), x["category"].alias("category")))
    return per.select(id_col, F.to_json(F.struct(F.size("_f").alias("total"), counts.alias("counts"), listed.alias("findings"))).alias("report"))
