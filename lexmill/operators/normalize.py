"""Text normalisation and line operators, as DataFrame expressions over lines kept in order."""

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The Unicode spaces that become a plain one; Han characters; closing and opening marks; currency units.
SPACES = "\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
HAN = "\\u3400-\\u9fff"
CLOSING, OPENING = "，。！？；：、,.!?;:）)】》」』", "（(【《「『"
UNITS = "万亿元|亿元|万元|人民币|美元|港币|元|万|亿"


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


def nfkc(c: Column) -> Column:
    """Compatibility composition of Unicode, which no built-in function has: an Arrow function that only texts beyond ASCII are sent to."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(composed(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def plain_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACES}\\t]", " ")


def stripped(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(F.regexp_replace(c, "(?U)^\\s+", ""), "(?U)\\s+\\z", "")


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 0, line)."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def classify(line: Column) -> Column:
    """EMPTY, HEADING, TABLE, LIST, PAGE_BREAK, FIELD or PARAGRAPH, the first that fits the stripped line."""
    s = stripped(line)
    return (
        F.when(s == "", "EMPTY")
        .when(s.rlike("^#{1,6}\\s"), "HEADING")
        .when(s.startswith("|"), "TABLE")
        .when(s.rlike("^(?:[-*+]|[0-9]+[.)]|[一二三四五六七八九十百千万]+[、.])"), "LIST")
        .when(s.rlike("^(?:[-=_]{3,}|第\\s*[0-9]+\\s*页)$"), "PAGE_BREAK")
        .when(s.rlike("^[^:：|]{1,40}[:：]\\s*\\S"), "FIELD")
        .otherwise("PARAGRAPH")
    )


def fenced(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``in_code``: a line that begins with three backticks turns code on and off, from itself on."""
    toggles = F.sum(F.when(stripped(F.col("line")).startswith("```"), 1).otherwise(0)).over(Window.partitionBy(id_col).orderBy("line_no"))
    return numbered.withColumn("in_code", toggles % 2 == 1)


def repair_phone(c: Column) -> Column:
    return F.regexp_replace(c, "(?<![0-9])(1[0-9]{2})\\s+([0-9]{4})\\s+([0-9]{4})(?![0-9])", "$1$2$3")


def repair_id(c: Column) -> Column:
    """Joins an identity number spaced 6-4-4-4, and 18 digits with white space anywhere between them."""
    c = F.regexp_replace(c, "(?<![0-9])([0-9]{6})\\s+([0-9]{4})\\s+([0-9]{4})\\s+([0-9]{3}[0-9Xx])(?![0-9])", "$1$2$3$4")
    loose = "(?<![0-9])(" + "([0-9])\\s*" * 17 + "([0-9Xx]))(?![0-9])"
    return F.regexp_replace(c, loose, "".join(f"${k}" for k in range(2, 20)))


def repair_amount(c: Column) -> Column:
    """Takes white space out of a number that a currency unit follows, and from before the unit."""
    pattern = f"(?<![0-9])([+-]?(?:[0-9][0-9,\\s]*[0-9]|[0-9])(?:\\s*\\.\\s*[0-9]+)?)[ \\t]*({UNITS})(?![0-9])"
    found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    compact = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: F.concat(x["g"], F.regexp_replace(F.coalesce(x["m"], F.lit("")), "\\s+", "")))
    return F.when(c.rlike(pattern), F.array_join(compact, "")).otherwise(c)


def plain_line(line: Column, keep_indent: Column | None = None) -> Column:
    """One line: right-trimmed, blanks single, numbers repaired, no spaces between Han characters or at marks."""
    value = F.regexp_replace(line, "[ \\t]+\\z", "")
    indent = F.lit("") if keep_indent is None else F.when(keep_indent, F.regexp_extract(value, "^\\s*", 0)).otherwise("")
    body = F.regexp_replace(stripped(value), "[ \\t]{2,}", " ")
    body = repair_phone(repair_amount(repair_id(body)))
    body = F.regexp_replace(body, f"(?<=[{HAN}]) +(?=[{HAN}])", "")
    body = F.regexp_replace(body, f" +([{CLOSING}])", "$1")
    body = F.regexp_replace(body, f"([{OPENING}]) +", "$1")
    return F.concat(indent, stripped(body))


def table_row(line: Column) -> Column:
    """A pipe row: edge cells trimmed, inner cells as plain lines; the number of pipes stays."""
    cells = F.split(line, "\\|", -1)
    last = F.size(cells) - 1
    return F.array_join(F.transform(cells, lambda c, i: F.when((i == 0) | (i == last), stripped(c)).otherwise(plain_line(c))), "|")


def limit_blank_runs(numbered: DataFrame, most: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Lines without the blank ones beyond ``most`` in a row (gaps and islands)."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    marked = numbered.withColumn("_blank", stripped(F.col("line")) == "").withColumn("_run", F.sum(F.when(F.col("_blank"), 0).otherwise(1)).over(w))
    nth = F.row_number().over(Window.partitionBy(id_col, "_run", "_blank").orderBy("line_no"))
    return marked.withColumn("_nth", nth).where(~F.col("_blank") | (F.col("_nth") <= most)).drop("_blank", "_run", "_nth")


def assemble(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the lines joined in order, stripped, with one final newline; empty stays empty."""
    joined = stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"))
    return numbered.groupBy(id_col).agg(joined.alias("_t")).select(id_col, F.when(F.col("_t") == "", "").otherwise(F.concat("_t", F.lit("\n"))).alias("text"))


#: White space in the sense of ``stripped``, as characters.
BLANKS = "\t\n\u000b\u000c\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _held(text: Column) -> Column:
    """(line, code) of the lines of a text with plain spaces and newlines: a line that begins with three backticks turns code on
    and off, from itself on, so that the text is cut before each such line and every other piece is code."""
    pieces = F.split(F.concat(F.lit("\n"), text), "\n(?=(?U:[\\s&&[^\n]]*)```)", -1)
    own = lambda p, k: F.slice(F.split(p, "\n", -1), F.when(k == 0, 2).otherwise(1), F.length(p) + 1)
    cut = F.flatten(F.transform(pieces, lambda p, k: F.transform(own(p, k), lambda l: F.struct(l.alias("line"), (k % 2 == 1).alias("code")))))
    return F.when(text.contains("```"), cut).otherwise(F.transform(F.split(text, "\n", -1), lambda l: F.struct(l.alias("line"), F.lit(False).alias("code"))))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _tidy(line: Column, bare: Column) -> Column:
    """``plain_line`` of a line whose stripped form is at hand; each repair only where the line has what it looks for."""
    body = F.when(bare.contains("  ") | bare.contains("\t"), F.regexp_replace(bare, "[ \\t]{2,}", " ")).otherwise(bare)
    body = _let(body, lambda b: F.when(b.rlike("[0-9]"), _let(repair_id(b), lambda i: repair_phone(repair_amount(i)))).otherwise(b))
    body = _let(body, lambda b: F.when(_ascii(b), b).otherwise(F.regexp_replace(b, f"(?<=[{HAN}]) +(?=[{HAN}])", "")))
    body = F.regexp_replace(F.regexp_replace(body, f" +([{CLOSING}])", "$1"), f"([{OPENING}]) +", "$1")
    indent = F.when(classify(bare).isin("LIST", "HEADING"), F.regexp_extract(line, "^\\s*", 0)).otherwise("")
    return F.concat(indent, F.trim(body, F.lit(BLANKS)))


def organize(docs: DataFrame, most_blank: int = 2, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line-wise organisation; broken lines are not merged and compatibility forms not folded. A null text has no row.

    All of it is local to a row: lines are an array, of which runs of blanks are told by the lines before each.
    """
    given = F.when(F.col(text_col).contains("\r"), newlines(F.col(text_col))).otherwise(F.col(text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, given.alias("_t")).select(id_col, F.when(_ascii(F.col("_t")), F.replace("_t", F.lit("\t"), F.lit(" "))).otherwise(plain_spaces(F.col("_t"))).alias("_t"))

    def tidied(x: Column) -> Column:
        table = F.startswith(x["bare"], F.lit("|"))
        line = F.when(x["code"], F.regexp_replace(x["line"], "[ \\t]+\\z", "")).when(table, table_row(x["line"])).otherwise(_tidy(x["line"], x["bare"]))
        return F.struct(line.alias("line"), x["code"].alias("code"))

    image = lambda x: ~x["code"] & x["line"].contains("<!--") & x["line"].rlike("(?i)^\\s*<!--\\s*image\\s*-->\\s*$")
    page = lambda x: ~x["code"] & x["line"].contains("第") & x["line"].rlike("^\\s*第\\s*[0-9]+\\s*页\\s*$")
    lines_ = F.transform(F.transform(_held(F.col("_t")), lambda x: F.struct(x["line"].alias("line"), F.trim(x["line"], F.lit(BLANKS)).alias("bare"), x["code"].alias("code"))), tidied)
    kept = F.transform(F.filter(lines_, lambda x: ~image(x)), lambda x: F.when(page(x), "---").otherwise(x["line"]))
    held = texts.select(id_col, F.transform(kept, lambda l: F.struct(l.alias("line"), (F.trim(l, F.lit(BLANKS)) == "").alias("blank"))).alias("_lines"))
    before = lambda i: [F.when(i >= k, F.get("_lines", i - k)["blank"]).otherwise(False) for k in range(1, most_blank + 1)]
    run = lambda x, i: ~reduce(lambda a, b: a & b, before(i), x["blank"])
    joined = F.trim(F.array_join(F.transform(F.filter("_lines", run), lambda x: x["line"]), "\n"), F.lit(BLANKS))
    return held.select(id_col, joined.alias("_t")).select(id_col, F.when(F.col("_t") == "", "").otherwise(F.concat("_t", F.lit("\n"))).alias("text"))
