"""Queries of recognition, span algebra, masking, audit and normalisation over ``documents``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import audit, masking, normalize, recognize, spans

SLICE = recognize.rules_named("email", "long_numeric_identifier", "number")


def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def found(*names):
    rules = recognize.rules_named(*names)
    return lambda spark, d: recognize.exploded(recognize.recognize(docs(spark, d), rules)).select("doc_id", "start", "end", "entity_type", "surface", "rule_id")


_LEN = "lambda x: length(x)"
_AT = f"CAST(list_sum(list_transform(g[1:i], {_LEN})) + coalesce(list_sum(list_transform(m[1:i - 1], {_LEN})), 0) AS BIGINT)"


def at_sql(pattern: str, table: str = "documents") -> str:
    """(doc_id, pos, m): each match with its start."""
    return f"SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {_AT})) AS pos, unnest(m) AS m FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {table} WHERE text IS NOT NULL)"


# RE2 looks neither ahead nor behind: numbers take the character after them along, accounts are whole runs.
_NUMBER = r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?:[^\d]|$)"
EMAIL_SQL = f"SELECT doc_id, pos AS start, pos + length(m) AS \"end\", 'EMAIL' AS entity_type, m AS surface, 'email' AS rule_id FROM ({at_sql(r'[A-Za-z0-9._%+-]+[ \t]*@[ \t]*[A-Za-z0-9.-]+\.[A-Za-z]{2,63}')})"
ACCOUNT_SQL = f"SELECT doc_id, pos AS start, pos + length(m) AS \"end\", 'BANK_ACCOUNT' AS entity_type, m AS surface, 'long_numeric_identifier' AS rule_id FROM ({at_sql('\\b[0-9]{12,19}\\b')})"
NUMBER_SQL = f"SELECT doc_id, pos AS start, pos + length(s) AS \"end\", 'NUMBER' AS entity_type, s AS surface, 'number' AS rule_id FROM (SELECT doc_id, pos, regexp_extract(m, '{_NUMBER}', 1) AS s FROM ({at_sql(_NUMBER)}))"
CAND = f"""cand AS (SELECT doc_id, start, "end", entity_type, surface, CASE rule_id WHEN 'email' THEN 96 WHEN 'number' THEN 10 ELSE 94 END AS priority,
  CASE rule_id WHEN 'email' THEN 1.0 WHEN 'number' THEN 0.8 ELSE 0.92 END AS score, CASE rule_id WHEN 'email' THEN 0 WHEN 'number' THEN 2 ELSE 1 END AS seq FROM ({EMAIL_SQL} UNION ALL {ACCOUNT_SQL} UNION ALL {NUMBER_SQL}))"""
COMP = f"""WITH {CAND}, reach AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cand),
comp AS (SELECT * EXCLUDE (r), sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end", seq ROWS UNBOUNDED PRECEDING) AS component FROM reach)"""
#: A fold over each component's spans, best first.
RESOLVED = f"""{COMP}, listed AS (SELECT doc_id, component, list({{'start': start, 'end': "end", 'entity_type': entity_type, 'surface': surface}} ORDER BY priority DESC, score DESC, "end" - start DESC, start, "end", seq) AS l FROM comp GROUP BY doc_id, component),
acc AS (SELECT doc_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda s: s['start'] < x[1]['end'] AND x[1]['start'] < s['end'])) > 0 THEN a ELSE list_concat(a, x) END, [])) AS s FROM (SELECT doc_id, list_transform(l, lambda x: [x]) AS l FROM listed)),
accepted AS (SELECT doc_id, s['start'] AS start, s['end'] AS "end", s['entity_type'] AS entity_type, s['surface'] AS surface FROM acc)"""
TOKENS = f"""{RESOLVED}, firsts AS (SELECT doc_id, entity_type, surface, min(start) AS f FROM accepted WHERE entity_type <> 'NUMBER' GROUP BY ALL),
mapping AS (SELECT doc_id, entity_type, surface, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY f, surface) AS n FROM firsts),
tok AS (SELECT *, '⟦' || CASE entity_type WHEN 'EMAIL' THEN '邮箱' ELSE '账号' END || n || '⟧' AS token FROM mapping)"""
MASKED = f"""{TOKENS}, placed AS (SELECT doc_id, start, "end", token, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM accepted JOIN tok USING (doc_id, entity_type, surface)),
pieces AS (SELECT p.doc_id, string_agg(substr(text, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)) || token, '' ORDER BY start) AS body, max("end") AS last FROM placed p JOIN documents d ON d.doc_id = p.doc_id GROUP BY p.doc_id),
masked AS (SELECT d.doc_id, d.text, CASE WHEN body IS NULL THEN text ELSE body || substr(text, CAST(last + 1 AS BIGINT)) END AS masked FROM documents d LEFT JOIN pieces USING (doc_id))"""


def candidates(spark, d):
    return recognize.exploded(recognize.recognize(docs(spark, d), SLICE))


def accepted(spark, d):
    return spans.resolve(candidates(spark, d))


def masked(spark, d):
    return masking.mask(docs(spark, d), SLICE)


def q_masked(spark, d):
    return masked(spark, d)["masked"].select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.length("masked").cast("long").alias("n_chars"))


def q_flagship(spark, d):
    m = masking.mask(docs(spark, d))  # the whole policy
    counts = m["accepted"].groupBy("_row").agg(F.count(F.lit(1)).alias("n_accepted"), F.count_if("anonymize").alias("n_masked"))
    return m["masked"].join(counts, "_row", "left").select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"), F.coalesce("n_masked", F.lit(0)).alias("n_masked"))


def q_restored(spark, d):
    m = masked(spark, d)
    back = masking.restore(m["masked"], m["mapping"])
    return back.select("doc_id", (F.col("restored") == F.col("text")).alias("exact"), F.sha2("restored", 256).alias("restored_sha256"))


def q_report(spark, d):
    m = masked(spark, d)
    return masking.report(m["candidates"], m["accepted"])


def q_audit(*kinds):
    return lambda spark, d: audit.findings(docs(spark, d), kinds)


_LINES = r"SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE text IS NOT NULL))"
AUDIT_EMAIL = rf"SELECT doc_id, line, 'EMAIL' AS category FROM ({_LINES}) WHERE regexp_matches(t, '[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9.-]+\.[A-Za-z]{{2,63}}')"
_IDS = "(regexp_full_match(r, '[0-9]{15}') AND try_strptime('19' || r[7:12], '%Y%m%d') IS NOT NULL OR regexp_full_match(r, '[0-9]{17}[0-9Xx]') AND try_strptime(r[7:14], '%Y%m%d') IS NOT NULL)"
AUDIT_ACCOUNT = rf"SELECT DISTINCT doc_id, line, 'BANK_ACCOUNT' AS category FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '[A-Za-z0-9]+')) AS r FROM ({_LINES})) WHERE regexp_full_match(r, '[0-9]{{16,19}}') AND NOT {_IDS}"


def q_lines(fn):
    return lambda spark, d: fn(normalize.lines(docs(spark, d)))


_NLINES = "SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
KIND = r"""CASE WHEN trim(line, ' ' || chr(9)) = '' THEN 'EMPTY' WHEN regexp_matches(s, '^#{1,6}\s') THEN 'HEADING' WHEN s LIKE '|%' THEN 'TABLE'
  WHEN regexp_matches(s, '^(?:[-*+]|[0-9]+[.)]|[一二三四五六七八九十百千万]+[、.])') THEN 'LIST' WHEN regexp_matches(s, '^(?:[-=_]{3,}|第\s*[0-9]+\s*页)$') THEN 'PAGE_BREAK'
  WHEN regexp_matches(s, '^[^:：|]{1,40}[:：]\s*\S') THEN 'FIELD' ELSE 'PARAGRAPH' END"""
_S = "(SELECT *, trim(line, ' ' || chr(9)) AS s FROM ({}))"


def q_blank(spark, d):
    # Every fourth line is taken for empty, so that runs of blank lines occur.
    numbered = normalize.lines(docs(spark, d)).withColumn("line", F.when(F.length("line") % 4 < 2, "").otherwise(F.col("line")))
    return normalize.limit_blank_runs(numbered, 1).select("doc_id", "line_no", F.length("line").alias("n"))


BLANK_SQL = f"""WITH l AS (SELECT doc_id, line_no, CASE WHEN length(line) % 4 < 2 THEN '' ELSE line END AS line FROM ({_NLINES})),
r AS (SELECT *, trim(line) = '' AS b, sum(CASE WHEN trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, b ORDER BY line_no) AS nth FROM r)
SELECT doc_id, line_no, length(line) AS n FROM n WHERE NOT b OR nth <= 1"""


def q_fence(spark, d):
    numbered = normalize.lines(docs(spark, d)).withColumn("line", F.when(F.col("line_no") % 5 == 2, F.concat(F.lit("```"), "line")).otherwise(F.col("line")))
    return normalize.fenced(numbered).groupBy("doc_id").agg(F.count_if("in_code").alias("n_code"), F.count(F.lit(1)).alias("n_lines"))


FENCE_SQL = f"SELECT doc_id, count(*) FILTER (c % 2 = 1) AS n_code, count(*) AS n_lines FROM (SELECT doc_id, sum(CASE WHEN line_no % 5 = 2 OR ltrim(line) LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS c FROM ({_NLINES})) GROUP BY doc_id"


def q_spaces(spark, d):
    odd = F.regexp_replace(F.regexp_replace("text", "e ", "e 　\t"), "\n", "\r\n")
    return docs(spark, d).select("doc_id", F.sha2(normalize.plain_spaces(normalize.newlines(odd)), 256).alias("sha256"))


def q_table_rows(spark, d):
    rows = normalize.lines(docs(spark, d)).where(F.col("line").contains("|"))
    made = F.concat(F.lit("|  "), F.regexp_replace("line", " ", "  "), F.lit(" |"))
    return rows.select("doc_id", "line_no", normalize.table_row(made).alias("row"))


def q_phone(spark, d):
    made = F.concat(F.lit("tel 1"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(" "), F.lpad((F.col("doc_id") % 9973).cast("string"), 4, "0"), F.lit("  "), F.lpad((F.col("doc_id") % 9967).cast("string"), 4, "0"))
    return docs(spark, d).select("doc_id", normalize.repair_phone(made).alias("repaired"))


PHONE_SQL = "SELECT doc_id, 'tel 1' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || lpad(CAST(doc_id % 9973 AS VARCHAR), 4, '0') || lpad(CAST(doc_id % 9967 AS VARCHAR), 4, '0') AS repaired FROM documents"


def q_keywords(spark, d):
    return recognize.keyword_spans(docs(spark, d), ["then", "thethe", "enen"]).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start"), F.max("end").cast("long").alias("last_end"))


KEYWORD_SQL = """WITH k AS (SELECT unnest(['then', 'thethe', 'enen']) AS keyword),
h AS (SELECT doc_id, keyword, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(keyword)) = keyword)) - 1 AS s FROM documents, k WHERE contains(text, keyword))
SELECT doc_id, keyword, count(*) AS n, CAST(sum(s) AS BIGINT) AS sum_start, max(s + length(keyword)) AS last_end FROM h GROUP BY ALL"""


def q_custom(spark, d):
    rules = (recognize.regex_rule("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"), recognize.field_rule("key", ["token", "secret"]))
    return recognize.exploded(recognize.recognize(docs(spark, d), rules)).select("doc_id", "start", "end", "surface", "rule_id")


_FIELD = r'(token|secret)\s*[:：]\s*[^\n|；;]*[^\n|；;\s]'
CUSTOM_SQL = f"""SELECT doc_id, pos AS start, pos + length(m) AS "end", m AS surface, 'ip' AS rule_id FROM ({at_sql('[0-9][0-9.]+')}) WHERE regexp_full_match(m, '[0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}}')
UNION ALL SELECT doc_id, pos + length(l) AS start, pos + length(m) AS "end", substr(m, length(l) + 1) AS surface, 'key' AS rule_id FROM (SELECT *, regexp_extract(m, '^(token|secret)\\s*[:：]\\s*', 0) AS l FROM ({at_sql(_FIELD)}))"""


def q_dedup(keep):
    return lambda spark, d: spans.dedup_positions(candidates(spark, d), keep).select("doc_id", "start", "end", "entity_type")


def _dedup_sql(order):
    return f'WITH {CAND} SELECT doc_id, start, "end", entity_type FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY {order}) = 1'


def q_nested(spark, d):
    c = candidates(spark, d)
    return spans.drop_nested(c.where("entity_type = 'NUMBER'"), c.where("entity_type <> 'NUMBER'")).select("doc_id", "start", "end", "surface")


NESTED_SQL = f"""WITH {CAND} SELECT doc_id, start, "end", surface FROM cand a WHERE entity_type = 'NUMBER' AND NOT EXISTS (SELECT 1 FROM cand b WHERE b.doc_id = a.doc_id AND b.entity_type <> 'NUMBER'
  AND b.start <= a.start AND a."end" <= b."end" AND (b.start < a.start OR a."end" < b."end"))"""


def q_windows(spark, d):
    c = candidates(spark, d).withColumn("entity_type", F.lit("X"))
    return spans.merge_windows(c).select("doc_id", "start", "end", F.round("score", 6).alias("score"))


WINDOWS_SQL = f"""WITH {CAND}, o AS (SELECT doc_id, start, "end", max(score) AS score FROM cand GROUP BY ALL) SELECT doc_id, start, "end", round(CAST(score AS DOUBLE), 6) AS score FROM o a
  WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a."end" <= b."end" AND b."end" - b.start > a."end" - a.start)"""

LONGEST_SQL = f"""WITH {CAND}, l AS (SELECT doc_id, list([{{'start': start, 'end': "end", 'entity_type': entity_type}}] ORDER BY start, "end" - start DESC, entity_type) AS l FROM cand GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(l, lambda a, x: CASE WHEN x[1]['start'] >= a[-1]['end'] THEN list_concat(a, x) ELSE a END)) AS s FROM l)
SELECT doc_id, s['start'] AS start, s['end'] AS "end", s['entity_type'] AS entity_type FROM k"""


def q_nfkc(spark, d):
    wide = F.translate("text", "0123456789abcdefghijklmnopqrstuvwxyz!", "０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ！")
    return docs(spark, d).select("doc_id", F.sha2(normalize.nfkc(wide), 256).alias("sha256"))


QUERIES = {
    "norm_nfkc": (q_nfkc, "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
    "longest_first": (lambda s, d: spans.longest_first(candidates(s, d)).select("doc_id", "start", "end", "entity_type"), LONGEST_SQL),
    "artifact_stem": (lambda s, d: docs(s, d).select("doc_id", masking.artifact_stem(F.col("doc_id"), F.col("source")).alias("stem")), "SELECT doc_id, 'document-' || left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || source), 12) AS stem FROM documents"),
    "token_type_name": (
        lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", masking.token_type_name(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit(" "), "p_type")).when(F.col("p_partkey") % 7 == 0, " - ").otherwise(F.concat(F.lit("_"), "p_name", F.lit("#")))).alias("name")),
        """WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace(upper(CASE WHEN p_partkey % 3 = 0 THEN p_size || ' ' || p_type WHEN p_partkey % 7 = 0 THEN ' - ' ELSE '_' || p_name || '#' END), '[^A-Z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS v FROM part)
SELECT p_partkey, CASE WHEN v = '' THEN 'ENTITY' WHEN regexp_matches(v, '^[0-9]') THEN 'E_' || v ELSE v END AS name FROM n""",
    ),
    "rec_email": (found("email"), EMAIL_SQL),
    "rec_account": (found("long_numeric_identifier"), ACCOUNT_SQL),
    "rec_number": (found("number"), NUMBER_SQL),
    "rec_custom_regex": (q_custom, CUSTOM_SQL),
    "keyword_overlap": (q_keywords, KEYWORD_SQL),
    "span_union": (lambda s, d: candidates(s, d).groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n")), f"WITH {CAND} SELECT doc_id, entity_type, count(*) AS n FROM cand GROUP BY ALL"),
    "span_components": (lambda s, d: spans.components(candidates(s, d)).select("doc_id", "start", "end", "component"), f'{COMP} SELECT doc_id, start, "end", CAST(component AS BIGINT) AS component FROM comp'),
    "resolve_spans": (lambda s, d: accepted(s, d).select("doc_id", "start", "end", "entity_type", "surface"), f"{RESOLVED} SELECT * FROM accepted"),
    "span_disjoint": (lambda s, d: spans.overlapping(candidates(s, d)).select("doc_id", "start", "end"), f'WITH {CAND} SELECT doc_id, start, "end" FROM cand QUALIFY start < max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'),
    "dedup_first": (q_dedup("first"), _dedup_sql("seq")),
    "dedup_last": (q_dedup("last"), _dedup_sql("seq DESC")),
    "dedup_best": (q_dedup("best"), _dedup_sql("score DESC, seq")),
    "nesting_antijoin": (q_nested, NESTED_SQL),
    "window_merge": (q_windows, WINDOWS_SQL),
    "token_text": (lambda s, d: masked(s, d)["mapping"].select("doc_id", "entity_type", "surface", F.col("n").cast("long").alias("n"), "token"), f"{TOKENS} SELECT doc_id, entity_type, surface, n, token FROM tok"),
    "mask_text": (q_masked, f"{MASKED} SELECT doc_id, sha256(masked) AS masked_sha256, length(masked) AS n_chars FROM masked"),
    "mask_report": (
        q_report,
        f"{RESOLVED}, c AS (SELECT doc_id, entity_type, count(*) AS detected FROM cand GROUP BY ALL), a AS (SELECT doc_id, entity_type, count(*) AS accepted FROM accepted GROUP BY ALL) SELECT doc_id, entity_type, detected, coalesce(accepted, 0) AS accepted, CASE WHEN entity_type = 'NUMBER' THEN 0 ELSE coalesce(accepted, 0) END AS masked FROM c LEFT JOIN a USING (doc_id, entity_type)",
    ),
    "restore_roundtrip": (q_restored, "SELECT doc_id, true AS exact, sha256(text) AS restored_sha256 FROM documents"),
    "content_hash": (lambda s, d: docs(s, d).select("doc_id", F.sha2("text", 256).alias("sha256"), F.left(F.sha2(F.concat(F.sha2("text", 256), F.lit("config")), 256), F.lit(12)).alias("job_id")), "SELECT doc_id, sha256(text) AS sha256, left(sha256(sha256(text) || 'config'), 12) AS job_id FROM documents"),
    "safe_id": (lambda s, d: docs(s, d).select("doc_id", masking.safe_id(F.concat_ws("/", "source", "doc_id")).alias("safe_id")), "SELECT doc_id, left(sha256(source || '/' || doc_id), 12) AS safe_id FROM documents"),
    "audit_email": (q_audit("EMAIL"), AUDIT_EMAIL),
    "audit_account": (q_audit("BANK_ACCOUNT"), AUDIT_ACCOUNT),
    "audit_rollup": (
        lambda s, d: audit.rollup(audit.findings(docs(s, d), ("EMAIL", "BANK_ACCOUNT"))),
        f"WITH f AS ({AUDIT_EMAIL} UNION ALL {AUDIT_ACCOUNT}) SELECT coalesce(category, 'total') AS category, count(*) AS n FROM f GROUP BY ROLLUP (category)",
    ),
    "norm_spaces": (q_spaces, "SELECT doc_id, sha256(replace(text, 'e ', 'e   ')) AS sha256 FROM documents"),
    "classify_lines": (q_lines(lambda l: l.select("doc_id", "line_no", normalize.classify(F.col("line")).alias("kind"))), f"SELECT doc_id, line_no, {KIND} AS kind FROM {_S.format(_NLINES)}"),
    "fence_state": (q_fence, FENCE_SQL),
    "organize_blank": (q_blank, BLANK_SQL),
    "table_row_norm": (q_table_rows, None),
    "phone_repair": (q_phone, PHONE_SQL),
    "organize_full": (lambda s, d: normalize.organize(docs(s, d)).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256")), None),
}
