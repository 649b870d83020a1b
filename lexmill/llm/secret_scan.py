"""Secret scans with one deterministic automaton for all rules.

One pass of the combined automaton reads each text's UTF-8 bytes until a rule's match ends, if any does. Texts where
none does, nearly all, are done. In the others the mirrored automaton reads backwards and marks where matches of each
rule start, and the rule's own automaton runs from the first start to the longest end, then from the next start after it:
leftmost, longest, non-overlapping per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.ship import ship

from . import common as C
from .automaton import Automaton, mirrored, parse


def either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Rule:
    """``prefix`` then ``value``; matches with a value under ``least`` characters are dropped (but consume their text)."""

    kind: str
    prefix: str
    value: str
    least: int
    base: bool = False


_KEYWORD = either_case("(password|passwd|secret|token|api_?key)")
#: The base kinds in their listed order, then the kinds that the method adds. A run of hex digits is counted to 32 in the
#: automaton itself: the longest matches of 32 or more are the whole runs.
RULES = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\x2D]+", 8, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 16, True),
    Rule("hex", "", r"[0-9a-f]{32,}", 32, True),
    Rule("private_key", "", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("github", "", r"gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("slack", "", r"xox[abprs]-[A-Za-z0-9\x2D]+", 20),
    Rule("google", "", r"AIza[A-Za-z0-9_\x2D]+", 39),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_\x2D]+\.[A-Za-z0-9_\x2D]+\.[A-Za-z0-9_\x2D]+", 40),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.prefix + r.value) for r in rules]
        self.single = [Automaton([t], anywhere=False) for t in trees]
        self.prefix = [Automaton([parse(r.prefix)], anywhere=False) if r.prefix else None for r in rules]
        self.back = Automaton([mirrored(t) for t in trees], anywhere=True)
        forward = Automaton(trees, anywhere=True, first_end=True)
        self.states = len(forward.rows)
        # A state is its row of next rows; an accepting one has no rows, so that reading on from it ends the pass.
        rows: list = [None if mask else [None] * 256 for mask in forward.accepts]
        for row, to in zip(rows, forward.rows, strict=True):
            if row is not None:
                row[:] = [rows[t] for t in to]
        self.start = rows[0]

    def any_match(self, data: bytes) -> bool:
        row = self.start
        try:
            for b in data:
                row = row[b]
        except TypeError:
            return True
        return row is None

    @staticmethod
    def longest(automaton: Automaton, data: bytes, at: int) -> int:
        """The end of the longest match from ``at``; -1 if there is none."""
        rows, accepts, state, end = automaton.rows, automaton.accepts, 0, at if automaton.accepts[0] else -1
        for i in range(at, len(data)):
            state = rows[state][data[i]]
            if state < 0:
                break
            if accepts[state]:
                end = i + 1
        return end

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of every kept match, in bytes, by start then rule."""
        if not self.any_match(data):
            return []
        starts: list[list[int]] = [[] for _ in self.rules]
        rows, accepts, state = self.back.rows, self.back.accepts, 0
        for i in range(len(data) - 1, -1, -1):
            state = rows[state][data[i]]
            mask = accepts[state]
            while mask:
                k = (mask & -mask).bit_length() - 1
                starts[k].append(i)
                mask &= mask - 1
        found = []
        for k, rule in enumerate(self.rules):
            done = 0
            for at in reversed(starts[k]):
                if at < done:
                    continue
                done = self.longest(self.single[k], data, at)
                value = at if self.prefix[k] is None else self.longest(self.prefix[k], data[at:done], 0) + at
                if done - value >= rule.least:
                    found.append((at, k, done))
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, start, end) in code points, end exclusive, by start then rule."""
        data = text.encode()
        found = self.byte_spans(data)
        if not found or len(data) == len(text):
            return [(k, a, b) for a, k, b in found]
        at, points, place = 0, 0, {}
        for x in sorted({p for a, _, b in found for p in (a, b)}):
            points += len(data[at:x].decode())
            at, place[x] = x, points
        return [(k, place[a], place[b]) for a, k, b in found]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    """The worker's scanner for the rules: compiled once in each Python worker."""
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redacted: bool = False, spans_col: str = "spans") -> DataFrame:
    """One row per input row: the id, ``spans_col`` (structs kind, start, end in code points, by start then listed kind).

    ``keep`` names further columns to carry; with ``redacted`` the text follows too, each maximal run of spans replaced by
    its first kind in angle brackets. A null or empty text has no spans; a null one stays null. Repeated rows get a row
    each; an empty table gives none. Texts are read whole, however long. Spans that begin together come in the rules' order. Columns
    that ``keep`` doesn't name are dropped; where it names one called ``spans_col``, give that another name.
    """

    def run(texts: list) -> list[list[tuple[str, int, int]]]:
        scan = scanner_of(rules).spans
        return [[(rules[k].kind, a, b) for k, a, b in scan(t)] if t else [] for t in texts]

    ship(docs.sparkSession)
    carried = [c for c in keep if c not in (id_col, text_col)]
    given = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), *(docs[c].alias(f"_keep_{i}") for i, c in enumerate(carried)))
    spans_field = T.StructField("_spans", T._parse_datatype_string(SPANS))
    schema = T.StructType([*given.schema.fields, spans_field])
    schema = schema if redacted else T.StructType([f for f in schema.fields if f.name != "_text"])

    def batches(source):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in source:
            texts = batch.column(1).to_pylist()
            found = run(texts)
            columns = [batch.column(i) for i in range(batch.num_columns) if redacted or i != 1]
            if redacted:
                columns[1] = pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], out.field("_spans").type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    done = given.mapInArrow(batches, schema)
    return done.select(F.col("_id").alias(id_col), *([F.col("_text").alias(text_col)] if redacted else []), *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(carried)), F.col("_spans").alias(spans_col))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    runs: list[list] = []
    for kind, a, b in spans:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([kind, a, b])
    parts, at = [], 0
    for kind, a, b in runs:
        parts += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*parts, text[at:]])


def op2(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(C.table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [r.kind for r in RULES if r.base]
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _sql_kind(k: int, rule: Rule) -> str:
    pattern = (rule.prefix + "(" + rule.value + ")").replace("'", "''")
    return rf"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS s, unnest(m) AS m
    FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t))
  WHERE length(regexp_extract(m, '{pattern}', {2 if rule.prefix else 1})) >= {rule.least}"""


OP2_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), kept AS ("
    + " UNION ALL ".join(_sql_kind(k, r) for k, r in enumerate(RULES))
    + """)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id GROUP BY t.doc_id"""
)
