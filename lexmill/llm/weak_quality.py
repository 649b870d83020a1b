"""Quality classifier from weak labels.

Overlapping heuristic labellers vote bad, good or nothing on every document, and the given labels on theirs.
Expectation-maximisation over the counts of vote patterns, of which there are few, estimates each labeller's accuracy and
every pattern's posterior. Posterior labels of a bounded sample train a hashed linear scorer, which then scores every
whole text. A second scorer of the same kind learns toxicity from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.ship import ship

from . import common as C

#: Feature hashes are taken modulo this.
SLOTS = 1 << 22
WORD = re.compile(r"[^\W\d_]+")
#: Each heuristic labeller's measure is bad beyond the first bound and good within the second; between them, and on texts of
#: fewer words than the third, it votes nothing. Measures are per word but for capitals (per letter) and repeats.
LABELLERS = {
    "symbols": (0.3, 0.05, 1),
    "capitals": (0.5, 0.2, 1),
    "marks": (0.3, 0.05, 1),
    "pipes": (0.2, 0.02, 1),
    "repeats": (0.65, 0.5, 40),
    "stutter": (0.25, 0.05, 10),
    "run_on": (0.99, 0.97, 30),
}
#: Words of a block in which repeats are counted, so that texts of all lengths compare.
BLOCK = 100
#: Tokens that each Python worker keeps with their features, and the longest kept; others are worked out each time.
CACHED, LONGEST = 400_000, 40

_classes = None
_tokens: dict[str, tuple[tuple[int, ...], str]] = {}


def _class_of():
    """An array that tells of each code point: 1 small or other letter, 2 capital, 3 symbol, 4 exclamation mark, 5 pipe, 6 full stop or question mark."""
    global _classes
    if _classes is None:
        import numpy as np

        _classes = np.fromiter((2 if c.isupper() else 1 if c.isalpha() else 0 for c in map(chr, range(0x110000))), np.uint8, 0x110000)
        for chars, kind in (("#*$%&<>", 3), ("!", 4), ("|", 5), (".?", 6)):
            _classes[[ord(c) for c in chars]] = kind
    return _classes


def votes(text: str) -> list[int]:
    """Each labeller's vote on a text, in order: -1 bad, 0 none, 1 good."""
    import numpy as np

    tokens = text.split()
    n = len(tokens)
    _, small, capital, symbols, marks, pipes, stops = np.bincount(_class_of()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=7).tolist()
    blocks = [tokens[i : i + BLOCK] for i in range(0, n, BLOCK)]
    blocks = blocks[:-1] if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 2 else blocks
    repeats = 1 - sum(len(set(b)) / len(b) for b in blocks) / max(len(blocks), 1)
    stutter = sum(map(str.__eq__, tokens, tokens[1:]))
    measures = (symbols / max(n, 1), capital / max(small + capital, 1), marks / max(n, 1), pipes / max(n, 1), repeats, stutter / max(n, 1), 1 - (stops + marks) / max(n, 1))
    return [0 if n < least else -1 if x > bad else 1 if x <= good else 0 for x, (bad, good, least) in zip(measures, LABELLERS.values(), strict=True)]


def expectation_maximisation(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 200) -> tuple[list[dict[int, tuple[float, float]]], list[float]]:
    """(per labeller: vote -> (P given bad, P given good); posterior of good per pattern).

    Documents are bad in different ways, which exclude each other more than independent votes would, so the model has a
    class of good documents and one bad class for each labeller, begun with the patterns that the labeller votes bad on.
    Given the class, votes are independent, and an abstention, as of most labellers on short texts, tells nothing. A
    labeller's accuracies are over all bad classes.
    """
    import numpy as np

    p = np.array(patterns)
    m = p.shape[1]
    c = np.array(counts, float)[:, None]
    cast = np.concatenate([p == v for v in (-1, 0, 1)], axis=1).astype(float)  # patterns by votes and labellers
    bad, good = cast[:, :m], cast[:, 2 * m :]
    some = bad.any(axis=1, keepdims=True)
    share = np.concatenate((np.where(some, 0.1, 0.9), np.where(some, 0.9 * bad / np.maximum(bad.sum(axis=1, keepdims=True), 1), 0.1 / m)), axis=1)
    for _ in range(rounds):
        mass = (c * share).sum(axis=0)
        n_bad, n_good = (c * share).T @ bad + 0.01, (c * share).T @ good + 0.01
        z = np.log((mass + 0.01) / (c.sum() + 0.01 * (m + 1))) + bad @ np.log(n_bad / (n_bad + n_good)).T + good @ np.log(n_good / (n_bad + n_good)).T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        before, share = share, e / e.sum(axis=1, keepdims=True)
        if np.abs(share - before).max() < 1e-9:
            break
    good = share[:, :1]
    rates = [(c * side).T @ cast / max(float((c * side).sum()), 1e-9) for side in (1 - good, good)]
    return [{v: (float(rates[0][0, i * m + j]), float(rates[1][0, i * m + j])) for i, v in enumerate((-1, 0, 1))} for j in range(m)], good[:, 0].tolist()


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def _token(t: str) -> tuple[tuple[int, ...], str]:
    """The slots of a token's lower-cased words, and its shape: the kinds of its characters in order of appearance."""
    found = _tokens.get(t)
    if found is None:
        found = tuple(_slot(f"w:{w}") for w in WORD.findall(t.lower())), "".join(dict.fromkeys("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in t))
        if len(_tokens) < CACHED and len(t) <= LONGEST:
            _tokens[t] = found
    return found


def features(text: str) -> list[int]:
    """Distinct hashed features of a whole text: its lower-cased words, its frequent word shapes, and its repetition."""
    tokens = text.split()
    counts = Counter(tokens)
    shapes: Counter[str] = Counter()
    found: set[int] = set()
    for t, n in counts.items():
        slots, shape = _token(t)
        found.update(slots)
        shapes[shape] += n
    found |= {_slot(f"s:{s}:{round(4 * n / len(tokens))}") for s, n in shapes.items() if 8 * n >= len(tokens)}
    distinct = len(counts) / max(len(tokens), 1)
    same = sum(map(str.__eq__, tokens, tokens[1:])) / max(len(tokens), 1)
    return [*found, *map(_slot, (f"r:{round(same * 8)}", f"n:{min(len(tokens).bit_length(), 5)}", f"d:{round(distinct * 5)}:{min(len(tokens).bit_length() // 3, 4)}"))]


def train(rows: list[tuple[list[int], float]], least: int = 4, rounds: int = 300, sparse: float = 1e-3) -> tuple[float, dict[int, float]]:
    """(bias, weight by feature) of a logistic scorer for posterior labels; features in under ``least`` rows have none.

    Classes weigh alike. Accelerated proximal gradient steps with an L1 penalty, which leaves the weights of words that tell
    nothing at 0; full batches, so it is the same wherever it runs.
    """
    import numpy as np

    if not rows:
        return 0.0, {}
    n = len(rows)
    at = np.repeat(np.arange(n), [len(f) for f, _ in rows])
    slots, column, seen = np.unique(np.fromiter((x for f, _ in rows for x in f), np.int64), return_inverse=True, return_counts=True)
    keep = seen[column] >= least
    at, column = at[keep], column[keep]
    y = np.array([p for _, p in rows])
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-9), 0.5 / max((y < 0.5).mean(), 1e-9)) / n
    v = np.ones(len(slots))
    for _ in range(12):  # the greatest curvature, by power iteration
        u = np.bincount(column, (weight * np.bincount(at, v[column], n))[at], len(slots))
        norm = max(float(np.linalg.norm(u)), 1e-12)
        v = u / norm
    rate = 1 / (0.3 * norm + 0.5)
    w = z = np.zeros(len(slots))
    bias = bias_z = 0.0
    t = 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(np.bincount(at, z[column], n) + bias_z, -50, 50))) - y) * weight
        moved = z - rate * np.bincount(column, error[at], len(slots))
        w, before = np.sign(moved) * np.maximum(np.abs(moved) - rate * sparse, 0), w
        bias, bias_before = bias_z - rate * error.sum(), bias
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z, bias_z = w + (last - 1) / t * (w - before), bias + (last - 1) / t * (bias - bias_before)
    kept = np.flatnonzero((seen >= least) & (w != 0))
    return float(bias), dict(zip(slots[kept].tolist(), w[kept].tolist(), strict=True))


def _features_of(t: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["_y", "_f"])

    return t.select("_y", "_text").mapInArrow(run, "_y double, _f array<int>")


def _sample(labelled: DataFrame, t: DataFrame, most: int) -> list[tuple[list[int], float]]:
    """Features and labels of ``most`` rows of each class at most, the first by hash; ``labelled`` has _id, _key, _y."""
    order = F.xxhash64("_key", "_id", F.lit(17))
    picked = None
    for side in (F.col("_y") >= 0.5, F.col("_y") < 0.5):
        part = labelled.where(side).orderBy(order, "_key").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = C.stored(picked, "sample").select(F.col("_id").alias("_sid"), F.col("_key").alias("_skey"), "_y")
    rows = t.join(F.broadcast(picked), t["_id"].eqNullSafe(picked["_sid"]) & (t["_key"] == picked["_skey"]))  # 2 * most rows
    return sorted((sorted(r["_f"]), r["_y"]) for r in _features_of(rows.select("_y", "_text")).collect())


def classify_quality(docs: DataFrame, labels: DataFrame | None = None, *, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, weak_good (posterior of the votes), quality_score, toxic_score, kept.

    ``labels`` (id, quality, toxic) is one more labeller, which votes on its rows alone, and what toxicity is learned
    from; without it toxic_score is 0. ``sample`` bounds the training rows of each class of each scorer; votes, accuracies
    and scores cover all rows and whole texts. kept: quality_score >= 0.5 and toxic_score < 0.5. Null, empty and blank texts
    have no words and are not kept. Repeated rows get a row each; of repeated label rows the greatest counts; a null label id
    labels nothing. Rows of the sample that tie by hash fall in by content key. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    t = C.rows(docs, id_col=id_col, text_col=text_col)
    id_type = t.schema["_id"].dataType.simpleString()
    names = [f"v_{name}" for name in LABELLERS]

    def vote(batches):
        import pyarrow as pa

        for batch in batches:
            cast = list(zip(*map(votes, batch.column(2).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int32()) for v in cast)], names=["_id", "_key", *names])

    voted = t.select("_id", "_key", "_text").mapInArrow(vote, f"_id {id_type}, _key bigint, " + ", ".join(f"{c} int" for c in names))
    if labels is None:
        voted = voted.withColumns({"v_human": F.lit(0), "_toxic": F.lit(None).cast("int")})
    else:
        held = labels.groupBy(labels[id_col].alias("_lid")).agg(F.max("quality").alias("_quality"), F.max("toxic").cast("int").alias("_toxic"))
        voted = voted.join(held, voted["_id"] == held["_lid"], "left").withColumn("v_human", F.when(F.col("_quality") == 1, 1).when(F.col("_quality") == 0, -1).otherwise(0)).drop("_lid", "_quality")
    names = [*names, "v_human"]
    voted = C.stored(voted, "votes")
    counted = voted.groupBy(*names).count().collect()  # 3 ** 8 patterns at most
    patterns = [tuple(r[c] for c in names) for r in counted]
    posterior = expectation_maximisation(patterns, [r["count"] for r in counted])[1] if patterns else []
    schema = ", ".join(f"{c} int" for c in names) + ", weak_good double"
    table = spark.createDataFrame([(*p, q) for p, q in zip(patterns, posterior, strict=True)], schema)
    judged = voted.join(F.broadcast(table), names).select("_id", "_key", "weak_good", "_toxic")

    sure = judged.where((F.col("weak_good") > 0.9) | (F.col("weak_good") < 0.1))
    quality = train(_sample(sure.select("_id", "_key", F.col("weak_good").alias("_y")), t, sample))
    toxic = train(_sample(judged.where("_toxic IS NOT NULL").select("_id", "_key", F.col("_toxic").cast("double").alias("_y")), t, sample)) if labels is not None else None

    def score(batches):
        import numpy as np
        import pyarrow as pa

        models = []
        for model in (quality, toxic):
            weight = np.zeros(SLOTS)
            if model is not None:
                weight[list(model[1])] = list(model[1].values())
            models.append((model, weight))

        def of(model, weight, found):
            return 0.0 if model is None else 1 / (1 + math.exp(-max(min(model[0] + math.fsum(weight[found]), 50), -50)))

        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [features(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([of(*m, f) for f in found], pa.float64()) for m in models), pa.array([bool(x.strip()) for x in texts], pa.bool_())], names=["_id", "_key", "quality_score", "toxic_score", "_worded"])

    scored = t.select("_id", "_key", "_text").mapInArrow(score, f"_id {id_type}, _key bigint, quality_score double, toxic_score double, _worded boolean")
    one = judged.groupBy(F.col("_id").alias("_jid"), F.col("_key").alias("_jkey")).agg(F.max("weak_good").alias("weak_good"))
    done = scored.join(one, scored["_id"].eqNullSafe(one["_jid"]) & (scored["_key"] == one["_jkey"]))
    kept = (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5) & F.col("_worded")
    return done.select(F.col("_id").alias(id_col), F.round("weak_good", 6).alias("weak_good"), F.round("quality_score", 6).alias("quality_score"), F.round("toxic_score", 6).alias("toxic_score"), kept.alias("kept"))


def op1(spark, sf_dir: str) -> DataFrame:
    return classify_quality(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
