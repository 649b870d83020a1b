"""The weak-label classifier on held-out documents."""

import math
import random

import pytest
from lexmill.llm import weak_quality


def test_em_finds_the_bad_ways():
    # Labellers vote good where they see nothing bad; an abstention tells nothing.
    patterns = [(1, 1, 1), (-1, 1, 1), (1, -1, 1), (1, -1, -1), (-1, 0, 1)]
    rates, good = weak_quality.expectation_maximisation(patterns, [900, 40, 40, 20, 1])
    assert good[0] > 0.9 and max(good[1:4]) < 0.2
    assert rates[0][-1][0] > 10 * rates[0][-1][1]


def test_em_agrees_with_a_plain_version():
    rnd = random.Random(3)
    patterns = sorted({tuple(rnd.choice((-1, 0, 1, 1)) for _ in range(4)) for _ in range(40)})
    counts = [rnd.randint(1, 500) for _ in patterns]
    m, total = 4, sum(counts)
    share = [[0.9 if -1 not in p else 0.1, *((0.9 / p.count(-1) if v == -1 else 0.0) if -1 in p else 0.1 / m for v in p)] for p in patterns]
    for _ in range(20):
        mass = [sum(c * r[k] for c, r in zip(counts, share)) for k in range(m + 1)]
        n = lambda k, j, v: 0.01 + sum(c * r[k] for p, c, r in zip(patterns, counts, share) if p[j] == v)  # noqa: B023, E731
        of = lambda k, j, v: n(k, j, v) / (n(k, j, -1) + n(k, j, 1)) if v else 1  # noqa: B023, E731
        e = [[(mass[k] + 0.01) / (total + 0.01 * (m + 1)) * math.prod(of(k, j, v) for j, v in enumerate(p)) for k in range(m + 1)] for p in patterns]
        share = [[x / sum(r) for x in r] for r in e]
    assert weak_quality.expectation_maximisation(patterns, counts, rounds=20)[1] == pytest.approx([r[0] for r in share], abs=1e-9)


def test_votes():
    names = list(weak_quality.LABELLERS)
    of = lambda text: dict(zip(names, weak_quality.votes(text), strict=True))
    plain = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}word{'.' if i % 9 == 0 else ''}" for i in range(90))
    assert set(of(plain).values()) == {1}
    assert of(plain.upper())["capitals"] == -1 and of(plain.replace(" ", "% "))["symbols"] == -1 and of(plain.replace(" ", "! "))["marks"] == -1
    assert of("same " * 5000)["repeats"] == -1 and of("same " * 50)["stutter"] == -1 and of(plain.replace(".", ""))["run_on"] == -1
    assert set(of("").values()) == set(of(" \n").values()) == {0} and of("a | b | c")["pipes"] == -1


def test_features_read_whole_tokens_and_texts():
    long = "a" * 30 + "!"
    assert weak_quality._token(long)[1] == "a!" and set(weak_quality.features(f"x {long}")) != set(weak_quality.features("x " + "a" * 30))
    assert set(weak_quality.features("y " * 30_000 + "zebra")) >= {weak_quality._slot("w:zebra")}


def test_classifier(spark):
    rnd = random.Random(2)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(common) + ("." if rnd.random() < 0.1 else "") for _ in range(n))
    rows, labels, want = [], [], {}
    for i in range(600):
        kind = rnd.choice(["good"] * 6 + ["junk", "caps", "toxic"])
        text = prose(rnd.randint(20, 120))
        if kind == "junk":
            text = " ".join(w + "%%%" for w in text.split())
        elif kind == "caps":
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == "toxic":
            w = text.split()
            for bad in ("awfulword", "nastyword"):
                w.insert(rnd.randrange(len(w)), bad)
            text = " ".join(w)
        rows.append((i, text, "x"))
        want[i] = kind == "good"
        if i % 2:
            labels.append((i, int(kind in ("good", "toxic")), int(kind == "toxic")))
    rows += [(1000, None, "x"), (1001, " ", "x"), rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    known = spark.createDataFrame([*labels, labels[0]], "doc_id long, quality int, toxic int")
    got = weak_quality.classify_quality(df, known).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id < 1000 and not r.doc_id % 2]
    assert sum(r.kept == want[r.doc_id] for r in held_out) >= 0.98 * len(held_out)
    assert not any(r.kept for r in got if r.doc_id >= 1000)
    alone = weak_quality.classify_quality(df)
    assert all(r.toxic_score == 0 for r in alone.collect())
    assert weak_quality.classify_quality(df.limit(0), known.limit(0)).count() == 0
