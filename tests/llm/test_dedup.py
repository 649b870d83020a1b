"""Deduplication against plain Python on small tables with copies, edits and odd rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from lexmill.llm import minhash_dedup, paragraph_dedup, shingles, suffix_dedup
from lexmill.llm.components import components
from lexmill.llm.shingles import band_keys, band_keys_of, common_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_reachable(nodes, edges):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(0, i) for i in range(1000, 1060)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5)]
    df = spark.createDataFrame(edges, "x long, y long")
    edges_on = [e for e in edges if e[0] != e[1]]
    want = least_reachable({n for e in edges_on for n in e}, edges_on)
    assert {r.node: r.component for r in components(df, "x", "y").collect()} == want
    assert components(df.limit(0), "x", "y").count() == 0


def test_band_keys_agree_with_jaccard():
    rng = np.random.default_rng(1)
    for size, same in ((300, 0.8), (1000, 0.3), (5, 0.8)):
        shared, hits = 4 if size == 5 else round(2 * size * same / (1 + same)), 0
        for _ in range(200):
            pool = np.unique(rng.integers(0, 2**63, 3 * size, dtype=np.uint64))
            rng.shuffle(pool)
            x, y = np.sort(pool[:size]), np.sort(np.concatenate((pool[:shared], pool[size : 2 * size - shared if size > 5 else size])))
            hits += bool((band_keys(x, 40, 6) == band_keys(y, 40, 6)).any())
        assert hits >= 199 if same == 0.8 else hits < 30


def test_near_duplicates(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(6)]
    texts = [None, "", "  \n", "One", "one", "one TWO", "ONE two", "É a b c d", "é a b c d"]
    for _ in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 3, 6, 9, 14])):
            w[rnd.randrange(len(w))] = word()
        texts.append(" ".join(w))
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [rows[0], (rows[5][0], rows[5][1], None, None), (None, texts[10], 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, component_id int").repartition(4)
    for k in (2, 5):
        sets = {}
        for i, t in enumerate(texts):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
            sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))) if w else frozenset()
        edges = [(a, b) for a in sets for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        least = least_reachable(sets, edges)
        got = minhash_dedup.near_duplicates(df, k=k).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (len(sets[i]), least[i], i == least[i]) for i in sets}
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(least[10], False)]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def linked_groups(spark, buckets, sets):
    """Components of star_links over ``buckets`` (lists of nodes) with ``sets`` by node, at 80 %."""
    node = lambda i: (i, i)
    members = spark.createDataFrame([(b, node(i)) for b, m in enumerate(buckets) for i in m], "bucket long, node struct<a: long, b: long>")
    held = spark.createDataFrame([(node(i), sorted(s)) for i, s in sets.items()], "node struct<a: long, b: long>, set array<long>")
    edges = minhash_dedup.star_links(members, lambda wanted: held.join(wanted, "node"), 80).collect()
    return least_reachable(sets, [(e.node.a, e.hub.a) for e in edges])


@pytest.mark.parametrize(("small", "block"), [(8, 512), (1, 512), (1, 2)])
def test_found_members_still_meet_others(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    # 3 is the hub; it is linked with 1, which is linked with 2, and 2 is not linked with the hub. 4 is alone.
    sets = {3: range(100), 1: range(10, 110), 2: range(20, 120), 4: range(60, 160), **{i: range(1000 * i, 1000 * i + 100) for i in range(5, 9)}}
    sets = {i: set(s) for i, s in sets.items()}
    assert linked_groups(spark, [[1, 2, 3, 4], *([3, i] for i in range(5, 9))], sets) == {1: 1, 2: 1, 3: 1, **{i: i for i in range(4, 9)}}


def test_members_with_one_common_bucket_meet(spark):
    # 2 and 3 are linked and share one bucket alone, whose hub turns both down; 2 has found a hub elsewhere, as has 3.
    sets = {9: range(100), 2: range(200, 300), 3: range(210, 310), 7: range(190, 290), 8: range(220, 320), **{i: range(1000 * i, 1000 * i + 100) for i in range(20, 30)}}
    sets = {i: set(s) for i, s in sets.items()}
    buckets = [[9, 2, 3], [7, 2], [8, 3], *([9, i] for i in range(20, 26)), *([7, i] for i in (26, 27)), *([8, i] for i in (28, 29))]
    assert linked_groups(spark, buckets, sets) == {9: 9, 2: 2, 3: 2, 7: 2, 8: 2, **{i: i for i in range(20, 30)}}


def test_members_and_sets_are_dealt_out_once(spark, monkeypatch):
    plans, stored = {}, minhash_dedup.C.stored

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label)

    monkeypatch.setattr(minhash_dedup.C, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        texts = [" ".join(f"w{(i // 2) * 100 + j}" for j in range(60)) + f" end{i}" for i in range(20)]
        rows = [*enumerate(texts), (0, texts[0]), (50, texts[4]), (51, "alone")]
        got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted([*((i, i // 2 * 2) for i in range(20)), (0, 0), (50, 4), (51, 51)])
    assert plans["buckets"].count("hashpartitioning(bucket#") == 1
    assert "hashpartitioning(name#" not in plans["star-links"]
    assert "hashpartitioning(node#" not in plans["sets"].split("MapInArrow")[0]


def test_variants_of_one_text(spark):
    rnd = random.Random(300)
    words = [f"w{i}" for i in range(900)]
    base = [rnd.choice(words) for _ in range(200)]
    texts = []
    for _ in range(300):
        w = list(base)
        for i in rnd.sample(range(200), rnd.randint(4, 9)):
            w[i] = rnd.choice(words)
        texts.append(" ".join(w))
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(199)} for i, t in enumerate(texts)}
    edges = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_reachable(sets, edges)
    assert 1 < len(set(want.values())) < 290
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, k=2).collect()} == want


def test_truncated_copies(spark):
    # Of each text longer copies, its first 98 % and its first 79 %: the last two are linked, the last and the longest are not.
    rnd = random.Random(12)
    texts = []
    for _ in range(40):
        w = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(rnd.randint(100, 300))]
        texts += [" ".join(v) for v in (w, [*w, "x1 y"], [*w, "x2 y"], [*w, "x3 y"], w[: len(w) * 98 // 100], w[: -(-len(w) * 79 // 100)])]
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, t in enumerate(texts)}
    edges = [(a, b) for a in sets for b in range(a // 6 * 6, a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, k=2).collect()} == least_reachable(sets, edges)


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(30)]
    got = dict(common_counts(np.concatenate(sets), np.array([len(x) for x in sets]), columns=7))
    assert all(got[i].tolist() == [len(np.intersect1d(sets[i], y)) for y in sets] for i in range(30))


def removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("part", [1 << 20, 300])
def test_copied_bytes(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rnd = random.Random(part)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(900)) for _ in range(3)]

    def edited():
        t = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(t))
            t = t[:i] + rnd.choice(["x", "", "yy"]) + t[i + rnd.randint(0, 2) :]
        return t[rnd.randint(0, 300) : rnd.randint(500, 900)]

    odd = [None, "", "a" * 199, "a" * 200, "b" * 201, "b" * 700, "ab" * 300, "abc" * 90 + "x" + "abc" * 90, "q" + "a" * 200, "é" * 100, "é" * 101 + "z"]
    texts = odd + [edited() for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(12, texts[12], 1), (None, texts[13], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ranges int").repartition(5)
    want = sorted(((r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], 200), strict=True)), key=repr)
    got = suffix_dedup.remove_copied(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_copied(df.limit(0)).count() == 0


@pytest.mark.parametrize("step", ["suffixes", "records", "windows", "result"])
def test_copied_bytes_holds_few_rows(spark, monkeypatch, step):
    """What a worker makes of a batch at once doesn't grow with the batch."""
    rnd, size = random.Random(3), 1500
    texts = ["".join(rnd.choices("abcd ", k=2000)) for _ in range(size)]
    t = spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)], "_id long, _text string, _key long")
    taken = []
    with monkeypatch.context() as m:
        m.setattr(type(t), "mapInArrow", lambda df, run, schema: taken.append((df, run)) or spark.createDataFrame([], schema))
        if step == "suffixes":
            suffix_dedup._suffixes(t, 200)
        elif step == "records":
            at = [(i, i, j, j, 20 * j, 20 * j, 20 * j + 50, True) for i in range(size) for j in range(60)]
            suffix_dedup._records(t, spark.createDataFrame(at, "_id long, _key long, lead long, h long, p int, lo int, hi int, fine boolean"), 200)
        elif step == "windows":
            reach = [(i, i, 1, 100, 0, 168, x[100:368].encode(), x[:100][::-1].encode(), [0, 5]) for i, x in enumerate(texts)]
            suffix_dedup._window_hashes(spark.createDataFrame(reach, "_id long, _key long, h long, p int, lo int, hi int, fwd binary, back binary, asked array<int>"), 200)
        else:
            ranges = spark.createDataFrame([(i, i, [(20 * j, 20 * j + 10) for j in range(100)]) for i in range(size)], "_id long, _key long, ranges array<struct<s:int,e:int>>")
            m.setattr(suffix_dedup, "copied_ranges", lambda *_: ranges)
            monkeypatch.setattr(suffix_dedup.C, "rows", lambda *_, **__: t)
            suffix_dedup.remove_copied(t)
    df, run = taken[0]
    whole = df.toArrow().combine_chunks().to_batches()
    assert [b.num_rows for b in whole] == [size]
    list(run([whole[0].slice(0, 1)]))  # imports
    few, peak = [], []
    for n in (100, size):
        tracemalloc.start()
        made = 0
        for out in run([whole[0].slice(0, n)]):
            made += out.num_rows
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        few.append(made)
    assert few[1] > 10 * few[0]
    assert peak[1] < 2 * peak[0]


def test_bands_of_many_sets_agree():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)) for _ in range(50)]
    got = band_keys_of(np.concatenate(sets), np.array([len(x) for x in sets]), 9, 2)
    assert all((got[i] == band_keys(x, 9, 2)).all() for i, x in enumerate(sets))


def test_words_of_long_texts(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["Ab", "é", "x" * 30, " ", "\n", "\xa0"]) for _ in range(400)).encode()
    whole = shingles.words_in(text)
    assert [text[a:b] for a, b in zip(whole[1], whole[2], strict=True)] == re.findall(rb"[^\x20\x09-\x0D]+", text)
    assert len(set(whole[0].tolist())) == len(set(re.findall(rb"[^\x20\x09-\x0D]+", text.lower())))
    monkeypatch.setattr(shingles, "PART", 50)
    assert all((x == y).all() for x, y in zip(whole, shingles.words_in(text), strict=True))
    monkeypatch.setattr(shingles, "LONGEST", 20)
    in_parts = shingles.words_in(text)
    monkeypatch.setattr(shingles, "PART", 1 << 20)
    assert all((x == y).all() for x, y in zip(in_parts, shingles.words_in(text), strict=True))


def test_what_paragraphs_are():
    line = np.array([0] * 25 + [1] * 12 + [2] * 12 + [4] * 12 + [5] * 7 + [6] * 30 + [7] * 5)
    assert paragraph_dedup.paragraphs(line, 20) == [(0, 25), (25, 49), (68, 98)]
    assert paragraph_dedup.paragraphs(line[:0], 20) == [] and paragraph_dedup.paragraphs(np.zeros(19, int), 20) == []


def plain_paragraphs(texts, passage):
    """Words that must go, by document: brute force over all pairs of paragraphs and all windows of ``passage`` words."""
    docs = [[(w, n) for n, line in enumerate((t or "").split("\n")) for w in re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER))] for t in texts]
    gone = [set() for _ in docs]
    units = [(i, a, b) for i, d in enumerate(docs) for a, b in paragraph_dedup.paragraphs(np.array([n for _, n in d]), 20)]
    sets = [{tuple(w for w, _ in docs[i][j : j + 5]) for j in range(a, b - 4)} for i, a, b in units]
    edges = [(x, y) for x in range(len(units)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    for x, top in least_reachable(range(len(units)), edges).items():
        if x != top:
            gone[units[x][0]] |= set(range(*units[x][1:]))
    first = {}
    for i, d in enumerate(docs):
        for j in range(len(d) - passage + 1):
            di, dj = first.setdefault(tuple(w for w, _ in d[j : j + passage]), (i, j))
            if di != i or j >= dj + passage:
                gone[i] |= set(range(j, j + passage))
    return gone


def test_paragraphs(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [line(n) for n in (51, 52, 60, 75, 120, 300)]
    long = [word() for _ in range(90)]
    edited = [*long[:40], "changed", *long[41:]]
    wrapped = "\n".join(line(11) for _ in range(8))
    texts = [f"{line(30)}\n{passages[2]}\n{line(25)}", f"{line(40)} {passages[2]} {line(40)}", line(50), " ".join(long), f"{line(30)}\n{' '.join(edited).upper()}", None, "", "short line\n" * 5, "é " * 400, wrapped, f"{line(3)}\n\n{wrapped.replace(wrapped.split()[50], 'other')}"]
    texts += ["a common line of some thirteen words that many pages of all have\n" + line(60) for _ in range(12)]
    for _ in range(40):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else line(rnd.randint(5, 60)) for _ in range(rnd.randint(1, 5))]
        texts.append(rnd.choice([" ", "\n", "\n\n"]).join(parts))
    texts += [" ".join(passages[4].split()[10:61]) + " " + line(9), line(30) + " " + " ".join(passages[4].split()[10:60]) + " " + line(30)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in paragraph_dedup.dedup_paragraphs(df).collect()}
    want = plain_paragraphs(texts, 51)
    assert sum(map(bool, want)) > 30 and want[4] and want[10] and want[8] and not want[-1]
    for i, t in enumerate(texts):
        places = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        assert {j for j, (a, b) in enumerate(places) if any(s.s <= a and b <= s.e for s in got[i].spans)} == want[i], i
    assert got[1].first_ids == [0] and got[4].first_ids == [3]
    assert paragraph_dedup.dedup_paragraphs(df.limit(0)).count() == 0
