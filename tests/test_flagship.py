"""The flagship query masks by every rule of the default policy."""

import hashlib

from lexmill.plans import text_queries

#: A text, the text masked, and how many of its entities are masked.
CASES = [
    ("call 010-12345678 now", "call ⟦电话1⟧ now", 1),
    ("call 13812345678 now", "call ⟦电话1⟧ now", 1),
    ("code 91350211M000100Y43 here", "code ⟦账号1⟧ here", 1),
    ("card 6222 8312 3456 7890 here", "card ⟦账号1⟧ here", 1),
    ("mail a.b@example.com, 6222021234567890 and a.b@example.com", "mail ⟦邮箱1⟧, ⟦账号1⟧ and ⟦邮箱1⟧", 3),
    ("on 2024-03-05 it was 12", "on 2024-03-05 it was 12", 0),
    ("nothing at all", "nothing at all", 0),
]


def test_flagship_masks_by_the_whole_policy(spark, tmp_path):
    spark.createDataFrame([(i, t, "s") for i, (t, *_) in enumerate(CASES)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in text_queries.q_flagship(spark, str(tmp_path)).collect()}
    assert {i: (r.masked_sha256, r.n_masked) for i, r in got.items()} == {i: (hashlib.sha256(m.encode()).hexdigest(), n) for i, (_, m, n) in enumerate(CASES)}
    assert got[5].n_accepted == 2  # a date and a number
