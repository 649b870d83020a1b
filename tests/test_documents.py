"""Document assembly on a few rows."""

from lexmill.operators import documents as D


def test_merge_and_convert(spark, tmp_path):
    items = spark.createDataFrame([("p", "a/x.md", " one<!-- image -->\n", "succeeded"), ("p", "a/w.md", None, "succeeded"), ("p", "z", "gone", "failed"), ("q", "z", "gone", "failed")], "project string, path string, text string, status string")
    got = [(r.project, r.markdown, r.n_items) for r in D.merged_markdown(items, names=True, status="status").collect()]
    assert got == [("p", "# p\n\n# ---- w.md ----\n\n\n\n# ---- x.md ----\n\none\n", 2)]

    files = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"\xff")), ("c", None)], "path string, content binary")
    rows = {r.path: (r.text, r.error) for r in D.converted(files, lambda n, c: c.decode()).collect()}
    assert rows == {"a": ("ok", None), "b": ("<!-- conversion failed -->", "UnicodeDecodeError"), "c": ("<!-- conversion failed -->", "AttributeError")}
    D.write_log(files.selectExpr("path AS item_id", "'e' AS event", "1 AS secret"), str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == [f'{{"event":"e","item_id":"{n}"}}' for n in "abc"]
    assert D.config_hash({"b": 1, "a": "类"}) == D.config_hash({"a": "类", "b": 1})
