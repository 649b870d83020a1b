"""Text files, labelled samples, vaults and the masking stream."""

from lexmill.operators import masking, recognize
from lexmill.sources import text_files, vault
from lexmill.sources.html import text_of
from lexmill.streaming.masking import mask_stream


def test_text_files(spark, tmp_path):
    (tmp_path / "B.md").write_bytes(b"\xef\xbb\xbfx\xc3\xa9")
    (tmp_path / "a.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.bin").write_bytes(b"no")
    assert [(r.ordinal, r.text) for r in text_files.read_texts(spark, f"file://{tmp_path}").orderBy("ordinal").collect()] == [(1, "café"), (2, "xé")]


def test_samples(spark, tmp_path):
    rows = [("a", "abcd", [(0, 2, "X"), (2, 4, "Y")], {"k": "v"}), ("b", "ab", [(0, 3, "X")], None), ("c", "abc", [(0, 2, "X"), (1, 3, "X")], None)]
    df = spark.createDataFrame(rows, "document_id string, text string, spans array<struct<start:int,end:int,label:string>>, metadata map<string,string>")
    text_files.write_samples(df, f"file://{tmp_path}/s")
    back = text_files.read_samples(spark, f"file://{tmp_path}/s")
    assert back.count() == 3
    assert sorted(r.document_id for r in text_files.bad_samples(back).collect()) == ["b", "c"]


def test_vault(spark):
    mapping = spark.createDataFrame([(1, "⟦邮箱1⟧", "a@b.com"), (1, "⟦邮箱2⟧", "c@d.com"), (2, "⟦电话1⟧", "138")], "doc_id long, token string, surface string")
    nonces = spark.createDataFrame([(1, bytearray(b"n" * 12)), (2, bytearray(b"m" * 12))], "doc_id long, nonce binary")
    sealed = vault.seal(mapping, "right", b"s" * 16, nonces)
    assert all(b"a@b.com" not in bytes(r.ciphertext) for r in sealed.collect())
    assert sorted(map(tuple, vault.unseal(sealed, "right").collect())) == sorted(map(tuple, mapping.collect()))
    assert {r.token for r in vault.unseal(sealed, "wrong").collect()} == {None}


def test_html():
    assert text_of("<p>a &amp; b<br>c</p><script>x</script> <div> d </div>") == "a & b\nc\nd"
    assert text_of("a<!-- <p> --> b <i title='>'>c</i> 1 < 2 &lt;p&gt;<STYLE>p {}</STYLE><h1>d</h1>") == "a b c 1 < 2 <p>d"
    assert text_of("") == text_of("<script>never closed <p>") == ""


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.com"), (2, "none")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    mask_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state", recognize.rules_named("email")).awaitTermination(120)
    masked = spark.read.parquet(f"{tmp_path}/out/masked")
    assert {r.doc_id: r.masked for r in masked.collect()} == {1: "mail ⟦邮箱1⟧", 2: "none"}
    mapping = spark.read.parquet(f"{tmp_path}/out/mapping")
    assert {r.restored for r in masking.restore(masked, mapping).collect()} == {"mail a@b.com", "none"}
