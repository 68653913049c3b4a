from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.sources import imports
from veridoc.streaming import versions


def outcomes(spark, root):
    return {r.name: r.outcome for r in versions.latest(spark, f"{root}/files", "file_ord").collect()}


def test_files_that_come_over_several_starts(spark, tmp_path):
    inbox, root = tmp_path / "in", f"{tmp_path}/out"
    inbox.mkdir()
    start = lambda: imports.stream(spark, str(inbox), "s", root, f"{tmp_path}/c").awaitTermination(120)
    (inbox / "a.md").write_bytes(b"# same")
    (inbox / "bad.txt").write_bytes(b"\xff")
    start()
    (inbox / "later.txt").write_bytes(b"# same")
    (inbox / "new.txt").write_bytes(b"new")
    start()
    start()  # nothing has come
    assert outcomes(spark, root) == {"a.md": "imported", "bad.txt": "failed", "later.txt": "duplicate", "new.txt": "imported"}
    docs = versions.latest(spark, f"{root}/documents", "id").collect()
    assert sorted(r.name for r in docs) == ["a.md", "new.txt"]
    batches = {r.batch_id: (r.total, r.imported, r.duplicates, r.failed, r.status) for r in versions.latest(spark, f"{root}/batches", "batch_id").collect()}
    assert batches == {"batch-0": (2, 1, 0, 1, "partial_failed"), "batch-1": (2, 1, 1, 0, "completed")}
    assert sorted(bytes(r.content) for r in spark.read.parquet(f"{root}/raw/*").collect()) == [b"# same", b"new"]


def test_a_batch_again_and_a_restored_document(spark, tmp_path):
    root = str(tmp_path)
    row = lambda *names: spark.createDataFrame([(n, n, b"text", "s", "b") for n in names], "file_ord string, original_name string, content binary, space_id string, batch_id string")
    for _ in range(2):
        imports.run_batch(row("a.txt", "b.txt"), root, 0)
    assert outcomes(spark, root) == {"a.txt": "imported", "b.txt": "duplicate"}
    first = versions.latest(spark, f"{root}/documents", "id").first()
    imports.delete(spark, root, spark.createDataFrame([(first.id,)], "id string"), 1)
    assert versions.latest(spark, f"{root}/documents", "id").first().status == "deleted"
    for _ in range(2):
        imports.run_batch(row("c.txt", "x.pdf"), root, 2)
    assert outcomes(spark, root)["c.txt"] == "restored" and outcomes(spark, root)["x.pdf"] == "failed"
    again = versions.latest(spark, f"{root}/documents", "id").collect()
    assert [(r.id, r.status, r.name) for r in again] == [(first.id, "active", "c.txt")]
    assert versions.latest(spark, f"{root}/documents", "id").filter(F.col("content_text") == "text").count() == 1


def test_only_the_bytes_of_new_documents_meet_others(spark, tmp_path):
    """A file's text is neither read again for what earlier batches hold, nor does it go with the row that decides its fate."""
    files = [("a.txt", b"\xef\xbb\xbf  one \n two "), ("b.md", b"  one \n two "), ("c.txt", b"same"), ("d.txt", b"same"), ("e.txt", b" \n\xe3\x80\x80"), ("f.txt", b""), ("g.doc", b"x")]
    rows = spark.createDataFrame([(n, n, b, "s", "b") for n, b in files], "file_ord string, original_name string, content binary, space_id string, batch_id string")
    imports.run_batch(rows, str(tmp_path), 0)
    docs = {r.name: (r.content_text, r.excerpt) for r in versions.latest(spark, f"{tmp_path}/documents", "id").collect()}
    assert docs == {"a.txt": ("  one \n two ", "one two"), "b.md": ("  one \n two ", "one two"), "c.txt": ("same", "same")}
    assert {r.name: r.error for r in versions.latest(spark, f"{tmp_path}/files", "file_ord").collect() if r.error} == {"e.txt": "blank text", "f.txt": "empty file", "g.doc": "unsupported type"}
    before = versions.latest(spark, f"{tmp_path}/documents", "id", columns=["status"])
    assert before.columns == ["id", "status"] and "content_text" not in before._jdf.queryExecution().executedPlan().toString()


def test_excerpts_from_the_beginning_of_a_text_are_those_of_the_whole(spark):
    wide = "\u3000"
    texts = ["", " ", "a" * 160 + " ", "a" * 160 + " b", "a" * 159 + "  b", " " * 700 + "x  y " * 90, wide * 700 + "a", "a" + wide * 700, "a" + wide * 700 + "b", ("x \n\t y" + wide) * 300, "a" + " " * 900 + "b", "a" * 161 + wide * 600, wide + "a" * 161 + wide * 600 + "b", "\x85" * 700, "é " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    whole = F.substring(text.collapsed(F.col("t")), 1, 160)
    assert rows.filter(~text.excerpt(F.col("t")).eqNullSafe(whole)).count() == 0
    assert rows.filter(text.is_blank(F.col("t")) != (text.strip(F.col("t")) == "")).count() == 0
