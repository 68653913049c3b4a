import numpy as np
import plain_segment as plain
import pytest
from pyspark.sql import functions as F

from veridoc.functions import text
from veridoc.operators import segment


def cut(body):
    return [(t, lv, p, body[a:e]) for t, lv, p, a, e in plain.split_sections(body)]


def test_preface_hierarchy_and_fence():
    body = "front\n# One\nx\n## Two ##\n```\n# hidden\n~~~\n```\n### Three\nend"
    assert [(t, lv, p) for t, lv, p, _ in cut(body)] == [(segment.PREFACE, 0, segment.PREFACE), ("One", 1, "One"), ("Two", 2, "One > Two"), ("Three", 3, "One > Two > Three")]
    assert "".join(s[3] for s in cut(body)) == body


@pytest.mark.parametrize("body, n", [(None, 0), (" \n\t", 0), ("plain", 1), ("\n\n# A", 1), ("~~~\n# A\n```\n# B", 1), ("# A\n### C\n## B", 3), (" # no heading", 1), ("#\tx\r\n# y", 2)])
def test_counts(body, n):
    assert len(cut(body)) == n


def test_levels_may_jump():
    assert [p for _, _, p, _ in cut("# A\n### C\n## B")] == ["A", "A > C", "A > B"]


def test_chunks_cover_the_text():
    rng = np.random.default_rng(0)
    for _ in range(200):
        body = "".join(rng.choice(list("ab\n"), rng.integers(0, 300)))
        most = int(rng.integers(1, 60))
        overlap = int(rng.integers(0, most))
        w = list(plain.windows(body, most, overlap))
        assert w[0][0] == 0 and w[-1][1] == len(body) and all(0 < e - a <= most or not body for a, e in w)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(w, w[1:]))


def test_sizes_are_checked():
    assert list(plain.windows("x" * 100, 100, 10)) == [(0, 100)]
    for most, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            list(plain.windows("x", most, overlap))


def texts():
    rng = np.random.default_rng(3)
    bits = ["# A", "## B ##", "### C", "###### F", "####### no", "#no", " # no", "```", "~~~", "  ```py", "text", "", " \t", "x" * 40, "# \u3000D\u3000", "#\tE\r", "# ###", "日本 é", "\u00a0", "# G\u2028h", "a\x1cb"]
    return ["\n".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(300)] + [None, "", " \n ", "\n\n# A", "plain", "# A\n", "x\n" * 900 + "# end", "front\n# One\nx\n## Two ##\n```\n# hidden\n~~~\n```\n### Three\nend"]


def test_sections_equal_plain_loops(spark):
    rows = list(enumerate(texts()))
    out = segment.sections(spark.createDataFrame(rows, "id int, content_text string"))
    assert "Python" not in out._jdf.queryExecution().toString()
    got = sorted((int(r.document_id), r.ordinal, r.section_id, r.title, r.level, r.section_path, r.content_text, r.start_offset, r.end_offset) for r in out.collect())
    assert got == [(i, n, f"section-{n}", t, lv, p, body[a:e], a, e) for i, body in rows for n, (t, lv, p, a, e) in enumerate(plain.split_sections(body), 1)]


@pytest.mark.parametrize("most, overlap", [(1500, 150), (10, 0), (10, 3), (7, 6), (1, 0), (20, 15)])
def test_chunks_equal_plain_loops(spark, monkeypatch, most, overlap):
    monkeypatch.setattr(segment, "STRETCH", 50)
    rng = np.random.default_rng(most)
    bodies = ["".join(rng.choice(list("ab\né"), rng.integers(0, 120))) for _ in range(120)] + ["x" * 200, "\n" * 90, "y\n" * 70, "", "line\n" + "z" * 99]
    df = spark.createDataFrame([(str(i), "s", "p", b, 5) for i, b in enumerate(bodies)], "document_id string, section_id string, section_path string, content_text string, start_offset int")
    got = sorted((int(r.document_id), r.ordinal, r.content_text, r.start_offset, r.end_offset) for r in segment.chunks(df, most, overlap).collect())
    assert got == [(i, n, b[a:e], a + 5, e + 5) for i, b in enumerate(bodies) for n, (a, e) in enumerate(plain.windows(b, most, overlap), 1)]


def test_a_long_text(spark):
    body = "# T\n" + "\n".join("line %d %s" % (i, "é" * (i % 50)) for i in range(20_000))
    df = spark.createDataFrame([(1, body)], "id int, content_text string")
    got = segment.chunks(segment.sections(df)).orderBy("start_offset").collect()
    assert [(r.start_offset, r.end_offset) for r in got] == list(plain.windows(body)) and all(r.content_text == body[r.start_offset : r.end_offset] for r in got)


def test_wrong_sizes(spark):
    for most, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            segment.windows(F.lit("x"), most, overlap)


def test_iso_times_are_utc_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            r = spark.range(1).select(text.iso(F.timestamp_millis(F.lit(1))).alias("t")).select("t", F.unix_millis(text.from_iso(F.col("t"))).alias("m")).first()
            assert tuple(r) == ("1970-01-01T00:00:00.001Z", 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_prompt_context(spark):
    part = spark.createDataFrame([("d", "n.md", None, "c", "p", "text\n")], "document_id string, document_name string, document_type string, chunk_id string, section_path string, content_text string")
    assert segment.prompt_context(part, "a", "b").first().context == "promptVersion: a\nschemaVersion: b\nsourceDocumentId: d\ndocumentName: n.md\ndocumentType: null\nchunkId: c\nsectionPath: p\n\n原文开始：\ntext\n\n原文结束。\n"


def test_document_sections_equal_their_sql_on_odd_texts(spark, tmp_path):
    """Headings, fences, blank and null texts: the SQL has one section for each document."""
    import duckdb

    from veridoc.plans import catalog

    texts = ["plain", "### are\nof", "a\n# b\nc\n## d", "```\n# x\n", "", " \n\t", None, "größe 😀\r\n# e"]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(catalog.SQL["document_sections"]).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["document_sections"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == len(texts)
