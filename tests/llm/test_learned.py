import zlib

import numpy as np
from pyspark.sql import functions as F

from veridoc.llm import additive, langid, quality

DATA = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_on_held_out_documents(spark):
    out = {r.doc_id: r for r in quality.op7_quality_cnn(spark, DATA).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in out.items())
    test = [(out[d].predicted, q) for d, q in labels if held(d)]
    assert np.mean([p == q for p, q in test]) >= 0.93


def test_quality_of_odd_texts(spark, tmp_path):
    rows = [(i, "plain words here. " * 5 if i % 2 else "$$$ !!! $$$ " * 9) for i in range(40)] + [(100, None), (101, ""), (102, "a"), (None, "plain words here. "), (103, "plain words. " * 200_000), (3, "plain words here. ")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("score", "quality", "bytes")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, 0), (None, 1, 0), (2, None, 0), (7, 5, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.op7_quality_cnn(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.score is not None for r in out)
    score = {r.doc_id: r.score for r in out}
    assert score[39] > 0.7 > 0.3 > score[38] and score[100] == score[101]


def test_quality_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.op7_quality_cnn(spark, str(tmp_path)).collect() == []


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 991, 992, 993, 5000):
        text = bytes(np.random.default_rng(n).integers(1, 256, n).astype(np.uint8))
        rows = quality.chunks_of(text)
        back = b"".join(r[: quality.STEP].tobytes() for r in rows[:-1]) + rows[-1].tobytes()
        assert back.rstrip(b"\0") == text and len(rows) >= 1


def test_languages_of_held_out_documents(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    out = langid.op10_kernel_langid(spark, DATA).collect()
    assert np.mean([r.lang_pred == true[r.doc_id] for r in out if r.held_out]) >= 0.98


def test_language_of_odd_texts(spark, tmp_path):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "der hund und die katze " * 3, "en" if i % 2 else "de") for i in range(40)] + [(100, None, "en"), (101, "", None), (102, "12 ²³ !!", "de"), (103, "ß", None), (None, "the dog", "en"), (104, "the dog " * 200_000, None), (3, "the cat", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op10_kernel_langid(spark, str(tmp_path)).collect()}
    assert [got[i].lang_pred for i in (38, 39, 100, 101, 102, 104)] == ["de", "en", "und", "und", "und", "en"] and got[103].lang_pred in ("de", "en")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert langid.op10_kernel_langid(spark, f"{tmp_path}/none").collect() == []


def test_network_equals_plain_convolution():
    """Largest responses, means and the logistic unit by plain loops over windows and bytes."""
    rng = np.random.default_rng(1)
    m = quality.constant(0.5)
    m.filters = rng.normal(0, 0.3, m.filters.shape).astype(np.float32)
    m.filters[:, 0] = -100
    m.bias, m.weights, m.offset = rng.normal(0, 0.1, quality.FILTERS), rng.normal(0, 0.5, 2 * quality.FILTERS), 0.2
    texts = [b"", b"abc", b"abcdefgh", bytes(rng.integers(1, 256, 700).astype(np.uint8)), bytes(rng.integers(1, 256, 1500).astype(np.uint8))]
    for text, got in zip(texts, m.scores(texts), strict=True):
        cuts = range(0, max(1, len(text) - (quality.CHUNK - quality.STEP)), quality.STEP)
        best = []
        for a in cuts:
            piece = text[a : a + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            best.append([max(0.0, max(sum(float(m.filters[w, piece[p + w], f]) for w in range(quality.WIDTH)) for p in range(quality.CHUNK - quality.WIDTH + 1)) + m.bias[f]) for f in range(quality.FILTERS)])
        features = np.concatenate([np.max(best, axis=0), np.mean(best, axis=0)])
        assert abs(got - 1 / (1 + np.exp(-(features @ m.weights + m.offset)))) < 1e-4


def test_kernel_and_ridge_equal_a_dense_calculation(monkeypatch):
    """With all texts as landmarks, Nystroem ridge regression is ridge regression in the span of the kernel's columns."""
    rng = np.random.default_rng(2)
    words = {n: ["".join(rng.choice(list(a), 4)) for _ in range(30)] for n, a in (("x", "abcdefg"), ("y", "defghij"), ("z", "ghijklm"))}
    texts = [(" ".join(rng.choice(words[n], 12)), n) for n in "xyz" for _ in range(15)]
    texts.sort(key=lambda t: t[1])
    m = langid.fit([t for t, _ in texts], [n for _, n in texts])

    def sets(t):
        b = langid.prepared(t)
        return {(n, b[i : i + n]) for n in langid.ORDERS for i in range(len(b) - n + 1)}

    held = [sets(t) for t, _ in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    k = np.array([[kernel(a, b) for b in held] for a in held])
    y = np.array([[1.0 if n == w else -1.0 for w in "xyz"] for _, n in texts])
    alpha = np.linalg.solve(k + langid.RIDGE * len(texts) * np.eye(len(texts)), y)
    new = [" ".join(rng.choice(words[n], 9)) for n in "xyzxyz"] + ["qqq zzz", "ab"]
    f = np.array([[kernel(sets(t), h) for h in held] for t in new]) @ alpha
    got = m.kernel(new).astype(float) @ m.weights
    assert np.abs(got - f).max() < 1e-3
    lang, score = m.predict(new)
    assert lang == ["xyz"[i] for i in f.argmax(axis=1)] and np.abs(score - (np.clip(f.max(axis=1), -1, 1) + 1) / 2).max() < 1e-3


def test_scores_are_double_and_lengths_apart(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.7]), (2, [1e200, 1e-200]), (3, [0.5]), (20, [2.0]), (40, [1.0, 2.0, 3.0]), (4, [1e308, 1e308])]
    df = additive.usable(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v")
    got = {}
    for r in additive.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == {0: [(1, 4, 0.1 * 1e308 + 0.2 * 1e308), (2, 2, 0.1 * 1e200 + 0.2 * 1e-200), (3, 1, 0.1 * 0.3 + 0.2 * 0.7)], 20: [(1, 3, 1.0)]}


def nearest(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    good = list({(i, v.tobytes()): (i, v) for i, v in good}.values())
    out = {}
    for q, x in good:
        if q % 20 == 0:
            out[q] = sorted((-float((x * v).sum()), i) for i, v in good if i != q)[:k]
    return out


def test_neighbours_by_recall_and_ties(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)]) for i in range(900)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, [float("inf")] * 24), (None, rows[1][1]), (5, rows[5][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("ids", "rank", "v")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in additive.op6_additive_ann(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    true = nearest(rows)
    assert set(got) == set(true)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & {i for _, i in true[q]})
    assert hits / (20 * len(got)) >= 0.95
    assert [f[1] for f in got[40]] == list(range(1000, 1020))


def test_few_vectors(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(0, [1.0, 2.0])]), ("two", [(0, [1.0, 2.0]), (1, [1.0, 2.0])])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in additive.op6_additive_ann(spark, f"{tmp_path}/{name}").collect()]
        assert got == ([(0, 1, 1, 5.0)] if name == "two" else [])


def test_neighbours_when_a_task_has_many_rows(spark, monkeypatch):
    """With few exact candidates the result must not fall as a task's rows grow."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20_000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<float>")
    monkeypatch.setattr(additive, "ROWS", 1000, raising=False)
    index = additive.build(rows, 21)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        out = additive.search(additive.Index(index.books, index.table.coalesce(1)), rows.filter("vec_id % 600 = 0"), 20, rerank=25).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = {i: set(np.argsort(-(v @ v[i]), kind="stable")[:21].tolist()) - {i} for i in range(0, 20_000, 600)}
    recall = sum(r.vec_id in best[r.query_id] for r in out) / (20 * len(best))
    assert recall >= 0.95
