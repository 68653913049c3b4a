import zlib

import numpy as np
import public_tokenizers
import pytest
from test_mixing import slow
from test_similar import shingled, slow_groups
from tokenizers import Tokenizer

import corpus_pipeline
from veridoc.llm import quality


@pytest.fixture
def tables(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bdfgklmn" for b in ("ain", "orel", "este", "ulin", "ando", "ire")]
    item = " ".join(rng.choice(words, 30))
    rows = []
    for i in range(60):
        t = list(rng.choice(words, int(rng.integers(20, 90))))
        rows.append((i, " ".join(t), f"s{i % 4}" if i % 7 else None))
        if i % 5 == 0:  # a near copy and an exact one
            t[int(rng.integers(0, 3))] = "other"
            rows += [(100 + i, " ".join(t), "s1"), (200 + i, rows[-1][1], "s2")]
        if i % 11 == 0:
            rows.append((300 + i, " ".join(rng.choice(words, 20)) + " " + item + " tail words", "s3"))
    bad = [(500 + i, " ".join(rng.choice(["$$$", "###", "%%% &&&", "@@@@"], 40)), "s0") for i in range(60)]
    rows += bad + [(900, None, "s1"), (901, "", None), (0, rows[0][1], rows[0][2])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if r in bad else 1, 0) for r in rows if r[0] < 900], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, item


def test_all_stages_equal_plain_loops(spark, tables):
    path, rows, item = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scored, name = quality.scored(docs, quality.train(docs, spark.read.parquet(f"{path}/labels.parquet")))
    score = {r.text: r[name] for r in scored.collect()}
    left = [r for r in rows if score[r[1]] >= quality.THRESHOLD]
    assert 60 <= len(left) < len(rows) - 40
    groups = slow_groups([(d, t) for d, t, _ in left])
    left = [min((r for r, h in zip(left, groups, strict=True) if h == g), key=lambda r: r[0]) for g in sorted(set(groups))]
    left = [r for r in left if not shingled(item) <= shingled(r[1])]
    taken = {(d, n): w // n for d, n, _, _, w in slow(left) if n}
    left = sorted((r for r in left for _ in range(taken.get((r[0], len((r[1] or "").split())), 0))), key=lambda r: r[0])
    whole, start, expected = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0, []
    for d, t, _ in left:
        ids = np.array(whole.encode(t, add_special_tokens=False).ids + [0], "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, path).orderBy("start").collect()]
    assert got == expected and len({d for d, *_ in got}) >= 30


def test_empty_tables(spark, tmp_path):
    for name, kinds in (("documents", "doc_id long, text string, source string"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_quality_filter_keeps_columns(spark, tables):
    path, rows, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as score", "2 as bytes", "3 as _vd_score")
    kept = quality.keep_good(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert kept.columns == docs.columns and {r._vd_score for r in kept.collect()} == {3}
    assert quality.keep_good(docs.limit(0), spark.read.parquet(f"{path}/labels.parquet")).collect() == []
