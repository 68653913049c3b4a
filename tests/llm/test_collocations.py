import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridoc.llm import collocations, packed


def slow(rows, top=2000):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] = f.get((lang, tuple(w[i : i + size])), 0) + 1
    out = []
    cand = {k: a for k, a in f.items() if a >= 10 and len(k[1]) > 1}
    for lang in n:
        own = []
        for (z, p), a in cand.items():
            if z != lang or any(x == lang and len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (x, q), b in cand.items()):
                continue
            cuts = [(10**6 * a * a // (f[z, p[:k]] * f[z, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            own.append((-s, -a, " ".join(p).encode(), f[z, p[:k]], f[z, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows(seed=4, n=300):
    r = random.Random(seed)
    words = ["new", "york", "city", "Ünion", "日本", "l" * 9, "m" * 17, "k" * 32, "j" * 33, "h" * 70, "nul\x00", "nul", "a", "b"] + [f"w{i}" for i in range(60)]
    phrases = ["New York city", "york city", "a b", "a  b", "a\tb", "nul\x00 nul", "in the " + "h" * 70, "日本 ünion"]
    text = lambda: "".join((r.choice(phrases) if r.random() < 0.4 else r.choice(words)) + r.choice([" ", " ", " ", ", ", ". ", "\n", "!? ", "\x0b"]) for _ in range(r.randint(0, 30)))
    return [(text(), r.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)] + [(None, "en"), ("", "fr"), ("x y " * 12, "fr"), ("p q " * 3, "es")] + [("the same text", "it")] * 40


def write(spark, tmp_path, data):
    df = spark.createDataFrame(data, "text string, lang string").withColumns({c: F.lit(1) for c in ("doc_id", "shard", "n", "phrase", "words")})
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_equals_plain_loops_and_sql(spark, tmp_path):
    data = rows() + [("long text. and so on " * 3000, "en"), ("no end " * 4000, "es")]
    path = write(spark, tmp_path, data)
    got = sorted(tuple(r) for r in collocations.op13_son_collocations(spark, path).collect())
    assert got == slow(data) and len(got) > 30
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.OP13_SQL})").fetchall()) == got


def test_empty_table_and_few_rows(spark, tmp_path):
    assert collocations.op13_son_collocations(spark, write(spark, tmp_path, [])).count() == 0
    df = spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")
    assert collocations.collocations(df).count() == 0


def test_first_rows_of_each_language(spark):
    data = rows(9, 200)
    got = collocations.collocations(spark.createDataFrame(data, "text string, lang string"), top=3).collect()
    assert sorted(map(tuple, got)) == slow(data, 3)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    """The bitmap may let anything through; the last count decides."""
    data = rows(7, 150)
    monkeypatch.setattr(collocations, "BITS", 3)
    monkeypatch.setattr(collocations, "RANGE", 1 << 40)
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(data, "text string, lang string")).collect())) == slow(data)


@pytest.mark.parametrize("piece, held", [(4 << 20, 1 << 21), (64, 50)])
def test_mined_counts_are_complete(monkeypatch, piece, held):
    monkeypatch.setattr(packed, "SLICE", piece)
    monkeypatch.setattr(collocations, "HELD", held)
    data = [(t or "", lang or "und") for t, lang in rows(5, 120)] + [("a b, " * 100, "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([z for _, z in data]), pa.array([i % 4 for i in range(len(data))], pa.int32()), pa.array([t.encode() for t, _ in data], pa.binary())], names=["lang", "shard", "text"])
    sent = pa.Table.from_batches(collocations._mined(iter([batch.slice(i, 30) for i in range(0, len(data), 30)]), (1, 2, 3), None, 3))
    total = sum(int(np.frombuffer(r["n"], "<u4").sum()) for r in sent.to_pylist())
    sizes = [len(re.findall(r"[^ \t]+", p)) for t, _ in data for p in re.split(r"[.,;:!?\n-\r]", t)]
    assert total == sum(max(0, w - k) for w in sizes for k in range(3))


def test_equal_hashes_of_different_phrases(monkeypatch):
    """First hashes that are alike for all phrases of a few: nothing is counted for another."""
    data = [(t or "", lang or "und") for t, lang in rows(6, 90)]
    batch = pa.RecordBatch.from_arrays([pa.array([z for _, z in data]), pa.array([t.encode() for t, _ in data], pa.binary())], names=["lang", "text"])

    class All:
        value = collocations.Bitmap(np.full(1 << 10, 255, np.uint8), 13)

    def counts():
        out = {}
        for b in collocations._counted(iter([batch.slice(i, 20) for i in range(0, 90, 20)]), All):
            for r in b.to_pylist():
                k = r["lang"], r["words"], r["phrase"]
                out[k] = out.get(k, 0) + r["n"]
        return out

    plain, of = counts(), collocations.Phrases.of
    monkeypatch.setattr(collocations.Phrases, "of", lambda self, places, size, seed=0: of(self, places, size, seed) % np.uint64(5) if seed == 0 else of(self, places, size, seed))
    assert counts() == plain and len(plain) > 300
    monkeypatch.setattr(collocations, "HELD", 40)
    assert counts() == plain


def test_scores_pass_64_bits(spark):
    a, left, right = 3_000_000_000, 4_000_000_000, 9_000_000_000
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (left * right)
