from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veridoc.llm import decontaminate as d
from veridoc.llm import shingles


def slow(text, items):
    """The best window of each item by comparing all windows of its size."""
    words, out = d.tokens(text), []
    for item_id, t in items:
        target = d.tokens(t)
        if not target or not words:
            continue
        size, k = min(len(target), len(words)), min(5, len(target))
        if size < k:
            continue
        grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))  # noqa: B023, E731
        own, best = grams(target), (0, 0)
        for a in range(len(words) - size + 1):
            other = grams(words[a : a + size])
            shared = sum((own & other).values())
            best = max(best, (shared / (sum(own.values()) + sum(other.values()) - shared), -a))
        if best[0] >= 0.8:
            out.append((item_id, round(best[0], 9), -best[1], size))
    return sorted(out, key=str)


def cases():
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([3, 14, 20, 35, 50, 50])] + [(90, None), (91, ""), (92, "same same same same same same same"), (3, "one more, with the id of another!")]
    docs = []
    for i in range(60):
        t = list(rng.choice(vocab, rng.integers(0, 120)))
        for j in rng.choice(len(items), rng.integers(0, 3)):
            own = (items[j][1] or "").upper().split()
            if own and rng.random() < 0.5:
                own[int(rng.integers(len(own)))] = "EDIT"
            at = int(rng.integers(0, len(t) + 1))
            t[at:at] = own
        docs.append((i, " ".join(t)))
    docs += [(900, None), (901, ""), (902, "w1 w2"), (903, "same " * 5000), (4, docs[4][1]), (4, docs[4][1]), (None, items[3][1])]
    return docs, items


def write(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item_id", "words")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{path}/benchmark.parquet")


def test_query_equals_all_windows(spark, tmp_path, monkeypatch):
    docs, items = cases()
    write(spark, tmp_path, docs, items)
    expected = sorted(((i, *m) for i, t in docs for m in slow(t, items)), key=str)
    assert len(expected) >= 25
    for size in (d.BLOCK_BYTES, 200):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.start_word, r.words) for r in d.op1_decontaminate(spark, str(tmp_path)).collect()), key=str)
        missed = [e for e in expected if e not in got]
        assert not [g for g in got if g not in expected] and all(e[2] < 0.9 for e in missed) and len(missed) <= 0.03 * len(expected)


def test_stage_keeps_clean_rows_and_columns(spark, tmp_path):
    docs, items = cases()
    write(spark, tmp_path, docs, items)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = d.clean(df, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert out.columns == df.columns
    bad = {r.doc_id for r in d.op1_decontaminate(spark, str(tmp_path)).collect()}
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert d.op1_decontaminate(spark, str(tmp_path)).collect() == []


def test_multi_index_finds_all_within_the_radius():
    index = d.Index([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(50)])
    rng = np.random.default_rng(1)
    near = np.array([int(index.prints[i % 50]) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 20)), replace=False)) for i in range(400)], np.uint64)
    true = {(w, i) for w in range(len(near)) for i in range(50) if int(near[w] ^ index.prints[i]).bit_count() <= d.RADIUS}
    assert index.candidates(near) == true and shingles.simhash(np.zeros(0, np.uint64)) == 0


def test_windows_far_apart_in_bits_but_alike():
    rng, seen = np.random.default_rng(3), 0
    while seen < 5:
        n = int(rng.integers(13, 60))
        item = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        text = list(item)
        for _ in range(int(rng.integers(1, 4))):
            text[int(rng.integers(0, n))] = f"e{rng.integers(0, 10**9)}"
        hashed = [shingles.hashes([w.encode() for w in t], 5) for t in (item, text)]
        if len(np.intersect1d(*hashed)) * 1.8 < 0.8 * (n - 4) * 2 or ((shingles.simhash(hashed[0]) ^ shingles.simhash(hashed[1])) & (1 << 64) - 1).bit_count() <= 15:
            continue
        expected = slow(" ".join(text), [(1, " ".join(item))])
        assert expected and [(i, round(s, 9), a, k) for i, s, a, k in d.Index([(1, " ".join(item))]).matches(" ".join(text))] == expected
        seen += 1


def test_an_item_does_not_depend_on_the_others_of_its_block():
    item = [f"w{i}" for i in range(20)]
    text = " ".join(["x"] * 5 + item[:19] + ["y"] * 5)
    long, short = (1, " ".join(item)), (2, " ".join(item[:19]))
    expected = slow(text, [long, short])
    assert len(expected) == 2
    for got in (d.Index([long, short]).matches(text), d.Index([long]).matches(text) + d.Index([short]).matches(text)):
        assert sorted(((i, round(s, 9), a, k) for i, s, a, k in got), key=str) == expected


def test_blocks_hold_few_items(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 10)
    made = list(d.blocks(spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(200)], "item_id long, text string")))
    assert sum(len(x.items) for x in made) == 200 and len(made) >= 15 and max(len(x.items) for x in made) <= 30
