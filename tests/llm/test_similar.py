import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.llm import simhash


def made(rng, n=400):
    """Texts of 60 words with near copies of a few edits, as (doc_id, text)."""
    vocab = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(vocab, 60)) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = list(base[i % len(base)])
        for _ in range(rng.integers(0, 3)):
            t[rng.integers(0, 60)] = str(rng.choice(vocab))
        rows.append((i, " ".join(t)))
    return rows


def shingled(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(rows):
    sets = [shingled(t) for _, t in rows]
    low = list(range(len(rows)))
    while True:
        before = list(low)
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return low


def test_keeps_the_first_of_each_group(spark):
    rows = made(np.random.default_rng(2), 240) + [(900, None), (901, ""), (3, None), (None, "only without id"), (7, "again again"), (7, "again again"), (None, "again again"), (950, "x y " * 20000)]
    rows[7] = (7, "again again")
    groups = slow_groups(rows)
    expected = []
    for g in set(groups):
        ids = [rows[i][0] for i in range(len(rows)) if groups[i] == g]
        known = [d for d in ids if d is not None]
        expected.append(min(known) if known else None)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "node", "label", "n", "first")})
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, expected))


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(2, 300):
        t = list(base)
        for _ in range(3):
            t[rng.integers(0, 200)] = f"e{i}x{rng.integers(9)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(rng.permutation(base))) for i in range(20)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == [0, *range(1000, 1020)]


def test_empty(spark):
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_pairs_in_crowded_buckets(spark):
    """Two thousand texts that share a long passage, and among them pairs and a chain of near copies unlike any hub."""
    rng = np.random.default_rng(6)
    base = [f"b184x{i}" for i in range(220)]  # its own shingles weigh most in every view, so all views are crowded
    own = lambda i, n: [f"o{i}x{j}" for j in range(n)]
    rows = [(i, " ".join(base + own(i, 80))) for i in range(2000)]
    for i in range(40):
        t = rows[i][1].split()
        for j in (230, 250, 270):
            t[j + int(rng.integers(0, 15))] = f"edit{i}"
        rows.append((5000 + i, " ".join(t)))
    t = rows[50][1].split()
    for i in range(8):
        t[222 + 9 * i] = f"drift{i}"
        rows.append((6000 + i, " ".join(t)))
    order = rng.permutation(len(rows))
    out = simhash.one_of_each(spark.createDataFrame([rows[i] for i in order], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == list(range(2000))


def test_recall_among_texts_of_one_template(spark):
    """Texts that share a 320-word template are 0.66 similar, and planted pairs among them 0.83 or more: exact links by brute force."""
    rng = np.random.default_rng(9)
    base, n = [f"t{i}" for i in range(320)], 1500
    rows = []
    for i in range(n):
        t = base + [f"o{i}x{j}" for j in range(76)]
        rows.append((2 * i, " ".join(t)))
        for _ in range(int(rng.integers(1, 7))):
            t[320 + int(rng.integers(0, 76))] = f"edit{i}"
        rows.append((2 * i + 1, " ".join(t)))
    sets = [shingled(t) for _, t in rows]
    pairs = [i for i in range(n) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])]
    assert len(pairs) == n and all(len(sets[0] & sets[j]) < 0.8 * len(sets[0] | sets[j]) for j in range(2, 2 * n))
    out = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame([rows[i] for i in rng.permutation(2 * n)], "doc_id long, text string")).collect()}
    assert out == set(range(0, 2 * n, 2))
