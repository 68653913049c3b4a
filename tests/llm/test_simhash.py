import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veridoc.llm import covering, shingles, simhash
from veridoc.llm.components import connected


def slow_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(p, 42) >> i & 1 for p in parts) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(parts))


def slow_components(rows, radius=2):
    least = {i: i for i in range(len(rows))}
    fps = [slow_print(t) for _, t in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and least[j] > least[i]:
                    least[j], changed = least[i], True
    group = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            group[least[i]] = min(d, group.get(least[i], d))
    return sorted((str(d), f"{fp:016x}", group.get(least[i])) for i, ((d, _), fp) in enumerate(zip(rows, fps)))


def run(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("fp", "label", "a", "b", "n", "component_id")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = simhash.op3_simhash(spark, str(tmp_path)).collect()
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out)


@pytest.mark.parametrize("extra", [False, True])
def test_query_equals_brute_force(spark, tmp_path, extra):
    rng = np.random.default_rng(3)
    vocab = ["alpha", "BETA", "gamma", "é", "x"]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 7)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "  \t\x0b\n"), (3, rows[3][1]), (3, rows[3][1]), (None, "alpha"), (None, "zzz only here"), (950, "word " * 20000), (951, "a b c")]
    assert run(spark, rows, tmp_path, extra) == slow_components(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    masks = [m % 2**64 for m in covering.masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        diff = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
        assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [2, 1000])
@pytest.mark.parametrize("radius", [1, 2])
def test_links_join_what_all_pairs_join(spark, radius, bucket):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 6)]
    fps = sorted({b ^ int(sum(1 << int(i) for i in rng.choice(10, rng.integers(0, 4), replace=False))) for b in base for _ in range(25)} | {-1, 0})
    got = covering.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, bucket).collect()
    mask = 2**64 - 1

    def parts(edges):
        low = {x: x for x in fps}
        for _ in fps:
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        return low

    true = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= radius]
    assert parts([(r.a, r.b) for r in got]) == parts(true)
    assert all(((r.a ^ r.b) & mask).bit_count() <= radius for r in got)


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(201))


def test_bit_counts_agree_between_the_two_ways():
    h = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    slow = sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in h) > len(h))
    assert shingles.simhash(h) % 2**64 == slow
