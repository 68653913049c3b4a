import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from veridoc.llm import mixing


def slow(rows):
    """(doc_id, size, source_size, target, taken) by plain loops."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    def key(d, t):
        u = (int(hashlib.md5(f"0:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        w = max(0.05, 1 - 5.0 * sum(t.count(c) for c in mixing.SYMBOLS) / len(t)) if t else 1.0
        return -math.log(u) / w

    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(words(t) for _, t, z in rows if z == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
    out = []
    for s in sources:
        e = int(target[s] // size[s]) if size[s] else 0
        total = 0
        for d, t in sorted(((d, t) for d, t, z in rows if z == s), key=lambda x: (key(*x), words(x[1]))):
            n = words(t)
            total += n
            out.append((d, n, size[s], round(target[s], 6), n * (e + (n > 0 and e < 2 and total - n / 2 <= target[s] - e * size[s]))))
    return sorted(out, key=str)


ROWS = [(i, "w " * (i % 23) + "$" * (i % 4), ["b", "a", "é", None, "b", "b"][i % 6]) for i in range(240)]
ROWS += [(1000, None, "z"), (1001, "", "a"), (5, ROWS[5][1], ROWS[5][2]), (5, ROWS[5][1], ROWS[5][2]), (None, "one two", "a"), (1002, "long " * 5000, "q")]


EQUAL = [(3, "one two three", "a")] * 20 + [(None, "x y", "b")] * 31 + [(4, "other words " * 40, "c")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:7], [(1, None, None)], [], EQUAL])
def test_query_equals_plain_loops(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(9) for c in ("size", "target", "range")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op8_source_mix(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == slow(rows)


def test_mixed_rows_are_copies_of_the_input(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = out.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words == sum(r[4] for r in slow(ROWS))


@pytest.mark.parametrize("rows", [EQUAL, [], [(1, None, None)], [(7, "a b", "s"), (7, "c d", "s"), (7, "e f", "s"), (8, "g " * 9, "t")]])
def test_mixed_rows_where_rows_are_equal(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("order", "copies", "_vd_copy")})
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text, r.source) for r in out.collect()]
    assert sum(len((t or "").split()) for _, t, _ in got) == sum(r[4] for r in slow(rows)) and set(got) <= set(rows)
    assert sorted(map(str, got)) == sorted(str((r.doc_id, r.text, r.source)) for r in mixing.mixed_documents(df.repartition(3)).collect())
