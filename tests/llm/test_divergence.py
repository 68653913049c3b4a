import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from veridoc.llm import divergence, packed


def slow(rows):
    """All rows by plain loops over whole numbers."""
    docs = [(t or "", lang or "", s or "") for t, lang, s in rows]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = set()
    for lang in {d[1] for d in docs}:
        count, seen = {}, {}
        for t, z, s in docs:
            if z == lang:
                own = count.setdefault(s, {})
                words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold))
                for w in words:
                    own[w] = own.get(w, 0) + 1
                for w in set(words):
                    seen[w] = seen.get(w, 0) + 1
        kept = [w for w, n in seen.items() if n >= 3]
        v = len(kept)
        size = {s: sum(c.get(w, 0) for w in kept) for s, c in count.items()}
        p = {s: {w: 1 + 10**9 * (c.get(w, 0) + 1) // (size[s] + v) for w in kept} for s, c in count.items()}
        q = {w: 1 + 10**9 * (sum(c.get(w, 0) for c in count.values()) + 1) // (sum(size.values()) + v) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in count.items():
            parts = {"pair": [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in count if o != s],
                     "term": [(f(p[s][w], q[w]), w) for w in kept if c.get(w, 0) and p[s][w] > q[w]]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, x, k) for k, (x, i) in enumerate(ranked[: None if part == "pair" else 200], 1)}
    return out


def rows(seed=3, n=150):
    r = random.Random(seed)
    words = ["a", "B", "eight888", "nine_nine", "exactlyeight", "sixteenletterszz", "seventeenletterss", "ünïcödé", "日本語", "𝔘𝔫𝔦", "x" * 31, "x" * 32, "x" * 33, "y" * 64, "y" * 65, "Z" * 300, "\x00nul", "tab\tbed", "1a2b"]
    words += [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    out = [(" ".join(r.choice(words if r.random() < 0.5 else words[:40]) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "ß", None])) for _ in range(n)]
    return out + [(None, "en", "only null"), ("", "fr", "a"), ("one two", "fr", "b"), (None, None, None), ("same text here", "en", "s1")] + [("same text here", "en", "s2")] * 5


def write(spark, tmp_path, data):
    df = spark.createDataFrame(data, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("doc_id", "bucket", "term", "n", "size")})
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_equals_plain_loops_and_sql(spark, tmp_path):
    data = rows() + [(" ".join(["long", "text", "w" * 200] * 400), "en", "s1"), ("Q" * 5000 + " a", "de", "s1"), ("Q" * 5000, "de", "s1"), ("q" * 5000, "de", "s2")]
    path = write(spark, tmp_path, data)
    got = divergence.op12_source_divergence(spark, path).select("lang", "source", "part", "rank", "item", "value").collect()
    assert len(got) == len(set(got)) and {(r[0], r[1], r[2], r[4], r[5], r[3]) for r in got} == slow(data)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{path}/documents.parquet/*.parquet'")
    sql = duckdb.sql(f"SELECT lang, source, part, rank, item, value FROM ({divergence.OP12_SQL})").fetchall()
    assert set(sql) == {tuple(r) for r in got} and len(sql) == len(got)


def test_small_pieces_and_early_sending_change_nothing(monkeypatch):
    data = rows() + [("one long row " * 300 + "w" * 700, "en", "s1"), ("", "en", "s1"), ("long " * 40, "de", "s2")]
    columns = [[x or "" for x in c] for c in zip(*data, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in columns[0]], pa.binary()), *(pa.array(c) for c in columns[1:])], names=["text", "lang", "source"])

    def kept():
        sent = pa.Table.from_batches(divergence._counted(iter([batch.slice(i, 50) for i in range(0, len(data), 50)]), 7))
        cells = {(r["lang"], r["bucket"]) for r in sent.select(["lang", "bucket"]).to_pylist()}
        of = lambda k: sent.filter((pc.field("lang") == k[0]) & (pc.field("bucket") == k[1]))
        return sorted(tuple(r.values()) for k in cells for r in divergence._kept(of(k)).to_pylist())

    whole = kept()
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(packed, "SLICE", 64)
    small = kept()
    strip = lambda rows: sorted(r[:-1] for r in rows)
    assert len(whole) > 100 and strip(small) == strip(whole)


def test_empty_table(spark, tmp_path):
    assert divergence.op12_source_divergence(spark, write(spark, tmp_path, [])).count() == 0


def test_radix_order_and_words():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**64, 5000, np.uint64), r.integers(0, 3, 5000, np.uint64)
    assert (packed.radix_order([b, a]) == np.lexsort([a, b])).all()
    data = np.frombuffer(b"abcdefghi\xff z", np.uint8)
    one, two = packed.words(data, np.array([0, 9, 11]), np.array([9, 1, 1]), 2)
    assert [x.tobytes() for x in np.stack([one, two], 1).astype(">u8")] == [b"abcdefghi" + bytes(7), b"\xff" + bytes(15), b"z" + bytes(15)]


def test_shares_are_exact():
    r = random.Random(0)
    pairs = [(n, t) for t in (1, 7, 10**9, 9 * 10**15) for n in {0, 1, t // 3, t - 1, t, r.randint(0, t)} if 0 <= n <= t]
    got = divergence._shares(np.array([n for n, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [1 + 10**9 * n // t for n, t in pairs]
