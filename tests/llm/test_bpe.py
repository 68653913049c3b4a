import hashlib
import random

import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from veridoc.llm import bpe


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.RANKS)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def texts():
    r = random.Random(5)
    pick = lambda of, n: "".join(r.choice(of) for _ in range(n))
    yield from [None, "", " ", "  a  b ", "hello world, it's 12345 o'clock\n\n\t x", "\x00\x01\x7f nul", "a" * 5000, "ab" * 900, "=-" * 700, "é" * 600, "日本語テキスト" * 60, " " * 400 + "x", " a b c"]
    yield from [pick("abcdefghijklmnopqrstuvwxyz", n) for n in (3, 63, 64, 65, 66, 257, 259, 1500)]  # around the limits of short words and zones
    yield from [pick(["the", "ing", "aa", "aaa", "x", " "], n) for n in (40, 900)]
    yield from [pick([chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), *range(0x4E00, 0x4E40), 0x1F600)], 400) for _ in range(30)]


def test_ids_and_bytes_equal_the_library(coder, library):
    rows = list(texts())
    ids, bounds = coder.encode(pa.array(rows, pa.string()))
    back = coder.decode(ids, bounds)
    for i, t in enumerate(rows):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode_ordinary(t or ""), t
        assert back[i] == (t or "").encode()


def test_a_full_memory_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    monkeypatch.setattr(bpe, "STEP_BYTES", 10)
    for t in ("some unusualwordform here", "someone unusualwordforms there", "some unusualwordform here"):
        assert coder.encode(pa.array([t]))[0].tolist() == library.encode_ordinary(t)


def test_other_vocabularies(tmp_path):
    """Ranks in which a longer token comes before the shorter one it contains."""
    import base64

    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"ab", b"cd", b"abcd", b"bcde", b"bc", b"aa", b"de", b"abc", b"aaa", b"cde", b"bcd"):
        ranks[token] = len(ranks)
    (tmp_path / "r").write_text("\n".join(f"{base64.b64encode(t).decode()} {n}" for t, n in ranks.items()))
    own, lib = bpe.Coder(str(tmp_path / "r")), tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    for n in (2, 5, 30, 64, 65, 200, 2000):
        t = ["".join(r.choice("abcde") for _ in range(n)) for _ in range(20)]
        ids, bounds = own.encode(pa.array(t))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [lib.encode_ordinary(x) for x in t]


def test_query(spark, tmp_path, library):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "a  b"), (3, "a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "decoded")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in bpe.op11_duckdb_bpe(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_table_and_wrong_ids(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op11_duckdb_bpe(spark, str(tmp_path)).count() == 0
    rows = spark.createDataFrame([(1, [464, 995]), (2, []), (3, None), (4, [220])], "k int, ids array<int>")
    assert {r.k: bytes(r.decoded) for r in bpe.decoded(rows).collect()} == {1: b"The world", 2: b"", 3: b"", 4: b" "}
    same = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "k int, text string")
    one, two = bpe.encoded(same, back="b").collect(), bpe.decoded(bpe.encoded(same), out="b").collect()
    assert sorted(one) == sorted(two)
    for wrong in ([50256], [None]):
        with pytest.raises(Exception, match="vocabulary|null"):
            bpe.decoded(spark.createDataFrame([(wrong,)], "ids array<int>")).collect()
    with pytest.raises(ValueError):
        bpe.encoded(spark.createDataFrame([("a", 1)], "text string, IDS int"))
