import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veridoc.llm import tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
HARD = ["", " ", "  a  b ", "a  b", "x \n y\t z", "it's 12 o'clock's <|endoftext|> end <|endoftext|>", "é ü 漢字 😀 !!", "\x1c a \x85 b", "a\r\n\r\n b", "don 't 're", "word " * 3000, "<|endoftext|>", "a <|endoftext|>b"]


def test_pieces_give_the_ids_of_whole_texts():
    whole = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("ab'!1 \n\té　"), rng.integers(0, 40))) for _ in range(400)]
    for capacity in (96 << 20, 3):
        got = tokens.Encoder(PATH, capacity).encode(pa.array(HARD + made))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in HARD + made]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_round_trip(kind, block):
    rng = np.random.default_rng(block)
    docs = [(None if i == 4 else i, rng.integers(0, 2 ** int(rng.integers(1, 33)), rng.integers(0, 50)).astype("<u4")) for i in range(40)]
    out = io.BytesIO()
    w = tokens.Writer(out, kind, block)
    for d, ids in docs:
        w.add(d, ids.tobytes())
    w.close()
    r = tokens.Reader(out, len(out.getvalue()))
    assert [(d, ids.tolist()) for d, ids in r] == [(d, ids.tolist()) for d, ids in docs]
    everything = np.concatenate([ids for _, ids in docs])
    assert r.ids(11, 300).tolist() == everything[11:311].tolist()
    with pytest.raises(ValueError):
        tokens.Reader(out, len(out.getvalue()) - 1)


def test_query_equals_plain_encoding(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(HARD)] + [(500, None), (7, "again"), (7, "again"), (7, "other"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "file": F.lit("x")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = tokens.op4_token_planes(spark, str(tmp_path)).orderBy("start").collect()
    whole, place = Tokenizer.from_file(PATH), 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows if r[0] is not None)) + [None]
    expected = {}
    for d, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == place
        expected[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        place += r.n_tokens
    assert not any(expected.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tokens.op4_token_planes(spark, str(tmp_path)).collect() == []


def test_what_is_kept_is_bounded_in_bytes():
    rng = np.random.default_rng(3)
    encoder, whole = tokens.Encoder(PATH, 1 << 20), Tokenizer.from_file(PATH)
    for _ in range(4):
        texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 3000))) for _ in range(20)] + [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 3000)) for _ in range(20)]
        got = encoder.encode(pa.array(texts))
        assert [np.frombuffer(g, "<u4").tolist() for g in got[::7]] == [whole.encode(t, add_special_tokens=False).ids for t in texts[::7]]
        assert sum(200 + 4 * len(p) + len(i) for p, i in encoder.known.items()) <= 1 << 20 and max(map(len, encoder.known)) <= tokens.LONGEST


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 5, 30, 1, 1)])], ["t"])
    assert [s.num_rows for s in tokens.light(batch, 0, 10)] == [3, 1, 2]


def test_small_batches_are_encoded_together():
    batch = lambda rows: pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    rows = [(i, "x" * (i * 37 % 200)) for i in range(300)] + [(300, "y" * 5000), (301, ""), (302, "z")]
    got = list(tokens.together(iter([batch(rows[a : a + 3]) for a in range(0, 303, 3)] + [batch([]).cast(batch(rows[:1]).schema)]), 4000))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
    assert len(got) < 20 and all(b.nbytes <= 4000 or b.num_rows <= 3 for b in got)
    assert list(tokens.together(iter([]))) == []


def test_texts_are_cut_between_words_and_signs():
    whole, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH, 1 << 18)
    encoder.encode(pa.array(["A word. A word, (word)\nWord; the word"]))
    assert set(encoder.known) == {"A", " word", ".", " A", ",", " (", "word", ")", "\n", "Word", ";", " the"}
    rng = np.random.default_rng(11)
    letters = [*"aZsdtmrvl'\".,5 \n\r\x0b\x1c\x85\xa0é’“\u2003\u2028\u3000\u1680。漢😀«²ªº\u0301\u200b\x00\x7f_-", "<|endoftext|>", "<|", "endoftext", "|>", "'ll", "\r\n", "  "]
    for _ in range(20):
        texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(200)]
        assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
