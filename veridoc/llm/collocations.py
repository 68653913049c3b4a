"""Collocations by SON: shards are mined completely at a support lowered to their share, and what any of them finds frequent is
counted over everything.

Documents fall into a few shards by a hash of their text. A shard is no task: its counts of phrase hashes are made in many
tasks, sent packed, and added up by (language, shard, range of hashes). A phrase that is in at least 10 places of a language is
in at least ceil(10 * share) places of some shard, for any shares that sum to one; here they are of the language's bytes. Words
and pairs are mined first, triples only where both their pairs are frequent in the same shard. Equal hashes of different phrases
only add candidates. The union goes to all tasks as a bitmap, of at most 128 MB however many candidates there are (a fuller one
lets more through), and the last pass counts what it lets through as text, so the counts, and the support, are exact.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm import packed
from veridoc.llm.joins import light
from veridoc.sources import scratch
from veridoc.sources.tables import table

#: Fixed values of the task: what ends a piece, what ends a word.
ENDS = packed.table_of(b".,;:!?\n\x0b\x0c\r")
GAPS = packed.table_of(b" \t") | ENDS
#: Places of a candidate, words of one, percent of a candidate's places from which a longer one replaces it, rows of a language.
SUPPORT, WORDS, PERCENT, TOP = 10, 3, 50, 2000
SHARDS = 4
#: Bytes of text for a range of hashes, counts that a task holds before it sends them, and bits of a bitmap at most (log 2).
RANGE, HELD, BITS = 16 << 20, 1 << 21, 30

_SENT = "lang string, shard int, range int, hashes binary, n binary"
_PHRASES = "lang string, words int, phrase string, n long"


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """A 64-bit hash of each word for each seed. Words of up to 32 bytes are hashed as packed numbers with their length."""
    sizes = ends - starts
    out = [np.zeros(len(starts), np.uint64) for _ in seeds]
    least = 0
    for n in (1, 2, 4):
        own = np.flatnonzero((sizes > least) & (sizes <= 8 * n))
        least = 8 * n
        if len(own):
            keys = packed.words(data, starts[own], sizes[own], n)
            for o, seed in zip(out, seeds, strict=True):
                o[own] = packed.mixed([sizes[own].astype(np.uint64) ^ np.uint64(seed), *keys])
    for i in np.flatnonzero(sizes > 32).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        for o, seed in zip(out, seeds, strict=True):
            o[i] = xxhash.xxh3_64_intdigest(word, seed)
    return out


class Phrases:
    """The phrases of rows of bytes: words within pieces, and hashes of one to three of them that differ by language."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, salts: np.ndarray, seeds: tuple[int, ...] = (1,)):
        self.data = packed.LOWER[data]
        self.starts, self.ends = packed.runs(~GAPS[self.data], bounds)
        self.rows = np.searchsorted(bounds, self.starts, "right") - 1
        piece = np.cumsum(ENDS[self.data], dtype=np.int64)[self.starts] if len(self.starts) else self.starts
        self.follows = np.zeros(len(self.starts), bool)  # the next word is in the same piece
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (self.rows[1:] == self.rows[:-1])
        self.hashes = word_hashes(self.data, self.starts, self.ends, seeds)
        self.salts = salts[self.rows]

    def places(self, size: int) -> np.ndarray:
        """The first words of all phrases of ``size`` words."""
        ok = np.ones(len(self.starts), bool)
        for k in range(size - 1):
            ok &= np.roll(self.follows, -k)
        return np.flatnonzero(ok)

    def of(self, places: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        return packed.mixed([self.salts[places] + np.uint64(size), *(self.hashes[seed][places + k] for k in range(size))])

    def text(self, place: int, size: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(place, place + size)).decode()


class Bitmap:
    """Whether a hash was put in, or shares its first bits with one that was; one map for each of ``sets``."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.bits = cells, bits

    def has(self, hashes: np.ndarray, which: np.ndarray | int = 0) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) + (np.asarray(which, np.int64) << self.bits)
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)


def _summed(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    at = np.flatnonzero(packed.changes([hashes]))
    return hashes[at], np.add.reduceat(n[order], at) if len(at) else n


def _mined(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], frequent, ranges: int) -> Iterator[pa.RecordBatch]:
    """What a task has of phrases of ``sizes`` words, as packed counts for each language, shard and range of hashes."""
    cells: dict[tuple[str, int], int] = {}
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    shift = np.uint64(64 - ranges)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, shard), c in cells.items():
            if c not in held:
                continue
            hashes, n = _summed(*(np.concatenate(x) for x in zip(*held.pop(c), strict=True)))
            own = (hashes >> shift).astype(np.int64) if ranges else np.zeros(len(hashes), np.int64)
            at = np.flatnonzero(packed.changes([own])).tolist()
            rows = [(lang, shard, int(own[a]), hashes[a:b].tobytes(), n[a:b].astype("<u4").tobytes()) for a, b in zip(at, [*at[1:], len(own)], strict=True)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256], strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])

    size = 0
    for b in batches:
        data, bounds = packed.bytes_of(b.column("text"))
        langs, shards = b.column("lang").to_pylist(), b.column("shard").to_numpy()
        of_row = np.array([cells.setdefault(k, len(cells)) for k in zip(langs, shards.tolist(), strict=True)], np.int64)
        salts = _salts(langs)
        for i, j, part, cut in packed.slices(data, bounds, ENDS):
            some = Phrases(part, np.array([0, len(part)]) if cut else bounds[i : j + 1] - bounds[i], salts[i:j])
            for n in sizes:
                places = some.places(n)
                if n == WORDS and frequent is not None:
                    shard = shards[i:j][some.rows[places]]
                    both = frequent.value.has(some.of(places, n - 1), shard) & frequent.value.has(some.of(places + 1, n - 1), shard)
                    places = places[both]
                if not len(places):
                    continue
                hashes, cell = some.of(places, n), of_row[i:j][some.rows[places]]
                order = packed.radix_order([cell.astype(np.uint64)])
                hashes, cell = hashes[order], cell[order]
                at = np.flatnonzero(packed.changes([cell])).tolist()
                for lo, hi in zip(at, [*at[1:], len(cell)], strict=True):
                    own = np.sort(hashes[lo:hi])
                    first = np.flatnonzero(packed.changes([own]))
                    held.setdefault(int(cell[lo]), []).append((own[first], np.diff(first, append=len(own))))
                    size += len(first)
            if size > HELD:
                for c, parts in held.items():
                    held[c] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from sent()
                    size = 0
    yield from sent()


def _frequent(rows: pd.DataFrame) -> pd.DataFrame:
    """The hashes of one language, shard and range that reach the shard's support."""
    hashes, n = _summed(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]]), np.concatenate([np.frombuffer(x, "<u4") for x in rows["n"]]).astype(np.int64))
    found = hashes[n >= rows["least"].iloc[0]]
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "range": [rows["range"].iloc[0]], "hashes": [found.tobytes()], "found": [len(found)]})


def mined(docs: DataFrame, shares: DataFrame, sizes: tuple[int, ...], frequent, ranges: int) -> DataFrame:
    """Hashes (shard, range, hashes, found) that are frequent in a shard of a language. ``docs`` has lang, shard, text as bytes."""
    sent = docs.mapInArrow(lambda b: _mined(b, sizes, frequent, ranges), _SENT)
    return sent.join(shares, ["lang", "shard"]).groupBy("lang", "shard", "range").applyInPandas(_frequent, "shard int, range int, hashes binary, found long")


def bitmap(found: DataFrame, ranges: int, sets: int):
    """The hashes as a bitmap for each shard (``sets`` of them) or for all, sent to all tasks. Its bits are 16 for each hash, 2^30 at
    most. Each range of hashes makes its own stretch of it in a task; the driver only puts stretches side by side."""
    spark = found.sparkSession
    most = found.agg(F.sum("found")).first()[0] or 0
    bits = max(ranges + 3, min(max(int(16 * most // sets).bit_length(), 13), BITS))
    own = bits - ranges

    def stretch(rows: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]])
        cells = np.zeros(1 << own, bool)
        cells[((h >> np.uint64(64 - bits)) & np.uint64((1 << own) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"which": [rows["which"].iloc[0]], "range": [rows["range"].iloc[0]], "cells": [np.packbits(cells, bitorder="little").tobytes()]})

    which = F.col("shard") if sets > 1 else F.lit(0)
    parts = found.withColumn("which", which).groupBy("which", "range").applyInPandas(stretch, "which int, range int, cells binary").toArrow()
    cells = np.zeros(sets << (bits - 3), np.uint8)
    for w, r, c in zip(*(x.to_pylist() for x in parts.columns), strict=True):
        at = (w << (bits - 3)) + (r << (own - 3))
        cells[at : at + len(c)] = np.frombuffer(c, np.uint8)
    return spark.sparkContext.broadcast(Bitmap(cells, bits))


class Named:
    """Counts of phrases by their two hashes, with the text of each; what a task has seen before only adds to a number."""

    def __init__(self) -> None:
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # sorted by the first
        self.n, self.name = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names: list[tuple[str, int, str]] = []

    def add(self, some: Phrases, places: np.ndarray, size: int, langs: list[str], lang: np.ndarray) -> Iterator[tuple[str, int, str, int]]:
        """Takes the phrases at ``places``. Those whose first hash is another phrase's too are given back with their number."""
        h = some.of(places, size)
        order = np.argsort(h, kind="stable")
        h, places = h[order], places[order]
        g = some.of(places, size, 1)
        at = np.flatnonzero(packed.changes([h]))
        alike = np.logical_and.reduceat(g == g[at][np.cumsum(packed.changes([h])) - 1], at) if len(at) else np.zeros(0, bool)
        h1, g1, n1, p1 = h[at], g[at], np.diff(at, append=len(h)), places[at]
        where = np.minimum(np.searchsorted(self.first, h1), max(0, len(self.first) - 1))
        known = self.first[where] == h1 if len(self.first) else np.zeros(len(h1), bool)
        alike &= ~known | (self.second[where] == g1) if len(self.first) else True
        np.add.at(self.n, where[known & alike], n1[known & alike])
        new = np.flatnonzero(~known & alike)
        names = np.arange(len(self.names), len(self.names) + len(new))
        self.names += [(langs[lang[p]], size, some.text(p, size)) for p in p1[new].tolist()]
        place = np.searchsorted(self.first, h1[new])
        self.first, self.second, self.n, self.name = (np.insert(x, place, y) for x, y in ((self.first, h1[new]), (self.second, g1[new]), (self.n, n1[new]), (self.name, names)))
        for k in np.flatnonzero(~alike).tolist():
            for p in places[at[k] : at[k] + n1[k]].tolist():
                yield langs[lang[p]], size, some.text(p, size), 1

    def rows(self) -> Iterator[tuple[str, int, str, int]]:
        n = np.zeros(len(self.names), np.int64)
        n[self.name] = self.n
        for name, k in zip(self.names, n.tolist(), strict=True):
            yield *name, k


def _counted(batches: Iterator[pa.RecordBatch], candidates) -> Iterator[pa.RecordBatch]:
    """Phrases that the bitmap lets through, as text with their number in the task; and all words of a language with 0 words."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())

    def sent(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while some := list(itertools.islice(rows, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=["lang", "words", "phrase", "n"])

    named, total = Named(), Counter()
    for b in batches:
        data, bounds = packed.bytes_of(b.column("text"))
        langs = b.column("lang").to_pylist()
        salts, code = _salts(langs), {x: i for i, x in enumerate(dict.fromkeys(langs))}
        names, of_row = list(code), np.array([code[x] for x in langs], np.int64)
        for i, j, part, cut in packed.slices(data, bounds, ENDS):
            some = Phrases(part, np.array([0, len(part)]) if cut else bounds[i : j + 1] - bounds[i], salts[i:j], (1, 2))
            lang = of_row[i:j][some.rows]
            total.update({names[k]: int(n) for k, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()) if n})
            for n in range(1, WORDS + 1):
                places = some.places(n)
                places = places[candidates.value.has(some.of(places, n))]
                yield from sent(named.add(some, places, n, names, lang))
        if len(named.names) > HELD // 4:
            yield from sent(named.rows())
            named = Named()
    yield from sent(itertools.chain(named.rows(), ((x, 0, "", n) for x, n in total.items())))


def phrase_counts(docs: DataFrame) -> DataFrame:
    """All phrases of one to three words with at least SUPPORT places in their language, and the number of its words as the
    phrase of none. ``docs`` has lang and text without nulls."""
    rows = docs.select("lang", F.pmod(F.xxhash64("text"), F.lit(SHARDS)).cast("int").alias("shard"), F.col("text").cast("binary").alias("text"))
    sizes = scratch.keep(rows.groupBy("lang", "shard").agg(F.sum(F.octet_length("text")).alias("size")), "shards")
    whole = sizes.groupBy("lang").agg(F.sum("size").alias("whole"))
    least = F.greatest(F.lit(1), F.ceil(F.lit(SUPPORT).cast("decimal(10,0)") * F.col("size").cast("decimal(19,0)") / F.col("whole").cast("decimal(19,0)")))
    shares = light(scratch.keep(sizes.join(whole, "lang").filter("whole > 0").select("lang", "shard", least.cast("long").alias("least")), "shares"))
    ranges = ((sizes.agg(F.sum("size")).first()[0] or 0) // RANGE).bit_length() + 2

    pairs = scratch.keep(mined(rows, shares, (1, 2), None, ranges), "pairs")
    of_shard = bitmap(pairs, ranges, SHARDS)
    triples = scratch.keep(mined(rows, shares, (3,), of_shard, ranges), "triples")
    candidates = bitmap(pairs.union(triples), ranges, 1)
    counts = rows.select("lang", "text").mapInArrow(lambda b: _counted(b, candidates), _PHRASES)
    kept = scratch.keep(counts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= SUPPORT) | (F.col("words") == 0)), "phrases")
    for b in (of_shard, candidates):
        b.destroy()
    for t in (pairs, triples):
        scratch.drop(t)
    return kept


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: the products are decimals of 38 digits."""
    d = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * d(a) * d(a), d(left) * d(right))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Null text is empty, null lang ``und``. Each row counts, so repeated rows count each time. Ties go by a, then by the bytes
    of the phrase. Texts, pieces and words of any length are whole. A language without candidates, and an empty table, give
    no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = phrase_counts(docs)
    of = lambda words, name, n: light(counts.filter(F.col("words") == words).select("lang", F.col("phrase").alias(name), F.col("n").alias(n)))
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    pairs = counts.filter("words = 2").select("lang", "phrase", F.col("n").alias("a"), first.alias("w1"), last.alias("w2"))
    pairs = pairs.join(of(1, "w1", "l"), ["lang", "w1"]).join(of(1, "w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", "phrase", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    triples = counts.filter("words = 3").select("lang", "phrase", F.col("n").alias("a"), first.alias("w1"), last.alias("w3"), F.substring_index("phrase", " ", 2).alias("w12"), F.substring_index("phrase", " ", -2).alias("w23"))
    inside = triples.select("lang", "a", F.explode(F.array("w12", "w23")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = pairs.join(inside, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {PERCENT} * a").drop("longer")
    for words, name, n in ((1, "w1", "l1"), (2, "w23", "r1"), (2, "w12", "l2"), (1, "w3", "r2")):
        triples = triples.join(of(words, name, n), ["lang", name])
    cut = lambda k: F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    triples = triples.select("lang", "phrase", "a", F.least(cut(1), cut(2)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    every = pairs.unionByName(triples)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    heads = every.withColumn("_n", F.row_number().over(some)).filter(F.col("_n") <= top)  # each part's best, so no language meets whole
    best = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = light(counts.filter("words = 0").select("lang", "n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`collocations` of all ``documents``; nulls, repeats and ties are as stated there."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT k, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT k, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM d)),
w AS (SELECT k, lang, i, unnest(w) AS w, generate_subscripts(w, 1) AS j FROM (SELECT k, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece)),
places AS (SELECT lang, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY k, i ORDER BY j)),
grams AS (SELECT lang, 1 AS size, a AS phrase FROM places UNION ALL SELECT lang, 2, concat(a, ' ', b) FROM places WHERE b IS NOT NULL UNION ALL SELECT lang, 3, concat(a, ' ', b, ' ', c) FROM places WHERE c IS NOT NULL),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND n >= 10),
cuts AS (SELECT lang, size, phrase, a, w, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:], ' ') AS two FROM cand, (VALUES (1), (2)) c(k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r, ((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one AND x.size = c.k JOIN f y ON y.lang = c.lang AND y.phrase = c.two AND y.size = c.size - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL),
ranked AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
    FROM best b JOIN total t USING (lang) LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT * FROM ranked WHERE rank <= 2000
"""
