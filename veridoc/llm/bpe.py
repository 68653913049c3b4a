"""Byte-level BPE inside tasks: DuckDB contracts token-position rows by a recursive query, and puts ids together again by an
ordered aggregation. Spark deals the documents; a worker holds the ranks and the words it has met, bounded in bytes.

Encoding starts with one row (word, position, token) for each byte. In each step of the recursion the rows meet their right
neighbours and the merge table, and each word's leftmost pair of minimum rank is contracted, until nothing changes. Two things
make a step do more than one contraction, and neither changes the result:

* *Ties*: if no longer token that contains a token has a lower rank than it (most tokens; ``calm`` in the merge table), then its
  contraction makes no pair that would come first, so all pairs of that minimum rank are contracted in the step, from left to right.
* *Zones*: a long word is cut in zones of over twice the longest token. What happens to a pair depends on pairs of lower
  rank, and those act only through tokens that reach it, so a pair that is the least of its own zone and the two beside it cannot
  be affected from further away.

Words of up to 64 bytes, nearly all, take a plainer query: one contraction a step, with each row knowing its right neighbour's
token and the rank of the two, so that only the rows beside a contraction meet the merge table again and words that are done
leave the recursion.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.llm.tokens import LOOSE, Encoder
from veridoc.sources.tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of pieces whose ids a worker remembers, bytes of new words that one recursive query takes, and characters of
#: texts that are encoded together (a longer text is encoded by itself).
KNOWN, STEP_BYTES, TOGETHER = 14 << 20, 1 << 18, 4 << 20
#: Bytes of a word that the plainer query takes.
SHORT = 64

_CONTRACT_SHORT = """
WITH RECURSIVE tokens(w, g, id, len, right_id, c, live) AS (
  SELECT b.w, b.g, b.id, 1::BIGINT, b.right_id, m.c, true FROM bytes_of_words b LEFT JOIN merges m ON m.a = b.id AND m.b = b.right_id
  UNION ALL (
    WITH least AS (SELECT w, min((c << 45) | (g << 16) | len) AS k FROM tokens WHERE live GROUP BY w),
    place AS (SELECT w, k >> 45 AS c, (k >> 16) & 536870911 AS g, ((k >> 16) & 536870911) + (k & 65535) AS gone, k & 65535 AS len FROM least),
    pick AS (SELECT p.*, p.len + t.len AS both, t.right_id FROM place p LEFT JOIN tokens t ON t.g = p.gone AND t.live),
    rest AS (
      SELECT t.w, t.g, t.c, p.c IS NOT NULL AS live, t.g = p.g OR t.g + t.len = p.g AS beside,
        CASE WHEN t.g = p.g THEN p.c ELSE t.id END AS id, CASE WHEN t.g = p.g THEN p.both ELSE t.len END AS len,
        CASE WHEN t.g = p.g THEN p.right_id WHEN t.g + t.len = p.g THEN p.c ELSE t.right_id END AS right_id
      FROM tokens t JOIN pick p ON p.w = t.w WHERE t.live AND t.g IS DISTINCT FROM p.gone)
    SELECT w, g, id, len, right_id, c, live FROM rest WHERE beside IS NOT TRUE
    UNION ALL
    SELECT r.w, r.g, r.id, r.len, r.right_id, m.c, true FROM rest r LEFT JOIN merges m ON m.a = r.id AND m.b = r.right_id WHERE beside))
SELECT w, id FROM tokens WHERE NOT live ORDER BY g
"""

_CONTRACT = """
WITH RECURSIVE tokens(w, pos, id, len) USING KEY (w, pos) AS (
  SELECT w, pos, id, 1::BIGINT FROM bytes_of_words
  UNION (
    WITH pairs AS (
      SELECT a.w, a.pos, b.pos AS gone, a.len + b.len AS len, m.c, m.calm, a.pos // {zone} AS zone
      FROM recurring.tokens a JOIN recurring.tokens b ON b.w = a.w AND b.pos = a.pos + a.len JOIN merges m ON m.a = a.id AND m.b = b.id
      WHERE a.len > 0 AND b.len > 0),
    of_zone AS (SELECT w, zone, min((c << 40) + pos) AS least FROM pairs GROUP BY w, zone),
    around AS (SELECT w, zone + d AS zone, min(least) AS least FROM of_zone, (VALUES (-1), (0), (1)) AS s(d) GROUP BY ALL),
    settled AS (
      SELECT p.*, (p.c << 40) + p.pos = r.least AS leftmost, q.w IS NOT NULL AS follows
      FROM pairs p JOIN around r ON r.w = p.w AND r.zone = p.zone AND r.least >> 40 = p.c
      LEFT JOIN pairs q ON q.w = p.w AND q.gone = p.pos AND q.c = p.c),
    runs AS (
      SELECT *, sum(CASE WHEN NOT follows OR before IS DISTINCT FROM pos THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) AS run
      FROM (SELECT *, lag(gone) OVER (PARTITION BY w ORDER BY pos) AS before FROM settled)),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS place, first_value(follows) OVER (PARTITION BY w, run ORDER BY pos) AS open
      FROM runs),
    chosen AS (SELECT * FROM placed WHERE CASE WHEN calm THEN place % 2 = 1 AND NOT open ELSE leftmost END)
    SELECT w, pos, c, len FROM chosen UNION ALL SELECT w, gone, -1, 0 FROM chosen))
SELECT w, id FROM tokens WHERE len > 0 ORDER BY w, pos
"""

_TOGETHER = "SELECT doc, string_agg(piece, '' ORDER BY pos) AS text, count(*) AS n FROM placed_ids JOIN vocabulary USING (id) GROUP BY doc"


def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """A row (a, b, c, calm) for each way to cut a token c into two tokens a and b."""
    rows, uneasy = [], set()
    for token, c in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                rows.append((a, b, c))
                uneasy.update(x for x in (a, b) if x > c)
    a, b, c = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "c": pa.array(c, pa.int64()), "calm": pa.array([x not in uneasy for x in c], pa.bool_())})


def numbered(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The pieces of all texts as numbers, the different pieces, and where each text's begin.

    A text may be cut before a single space between two characters that are no white space: no match of the pattern goes
    across. Arrow cuts and numbers; texts with other white space are cut by a loop.
    """
    texts = texts.fill_null("")
    lists = pc.split_pattern(texts, " ")
    loose = np.flatnonzero(pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False))
    if len(loose):
        other = pa.array([Encoder.cut(t) for t in texts.take(pa.array(loose)).to_pylist()], lists.type)
        order = np.arange(len(texts))
        order[loose] = len(texts) + np.arange(len(loose))
        lists = pa.concat_arrays([lists, other]).take(pa.array(order))
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    codes = pc.dictionary_encode(lists.flatten())
    row, names = codes.indices.to_numpy().astype(np.int64), codes.dictionary.to_pylist()
    # a text's first piece has no space before it; it counts as a piece of its own
    first = bounds[:-1]
    heads, place = np.unique(row[first], return_inverse=True)
    row[first] = len(names) + place
    used = np.bincount(row, minlength=len(names) + len(heads)) > 0
    pieces = [" " + n for n, u in zip(names, used.tolist(), strict=False) if u] + [names[h] for h in heads.tolist()]
    return (np.cumsum(used) - 1)[row], pieces, bounds


class Coder:
    """Ids of texts and texts of ids, through one in-memory DuckDB connection of a worker."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = ranks_of(path)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"{len(missing)} of the 256 bytes have no token")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("given", merge_table(self.ranks))
        self.con.execute("CREATE TABLE merges AS FROM given")
        self.con.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS FROM given")
        self.query = _CONTRACT.format(zone=2 * max(map(len, self.ranks)) + 2)
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.total, self.held = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0

    def _forget(self) -> None:
        """Keeps the third that was met first, which has most of the frequent pieces."""
        n = len(self.known) // 3
        self.known = dict(itertools.islice(self.known.items(), n))
        starts = np.concatenate(self.starts)[: n + 1]
        self.total, self.held = int(starts[-1]), sum(map(len, self.known))
        self.ids, self.starts = [np.concatenate(self.ids)[: self.total].copy()], [starts.copy()]

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are no tokens themselves, in order, and how many each has. All are short, or all long."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        w, ids = np.repeat(np.arange(len(words)), n), self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        if n.max() <= SHORT:
            # one place is free after each word, so no token is beside one of the next word
            ends = np.cumsum(n) - 1
            last = np.zeros(len(ids), bool)
            last[ends] = True
            given = {"w": w, "g": np.arange(len(ids)) + w, "id": ids, "right_id": pa.array(np.roll(ids, -1), pa.int64(), mask=last)}
        else:
            given = {"w": w, "pos": np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n), "id": ids}
        self.con.register("bytes_of_words", pa.table(given))
        out = self.con.sql(_CONTRACT_SHORT if n.max() <= SHORT else self.query).to_arrow_table()
        self.con.unregister("bytes_of_words")
        return out.column("id").to_numpy().astype(np.int32), np.bincount(out.column("w").to_numpy(), minlength=len(words))

    def words_of(self, words: set[str]) -> dict[str, np.ndarray]:
        """Ids of each word: a token as it is, one that is a known piece as remembered, others by the recursive queries, some of
        them at a time."""
        found: dict[str, np.ndarray] = {}
        ids, starts = np.concatenate(self.ids), np.concatenate(self.starts)
        waiting: tuple[list, list] = ([], [])
        size = [0, 0]

        def run(kind: int) -> None:
            if waiting[kind]:
                ids, counts = self.contracted([b for _, b in waiting[kind]])
                ends = np.cumsum(counts).tolist()
                found.update((w, ids[a:b]) for (w, _), a, b in zip(waiting[kind], [0, *ends[:-1]], ends, strict=True))
                waiting[kind].clear()
                size[kind] = 0

        for w in words:
            b = w.encode()
            if (one := self.ranks.get(b)) is not None:
                found[w] = np.array([one], np.int32)
                continue
            if (k := self.known.get(w)) is not None:
                found[w] = ids[starts[k] : starts[k + 1]]
                continue
            kind = int(len(b) > SHORT)
            waiting[kind].append((w, b))
            size[kind] += len(b)
            if size[kind] > STEP_BYTES:
                run(kind)
        run(0)
        run(1)
        return found

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces: each is cut at the pattern's matches, and those that are new are looked up together."""
        cut = [self.split(p) for p in pieces]
        found = self.words_of({w for p in cut for w in p})
        ids = [found[w] for p in cut for w in p]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(list(map(len, cut)))]
        first = len(self.known)
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))
        self.starts.append(ends + self.total)
        self.total += int(ends[-1])
        self.ids += ids
        self.held += sum(map(len, pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of an Arrow array of strings, and where each text's begin; null is an empty text."""
        if self.held > KNOWN:
            self._forget()
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        row, pieces, bounds = numbered(texts)
        get = self.known.get
        at = [get(p) for p in pieces]
        if new := [p for p, i in zip(pieces, at, strict=True) if i is None]:
            self.learn(new)
            at = [self.known[p] for p in pieces]
        at = np.array(at, np.int64)[row]
        self.ids, self.starts = [np.concatenate(self.ids)], [np.concatenate(self.starts)]
        start, stop = self.starts[0][:-1][at], self.starts[0][1:][at]
        n = stop - start
        ends = np.cumsum(n)
        return self.ids[0][np.repeat(start - ends + n, n) + np.arange(ends[-1])], np.concatenate([[0], ends])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids; an id outside the vocabulary is an error."""
        n = np.diff(bounds)
        ids = ids[bounds[0] : bounds[-1]].astype(np.int32)
        self.con.register("placed_ids", pa.table({"doc": np.repeat(np.arange(len(n)), n), "pos": np.arange(len(ids)), "id": ids}))
        got = self.con.sql(_TOGETHER).to_arrow_table()
        self.con.unregister("placed_ids")
        if sum(got.column("n").to_pylist()) != len(ids):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(n)
        for d, t in zip(got.column("doc").to_pylist(), got.column("text").to_pylist(), strict=True):
            out[d] = t.encode("latin-1")
        return out


@lru_cache(1)
def _coder(path: str) -> Coder:
    return Coder(path)


def some_together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about TOGETHER characters each."""
    ends = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + TOGETHER, "right")))
        yield i, j
        i = j


def encoded(docs: DataFrame, column: str = "text", path: str = RANKS, out: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``column`` as the array ``out`` instead of the text; null and empty texts have none. ``back``
    names a further column for the bytes that the ids decode to, as :func:`decoded` would add, by the same workers.

    Each match of the public pattern is encoded by itself, without special tokens. Ids of a text do not depend on other rows,
    so repeated rows give equal ids. Other columns pass through. One that is named like a new column is refused.
    """
    keep = [c for c in docs.columns if c != column]
    new = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(back, T.BinaryType(), False)] if back else [])
    if taken := {f.name.lower() for f in new} & {c.lower() for c in keep}:
        raise ValueError(f"{sorted(taken)} are columns already")
    schema = T.StructType([docs.schema[c] for c in keep] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            for i, j in some_together(batch.column(column)):
                b = batch.slice(i, j - i)
                ids, bounds = coder.encode(b.column(column))
                added = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                if back:
                    added.append(pa.array(coder.decode(ids, bounds), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *added], names=schema.names)

    return docs.select(*keep, column).mapInArrow(run, schema)


def decoded(rows: DataFrame, column: str = "ids", path: str = RANKS, out: str = "decoded") -> DataFrame:
    """``rows`` and the bytes ``out`` of the ids in ``column``: null and empty arrays give no bytes, an unknown id or a null in
    an array fails the job. Bytes, not text: ids may end within a character."""
    if out.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"{out} is a column already")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            lists = b.column(column)
            n = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null among the ids")
            texts = coder.decode(flat.to_numpy(), np.concatenate([[0], np.cumsum(n)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def op11_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every whole text of ``documents``, and the digest of what they decode to.

    Null and empty texts have no ids: n_tokens 0, and the digests of nothing. Repeated rows and null doc_ids are rows like any
    other, texts of any length are encoded whole, an empty table gives no rows, further columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = encoded(docs, back="decoded")
    text = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
