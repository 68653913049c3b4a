"""How the word use of the sources of a language differs, from exact counts over all documents.

Terms are cut and counted inside tasks as numbers: those of up to 8 bytes are one uint64, those of up to 16 two, radix-sorted
and run-counted; longer ones are sorted as bytes, in buckets by length. What a task has counted is sent once for each language
and bucket of terms, packed. All counts of a term of a language meet in one bucket, which decides whether it is kept.
Buckets grow in number with the bytes of the corpus, so none grows with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm import packed
from veridoc.llm.joins import light
from veridoc.sources import scratch
from veridoc.sources.tables import table

#: ASCII letters and all bytes of other characters.
TERM = packed.table_of(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
#: Documents that a kept term is in, terms of a source that are returned, and the scale of probabilities.
DOCUMENTS, TERMS, SCALE = 3, 200, 1_000_000_000
#: Bytes of text for a bucket of terms, and counts that a task holds before it sends them.
BUCKET, HELD = 32 << 20, 1 << 20

_SENT = "lang string, bucket int, kind int, sources array<string>, keys binary, source binary, n binary, docs binary"
_KEPT = "lang string, bucket int, term string, source string, n long, total long, head boolean"
_SUMS = "lang string, source string, item string, value long"


class Counts:
    """Counts of (term, group) with the documents they come from: packed short terms by their number of words, long terms by
    the power of two that holds their length."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, kind: int, keys: list[np.ndarray], group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        if len(group):
            self.parts.setdefault(kind, []).append((keys, group, n, docs))
            self.size += len(group)

    def add_text(self, data: np.ndarray, bounds: np.ndarray, groups: np.ndarray) -> None:
        """The terms of rows; ``groups`` has a number for each row."""
        data = packed.LOWER[data]
        starts, ends = packed.runs(TERM[data], bounds)
        sizes = ends - starts
        rows = np.searchsorted(bounds, starts, "right") - 1
        for kind, least, most in ((1, 1, 8), (2, 9, 16)):
            own = np.flatnonzero((sizes >= least) & (sizes <= most))
            self._counted(kind, packed.words(data, starts[own], sizes[own], kind), rows[own], groups)
        width = 32
        while len(own := np.flatnonzero(sizes > width // 2)) and width // 2 >= 16:
            own = own[sizes[own] <= width]
            if len(own):
                cells = np.zeros((len(own), width), np.uint8)
                place = np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
                cells[np.repeat(np.arange(len(own)), sizes[own]), place] = data[np.repeat(starts[own], sizes[own]) + place]
                self._counted(width, [cells.view(f"S{width}").ravel()], rows[own], groups)
            width *= 2

    def _counted(self, kind: int, keys: list[np.ndarray], rows: np.ndarray, groups: np.ndarray) -> None:
        if not len(rows):
            return
        # terms come in the order of rows, which a stable sort keeps within each term and group
        order = packed.radix_order([groups[rows].astype(np.uint64)])
        order = packed.radix_order(keys, order) if kind <= 2 else order[np.argsort(keys[0][order], kind="stable")]
        keys, rows = [k[order] for k in keys], rows[order]
        group = groups[rows]
        new = packed.changes([*keys, group])
        at = np.flatnonzero(new)
        docs = np.add.reduceat((new | packed.changes([rows])).astype(np.int64), at)
        self.add(kind, [k[at] for k in keys], group[at], np.diff(at, append=len(rows)), docs)

    def compact(self, one_document: bool = False) -> None:
        """Each (term, group) once. ``one_document``: all counts are of one and the same."""
        self.size = 0
        for kind, parts in self.parts.items():
            keys = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
            group, n, docs = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            order = packed.radix_order([group.astype(np.uint64)])
            order = packed.radix_order(keys, order) if kind <= 2 else order[np.argsort(keys[0][order], kind="stable")]
            keys, group = [k[order] for k in keys], group[order]
            at = np.flatnonzero(packed.changes([*keys, group]))
            docs = np.add.reduceat(docs[order], at)
            self.parts[kind] = [([k[at] for k in keys], group[at], np.add.reduceat(n[order], at), np.minimum(docs, 1) if one_document else docs)]
            self.size += len(at)


def _buckets(kind: int, keys: list[np.ndarray], buckets: int) -> np.ndarray:
    if kind <= 2:
        return (packed.mixed(keys) % np.uint64(buckets)).astype(np.int64)
    return np.fromiter((zlib.crc32(t) for t in keys[0].tolist()), np.int64, len(keys[0])) % buckets


def _sent(counts: Counts, groups: list[tuple[str, str]], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each language, bucket and kind of term, with what was counted as packed arrays."""
    counts.compact()
    langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in groups))}
    of_group = np.array([langs[lang] for lang, _ in groups], np.int64)
    names, rows = list(langs), []
    for kind, ((keys, group, n, docs),) in counts.parts.items():
        cell = of_group[group] * buckets + _buckets(kind, keys, buckets)
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        at = np.flatnonzero(packed.changes([cell]))
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(cell)], strict=True):
            own = order[a:b]
            used, code = np.unique(group[own], return_inverse=True)
            lang, bucket = divmod(int(cell[a]), buckets)
            rows.append((names[lang], bucket, kind, [groups[g][1] for g in used], b"".join(k[own].tobytes() for k in keys), code.astype("<u4").tobytes(), n[own].astype("<i8").tobytes(), docs[own].astype("<i8").tobytes()))
            if len(rows) >= 256:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts, groups = Counts(), {}
    for b in batches:
        data, bounds = packed.bytes_of(b.column("text"))
        of_row = np.array([groups.setdefault(k, len(groups)) for k in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
        long = None
        for i, j, part, cut in packed.slices(data, bounds, ~TERM):
            if cut:  # a part of one document: parts are put together before they count as one
                if long is None or long[0] != i:
                    if long:
                        _taken(counts, long[1])
                    long = (i, Counts())
                long[1].add_text(part, np.array([0, len(part)]), of_row[i:j])
            else:
                counts.add_text(part, bounds[i : j + 1] - bounds[i], of_row[i:j])
        if long:
            _taken(counts, long[1])
        if counts.size > HELD:
            counts.compact()
            if counts.size > HELD // 2:
                yield from _sent(counts, list(groups), buckets)
                counts, groups = Counts(), {}
    if counts.size:
        yield from _sent(counts, list(groups), buckets)


def _taken(counts: Counts, one: Counts) -> None:
    one.compact(one_document=True)
    for kind, parts in one.parts.items():
        for p in parts:
            counts.add(kind, *p)


def _kept(rows: pa.Table) -> pa.Table:
    """The kept terms of a language and bucket with their counts by source, from what all tasks have sent."""
    counts, sources = Counts(), {}
    lang, bucket = rows["lang"][0], rows["bucket"][0]
    for r in rows.to_pylist():
        n = np.frombuffer(r["n"], "<i8")
        local = np.array([sources.setdefault(s, len(sources)) for s in r["sources"]], np.int64)
        keys = np.frombuffer(r["keys"], np.uint64).reshape(r["kind"], -1) if r["kind"] <= 2 else [np.frombuffer(r["keys"], f"S{r['kind']}")]
        counts.add(r["kind"], list(keys), local[np.frombuffer(r["source"], "<u4")], n, np.frombuffer(r["docs"], "<i8"))
    counts.compact()
    names = pa.array(list(sources), pa.string())
    out = [_schema(_KEPT).empty_table()]
    for kind, ((keys, group, n, docs),) in counts.parts.items():
        head = packed.changes(keys)
        at = np.flatnonzero(head)
        term = np.cumsum(head) - 1
        keep = (np.add.reduceat(docs, at) >= DOCUMENTS)[term]
        cells = np.stack(keys, 1).astype(">u8").view(f"S{8 * kind}").ravel() if kind <= 2 else keys[0]
        found = {"term": pa.array(cells[keep].tolist(), pa.binary()).cast(pa.string()), "source": names.take(pa.array(group[keep])), "n": n[keep], "total": np.add.reduceat(n, at)[term][keep], "head": head[keep]}
        size = int(keep.sum())
        out.append(pa.table({"lang": pa.repeat(lang, size), "bucket": pa.repeat(bucket, size), **found}, schema=_schema(_KEPT)))
    return pa.concat_tables(out)


def _schema(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))])


def term_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Kept terms: (lang, bucket, term, source, n, total over the sources, head: one row of each term has it).
    ``docs`` has lang, source and text without nulls."""
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(lambda b: _counted(b, buckets), _SENT)
    return rows.groupBy("lang", "bucket").applyInArrow(_kept, _KEPT)


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total) for n <= total, by long division three digits at a time so that nothing passes 64 bits."""
    rest, out = n % total, n // total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _pair_sums(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """For each two sources of a language the sum of f over the kept terms of one bucket."""
    lang, names = groups["lang"][0], groups["source"].combine_chunks()
    place = pc.index_in(terms["source"], names).to_numpy().astype(np.int64)
    term = terms["term"].combine_chunks().dictionary_encode()
    counts = np.zeros((len(names), len(term.dictionary)), np.int64)
    counts[place, term.indices.to_numpy().astype(np.int64)] = terms["n"].to_numpy()
    total = groups["n"].to_numpy() + groups["kept"].to_numpy()
    p = _shares(counts + 1, total[:, None])
    out = [_schema(_SUMS).empty_table()]
    for i, own in enumerate(p):
        value = np.concatenate([((own - q) ** 2 // q).sum(1) for q in np.array_split(p, max(1, p.size >> 20))])
        keep = np.flatnonzero(np.arange(len(names)) != i)
        out.append(pa.table({"lang": pa.repeat(lang, len(keep)), "source": pa.repeat(names[i], len(keep)), "item": names.take(pa.array(keep)), "value": value[keep]}, schema=_schema(_SUMS)))
    return pa.concat_tables(out)


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exact."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * big(n + 1), big(total)) + 1


def audit(docs: DataFrame) -> DataFrame:
    """The divergence of each source of each language from the others, and the terms that tell it from its language.

    Null text, lang and source count as ''. Each row is a document, so repeated rows count each time. A group without terms
    and a language without kept terms have all their pairs, the latter with value 0. Texts and terms of any length are whole;
    ties are ordered by the item's UTF-8 bytes. An empty table gives no rows, further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = scratch.keep(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("size")), "groups")
    buckets = 8 + (groups.agg(F.sum("size")).first()[0] or 0) // BUCKET
    terms = scratch.keep(term_counts(docs, buckets), "terms")
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("head").alias("kept"))
    stats = groups.select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    stats = light(scratch.keep(stats.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "kept")]), "stats"))

    cells = terms.select("lang", "bucket").distinct().join(stats, "lang").select(*[F.col(c).alias(c) for c in ("lang", "bucket", "source", "n", "kept")])
    parts = terms.groupBy("lang", "bucket").cogroup(cells.groupBy("lang", "bucket")).applyInArrow(_pair_sums, _SUMS)
    found = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = stats.select("lang", "source").join(stats.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = both.join(found, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    rows = terms.join(stats, ["lang", "source"]).select("lang", "source", "term", share(terms["n"], stats["n"] + F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_n") + F.col("kept")).alias("q"))
    rows = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    return pairs.unionByName(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TERMS))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`audit` of all ``documents``; nulls, repeats and ties are as stated there."""
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
total AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (total.n + 1)::HUGEINT) // ((SELECT sum(n) FROM c WHERE c.lang = total.lang)::HUGEINT + v.v) AS q FROM total JOIN v USING (lang)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (coalesce(sizes.n, 0)::HUGEINT + v.v) AS p
    FROM groups JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN sizes USING (lang, source) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
