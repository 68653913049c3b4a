"""SimHash near-duplicate detection with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import covering, shingles
from veridoc.llm.components import connected
from veridoc.llm.joins import light
from veridoc.sources import scratch
from veridoc.sources.tables import fresh, table


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """``doc_id`` and the 64-bit fingerprint ``fp`` (signed long) of each row's whole text, a row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [shingles.simhash(shingles.hashes(shingles.words(t.as_py()), shingle_words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """The component of each document under "fingerprints differ in at most ``radius`` bits".

    Returns a row for each input row: ``doc_id``, ``fp``, ``component_id`` (smallest doc_id of the component) and
    ``links`` (how many other fingerprints it was linked to by the tables; stars stand for the links in large buckets).
    Equal fingerprints are folded before the search, so a group of copies is one node. Null and wordless texts have
    fingerprint 0 and are linked like any other. A null doc_id takes part but never names a component unless nothing
    else does; repeated rows stay repeated. An empty table gives an empty result. Other columns are ignored.
    """
    rows = scratch.keep(fingerprints(docs, shingle_words), "prints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = scratch.keep(covering.links(nodes.select("fp"), radius).distinct(), "links")
    labels = connected(edges).withColumnRenamed("node", "fp")
    degree = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("links"))
    known = (
        nodes.join(labels, "fp", "left").join(degree, "fp", "left")
        .select("fp", "least", F.coalesce("label", "fp").alias("label"), F.coalesce("links", F.lit(0).cast("long")).alias("links")))
    # almost every component is one fingerprint; only the others need the second aggregation
    named = known.groupBy("label").agg(F.min("least").alias("component_id"))
    lookup = scratch.keep(known.join(named, "label").select("fp", "component_id", "links"), "lookup")
    return rows.join(lookup, "fp").select("doc_id", "fp", "component_id", "links")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at 2 bits or fewer."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


#: What a text's bucket may hold for all its pairs to be listed; larger ones are listed by rare shingles.
BUCKET = 32
#: Bits in which the plain fingerprints of texts at a similarity of 0.8 or more may differ: 10 on average, and none of
#: 25,826 made pairs at 0.80 to 0.83 was over 23.
APART = 24
#: Entries of one list that a task holds together, and texts that one copy of a hub's shingles is compared with.
BLOCK, DEALT = 1024, 256
#: Cells in which shingles are counted to put rare ones first; cells that shingles share change the order, not the result.
CELLS = 1 << 20
#: Digests that a task remembers, to send the shingles of a text that repeats only once.
REMEMBERED = 100_000


def digest(text: str = "text"):
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(docs: DataFrame, shingle_words: int, views: int) -> DataFrame:
    """A row for each row of ``docs``: ``key`` (digest), ``fp`` (plain fingerprint), ``views`` (weighted ones), ``size`` and
    ``set`` (32-bit hashes of the different shingles). A task that meets a text again leaves ``set`` null."""
    names = ["key", "fp", "views", "size", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = np.unique(shingles.hashes(shingles.words(text.as_py()), shingle_words))
                    small = np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32)
                    rows.append((shingles.simhash(h), shingles.weighted_simhashes(h, views), len(small), None if key in met else small))
                    if len(met) < REMEMBERED:
                        met.add(key)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32())), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    rows = docs.select(digest().alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "key binary, fp long, views array<long>, size int, set array<int>")


def similar_texts(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, views: int = 4) -> DataFrame:
    """Links ``a``, ``b`` between digests of different texts: they join the texts that similar pairs join.

    Similar means a Jaccard similarity of the shingle sets of at least ``similarity``. One plain fingerprint is 10 bits
    apart at 0.8, too far for covering tables. So a text gets one fingerprint for each of several views, which weight the
    shingles by hashes of their own; similar texts often agree in a view within 2 bits, and the covering tables find all
    pairs that do. Candidates are compared on all their shingles, in three steps, each for what is still apart:

    * each text with its bucket's hub, the text with most copies: that joins a group of near copies by work in proportion
      to its members, however large it is;
    * in buckets of up to BUCKET texts all pairs whose texts are not joined yet;
    * in larger ones, where many texts share a passage, all pairs that share one of their rarest shingles
      (:func:`prefix_pairs`), which finds every similar pair of such a bucket.

    Pairs whose sizes, or whose plain fingerprints by more than APART bits, rule out the similarity are not compared.
    32-bit hashes of two shingles in 4 billion are alike, which moves a similarity by less than can be told from rounding.
    """
    signed = scratch.keep(signatures(docs, shingle_words, views), "signed")
    texts = scratch.keep(signed.groupBy("key").agg(F.count("*").alias("copies"), F.first("views").alias("views"), F.first("fp").alias("fp"), F.first("size").alias("size")), "texts")
    tables = [(v, t, m) for v in range(views) for t, m in enumerate(covering.masks(2))]
    buckets = F.array(*[F.xxhash64(F.lit(v), F.lit(t), F.col("views")[v].bitwiseAND(F.lit(m))) for v, t, m in tables])
    placed = texts.select("key", F.explode(buckets).alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = scratch.keep(placed.join(shared, "bucket").join(texts.drop("views"), "key"), "crowded")
    members = scratch.keep(crowded.select("key").distinct(), "members")
    sets = scratch.keep(signed.filter("set is not null").select("key", "set").join(light(members), "key", "left_semi").groupBy("key").agg(F.first("set").alias("set")), "sets")
    scratch.drop(signed)

    def possible(a: str, b: str):
        near = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= APART
        x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
        return near & (F.least(x, y) >= similarity * F.greatest(x, y))

    text = F.struct("key", "fp", "size")
    hubs = crowded.groupBy("bucket").agg(F.max(F.struct("copies", F.xxhash64("key").alias("h"), text.alias("t"))).alias("hub")).select("bucket", F.col("hub.t").alias("hub"))
    stars = crowded.select("bucket", text.alias("own")).join(hubs, "bucket").filter((F.col("own.key") != F.col("hub.key")) & possible("own", "hub"))
    links = scratch.alone(lambda: compared(stars.select(F.col("own.key").alias("a"), F.col("hub.key").alias("b")).distinct(), sets, similarity), "star-links")

    def still_apart() -> DataFrame:
        named = crowded.join(connected(links).withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        apart = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
        return named.join(apart, "bucket").select("bucket", "n", "key", "label", "fp", "size")

    left = scratch.alone(still_apart, "apart")
    for done in (crowded, members, texts):
        scratch.drop(done)
    member = F.struct("key", "label", "fp", "size").alias("own")
    small = left.filter(F.col("n") <= BUCKET).groupBy("bucket").agg(F.collect_list(member).alias("m")).select(F.explode("m").alias("own"), "m").select("own", F.explode("m").alias("other"))
    pairs = small.filter((F.col("own.key") < F.col("other.key")) & (F.col("own.label") != F.col("other.label")) & possible("own", "other")).select(F.col("own.key").alias("a"), F.col("other.key").alias("b"))
    thick = left.filter(F.col("n") > BUCKET).select("key", "label", "fp", "size").distinct()
    waiting = scratch.alone(lambda: pairs.union(prefix_pairs(thick, sets, similarity)).distinct(), "pairs")
    scratch.drop(left)
    return settled(waiting, links, sets, similarity)


def settled(pairs: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``links`` and such of the similar ``pairs`` (``a``, ``b``), both written tables that are removed, as are needed to join what all of them would join.

    Two components with many pairs between them need only one that is similar. So each round compares some pairs for each
    two components, drops those that have become one, and takes eight times as many for the others the next time.
    Every pair is compared in the end, unless its texts are joined already.
    """
    most, waiting, last = 1, pairs, pairs

    def dealt_out() -> DataFrame:
        labels, rows = connected(links), waiting
        for end in ("a", "b"):
            rows = rows.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")), end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
        rows = rows.filter("la <> lb").select("a", "b", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
        counts = rows.groupBy("la", "lb").agg(F.count("*").alias("n"), F.min(F.xxhash64("a", "b")).alias("first"))
        h, share = F.xxhash64("a", "b"), F.ceil(F.col("n") / most)
        return rows.join(counts, ["la", "lb"]).select("a", "b", ((h == F.col("first")) | (F.pmod(h, share) == 0)).alias("now"))

    while True:
        dealt = scratch.alone(dealt_out, "waiting")
        scratch.drop(last)
        if not dealt.limit(1).count():
            scratch.drop(dealt)
            return links
        more = scratch.alone(lambda: links.union(compared(dealt.filter("now").select("a", "b"), sets, similarity)), "links")  # noqa: B023
        scratch.drop(links)
        links, last = more, dealt
        waiting, most = dealt.filter("not now").select("a", "b"), most * 8


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The similar ones of ``pairs`` (``a``, ``b``); ``sets`` has ``key``, ``set``.

    Pairs with the same ``b`` are dealt into parts of about DEALT. A part's shingles of ``b`` come first and those of its
    texts pass by one at a time, so a task holds two sets, and no text is a group of its own however many pairs it has.
    """
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    dealt = scratch.keep(pairs.join(counts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / DEALT)).alias("part")), "dealt")
    rows = scratch.keep(dealt.select("b", "part", F.lit(1).alias("place"), F.col("a").alias("key")).union(dealt.select("b", "part", F.lit(0), "b").distinct()), "rows")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.int32)
        for b in batches:
            found = []
            for own, place, key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                x = x.values.to_numpy()
                if place == 0:
                    hub, held = own, x
                elif own == hub:
                    shared = len(np.intersect1d(x, held, assume_unique=True))
                    if shared >= similarity * (len(x) + len(held) - shared):
                        found.append((key, own))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*found, strict=True) if found else ((), ()))], ["a", "b"])

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = sets.join(light(rows), "key").repartition(parts, "b", "part").sortWithinPartitions("b", "part", "place")
    return grouped.select("b", "place", "key", "set").mapInArrow(verify, "a binary, b binary")


def prefix_pairs(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``texts`` (``key``, ``label``, ``fp``, ``size``) that may be similar and have different labels; none is missing.

    With all shingles in one order, the rarest first, two sets of the given similarity share one among the first
    n - ceil(similarity n) + 1 of each, and at the first that they share so many must follow in both that the similarity
    can be reached. So texts are listed under these shingles with their places, and those of a list are paired if places,
    sizes and fingerprints allow it. A list with one label is passed over before texts meet. A list of more than BLOCK
    texts is cut into blocks, and each two of them meet as a group of its own; a label with more than BLOCK texts in a
    list has blocks to itself, which do not meet each other. So no list is held by one task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int64)
        for b in batches:
            seen += np.bincount(b.column(0).flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["cell", "n"])

    spark, named = sets.sparkSession, scratch.keep(sets.join(light(scratch.keep(texts, "thick")), "key"), "prefix-sets")
    counts = named.select("set").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)
    often[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    sent = spark.sparkContext.broadcast(often)  # CELLS numbers, whatever the input

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part, out = b.slice(at, 200), []
                for x in part.column(0):
                    x = x.values.to_numpy()
                    need = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
                    # texts without words are alike and are listed under 0
                    out.append(x[np.lexsort((x, sent.value[x & (CELLS - 1)]))[:need]] if len(x) else np.zeros(1, np.int32))
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in out]))
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int32()), pa.array(place), *(c.take(row) for c in part.columns[1:])], ["token", "place", *entry])

    entry = ["key", "label", "fp", "size"]
    listed = scratch.keep(named.select("set", *entry).mapInArrow(first, "token int, place int, key binary, label binary, fp long, size int"), "prefixes")
    mixed = listed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high").select("token", "n")
    lists = scratch.keep(listed.join(mixed, "token"), "lists")
    scratch.drop(listed)
    whole = F.struct(F.lit(b"").alias("own"), F.lit(0).cast("long").alias("at"))
    entry = ["key", "label", "fp", "size", "place"]
    short = lists.filter(F.col("n") <= BLOCK).select("token", whole.alias("p"), whole.alias("q"), whole.alias("block"), *entry)
    long = lists.filter(F.col("n") > BLOCK)
    shares = long.groupBy("token", "label").agg(F.count("*").alias("c"))
    rest = shares.filter(F.col("c") <= BLOCK).groupBy("token").agg(F.sum("c").alias("rest"))
    alone = F.col("c") > BLOCK
    dealt = scratch.keep(
        long.join(shares, ["token", "label"]).join(rest, "token", "left").select(
            "token", *entry, F.struct(
                F.when(alone, F.col("label")).otherwise(F.lit(b"")).alias("own"),
                F.when(alone, F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / BLOCK))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("rest") / BLOCK))).alias("at")).alias("block")), "blocks")
    each = dealt.select("token", "block").distinct()
    meet = each.withColumnRenamed("block", "p").join(each.withColumnRenamed("block", "q"), "token").filter("p <= q and (p.own = x'' or p.own <> q.own)")
    sides = meet.select("token", "p", "q", F.col("p").alias("block")).union(meet.filter("p <> q").select("token", "p", "q", F.col("q").alias("block")))
    rows = short.unionByName(dealt.join(sides, ["token", "block"]).select("token", "p", "q", "block", *entry))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(group: list[tuple]) -> pa.RecordBatch:
            side, keys, labels, fp, size, place = zip(*group, strict=True)
            side, keys, fp, size = np.array(side), np.array(keys, object), np.array(fp, np.int64).view(np.uint64), np.array(size, np.float64)
            after, label = size - np.array(place), np.unique(np.array(labels, object), return_inverse=True)[1]
            out: list[tuple[np.ndarray, np.ndarray]] = []
            two = side.any()
            for x in np.flatnonzero(~side).tolist():
                y = np.flatnonzero(side) if two else np.arange(x + 1, len(side))
                ok = (label[y] != label[x]) & (np.bitwise_count(fp[y] ^ fp[x]) <= APART)
                ok &= np.minimum(after[y], after[x]) * (1 + similarity) >= similarity * (size[y] + size[x]) - 1e-9
                y = y[ok]
                if len(y):
                    out.append((np.repeat(x, len(y)), y))
            # by number: numpy's own strings would lose a zero byte at the end of a digest
            a, b = (keys[np.concatenate(c)] for c in zip(*out, strict=True)) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([min(x, y) for x, y in zip(a, b, strict=True)], pa.binary()), pa.array([max(x, y) for x, y in zip(a, b, strict=True)], pa.binary())], ["a", "b"])

        now, group = None, []
        for b in batches:
            for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != now:
                    if len(group) > 1:
                        yield flushed(group)
                    now, group = g, []
                group.append(row)
        if len(group) > 1:
            yield flushed(group)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.withColumn("side", F.col("block") != F.col("p")).repartition(parts, "token", "p", "q").sortWithinPartitions("token", "p", "q")
    group = F.struct("token", "p", "q").alias("group")
    return met.select(group, "side", *entry).mapInArrow(pair, "a binary, b binary").distinct()


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of copies and near copies, the one with the smallest doc_id, with its columns.

    Groups are components of :func:`similar_texts`; texts without words are alike. A null doc_id is kept only in a group
    without another. Of rows that repeat doc_id and text one is kept. An empty table stays empty, and a column of any other
    name stays as it is. A very long text is one set of shingles in a task at a time.
    """
    links = scratch.alone(lambda: similar_texts(docs, **how), "similar")
    labels = connected(links)
    texts = docs.select("doc_id", digest().alias("node")).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("least"), F.count("*").alias("n"))
    named = texts.join(labels, "node", "left").select("node", "least", "n", F.coalesce("label", "node").alias("label"))
    first = named.groupBy("label").agg(F.min("least").alias("first"), F.sum("n").alias("rows"))
    # only texts whose rows are not all kept are looked up: the others need no shuffle of their text
    fate = scratch.keep(named.join(first, "label").filter("rows > 1").select(F.col("node").alias("_vd_node"), (F.col("first.node") == F.col("node")).alias("_vd_kept"), F.col("first.doc_id").alias("_vd_first")), "fate")
    at = fresh(docs, "digest")
    joined = docs.withColumn(at, digest()).join(light(fate), F.col(at) == F.col("_vd_node"), "left")
    alone = joined.filter("_vd_node is null").select(*docs.columns)
    first_rows = joined.filter(F.col("_vd_kept") & F.col("doc_id").eqNullSafe(F.col("_vd_first")))
    return alone.union(first_rows.dropDuplicates([at]).select(*docs.columns))
