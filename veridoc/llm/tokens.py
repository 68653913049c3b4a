"""Token ids of whole documents in compressed plane-shuffled files, written and read by Spark tasks.

A file holds fixed-size blocks of ids. Each block is transposed into planes: bit planes (all bits 0 of the block, then
all bits 1, ...) or byte planes; planes that are zero throughout are left out and the others compressed with zstandard.
The footer has an index with a row for each chunk (offset, ids, first id's place, length of each plane) and one with a
row for each document (doc_id, number of ids); the last bytes tell where the footer begins, so readers fetch ranges.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.packed import bytes_of
from veridoc.sources import scratch
from veridoc.sources.tables import table

MAGIC = b"VDPLANE1"
TAIL = struct.Struct("<qqqq8s")
END_ID = 0
#: White space beside a space, or a space at an end: there not every space is a place to cut. White space as in Unicode.
_WHITE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
LOOSE = f"^ | [{_WHITE}]|[{_WHITE}] | $"
#: Bytes of text that are encoded at once.
AT_ONCE = 4 << 20
#: Longer pieces are not kept: each kept one is then a few hundred bytes at most.
LONGEST = 64


#: Kinds of bytes: unknown, of another letter or sign that is no white space, A-Z and a-z, digits, other signs, the apostrophe, the space, other white space.
UNKNOWN, OTHER, LETTER, DIGIT, SIGN, QUOTE, SPACE, WHITE = range(8)
KIND = np.full(256, UNKNOWN, np.uint8)
KIND[0x21:0x7F], KIND[0x80:] = SIGN, OTHER
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], KIND[0x30:0x3A], KIND[0x27], KIND[0x20], KIND[9:14] = LETTER, DIGIT, QUOTE, SPACE, WHITE
#: True for 8 * kind + kind of the next byte where a match of the byte-level pattern always ends, whatever stands around.
ENDS = np.zeros((8, 8), bool)
ENDS[OTHER:SPACE, SPACE:] = True
for _a, _b in ((LETTER, (DIGIT, SIGN, QUOTE)), (DIGIT, (LETTER, SIGN, QUOTE)), (SIGN, (LETTER, DIGIT)), (QUOTE, (DIGIT,))):
    ENDS[_a, list(_b)] = True
ENDS = ENDS.reshape(-1)
#: Letters with these first two bytes may be white space (U+0085 and U+00A0, U+1680, U+2000 to U+205F, U+3000).
MAYBE_WHITE = {0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}


class Encoder:
    """Ids of texts by a ``tokenizers`` file, as little-endian uint32 bytes.

    Where a match of the byte-level pattern always ends, a text may be cut without a change to its ids: before white space,
    after a single line end, and between ASCII letters, digits and other signs. So the library encodes each distinct piece
    once: numpy cuts the texts of a batch, Arrow numbers their pieces and looks them up among those that are kept, and their
    ids are put together by numpy. Where the kind of a letter is not known, and within added tokens, nothing is cut; with
    another pattern each text is one piece. What is kept is bounded in bytes; when it is full, all but the pieces met first,
    which are the frequent ones, are forgotten. Pieces of over LONGEST bytes, such as texts without spaces, are never kept.
    """

    def __init__(self, path: str, capacity: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.capacity = Tokenizer.from_file(path), capacity
        if hasattr(self.tokenizer.model, "_resize_cache"):  # its own cache only costs time below this one
            self.tokenizer.model._resize_cache(0)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        pattern = str(self.tokenizer.pre_tokenizer)
        self.cuts = (
            pattern.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pattern and self.tokenizer.normalizer is None
            and self.mark in self.added and not any(t.lstrip or t.rstrip or t.single_word for t in added))
        vocab = self.tokenizer.get_vocab()
        self.bytes_of_id = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of_id[list(vocab.values())] = list(map(len, vocab))  # a byte-level token has a character for each byte
        self._forget(0)

    def _forget(self, most: int) -> None:
        """Keeps the ``most`` pieces that were met first."""
        if most:
            self.names, self.flat, self.ends = pa.concat_arrays([self.names.slice(0, most)]), self.flat[: self.ends[most - 1]].copy(), self.ends[:most].copy()
        else:
            self.names, self.flat, self.ends = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.held = int(self._cost(self.names, np.diff(self.ends, prepend=0)).sum())

    @property
    def known(self) -> dict[str, bytes]:
        """The pieces that are kept, and their ids."""
        return {p: self.flat[a:b].tobytes() for p, a, b in zip(self.names.to_pylist(), [0, *self.ends.tolist()], self.ends.tolist(), strict=False)}

    @staticmethod
    def _cost(pieces: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Bytes that pieces and what is made of them for a lookup take, counted amply."""
        return 200 + 4 * pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 4 * sizes

    def _learned(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has. Many go at a time: one follows the other where that changes
        no ids, and elsewhere a special token stands between them, for the library encodes what stands between special tokens
        by itself. The bytes behind the ids tell the pieces apart again."""
        alone = np.full(len(pieces), not self.cuts)
        for t in self.added:
            alone |= pc.match_substring(pieces, t).to_numpy(zero_copy_only=False)
        data, bounds = bytes_of(pieces.filter(pa.array(~alone)))
        apart = np.flatnonzero(~self.ends_in(data)[bounds[1:-1]]) + 1
        whole, breaks = data.tobytes(), [0, *bounds[apart].tolist(), len(data)]
        parts = [whole[a:b] for a, b in zip(breaks, breaks[1:], strict=False)]
        joined = [self.mark.encode().join(parts[a : a + 50]).decode() for a in range(0, len(parts), 50)]
        ids = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in ids)])
        flat = flat[flat != self.mark_id]
        behind = np.cumsum(self.bytes_of_id[flat])
        last = np.searchsorted(behind, bounds[1:])
        if not np.array_equal(behind[last], bounds[1:]):
            raise ValueError("a piece does not end where a token does")
        sizes = np.diff(last, prepend=-1)
        if not alone.any():
            return flat, sizes
        single = [np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4") for p in pieces.filter(pa.array(alone)).to_pylist()]
        order = np.argsort(np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)]), kind="stable")
        every = np.concatenate([sizes, np.array(list(map(len, single)), np.int64)])
        return _gathered(np.concatenate([flat, *single]), np.cumsum(every)[order], every[order]), every[order]

    def _keep(self, pieces: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.held > 0.9 * self.capacity:
            self._forget(len(self.names) // 3)
        cost = np.where(pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= LONGEST, self._cost(pieces, sizes), 0)
        kept = (cost > 0) & (self.held + np.cumsum(cost) <= self.capacity)
        some = sizes[kept]
        self.flat = np.concatenate([self.flat, _gathered(flat, np.cumsum(sizes)[kept], some)])
        self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(some)])
        self.names = pa.concat_arrays([self.names, pieces.filter(pa.array(kept))])
        self.held += int(cost[kept].sum())

    @staticmethod
    def cut(text: str) -> list[str]:
        """The pieces of any text, each but the first without the space before it."""
        parts = text.split(" ")
        out = parts[:1]
        for p in parts[1:]:
            if p and out[-1] and not out[-1][-1].isspace() and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        return out

    def ends_in(self, data: np.ndarray) -> np.ndarray:
        """True at each byte before which a match surely ends."""
        begin = np.zeros(len(data) + 1, bool)
        if self.cuts:
            kind = KIND[data]
            for lead, seconds in MAYBE_WHITE.items():
                at = np.flatnonzero(data[:-2] == lead)
                at = at[np.isin(data[at + 1], seconds)]
                kind[np.add.outer(np.arange(3), at)] = UNKNOWN
            at = np.flatnonzero(data[:-1] == 0xC2)
            kind[np.add.outer(np.arange(2), at)] = UNKNOWN
            begin[1:-1] = ENDS[8 * kind[:-1] + kind[1:]]
            at = np.flatnonzero(kind[1:-1] == WHITE) + 1  # a line end by itself
            solid = (kind >= OTHER) & (kind <= QUOTE)
            begin[at + 1] = solid[at - 1] & solid[at + 1]
            whole = data.tobytes()
            for t in map(str.encode, self.added):
                at = whole.find(t)
                while at >= 0:
                    begin[at + 1 : at + len(t)] = False
                    at = whole.find(t, at + 1)
        return begin

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow array of strings without nulls."""
        data, bounds = bytes_of(texts)
        if not len(data):
            return [b""] * len(texts)
        begin = self.ends_in(data)
        begin[bounds] = True
        at = np.flatnonzero(begin)
        pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        numbered = pieces.dictionary_encode()
        names, place = numbered.dictionary, pc.index_in(numbered.dictionary, value_set=self.names).fill_null(-1).to_numpy()
        ends, flat = self.ends, self.flat
        new = place < 0
        if new.any():
            missing = names.filter(pa.array(new))
            found, sizes = self._learned(missing)
            place = place.copy()
            place[new] = len(ends) + np.arange(len(missing))
            ends, flat = np.concatenate([ends, len(flat) + np.cumsum(sizes)]), np.concatenate([flat, found])
            self._keep(missing, found, sizes)
        row = place[numbered.indices.to_numpy()]
        count = np.diff(ends, prepend=0)[row]
        out, last = _gathered(flat, ends[row], count), np.append(0, np.cumsum(count))[np.searchsorted(at, bounds)].tolist()
        return [out[a:b].tobytes() for a, b in zip(last, last[1:], strict=False)]


def _gathered(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` by where they end and how long they are, one after the other."""
    total = np.cumsum(sizes)
    return flat[np.repeat(ends - total, sizes) + np.arange(total[-1] if len(total) else 0)]


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, b].tobytes() for b in range(4)]
    return [p.tobytes() for b in range(4) for p in (
        np.packbits(np.unpackbits(octets[:, b : b + 1], axis=1, bitorder="little").T, axis=1, bitorder="little")
        if octets[:, b].any() else np.zeros((8, 0), np.uint8))]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    octets = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for b, p in enumerate(planes):
            if p:
                octets[:, b] = np.frombuffer(p, np.uint8)
    else:
        for b in range(4):
            rows = [np.frombuffer(p, np.uint8) if p else np.zeros((n + 7) // 8, np.uint8) for p in planes[8 * b : 8 * b + 8]]
            if any(planes[8 * b : 8 * b + 8]):
                bits = np.unpackbits(np.stack(rows), axis=1, bitorder="little")[:, :n]
                octets[:, b] = np.packbits(bits.T, axis=1, bitorder="little")[:, 0]
    return octets.reshape(-1).view("<u4")


class Writer:
    """Appends documents to one file; what it holds at a time is one block and the two indexes."""

    def __init__(self, out: io.RawIOBase, kind: str = "byte", block: int = 1 << 16, level: int = 3):
        self.out, self.kind, self.block, self.zip = out, kind, block, zstandard.ZstdCompressor(level=level)
        self.at, self.ids, self.waiting, self.held = len(MAGIC), 0, [], 0
        self.chunks: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            self._flush(self.block)

    def _flush(self, least: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) - len(ids) % self.block if least > 1 else len(ids)
        for a in range(0, whole, self.block):
            part = ids[a : min(a + self.block, whole)]
            packed = [self.zip.compress(p) if p.count(0) != len(p) else b"" for p in to_planes(part, self.kind)]
            self.chunks.append([self.at, len(part), self.ids, *map(len, packed)])
            self.out.write(b"".join(packed))
            self.at += sum(map(len, packed))
            self.ids += len(part)
        self.waiting, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(1)
        chunks = np.array(self.chunks, "<i8").reshape(len(self.chunks), -1)
        docs = np.array([self.sizes, [d or 0 for d in self.doc_ids], [d is not None for d in self.doc_ids]], "<i8").reshape(3, -1)
        a, b = self.zip.compress(chunks.tobytes()), self.zip.compress(docs.tobytes())
        self.out.write(a + b)
        self.out.write(TAIL.pack(self.at, len(a), len(b), len(docs[0]), (self.kind + "       ")[:8].encode()))
        self.out.write(MAGIC)


class Reader:
    """Reads a file through any object with ``seek`` and ``read``, fetching ranges."""

    def __init__(self, source: io.RawIOBase, size: int):
        self.source = source
        tail = self._range(size - TAIL.size - len(MAGIC), TAIL.size + len(MAGIC))
        if tail[TAIL.size :] != MAGIC:
            raise ValueError("not a token file, or cut short")
        at, a, b, n, kind = TAIL.unpack(tail[: TAIL.size])
        self.kind, self.unzip = kind.strip().decode(), zstandard.ZstdDecompressor()
        foot = self._range(at, a + b)
        self.chunks = np.frombuffer(self.unzip.decompress(foot[:a]), "<i8").reshape(-1, 3 + (4 if self.kind == "byte" else 32))
        self.docs = np.frombuffer(self.unzip.decompress(foot[a:]), "<i8").reshape(3, n)

    def _range(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def chunk(self, k: int) -> np.ndarray:
        at, n, _, *sizes = self.chunks[k].tolist()
        data, planes, p = self._range(at, sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unzip.decompress(data[p : p + s]) if s else b"")
            p += s
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, size: int) -> np.ndarray:
        """The ids from one place on, out of the chunks that hold them."""
        first = max(0, int(np.searchsorted(self.chunks[:, 2], start, "right")) - 1)
        parts, base, k = [], int(self.chunks[first, 2]) if len(self.chunks) else 0, first
        while k < len(self.chunks) and self.chunks[k, 2] < start + size:
            parts.append(self.chunk(k))
            k += 1
        return (np.concatenate(parts) if parts else np.zeros(0, "<u4"))[start - base : start - base + size]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document, a chunk at a time."""
        held, k = np.zeros(0, "<u4"), 0
        for size, doc_id, known in self.docs.T.tolist():
            parts, have = [held], len(held)
            while have < size:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (doc_id if known else None), held[:size]
            held = held[size:]


def write(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", block: int = 1 << 16) -> DataFrame:
    """Encode ``doc_id``, ``text`` in ascending doc_id order into files below ``path``; returns their manifest.

    Rows are dealt by ranges of (doc_id, hash of the text), so a doc_id that repeats very often still spreads; null
    doc_ids come last. Each task writes one file under a name of its own and then renames it, so a repeated attempt
    replaces whole files only. Manifest: ``file``, ``part``, ``bytes``, ``docs``, ``ids``.
    """
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        fs.create_dir(root, recursive=True)
        name, made = f"{root}/part-{part:06d}.vdt", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        writer, encoder = None, None
        for b in together(batches):
            if b.num_rows and writer is None:
                out = fs.open_output_stream(made)
                writer, encoder = Writer(out, kind, block), encoder_for(tokenizer)
            for some in light(b, 1, AT_ONCE):
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                    writer.add(doc_id, ids + struct.pack("<I", END_ID))
        if writer is not None:
            writer.close()
            out.close()
            pa.default_memory_pool().release_unused()
            fs.move(made, name)
            size = fs.get_file_info(name).size
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "bytes": size, "docs": len(writer.sizes), "ids": writer.ids}])

    files = placed.repartitionByRange(*keys).sortWithinPartitions(*keys, F.length("text"))
    return scratch.keep(files.mapInArrow(run, "file string, part long, bytes long, docs long, ids long"), "tokens-manifest")


def together(batches: Iterator[pa.RecordBatch], most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: small ones are joined until they have about ``most`` bytes, so a piece is looked up less often."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and (b.nbytes > most or sum(x.nbytes for x in held) + b.nbytes > most):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        held.append(b)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def light(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings in ``column`` have about ``most`` bytes, or that are one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at)
        yield batch.slice(at, n)
        at += n


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """This worker's encoder, kept from task to task. A task has one core, so the library makes no threads of its own."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def read(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    The manifest has a row for each file, so one small window turns its counts into each file's first place.
    """
    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    files = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                rows, start = [], row["start"]
                with fs.open_input_file(row["file"]) as source:
                    for doc_id, ids in Reader(source, row["bytes"]):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("file", "bytes", "start").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, kind: str = "byte") -> DataFrame:
    """Write all documents' ids to the shared folder and return what reading the files back gives, a row each.

    A null text counts as empty and has only the end id. Repeated rows are written as often as they stand there; rows with
    equal doc_ids stand in the order of a hash of their texts. An empty table writes no file. A very long text is encoded
    by itself, and its ids are in memory once. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = scratch.new_dir(spark, "tokens")
    return read(spark, write(docs, path, str(tokenizer), kind), path)


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, counts and checksums of all documents' ids, from the files."""
    return token_files(table(spark, sf_dir, "documents"))
