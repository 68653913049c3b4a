"""Words and word shingles of whole texts, and SimHash fingerprints of them, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z of UTF-8 text and cuts it at spaces and the characters 9 to 13."""
    return text.lower().split() if text else []


def hashes(tokens: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``size``-word shingle, repeats included; of the whole sequence if it is shorter."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    start = np.zeros(n, np.int64)
    np.cumsum(lengths[:-1] + 1, out=start[1:])
    stop = (start + lengths)[size - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[: n - size + 1].tolist(), stop.tolist(), strict=True)], np.uint64)


def simhash(h: np.ndarray) -> int:
    """A 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes; 0 for none. Returned as signed."""
    n = len(h)
    if not n:
        return 0
    planes = np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(n, 8)
    if n < 96:
        ones = np.unpackbits(planes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(planes[:, b], minlength=256) @ _BIT for b in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def weighted_simhashes(unique: np.ndarray, views: int) -> list[int]:
    """One fingerprint for each view of a set of hashes.

    A view gives each shingle a weight 1/u^2 by its own uniform hash u in (0, 1], the same in every document, so a few
    shingles carry the sum and documents that share most shingles often agree in nearly all bits.
    """
    if not len(unique):
        return [0] * views
    u = np.stack([(mix(unique, v + 1) >> np.uint64(11)).astype(np.float64) + 1 for v in range(views)])
    weight, total = (u.min(axis=1, keepdims=True) / u) ** 2, np.zeros((views, 64))
    for at in range(0, len(unique), 4096):
        signs = np.unpackbits(np.ascontiguousarray(unique[at : at + 4096], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * 2.0 - 1
        total += weight[:, at : at + 4096] @ signs
    return np.packbits(total > 0, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Well-mixed 64-bit values of the hashes, another function for each salt."""
    x = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))
