"""Vectorised text kernels shared by the operators; numpy only, no Spark.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.batches import chunks  # noqa: F401, the operators take it from here

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once.
PIECE = 1 << 20
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _powers() -> list[np.ndarray]:
    """2 * PIECE powers of the base and of its inverse modulo 2**64, made once."""
    for base in (_BASE, pow(_BASE, -1, 1 << 64)) if not _POWERS else ():
        p = np.full(2 * PIECE + 1, base, U64)
        p[0] = 1
        _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array, a space after each; their first bytes and their lengths. Null counts as empty."""
    parts = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    return np.frombuffer(b" ".join([*parts, b""]), np.uint8), starts, lengths


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word. The last byte must be a space."""
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, given by ascending starts, by polynomial prefix sums over two pieces of the data at a time."""
    power, inverse = _powers()
    out = np.zeros(len(starts), U64)
    for a in range(0, len(data), PIECE):
        i, j = np.searchsorted(starts, (a, a + PIECE))
        if i == j:
            continue
        part = data[a : a + 2 * PIECE]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(_TABLE[part] * power[: len(part)], dtype=U64)))
        s = starts[i:j] - a
        out[i:j] = (total[np.minimum(ends[i:j] - a, len(part))] - total[s]) * inverse[s]
        for k in (i + np.flatnonzero(ends[i:j] > a + len(part))).tolist():  # longer than a piece
            for at in range(a + len(part), int(ends[k]), PIECE):
                rest = data[at : min(at + PIECE, int(ends[k]))]
                out[k] += (_TABLE[rest] * power[: len(rest)]).sum(dtype=U64) * U64(pow(_BASE, at - int(starts[k]), 1 << 64))
    return mix(out + (ends - starts).astype(U64))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, lower-cased: (hashes sorted within each text, text index, words per text).

    With fewer words than n the whole sequence is one shingle; without words there is none.
    """
    data, starts, _ = joined(texts)
    data = lower(data)
    first, end = word_spans(data)
    words = span_hashes(data, first, end)
    owner = np.searchsorted(starts, first, "right") - 1
    counts = np.bincount(owner, minlength=len(starts))
    lead = np.concatenate(([0], np.cumsum(counts)))[:-1]
    acc = np.zeros(max(len(words) - n + 1, 0), U64)
    for j in range(n):
        acc = acc * U64(_BASE) + words[j : len(words) - n + 1 + j]
    full = np.flatnonzero(owner[: len(acc)] == owner[n - 1 :]) if len(acc) else np.zeros(0, np.int64)
    h, o = mix(acc[full] + U64(n)), owner[full]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(n - 1):
            has = counts[short] > j
            extra[has] = extra[has] * U64(_BASE) + words[lead[short[has]] + j]
        h, o = np.concatenate((h, mix(extra + counts[short].astype(U64)))), np.concatenate((o, short))
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    if len(h):
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
        h, o = h[keep], o[keep]
    return h, o, counts


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def words_at(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes at every position as one number, without a copy."""
    return np.ndarray((max(len(data) - 7, 0),), np.dtype(f"{order}u8"), data, 0, (1,))


def pack_planes(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, so that a general compressor finds the constant ones."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack_planes(blob: bytes, dtype: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)
