"""Vector operations over the UTF-8 bytes of many texts at once (numpy on Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at a time; one longer text is handled alone.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        base = np.full(size, _P_INV if inverse else _P, U64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if size <= 4 * CHUNK:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit words (splitmix finaliser)."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[i] the polynomial hash of the first i bytes; substring() reads any substring's hash from it."""
    c = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=c[1:])
    return c


def substring(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * powers(len(c), True)[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) for runs of rows of about `size` bytes."""
    raw, at = text_buffer(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hash, start, end) of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased first."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z.astype(U64), z, z
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    start = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    doc = np.searchsorted(at, start, "right") - 1
    return doc, substring(prefix_hash(data), start, end), start, end


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the word n-grams of each text, in order of place; a shorter text is one n-gram as a whole."""
    doc, h, _, _ = word_hashes(data, at)
    if not len(doc):
        return doc, h
    count = np.bincount(doc, minlength=len(at) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    gram = np.zeros(len(h), U64)
    for j in range(min(width, len(h))):
        gram[: len(h) - j] += h[j:] * powers(2 * width + 2)[2 * j + 1]
    left = first[doc + 1] - np.arange(len(h))
    keep = left >= width
    for d in np.flatnonzero((count > 0) & (count < width)):
        i = first[d]
        gram[i] = (h[i : first[d + 1]] * powers(2 * width + 2)[1 : 2 * count[d] : 2]).sum(dtype=U64)
        keep[i] = True
    gram = mix(gram, 7) + mix(np.minimum(count, width).astype(U64), 3)[doc]
    return doc[keep], gram[keep]


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (text index, hash) without repeats, in order."""
    if not len(doc):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values (doubling; log2(width) passes)."""
    span, m = 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(values: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers: for each window of `width` positions inside one text, the place of its least value (leftmost of equals).

    first, last: the positions [first, last) of each text. Returns (text index, place, first window, last window): the
    windows starting at first..last window are all those whose minimiser is that place.
    """
    n = len(values)
    bits = max(20, n.bit_length())
    place = np.arange(n, dtype=U64)
    packed = ((values >> U64(bits)) << U64(bits)) | place
    m = sliding_min(packed, width) if n >= width else packed[:0]
    long = last - first >= width
    doc_of = np.repeat(np.arange(len(first)), np.where(long, last - first - width + 1, 0))
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b - width + 1) for a, b in zip(first[long], last[long])]]) if long.any() else np.zeros(0, np.int64)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    at = (m[starts] & U64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc_of[1:] != doc_of[:-1])
    i = np.flatnonzero(new)
    j = np.concatenate((i[1:], [len(at)])) - 1
    return doc_of[i], at[i], starts[i], starts[j]
