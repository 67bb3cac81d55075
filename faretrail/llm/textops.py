"""Vectorised byte-level text helpers used inside Spark tasks.

Every function works on one Arrow batch: ``data`` holds the UTF-8 bytes of all
its texts one after another, ``offsets`` (length n + 1) says where each text
starts. Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r;
UTF-8 continuation bytes are never separators, so byte and character words are
the same. Work arrays are bounded by ``BLOCK`` bytes, not by the text length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

_tables: dict[str, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables["up"], _tables["down"] = _powers(_BASE), _powers(_BASE_INV)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, _, (_, offs, data) = len(column), None, column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word, in order."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~SEPARATOR[data]
    cut = np.zeros(n + 1, dtype=bool)  # a text starts here
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word
    last[:-1] &= ~(word[1:] & ~cut[1:n])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _long_word(data: np.ndarray) -> np.uint64:
    up, _ = _power_tables()
    total = 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return np.uint64(total & _MASK)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans ordered, not overlapping).

    A polynomial over the bytes modulo 2^64 from prefix sums, mixed with the
    length; equal spans hash equal wherever they stand.
    """
    up, down = _power_tables()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        k = int(np.searchsorted(ends, base + BLOCK, side="right"))
        if k <= i:
            out[i] = _long_word(data[base : ends[i]])
            i += 1
            continue
        part = data[base : ends[k - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:k] - base, ends[i:k] - base
        out[i:k] = (sums[e] - sums[s]) * down[s]
        i = k
    return mix(out ^ ((ends - starts).astype(np.uint64) * _STEP))


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of ``k`` words; a text of one to k - 1
    words gives its whole sequence as one shingle. Repeats are kept."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[first, n])
    short = first[count < k]
    short_len = count[count < k]
    full = np.zeros(n, dtype=bool)
    if n >= k:
        full[: n - k + 1] = text[: n - k + 1] == text[k - 1 :]
    at = np.flatnonzero(full)
    out = words[at].copy()
    for j in range(1, k):
        out *= _STEP
        out += words[at + j]
    if not len(short):
        return mix(out), text[at]
    low = words[short].copy()
    for j in range(1, k):
        more = short_len > j
        low[more] = low[more] * _STEP + words[short[more] + j]
    low ^= short_len.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    values, owner = np.r_[out, low], np.r_[text[at], text[short]]
    order = np.argsort(owner, kind="stable")
    return mix(values[order]), owner[order]


def hash_unit(ids: np.ndarray, seed: int) -> np.ndarray:
    """Mixed 64-bit value of integer ids under a seed."""
    return mix(ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & _MASK))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20):
    """The batch in row slices of at most ``max_bytes`` of text (one row at least)."""
    col = batch.column(batch.schema.get_field_index(column))
    _, offsets = text_bytes(col)
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


def distinct_sorted(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values in ascending unsigned order. ``owner`` is
    non-decreasing; the result keeps the owners' order."""
    n = len(values)
    if n == 0:
        return values, owner
    local = np.cumsum(np.r_[False, owner[1:] != owner[:-1]]).astype(np.uint64)
    bits = max(1, int(local[-1]).bit_length())
    packed = (local << np.uint64(64 - bits)) | (values >> np.uint64(bits))
    order = np.argsort(packed)
    p = packed[order]
    v = values[order]
    if ((p[1:] == p[:-1]) & (v[1:] != v[:-1])).any():  # the kept bits tie: sort by all of them
        order = np.lexsort((values, local))
        v = values[order]
    o = owner[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])]
    return v[new], o[new]


def set_digests(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per segment of ``values``; they do not depend on the order."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a = np.add.reduceat(mix(values ^ np.uint64(0x243F6A8885A308D3)), starts)
    b = np.add.reduceat(mix(values ^ np.uint64(0x13198A2E03707344)), starts)
    return mix(a), mix(b)


def digest_column(d1: np.ndarray, d2: np.ndarray) -> pa.Array:
    """16-byte keys from two 64-bit digests."""
    both = np.empty((len(d1), 2), dtype=">u8")
    both[:, 0], both[:, 1] = d1, d2
    return pa.Array.from_buffers(pa.binary(16), len(d1), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
