"""Vectorised text kernels shared by the corpus operators.

Every kernel works on the flat UTF-8 buffer of an Arrow string column, so a
batch is tokenised and hashed without creating Python strings.  Memory is
bounded: callers walk a batch through :func:`slices`, and the hash kernel works
in chunks of about one megabyte whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0xD1342543DE82EF95)
_cache: dict[str, np.ndarray] = {}


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of at most ``limit`` text bytes (a longer text stands alone)."""
    _, offs = flat(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower()
#: Word bytes of the two word classes in use: not white space; and letters, digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "p" not in _cache:
        inv = pow(int(_PRIME), -1, 1 << 64)
        ones = np.full(_CHUNK + 1, _PRIME, np.uint64)
        ones[0] = 1
        back = np.full(_CHUNK + 1, np.uint64(inv), np.uint64)
        back[0] = 1
        _cache["p"], _cache["i"] = np.cumprod(ones, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        _cache["v"] = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT)
    return _cache["p"], _cache["i"], _cache["v"]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range (ranges ascending, not overlapping); equal bytes give equal hashes anywhere."""
    out = np.zeros(len(starts), np.uint64)
    powers, inverse, value = _powers()
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(int(np.searchsorted(ends, a + _CHUNK, "right")), i + 1)
        if ends[j - 1] - a > _CHUNK:  # one word beyond a chunk
            h, p = 0, int(_PRIME)
            for k in range(a, int(ends[i]), _CHUNK):
                part = value[data[k : min(k + _CHUNK, int(ends[i]))]]
                h = (h + int((part * powers[: len(part)]).sum(dtype=np.uint64)) * pow(p, k - a, 1 << 64)) % (1 << 64)
            out[i] = h
        else:
            b = int(ends[j - 1])
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(value[data[a:b]] * powers[: b - a], out=total[1:])
            s = starts[i:j] - a
            out[i:j] = (total[ends[i:j] - a] - total[s]) * inverse[s]
        i = j
    out += (ends - starts).astype(np.uint64) * _MULT
    return mix(out)


def hash_runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h)-k+1 entries, none when shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * _PRIME + h[i : i + n]
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and the row offsets into them.

    Words are runs of non-space bytes after lower-casing A-Z.  A row of fewer
    than ``k`` words has its whole sequence as one shingle; a row without words has none.
    """
    low = LOWER[data]
    starts, ends, first = words(low, offs, NOT_SPACE)
    h = hash_words(low, starts, ends)
    runs = hash_runs(h, k)
    parts, sizes = [], np.zeros(len(offs), np.int64)
    for r in range(len(offs) - 1):
        a, b = first[r], first[r + 1]
        if b - a >= k:
            s = np.unique(runs[a : b - k + 1])
        elif b > a:
            s = hash_runs(h[a:b], int(b - a))
        else:
            continue
        parts.append(s)
        sizes[r + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)
