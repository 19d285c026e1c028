"""Vectorised UTF-8 text kernels shared by the Arrow-batched operators.

Everything works on the raw byte buffer of an Arrow string column, so a batch
is never turned into Python strings.  Batches are cut into slices of about
``SLICE_BYTES`` of text, which bounds the temporaries to a few dozen MB; a
single text longer than that forms a slice of its own (whole texts only).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: rows of a text table that are sent to a Python worker at once
BATCH_ROWS = 512

#: ranges longer than this are hashed one by one
LONG_RANGE = 256
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: keeps the lowest i bytes of a word
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

def small_batches(spark) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS rows, as rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last) row ranges of about ``limit`` bytes of text each."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal ``kind`` (0: between runs), cut at text ends."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(hash, first word of each text) of words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased.

    The second value has len(offsets) entries: words of text i are
    first[i]:first[i + 1].
    """
    starts, ends = runs((~IS_SPACE[raw]).view(np.uint8), offsets)
    return hashes(LOWER[raw] if lower else raw, starts, ends), np.searchsorted(starts, offsets)


def _eights(raw: np.ndarray) -> np.ndarray:
    """Row i is raw[i : i + 8], zeros standing for what is past the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)


def _eight(rows: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a word, without those past the ``left`` ones of its range."""
    return rows[at].view("<u8").ravel() & _KEEP[np.minimum(left, 8)]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges: eight bytes a step, the state mixed after each; BLAKE2 for long ranges."""
    size = ends - starts
    state = mix64(size.astype(np.uint64) * _SEED + _SEED)
    rows = _eights(raw)
    at = np.flatnonzero((size > 0) & (size <= LONG_RANGE))
    done = 0
    while len(at):
        state[at] = mix64((state[at] ^ _eight(rows, starts[at] + done, size[at] - done)) * _SEED + _SEED)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_RANGE):
        state[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return state


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether every range holds the bytes of the range numbered by ``other``."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    rows = _eights(raw)
    at = np.flatnonzero((size > 0) & (size <= LONG_RANGE) & (other != np.arange(len(size))))
    done = 0
    while len(at):
        left = size[at] - done
        if (_eight(rows, starts[at] + done, left) != _eight(rows, starts[other[at]] + done, left)).any():
            return False
        done += 8
        at = at[size[at] > done]
    return all(np.array_equal(raw[starts[i] : ends[i]], raw[starts[o] : ends[o]]) for i in np.flatnonzero(size > LONG_RANGE) if (o := other[i]) != i)


_STEP = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(word: np.ndarray, first: np.ndarray, k: int):
    """(hash, first shingle of each text) of k-word shingles; a shorter text is one shingle as a whole."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    if not len(word):
        return np.zeros(0, np.uint64), to
    acc = np.zeros(max(0, len(word) - k + 1), np.uint64)
    for j in range(k if len(acc) else 0):
        acc += word[j : len(word) - k + 1 + j] * _STEP[j]
    out = np.empty(int(to[-1]), np.uint64)
    pos = np.arange(to[-1]) - np.repeat(to[:-1] - first[:-1], n)
    short = np.repeat(count < k, n)
    out[~short] = acc[pos[~short]]
    for at in np.flatnonzero((count < k) & (count > 0)):
        w = word[first[at] : first[at + 1]]
        out[to[at]] = np.append(w * _STEP[: len(w)], _STEP[63:] * np.uint64(len(w))).sum(dtype=np.uint64)
    return mix64(out), to
