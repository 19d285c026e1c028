"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the pattern of public byte-level vocabularies; each piece is
merged by itself.  For a piece, the leaves of a segment tree hold the rank of
the pair that starts at each live position, and every inner node the least
(rank, position) below it, so the root is the leftmost pair of least rank.  A
merge updates the leaves of the merged position, of its right neighbour (now
dead) and of its left one: logarithmic work a merge, whatever the length.

The cutting is done on whole batches of bytes by class tables.  The distinct
new pieces of a slice of text are merged side by side, one merge of each at a
time, their trees being rows of one array; pieces of over MAX_SIDE bytes have a
tree of their own.  Encoded pieces are kept in two generations of at most
MAX_CACHED pieces each, which bounds a worker's memory.  The rank table is read by
the driver and sent along (the vocabulary has a fixed size).

Edge cases.  A null or empty text has no tokens.  Bytes that the vocabulary
lacks cannot occur: it holds all 256 single bytes (checked).  Special tokens
are ordinary text.  Rows are independent: ids may be null or repeated.
Other columns are not read.  Equal pieces of a slice are found by hash and compared
by bytes.  A text longer than a slice is a slice of its own, encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sonogrid.llm import _text

MAX_CACHED = 1 << 16
MAX_SIDE = 64
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as got:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, got)}


class SegmentTree:
    """Least (rank, position) over positions, as one integer rank * size + position."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        tree = [_NONE] * size + [r * size + i if r < _NONE else _NONE for i, r in enumerate(ranks)] + [_NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.tree = tree

    def least(self) -> int:
        return self.tree[1]

    def put(self, at: int, rank: int) -> None:
        tree = self.tree
        i = at + self.size
        tree[i] = rank * self.size + at if rank < _NONE else _NONE
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the live token to the left
    tree = SegmentTree([get(piece[i : i + 2], _NONE) for i in range(n - 1)])
    while (least := tree.least()) < _NONE:
        at = least % tree.size
        gone = end[at]
        stop = end[at] = end[gone]
        if gone < n - 1:
            tree.put(gone, _NONE)
        if stop < n:
            before[stop] = at
            tree.put(at, get(piece[at : end[stop]], _NONE))
        else:
            tree.put(at, _NONE)
        left = before[at]
        if left >= 0:
            tree.put(left, get(piece[left:stop], _NONE))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class PairTable:
    """Rank of the token that two adjacent tokens make, by arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], 1 << 62)
        self.values = np.append(np.array(values, np.int64)[order], 0)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)


def merge_side_by_side(pieces: list[bytes], size: int, single: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Ids (as little-endian unsigned 32-bit integers) of pieces of 1 to ``size`` bytes; size is a power of two."""
    m = len(pieces)
    n = np.fromiter(map(len, pieces), np.int64, m)
    live = np.arange(size) < n[:, None]
    token = np.full((m, size + 1), -1, np.int64)
    token[:, :size][live] = single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.tile(np.arange(1, size + 1), (m, 1))  # next live position
    before = np.tile(np.arange(-1, size), (m, 1))
    tree = np.full((m, 2 * size), _NONE, np.int64)
    i, j = np.nonzero(np.arange(size) < n[:, None] - 1)
    rank = pairs.ranks(token[i, j], token[i, j + 1])
    tree[i, j + size] = np.where(rank < _NONE, rank * size + j, _NONE)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(rows, at, rank):
        node = at + size
        tree[rows, node] = np.where(rank < _NONE, rank * size + at, _NONE)
        for _ in range(size.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.arange(m)
    while True:
        rows = rows[tree[rows, 1] < _NONE]
        if not len(rows):
            break
        least = tree[rows, 1]
        at = least % size
        token[rows, at] = least // size
        gone = after[rows, at]
        stop = after[rows, gone]
        after[rows, at] = stop
        before[rows, stop] = at
        live[rows, gone] = False
        put(rows, gone, np.full(len(rows), _NONE))
        has = stop < n[rows]
        put(rows, at, np.where(has, pairs.ranks(token[rows, at], np.where(has, token[rows, stop], 0)), _NONE))
        left = before[rows, at]
        has = left >= 0
        put(rows[has], left[has], pairs.ranks(token[rows[has], left[has]], token[rows[has], at[has]]))
    ids = token[:, :size][live].astype("<u4").tobytes()
    to = np.cumsum(live.sum(axis=1)) * 4
    return [ids[a:b] for a, b in zip([0, *to[:-1].tolist()], to.tolist())]


_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    if not _classes:
        import regex

        table = np.full(0x110000, _OTHER, np.uint8)
        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, text):
                low, high = ord(m[0][0]), ord(m[0][-1])
                table[low : high + 1] = np.where((np.arange(low, high + 1) >= 0xD800) & (np.arange(low, high + 1) < 0xE000), _OTHER, kind)
        _classes.append(table)
    return _classes[0]


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pattern's pieces start, for texts raw[offsets[i]:offsets[i + 1]].

    The pattern: a contraction ('s 't 're 've 'm 'll 'd), or a run of letters,
    of numbers or of others with one space before it, or white space, of which
    the last character is left to what follows.
    """
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # byte position of each character
    n = len(at)
    if not n:
        return np.zeros(0, np.int64)
    b0 = raw[at].astype(np.int32)
    code = b0.copy()
    if (b0 >= 0x80).any():
        pad = np.concatenate([raw, np.zeros(3, np.uint8)])
        for low, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
            i = np.flatnonzero((b0 >= low) & (b0 < (low | mask) + 1))
            if len(i):
                c = b0[i] & mask
                for j in range(1, size):
                    c = (c << 6) | (pad[at[i] + j] & 0x3F)
                code[i] = c
    kind = char_classes()[code]
    first = np.zeros(n + 1, bool)  # characters that start a text
    first[np.searchsorted(at, offsets)] = True
    new = np.empty(n, bool)  # starts a run of one class
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= first[:n]
    starts = new.copy()
    # the last character of a white space run that something follows: a piece of its own or part of the next
    follows = np.flatnonzero(new[1:] & ~first[1:n] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    starts[follows - 1] = True
    blank = code[follows - 1] == 32
    starts[follows[blank]] = False
    # contractions
    quote = np.flatnonzero((code == 39) & starts & (kind == _OTHER))
    quote = quote[quote + 1 < n]
    quote = quote[new[quote + 1] & ~first[quote + 1]]
    if len(quote):
        wide = np.concatenate([code, [0, 0]])
        same = np.concatenate([first[:n], [True, True, True]])
        c1 = wide[quote + 1]
        c2 = np.where(same[quote + 2], 0, wide[np.minimum(quote + 2, n)])
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        starts[quote[one | two] + 1] = False
        for chosen, size in ((one, 2), (two, 3)):
            after = quote[chosen] + size
            after = after[after < n]
            starts[after] = True
    return at[starts]


class Encoder:
    """Encodes slices of texts; holds the ranks and a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold all single bytes")
        self.ranks = ranks
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(ranks)
        by_id = sorted(ranks.items(), key=lambda kv: kv[1])
        self.sizes = np.zeros(by_id[-1][1] + 1, np.int64)
        self.at = np.zeros(by_id[-1][1] + 2, np.int64)
        for token, rank in by_id:
            self.sizes[rank] = len(token)
        self.at[1:] = np.cumsum(self.sizes)
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)

    def pieces(self, wanted: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        new, old, ranks = self.new, self.old, self.ranks
        out = []
        missing: dict[int, list[int]] = {}
        for k, piece in enumerate(wanted):
            got = new.get(piece)
            if got is None:
                got = old.get(piece)
                if got is None:
                    whole = ranks.get(piece)
                    if whole is not None:
                        got = whole.to_bytes(4, "little")
                    else:
                        n = len(piece)
                        missing.setdefault(8 if n <= 8 else 16 if n <= 16 else MAX_SIDE if n <= MAX_SIDE else 0, []).append(k)
                if got is not None:
                    new[piece] = got
            out.append(got)
        for size, at in missing.items():
            if size:
                for k, got in zip(at, merge_side_by_side([wanted[k] for k in at], size, self.single, self.pairs)):
                    out[k] = new[wanted[k]] = got
            else:
                for k in at:
                    out[k] = np.array(merge_piece(wanted[k], ranks), "<u4").tobytes()
        if len(new) > MAX_CACHED:
            self.old, self.new = new, {}
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text)."""
        starts = piece_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(raw))
        _, first, which = np.unique(_text.hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if not _text.same_bytes(raw, starts, ends, first[which]):  # two pieces of one hash: each by itself
            first = which = np.arange(len(starts))
        data = raw.tobytes()
        parts = self.pieces([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, at = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        n = size[which]
        to = np.cumsum(n)
        ids = flat[np.arange(to[-1]) + np.repeat(at[which] - (to - n), n)]
        return ids, np.concatenate([[0], to])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.sizes[ids]
        to = np.cumsum(n)
        if not len(to):
            return b""
        return self.bytes[np.arange(to[-1]) + np.repeat(self.at[ids] - (to - n), n)].tobytes()


_encoders: dict[str, Encoder] = {}


def _encoder(ranks: dict[bytes, int], name: str) -> Encoder:
    """The encoder of this worker process, with its cache, for one vocabulary."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(ranks)
    return _encoders[name]


def _coder(shared, name: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        coder = _encoder(shared.value, name)
        for batch in batches:
            raw, offsets = _text.utf8(batch.column("text"))
            n_tokens, ids_sha, text_sha, kept = [], [], [], []
            for a, b in _text.slices(offsets):
                ids, to = coder.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = ids.astype("<u4")
                for i in range(b - a):
                    own = ids[to[i] : to[i + 1]]
                    n_tokens.append(len(own))
                    ids_sha.append(hashlib.sha256(own).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(own)).hexdigest())
                    if keep_ids:
                        kept.append(own.astype(np.int32))
            cols = [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with keep_ids the ids.

    ``vocabulary`` is the path of a rank file on the driver.
    """
    _text.small_batches(docs.sparkSession)
    ranks = load_ranks(vocabulary)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    id_type = docs.schema[id_col].dataType
    out = [T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        out.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    given = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return given.mapInArrow(_coder(shared, name, keep_ids), T.StructType(out))
