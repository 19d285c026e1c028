"""Katz back-off language model: Good-Turing discounts, exactly normalised back-off weights.

Bigrams back off to words and words to one unknown type.  With c the training
count, a seen pair has d2(c) * c(h, w) / c(h); an unseen one has alpha(h) * P(w),
where alpha(h) = (1 - sum of the seen pairs' probabilities) / (1 - sum of P(w)
over the seen w), both sums over the whole table of pairs.  P(w) = d1(c) * c / N,
and what the discounts take from the words is the unknown type's.  Counts above
K are not discounted.  If the count-of-counts give no valid discount, half a
count is taken off counts up to K; if nothing is left to back off to, one count
is added to the history for it.  The model of any history sums to one.

Tables.  Texts are cut into blocks of about BLOCK_TOKENS tokens, each written to
the shared folder as its distinct words and a stream of their numbers.  Counts
live in tables partitioned by the hash of the word or pair, in buckets of about
BUCKET_KEYS keys.  A block asks the buckets for the keys it holds, each once, so
a word that is a third of all tokens is one row a block, and gets back one number
a key.  Three rounds (words, pairs, back-off sums) give a block all that its
tokens need; then each token is scored from the pair down to the unknown type.
Nothing but count-of-counts up to K + 1 and totals reaches the driver.

Requests travel by levels of a fixed fan-out.  While blocks and buckets are FAN at
most, blocks ask the buckets themselves.  Beyond that a block asks FAN parts of the
key range; the requests of FAN blocks for one part meet in a task that merges them,
each key once, and asks the next FAN parts within its own, and so on until a part is
a bucket.  Answers go back the same way.  So no task asks or is asked by more than
about FAN others, and the number of requests grows with the blocks times the levels,
which are the logarithm of the input to the base FAN.

The model has no order above two: the requests of triples and of the back-off sums
of pairs would take about twice the disk that pairs take.

Edge cases.  A null or empty text is one end token.  Without training texts all
tokens are unknown with probability one.  Repeated rows and ids are scored each;
a null id is in the training part.  Very long texts are read whole; a block is cut
between texts only, so it may hold one text of any length.  Extra columns are not
read.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm import _text
from sonogrid.llm._store import get_file, put_file, shared_dir, written

BLOCK_TOKENS = 1_500_000
BUCKET_KEYS = 1_000_000
FAN = 512
K = 5
END = np.uint64(0x9D5C1F0B7A3E4C61)
START = np.uint64(0x3B8F5E2D91C07A46)
_REQUEST = "bucket long, block string, keys binary, counts binary"
_REPLY = "block string, bucket long, totals binary, more binary"


def _squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) + len(data).to_bytes(8, "little")


def _expand(data: bytes) -> bytes:
    size = int.from_bytes(data[-8:], "little")
    return pa.decompress(data[:-8], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte: leading bytes are mostly zero and vanish."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _save(uri: str, **arrays) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    put_file(uri, _squeeze(out.getvalue()))


def _load(uri: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(_expand(get_file(uri)))) as got:
        return dict(got)


def _blocks(folder: str):
    """mapInArrow: writes blocks, a row for each."""

    def flush(parts):
        word = np.concatenate([p[0] for p in parts])
        size = np.concatenate([p[1] for p in parts])
        ids = pa.concat_arrays([p[2] for p in parts])
        held = np.concatenate([p[3] for p in parts])
        words, stream = np.unique(word, return_inverse=True)
        uri = f"{folder}/{uuid.uuid4().hex}"
        _save(
            uri,
            words=words,
            stream=stream.astype(np.int32),
            size=size,
            held=held,
            ids=ids.fill_null(0).to_numpy(zero_copy_only=False),
            known=ids.is_valid().to_numpy(zero_copy_only=False),
        )
        train = int(size[~held].sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (uri, len(words), len(word), train, int((~held).sum()))], ["block", "n_words", "n_tokens", "train_tokens", "train_docs"]
        )

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            raw, offsets = _text.utf8(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column("doc_id")
            for a, b in _text.slices(offsets):
                word, first = _text.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                word = np.insert(word, first[1:], END)
                parts.append((word, np.diff(first) + 1, ids.slice(a, b - a), held[a:b]))
                n += len(word)
                if n >= BLOCK_TOKENS:
                    yield flush(parts)
                    parts, n = [], 0
        if parts:
            yield flush(parts)

    return run


def _pack_values(values: np.ndarray) -> bytes:
    """Counts or sums, with a sign of their kind before them; counts in 32 bits where they fit."""
    if values.dtype.kind == "f":
        return b"d" + _squeeze(values.astype(np.float64).tobytes())
    if len(values) and values.max() >= 1 << 31:
        return b"l" + _squeeze(values.astype(np.int64).tobytes())
    return b"i" + _squeeze(values.astype(np.int32).tobytes())


def _unpack_values(data: bytes) -> np.ndarray:
    kind = {b"d": np.float64, b"l": np.int64, b"i": np.int32}[bytes(data[:1])]
    return np.frombuffer(_expand(data[1:]), kind)


class Routes:
    """How requests of so many blocks reach so many buckets: widths of the parts of each level, in buckets; the last is 1."""

    def __init__(self, blocks: int, buckets: int):
        self.blocks, self.buckets, self.widths = blocks, buckets, []
        reach = FAN
        while reach < max(blocks, buckets):
            self.widths.append(-(-buckets // reach))
            reach *= FAN
        self.widths.append(1)

    def asked(self, asker: str, keys: np.ndarray, values: np.ndarray, level: int) -> pd.DataFrame:
        """A request a part for sorted keys; the order of the answers is that of the keys.

        ``values``: a count a key, or a row of sums a key.
        """
        bucket = ((keys >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        parts, at = np.unique(bucket // self.widths[level], return_index=True)
        ends = [*at[1:].tolist(), len(keys)]
        cut = list(zip(at.tolist(), ends))
        return pd.DataFrame(
            {
                "bucket": pd.Series(parts, dtype="int64"),
                "block": pd.Series([asker] * len(cut), dtype=object),
                "keys": pd.Series([_pack_keys(keys[a:b]) for a, b in cut], dtype=object),
                "counts": pd.Series([_pack_values(values[a:b]) for a, b in cut], dtype=object),
            }
        )


def _answered(pdf: pd.DataFrame, column: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(_expand(x), dtype) for x in pdf.sort_values("bucket")[column]] or [np.zeros(0, dtype)])


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct keys, number of each asked key among them, values as asked, keys of each request) of requests in order."""
    asked = [_unpack_keys(x) for x in pdf["keys"]]
    values = [_unpack_values(x) for x in pdf["counts"]]
    values = [v.reshape(len(k), -1) if v.dtype.kind == "f" else v for k, v in zip(asked, values)]
    distinct, which = np.unique(np.concatenate(asked), return_inverse=True)
    return distinct, which, np.concatenate(values), list(map(len, asked))


def _first(which: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marks the first of the requests that has a key in training."""
    own = np.zeros(len(which), np.int64)
    used = np.flatnonzero(counts > 0)
    _, first = np.unique(which[used], return_index=True)
    own[used[first]] = 1
    return own


def _summed(which: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 2:
        return np.stack([np.bincount(which, values[:, i], n) for i in range(values.shape[1])], axis=1)
    return np.bincount(which, values, n).astype(np.int64)


def _replies(pdf: pd.DataFrame, sizes: list[int], totals: np.ndarray, more: np.ndarray | None = None) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    cut = [(e - s, e) for s, e in zip(sizes, ends)]
    return pd.DataFrame(
        {
            "block": pd.Series(list(pdf["block"]), dtype=object),
            "bucket": pd.Series(list(pdf["bucket"]), dtype="int64"),
            "totals": pd.Series([_squeeze(totals[a:b].tobytes()) for a, b in cut], dtype=object),
            "more": pd.Series([None if more is None else _squeeze(more[a:b].tobytes()) for a, b in cut], dtype=object),
        }
    )


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket: for each asked key 2 * total count + (1 for the first asker that has it in training).

    One more row, without block, has the counts of counts: of all keys, of 1 .. K + 1.
    """
    pdf = pdf.sort_values("block")
    distinct, which, counts, sizes = _merged(pdf)
    total = _summed(which, counts, len(distinct))
    kinds = np.bincount(np.minimum(total, K + 2), minlength=K + 3)
    stats = np.concatenate([[int((total > 0).sum())], kinds[1 : K + 2]]).astype(np.int64)
    out = _replies(pdf, sizes, total[which] * 2 + _first(which, counts))
    out.loc[len(out)] = [None, int(pdf["bucket"].iloc[0]), stats.tobytes(), None]
    return out


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket: for each asked history both back-off sums over all blocks."""
    pdf = pdf.sort_values("block")
    distinct, which, pairs, sizes = _merged(pdf)
    a, b = _summed(which, pairs, len(distinct)).T
    return _replies(pdf, sizes, a[which], b[which])


def _combine(routes: Routes, level: int, folder: str):
    """The requests of a group of askers for one part: merged, and asked of the parts of the next level."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        distinct, which, values, sizes = _merged(pdf)
        asker = f"{folder}/{level}.{pdf['part_of'].iloc[0]}.{pdf['bucket'].iloc[0]}"
        own = np.zeros(len(which), np.int64) if values.ndim == 2 else _first(which, values)
        _save(asker, which=which.astype(np.int32), own=own.astype(bool), sizes=np.array(sizes), bucket=pdf["bucket"].to_numpy(), block=np.array(list(pdf["block"])))
        return routes.asked(asker, distinct, _summed(which, values, len(distinct)), level)

    return run


def _distribute(pdf: pd.DataFrame) -> pd.DataFrame:
    """The answers to merged requests, told to those who asked."""
    held = _load(pdf["block"].iloc[0])
    which, sizes = held["which"], held["sizes"].tolist()
    asked = pd.DataFrame({"block": held["block"].tolist(), "bucket": held["bucket"]})
    if pdf["more"].iloc[0] is not None:
        return _replies(asked, sizes, *(_answered(pdf, c, np.float64)[which] for c in ("totals", "more")))
    got = _answered(pdf, "totals", np.int64)[which]
    return _replies(asked, sizes, got - (got & 1) + (got & held["own"]))


def _routed(requests: DataFrame, routes: Routes, folder: str, answer) -> tuple[DataFrame, DataFrame]:
    """(answers to the blocks, rows without block) of requests, by the levels of the routes."""
    folder = f"{folder}/{uuid.uuid4().hex}"
    groups = routes.blocks
    for level in range(1, len(routes.widths)):
        groups = -(-groups // FAN)
        dealt = requests.withColumn("part_of", F.expr(f"cast(pmod(xxhash64(block), {groups}) as long)"))
        requests = dealt.groupBy("part_of", "bucket").applyInPandas(_combine(routes, level, folder), _REQUEST)
    answers = written(requests.groupBy("bucket").applyInPandas(answer, _REPLY))
    told = answers.where("block is not null")
    for _ in range(1, len(routes.widths)):
        told = told.groupBy("block").applyInPandas(_distribute, _REPLY)
    return told, answers.where("block is null")


def discounts(of: np.ndarray) -> np.ndarray:
    """d(0..K): Good-Turing discount factors from the counts of counts of[1..K+1]; d(0) is 1, unused."""
    d = np.ones(K + 1)
    r = np.arange(1, K + 1)
    n = of.astype(float)
    if (n[1:] > 0).all():
        last = (K + 1) * n[K + 1] / n[1]
        if last < 1:
            d[1:] = ((r + 1) * n[r + 1] / n[r] / r - last) / (1 - last)
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        d[1:] = (r - 0.5) / r
    return d


class Words:
    """Discounted word probabilities from the totals."""

    def __init__(self, n: int, of: np.ndarray):
        self.n, self.d = n, discounts(of)
        r = np.arange(1, K + 1)
        self.unknown = float((of[1 : K + 1] * r * (1 - self.d[1:])).sum()) / n if n else 1.0
        self.scale = 1.0
        if n and self.unknown < 1 / (n + 1):
            self.scale, self.unknown = n / (n + 1) / (1 - self.unknown), 1 / (n + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, c * self.d[np.where(c > K, 0, c)] / self.n * self.scale, self.unknown)


def _events(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, word, text) of each token, as numbers of the block's words; len(words) is the start."""
    word = block["stream"].astype(np.int64)
    n_words = len(block["words"])
    history = np.empty_like(word)
    history[1:] = word[:-1]
    ends = np.cumsum(block["size"])
    history[np.concatenate([[0], ends[:-1]])] = n_words
    return history, word, np.repeat(np.arange(len(ends)), block["size"])


def _ask_words(routes: Routes):
    def run(batches):
        for batch in batches:
            for uri in batch.column("block").to_pylist():
                block = _load(uri)
                train = np.repeat(~block["held"], block["size"])
                counts = np.bincount(block["stream"][train], minlength=len(block["words"])).astype(np.int32)
                yield pa.RecordBatch.from_pandas(routes.asked(uri, block["words"], counts, 0), preserve_index=False)

    return run


def _known_pairs(block: dict, c: np.ndarray):
    """(pairs of known words in the order of their keys, keys, training counts); a pair is history * (words + 1) + word.

    Keys keep 54 bits of the hash, with which the packed keys are half as long.
    """
    history, word, text = _events(block)
    n = len(block["words"]) + 1
    known = np.append(c, 1) > 0
    use = known[history] & known[word]
    pair, which = np.unique(history[use] * n + word[use], return_inverse=True)
    counts = np.bincount(which, ~block["held"][text[use]], len(pair)).astype(np.int32)
    hashed = np.append(block["words"], START)
    keys = _text.mix64(hashed[pair // n] * np.uint64(0x9FB21C651E98DF25) + _text.mix64(hashed[pair % n])) >> np.uint64(10) << np.uint64(10)
    order = np.argsort(keys, kind="stable")
    return pair[order], keys[order], counts[order]


def _ask_pairs(routes: Routes):
    """A block's word counts arrive; it keeps them beside it and asks for its pairs of known words."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uri = pdf["block"].iloc[0]
        block = _load(uri)
        c = _answered(pdf, "totals", np.int64) >> 1
        _save(f"{uri}.words", c=c)
        _, keys, counts = _known_pairs(block, c)
        return routes.asked(uri, keys, counts, 0)

    return run


def _seen(block: dict, c: np.ndarray, train_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and the start, those with a training count in the order of their hashes)."""
    hashed = np.append(block["words"], START)
    seen = np.flatnonzero(np.append(c, train_docs) > 0)
    return hashed, seen[np.argsort(hashed[seen])]


def _ask_backoff(routes: Routes, words: Words, d2: np.ndarray, train_docs: int):
    """A block's pair counts arrive; it keeps them and adds its own pairs' shares to the back-off sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uri = pdf["block"].iloc[0]
        block, c = _load(uri), _load(f"{uri}.words")["c"]
        pair = _known_pairs(block, c)[0]
        reply = _answered(pdf, "totals", np.int64)
        c2, own = reply >> 1, (reply & 1) == 1
        n = len(block["words"]) + 1
        h, w = pair[own] // n, pair[own] % n
        mass = c2[own] * d2[np.where(c2[own] > K, 0, c2[own])]
        a = np.bincount(h, mass, n)
        b = np.bincount(h, words.p(c[w]), n)
        _save(f"{uri}.pairs", c2=c2)
        hashed, seen = _seen(block, c, train_docs)
        return routes.asked(uri, hashed[seen], np.stack([a[seen], b[seen]], axis=1).astype(np.float64), 0)

    return run


def _score(words: Words, d2: np.ndarray, train_docs: int, n_train: int, n_types: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uri = pdf["block"].iloc[0]
        block, c, c2 = _load(uri), _load(f"{uri}.words")["c"], _load(f"{uri}.pairs")["c2"]
        n = len(block["words"]) + 1
        ch = np.append(c, train_docs).astype(float)
        left, below = np.ones(n), np.zeros(n)
        _, seen = _seen(block, c, train_docs)
        left[seen] = 1 - _answered(pdf, "totals", np.float64) / np.maximum(1, ch[seen])
        below[seen] = _answered(pdf, "more", np.float64)
        none = (ch > 0) & (left < 1e-9)
        scale = np.where(none, ch / (ch + 1), 1.0)
        left = np.where(none, 1 / (ch + 1), left)
        alpha = np.where(ch > 0, left / np.maximum(1e-12, 1 - below), 1.0)
        pair = _known_pairs(block, c)[0]
        order = np.argsort(pair)
        pair, count = np.append(pair[order], -1), np.append(c2[order], 0)
        del order
        history, word, _ = _events(block)
        at = np.searchsorted(pair[:-1], history * n + word)
        c2 = np.where(pair[at] == history * n + word, count[at], 0)
        p1 = words.p(c)
        direct = c2 * d2[np.where(c2 > K, 0, c2)] / np.maximum(1, ch[history]) * scale[history]
        p = np.where(c2 > 0, direct, alpha[history] * p1[word])
        base = np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1)))
        starts = np.concatenate([[0], np.cumsum(block["size"])[:-1]])
        return pd.DataFrame(
            {
                "doc_id": pd.Series(pd.arrays.IntegerArray(block["ids"].copy(), ~block["known"])),
                "held_out": block["held"],
                "n_tokens": block["size"].astype(np.int64),
                "n_known": np.add.reduceat((c[word] > 0).astype(np.int64), starts),
                "train_tokens": np.full(len(starts), n_train, np.int64),
                "base_score": np.add.reduceat(base[word], starts),
                "score": np.add.reduceat(np.log10(p), starts),
            }
        )

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Model and base score of each row; rows with held_out true are not learned from."""
    spark = docs.sparkSession
    _text.small_batches(spark)
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out)
    folder = shared_dir(spark)
    blocks = written(given.mapInArrow(_blocks(folder), "block string, n_words long, n_tokens long, train_tokens long, train_docs long"))
    size = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in blocks.columns[1:]], F.count(F.lit(1)).alias("n")).first()
    if not size.n:
        return spark.createDataFrame([], SCORED)
    few = Routes(size.n, max(1, size.n_words // BUCKET_KEYS))
    many = Routes(size.n, max(1, size.n_tokens // 2 // BUCKET_KEYS))

    spread = blocks.select("block").repartition(int(size.n), "block")
    replies, stats = _routed(spread.mapInArrow(_ask_words(few), _REQUEST), few, folder, _totals)

    def counted(replies: DataFrame) -> np.ndarray:
        """Distinct keys, then how many have counts 1 .. K + 1, summed over the buckets."""

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum((np.frombuffer(x, np.int64) for x in pdf["totals"]), np.zeros(K + 2, np.int64))
            return pd.DataFrame({"part": [0], **{f"s{i}": [total[i]] for i in range(K + 2)}})

        fields = ", ".join(f"s{i} long" for i in range(K + 2))
        stats = replies.withColumn("part", F.expr("bucket div 1024"))
        parts = stats.groupBy("part").applyInPandas(add, f"part long, {fields}")
        return np.array(parts.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)) for i in range(K + 2)]).first(), np.int64)

    of1 = counted(stats)
    words = Words(size.train_tokens, of1)
    replies, stats = _routed(replies.groupBy("block").applyInPandas(_ask_pairs(many), _REQUEST), many, folder, _totals)
    d2 = discounts(counted(stats))
    replies = written(replies) if len(many.widths) > 1 else replies
    # a block none of whose pairs are known still has its words
    replies = replies.unionByName(
        spread.join(replies.select("block").distinct(), "block", "left_anti").select("block", F.lit(0).cast("long").alias("bucket"), F.lit(b"").alias("totals"), F.lit(None).cast("binary").alias("more"))
    )
    sums, _ = _routed(replies.groupBy("block").applyInPandas(_ask_backoff(few, words, d2, size.train_docs), _REQUEST), few, folder, _sums)
    sums = written(sums) if len(few.widths) > 1 else sums
    sums = sums.unionByName(
        spread.join(sums.select("block").distinct(), "block", "left_anti").select("block", F.lit(0).cast("long").alias("bucket"), F.lit(b"").alias("totals"), F.lit(b"").alias("more"))
    )
    return sums.groupBy("block").applyInPandas(_score(words, d2, size.train_docs, size.train_tokens, int(of1[0])), SCORED)
