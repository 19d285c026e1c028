"""Quality classifier on random-indexing word vectors.

Tokens are runs of one kind of byte: small letters and all bytes from 0x80,
capitals, digits, other signs.  Each hashes to one of BUCKETS rows.  A row has
a sparse random index vector (two entries of -1 or 1); its word vector is the
sum of the index vectors of all neighbours within WINDOW tokens, over all texts
of the corpus, scaled to unit length, beside its own index vector.  A text is
the mean of its tokens' vectors with the logarithm of their number.  A
two-layer numpy network scores it; a temperature fitted on a part of the
training rows calibrates the probability.

The network is fitted on MAX_TRAIN labelled texts at most, the first by a hash of id,
label and text (a documented bound).  The table of vectors has a fixed size; it is summed
over all tasks from partial tables.

Edge cases.  A null text is empty; a text without tokens has the zero vector
and gets the network's score of it.  Labels that are null or neither 0 nor 1
are not used; several labels of one id count as several rows, but rows alike in id,
label and text once.  With fewer than LEAST_TRAIN labelled texts, or without labels of
both kinds, every score is the share of label 1 (0.5 without any).  Null and repeated
ids are scored like others.  Very long texts are pooled whole, one at a time.  Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm import _sketch, _text
from sonogrid.llm._learn import Adam, different, drawn

BUCKETS = 1 << 15
DIM = 32
WINDOW = 2
MAX_TRAIN = 12000
HIDDEN = 32
LEAST_TRAIN = 10

_KIND = np.full(256, 4, np.uint8)
_KIND[_text.IS_SPACE] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3

_rng = np.random.Generator(np.random.PCG64(11))
INDEX_AT = np.stack([_rng.permutation(DIM)[:2] for _ in range(BUCKETS)])
INDEX_SIGN = _rng.choice(np.array([-1, 1]), (BUCKETS, 2))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, first token of each text)."""
    starts, ends = _text.runs(_KIND[raw], offsets)
    return (_text.hashes(raw, starts, ends) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), np.searchsorted(starts, offsets)


def _contexts(batches):
    """mapInArrow: the task's sums of neighbours' index vectors."""
    total = np.zeros(BUCKETS * DIM, np.int64)
    for batch in batches:
        raw, offsets = _text.utf8(batch.column("text"))
        for a, b in _text.slices(offsets):
            at, first = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            text = np.repeat(np.arange(b - a), np.diff(first))
            cells, signs = [], []
            for gap in range(1, WINDOW + 1):
                if len(at) <= gap:
                    continue
                same = text[gap:] == text[:-gap]
                x, y = at[gap:][same], at[:-gap][same]
                for u, v in ((x, y), (y, x)):
                    cells.append((u[:, None] * DIM + INDEX_AT[v]).ravel())
                    signs.append(INDEX_SIGN[v].ravel())
            if cells:
                total += np.bincount(np.concatenate(cells), np.concatenate(signs), BUCKETS * DIM).astype(np.int64)
    yield from _sketch.chunks(total)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, 2 * DIM): unit context vectors beside index vectors."""
    sums = _sketch.total(docs.select("text").mapInArrow(_contexts, _sketch.SCHEMA), BUCKETS * DIM).reshape(BUCKETS, DIM).astype(np.float32)
    sums /= np.maximum(1, np.linalg.norm(sums, axis=1, keepdims=True))
    own = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(own, INDEX_AT, INDEX_SIGN.astype(np.float32), axis=1)
    return np.hstack([sums, own])


def pooled(vectors: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIM + 1) mean vectors and log sizes."""
    at, first = tokens(raw, offsets)
    n = np.diff(first)
    out = np.zeros((len(n), vectors.shape[1] + 1), np.float32)
    some = np.flatnonzero(n > 0)
    if len(some):
        # whole texts, in blocks of tokens that bound the gathered rows
        for lo in range(0, len(some), 64):
            part = some[lo : lo + 64]
            t0, t1 = first[part[0]], first[part[-1] + 1]
            if t1 - t0 > 1 << 18:
                for i in part:
                    counts = np.bincount(at[first[i] : first[i + 1]], minlength=BUCKETS).astype(np.float32)
                    out[i, :-1] = counts @ vectors
            else:
                out[part, :-1] = np.add.reduceat(vectors[at[t0:t1]], first[part] - t0, axis=0)
        out[some, :-1] /= n[some, None]
    out[:, -1] = np.log1p(n) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 400) -> dict:
    """Network and temperature; a fifth of the rows is kept for the temperature."""
    if len(y) < LEAST_TRAIN or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.5}
    rng = np.random.Generator(np.random.PCG64(3))
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    z = (x - mean) / scale
    params = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    adam = Adam(params, 0.01)
    t, target = z[used], y[used]
    for _ in range(epochs):
        w1, b1, w2, b2 = params
        h = np.tanh(t @ w1 + b1)
        g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - target) / len(t)
        back = np.outer(g, w2) * (1 - h * h)
        adam.step([t.T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ g + 1e-4 * w2, np.array([g.sum()])])
    model = {"mean": mean, "scale": scale, "params": params, "temperature": 1.0}
    logits, own = _logits(model, x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -(2 * own - 1) * logits / g)) for g in grid]
    model["temperature"] = float(grid[int(np.argmin(loss))])
    return model


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = model["params"]
    return np.tanh((x - model["mean"]) / model["scale"] @ w1 + b1) @ w2 + b2


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), model["share"])
    return 1 / (1 + np.exp(-np.clip(_logits(model, x) / model["temperature"], -50, 50)))


def _pool_rows(shared):
    def run(batches):
        for batch in batches:
            raw, offsets = _text.utf8(batch.column("text"))
            rows = [r.tobytes() for a, b in _text.slices(offsets) for r in pooled(shared.value, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("mark"), pa.array(rows, pa.binary())], ["quality", "mark", "x"])

    return run


def _scorer(shared):
    def run(batches):
        vectors, model = shared.value
        for batch in batches:
            raw, offsets = _text.utf8(batch.column("text"))
            parts = [predict(model, pooled(vectors, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in _text.slices(offsets)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row; rows with held_out true lend no label."""
    spark = docs.sparkSession
    _text.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out)
    vectors = word_vectors(docs)
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where("quality in (0, 1) and doc_id is not null").withColumn("held_out", held_out).where("not held_out").drop("held_out")
    usable = usable.distinct()
    chosen = usable.where(drawn(usable.count(), MAX_TRAIN, "doc_id"))  # about MAX_TRAIN ids, two labels each at most
    labelled = docs.join(F.broadcast(chosen), "doc_id").select("quality", F.xxhash64("doc_id", "quality", "text").alias("mark"), "text")
    # ids may repeat: the rows are drawn again, and equal ones merged
    n = labelled.agg(different("mark")).first()[0]
    sample = labelled.where(drawn(n, MAX_TRAIN + MAX_TRAIN // 4, "mark")).mapInArrow(_pool_rows(spark.sparkContext.broadcast(vectors)), "quality int, mark long, x binary")
    got = sample.groupBy("quality", "mark").agg(F.min("x").alias("x")).orderBy("mark").limit(MAX_TRAIN).select("quality", "x").collect()
    got.sort(key=lambda r: (bytes(r.x), r.quality))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float64).reshape(len(got), vectors.shape[1] + 1)
    model = fit(x, np.array([r.quality for r in got], np.float64))
    shared = spark.sparkContext.broadcast((vectors, model))
    return docs.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double, predicted int")
