"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  One logistic regression on hashed byte
n-grams (A-Z lower-cased) predicts each bit.  Decoding sums, for each language,
the logistic losses of its bits, weighted by how well each bit is predicted for
that language in training, and takes the least; a text is flagged ambiguous
where the runner-up is within AMBIGUOUS of it.

Up to six languages get the exhaustive code of 2**(L-1) - 1 bits, more get
seeded random codewords of 12 * log2(L) bits.  The classifiers are fitted on
MAX_TRAIN texts at most (a documented bound), an equal share from each language,
the first by a hash of id and text; everything else reads all rows, whole texts.

Edge cases.  A null text, an empty one or one without a letter is ``und`` with
score 0.  Without any labelled text all are ``und``.  Null languages are not
learned from.  More than MAX_LANGUAGES languages are an error.  Repeated rows and null
ids are scored like others, and rows alike in id and text are learned from once;
ties between languages go to the first by name.  Texts longer than FEATURE_BYTES are
scored whole, one at a time.  Extra columns are not read; carried ones may have any
name but doc_id, text and those of the results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonogrid.llm import _text
from sonogrid.llm._learn import Adam, different, drawn

BUCKETS = 4096
DIM = BUCKETS + 256
MAX_TRAIN = 4000
#: bytes of text whose dense features are held at once
FEATURE_BYTES = 1 << 17
MAX_LANGUAGES = 1000
AMBIGUOUS = 0.02


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors (texts, DIM): square roots of the shares of byte trigrams and of single bytes."""
    n = len(offsets) - 1
    b = _text.LOWER[raw].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    hashed = [row * DIM + BUCKETS + b]
    if len(b) >= 3:
        h = ((b[:-2] * 0x1F123BB5 + b[1:-1] * 0x2C1B3C6D + b[2:] * 0x297A2D39) >> 7) & (BUCKETS - 1)
        inside = row[:-2] == row[2:]
        hashed.append((row[:-2] * DIM + h)[inside])
    x = np.bincount(np.concatenate(hashed), minlength=n * DIM).reshape(n, DIM).astype(np.float32)
    return np.sqrt(x / np.maximum(1, x.sum(axis=1, keepdims=True)))


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of -1 and 1, rows and columns distinct."""
    if n <= 6:
        columns = [[1 if l == 0 or (c >> (l - 1)) & 1 else -1 for l in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.float32).reshape(-1, n).T
    bits = int(np.ceil(12 * np.log2(n)))
    rng = np.random.Generator(np.random.PCG64(7))
    while True:
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        if len(np.unique(code, axis=0)) == n:
            return code


def fit(x: np.ndarray, y: np.ndarray, n: int, epochs: int = 250) -> dict:
    """Bit classifiers and their weights for labels y in 0..n-1."""
    code = codewords(n)
    target = code[y]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    adam = Adam([w, b], 0.1)
    for _ in range(epochs):
        m = np.clip((x @ w + b) * target, -30, 30)
        g = -target / (1 + np.exp(m)) / len(x)
        adam.step([x.T @ g + 1e-5 * w, g.sum(axis=0)])
    right = ((x @ w + b) * target) > 0
    trust = np.array([[right[y == l, j].mean() if (y == l).any() else 0.5 for j in range(code.shape[1])] for l in range(n)], np.float32)
    trust = trust.reshape(n, -1)
    return {"code": code, "w": w, "b": b, "trust": trust / np.maximum(1e-9, trust.sum(axis=1, keepdims=True))}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) by the least weighted loss."""
    n, bits = model["code"].shape
    if not bits:
        return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
    m = x @ model["w"] + model["b"]
    loss = np.stack([(np.logaddexp(0, -m * model["code"][l]) * model["trust"][l]).sum(axis=1) for l in range(n)], axis=1)
    best = loss.argmin(axis=1)
    two = np.partition(loss, 1, axis=1)[:, :2]
    p = np.exp(-bits * (loss - two[:, :1]))
    return best, 1 / p.sum(axis=1), two[:, 1] - two[:, 0] < AMBIGUOUS


def _letters(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter."""
    low = raw | 0x20
    seen = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _featured(batches):
    """mapInArrow: language, mark and packed vector; most of a vector is zeros, and the driver gathers them."""
    for batch in batches:
        raw, offsets = _text.utf8(batch.column("text"))
        rows = []
        for a, b in _text.slices(offsets, FEATURE_BYTES):
            rows += [zlib.compress(r.astype(np.float16).tobytes(), 1) for r in features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("mark"), pa.array(rows, pa.binary())], ["lang", "mark", "x"])


def train(docs: DataFrame, usable) -> tuple[list[str], dict] | None:
    """Languages and model from the usable rows of (doc_id, text, lang)."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(different("doc_id", "text").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = MAX_TRAIN // len(counts)
    chosen = F.lit(False)
    for lang, n in counts.items():
        # half as many again and a few, so that a rare language is not missed; the first ``share`` are used
        chosen = chosen | ((F.col("lang") == lang) & drawn(n, share + share // 2 + 30, "doc_id", "text"))
    marked = rows.where(chosen).select("lang", F.xxhash64("doc_id", "text").alias("mark"), "text")
    merged = marked.mapInArrow(_featured, "lang string, mark long, x binary").groupBy("lang", "mark").agg(F.min("x").alias("x"))
    ranked = merged.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("nth") <= share)
    got = sorted((r.lang, zlib.decompress(r.x)) for r in ranked.select("lang", "x").collect())  # at most MAX_TRAIN rows
    if not got:
        return None
    langs = sorted({lang for lang, _ in got})
    y = np.array([langs.index(lang) for lang, _ in got])
    x = np.empty((len(got), DIM), np.float32)
    for i, (_, raw) in enumerate(got):
        x[i] = np.frombuffer(raw, np.float16)
    del got
    return langs, fit(x, y, len(langs))


def _scorer(shared):
    def run(batches):
        learnt = shared.value
        for batch in batches:
            raw, offsets = _text.utf8(batch.column("text"))
            lang, score, unsure = [], [], []
            for a, b in _text.slices(offsets, FEATURE_BYTES):
                r, o = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                has = _letters(r, o)
                if learnt is None:
                    best, p, amb = np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool)
                    has[:] = False
                else:
                    best, p, amb = decode(learnt[1], features(r, o))
                lang += [learnt[0][l] if h else "und" for l, h in zip(best, has)]
                score += np.where(has, p, 0.0).tolist()
                unsure += (amb | ~has).tolist()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns) if batch.schema.field(i).name != "text"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                [*[f.name for f in batch.schema if f.name != "text"], "lang_pred", "score", "ambiguous"],
            )

    return run


def identify_languages(docs: DataFrame, usable=None, carry=(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the carried columns, lang_pred, score and ambiguous for each row.

    ``usable`` restricts the rows learnt from; ``carry`` is (name, column) pairs.
    """
    spark = docs.sparkSession
    _text.small_batches(spark)
    usable = F.lit(True) if usable is None else usable
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shared = spark.sparkContext.broadcast(train(known, usable))
    given = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in carry], F.col(text_col).alias("text"))
    own = [f for f in given.schema if f.name != "text"]
    found = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return given.mapInArrow(_scorer(shared), T.StructType([*own, *found]))
