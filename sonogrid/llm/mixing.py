"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, lang, topic).  Cell weights start at the
cells' tokens and are raked in turn to target shares of sources, languages and
topics until all three margins fit; that is ``cell_weight``.  The sample is raked
likewise, but no cell can give more tokens than it has: a document is kept with
probability min(1, raise) of its cell, and the raises are raked until the kept
tokens' margins fit the targets and their expected sum is ``keep`` of all.  The
draw is a hash of the id, so it is the same in every run.

Targets out of reach.  A value whose target times ``keep`` exceeds all its tokens
is kept whole, and the other targets of its axis rise in proportion.  What it
lacks is in the result: ``source_shortfall``, ``lang_shortfall`` and
``topic_shortfall`` are the target share of the row's value less its expected
share of the sample (below zero: more than its target).  Margins that no sample
can fit together are left where the steps end, and show there as well.

Targets.  Each margin's share of tokens to a power (POWERS): below one it lifts
rare values.  Tokens are words, runs of other than white space.  The topic is
``topic_col`` if given, else a cluster of vocabulary: a text's vector is the square
root of the shares of its words in HASHED buckets, less the mean vector of its
language, and its topic the nearest of TOPICS centres by the cosine.  Centres start
from SEEDS texts at most, drawn by a hash of id and text; then one step over all
texts sets each to the mean of its texts.  The language means are of all texts, too,
for the MAX_MEANS languages with most texts; others share one mean.

Raking ends when no margin is off by TOLERANCE of all tokens, or after STEPS rounds
(BOUNDED_STEPS for the sample); ``mix_gap`` is what the sample's margins were off by
then, so an unfinished fit shows.

Cells are few (sources x languages x topics); up to MAX_CELLS are fitted on the
driver.  Beyond that the cells stay distributed and each raking step is an
aggregation and a join.  Both ways take the same rounds and have the same results to
the last bit: sums are of whole units of 2 ** -59 of the total or less, so no order of
adding changes them, and powers are worked out in decimals.  Margins that no sample
can fit together take all BOUNDED_STEPS rounds, on tables as well.  Document rows are
never shuffled, but for pre-aggregated cell sums; cell rates are joined by broadcast
up to MAX_CELLS.

Edge cases.  Null sources or languages form cells of their own, under ``''``.  A text
without words has no tokens and no topic (``''``), and is kept with its cell's
probability, 1 in a cell without any tokens.  Null ids draw as the empty text;
repeated ids draw alike.  Very long texts are read whole.  Extra columns are carried
along; one with the name of a result is replaced by it (``mixed`` returns all as they
were).  An empty table gives an empty one.
"""

from __future__ import annotations

import decimal
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonogrid.llm import _text
from sonogrid.llm._learn import different, drawn
from sonogrid.llm._store import delete, shared_dir, written

POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
AXES = tuple(POWERS)
KEEP = 0.6
MAX_CELLS = 20_000
STEPS = 60
#: rounds of the bounded raking, wherever it runs
BOUNDED_STEPS = 3000
TOLERANCE = 1e-9
#: raises stay between one over this and this
MOST_RAISE = 1e12
TOPICS = 12
HASHED = 1024
SEEDS = 2000
MAX_MEANS = 64
#: bytes of text whose dense vectors are held at once
SLICE = 1 << 18


def _vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((texts, HASHED) square roots of the shares of hashed words, words of each text)."""
    word, first = _text.words(raw, offsets)
    n = np.diff(first)
    cell = np.repeat(np.arange(len(n)), n) * HASHED + (word >> np.uint64(40)).astype(np.int64) % HASHED
    x = np.bincount(cell, minlength=len(n) * HASHED).reshape(len(n), HASHED).astype(np.float32)
    return np.sqrt(x / np.maximum(1, n)[:, None]), n


def _nearest(x: np.ndarray, lang: np.ndarray, model: dict) -> np.ndarray:
    """Number of the nearest centre of each vector of the numbered languages."""
    # the vector's own length changes nothing: cosines differ by the centres alone.  einsum sums each row
    # by itself, so a text has the same topic in every pass, whatever stands beside it in a batch
    return np.einsum("ij,kj->ik", x - model["means"][lang], model["centres"]).argmax(axis=1)


def _batches(batches, model: dict):
    """(batch, first, last, vectors, words, language numbers) of slices of the texts of each batch."""
    known = {name: i for i, name in enumerate(model["langs"])}
    for batch in batches:
        raw, offsets = _text.utf8(batch.column("text"))
        lang = np.array([known.get(v, len(known)) for v in batch.column("lang").to_pylist()], np.int64)
        for a, b in _text.slices(offsets, SLICE):
            yield batch, a, b, *_vectors(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), lang[a:b]


def _sums(model: dict):
    """mapInArrow: a task's sums of vectors by language, or, given centres, of centred unit vectors by topic; counts in a last column."""
    rows = len(model["centres"]) if "centres" in model else len(model["langs"]) + 1

    def run(batches):
        total = np.zeros((rows, HASHED + 1))
        for _, _, _, x, n, lang in _batches(batches, model):
            to = lang
            if "centres" in model:
                to = _nearest(x, lang, model)
                x = x - model["means"][lang]
                x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
            for row in np.unique(to[n > 0]).tolist():
                some = (to == row) & (n > 0)
                total[row, :-1] += x[some].sum(axis=0, dtype=np.float64)
                total[row, -1] += some.sum()
        for row in np.flatnonzero(total[:, -1]):
            yield pa.RecordBatch.from_arrays([pa.array([int(row)]), pa.array([total[row].tobytes()], pa.binary())], ["row", "sums"])

    return run


def _added(parts: DataFrame, rows: int) -> np.ndarray:
    """The sums of all tasks, on the driver: ``rows`` vectors whatever the input; added in a fixed order of tasks' values."""

    def add(pdf):
        total = sum((np.frombuffer(v, np.float64) for v in sorted(pdf["sums"])), np.zeros(HASHED + 1))
        return pdf.head(1).assign(sums=[total.tobytes()])

    out = np.zeros((rows, HASHED + 1))
    for r in parts.groupBy("row").applyInPandas(add, "row long, sums binary").collect():
        out[r.row] = np.frombuffer(r.sums)
    return out


def _seed_vectors(model: dict):
    def run(batches):
        for batch, a, b, x, n, lang in _batches(batches, model):
            x = x - model["means"][lang]
            x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
            some = np.flatnonzero(n)
            marks = batch.column("mark").slice(a, b - a).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([marks, pa.array([x[i].astype(np.float32).tobytes() for i in some], pa.binary())], ["mark", "x"])

    return run


def centres(x: np.ndarray) -> np.ndarray:
    """TOPICS unit centres at most of unit vectors, from far-off starts by a few steps of k-means."""
    found = [x[0]]
    near = x @ found[0]
    while len(found) < min(TOPICS, len(x)) and near.min() < 1 - 1e-6:
        found.append(x[near.argmin()])
        near = np.maximum(near, x @ found[-1])
    c = np.array(found)
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(1e-9, np.linalg.norm(c, axis=1, keepdims=True))
    return c


def learn_topics(docs: DataFrame) -> dict:
    """The model of topics of (doc_id, lang, text): languages, their means, and centres."""
    names = [r.lang for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_MEANS).collect()]
    model = {"langs": sorted(names)}
    sums = _added(docs.select("lang", "text").mapInArrow(_sums(model), "row long, sums binary"), len(names) + 1)
    model["means"] = (sums[:, :-1] / np.maximum(1, sums[:, -1:])).astype(np.float32)
    marked = docs.withColumn("mark", F.xxhash64("doc_id", "text"))
    n = marked.agg(different("mark")).first()[0]
    chosen = marked.where(drawn(n, SEEDS + SEEDS // 4, "mark")).select("lang", "text", "mark")
    merged = chosen.mapInArrow(_seed_vectors(model), "mark long, x binary").groupBy("mark").agg(F.min("x").alias("x"))
    seeds = [np.frombuffer(r.x, np.float32) for r in merged.orderBy("mark").limit(SEEDS).collect()]
    if not seeds:
        return model | {"centres": np.zeros((1, HASHED), np.float32)}
    model["centres"] = centres(np.array(seeds)).astype(np.float32)
    sums = _added(docs.select("lang", "text").mapInArrow(_sums(model), "row long, sums binary"), len(model["centres"]))[:, :-1]
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    model["centres"] = np.where(size > 0, sums / np.maximum(1e-9, size), model["centres"]).astype(np.float32)
    return model


def _described(shared):
    """mapInArrow: the columns but ``text`` with mix_topic and mix_tokens."""

    def run(batches):
        for batch in batches:
            model, topics, tokens = shared.value, [], []
            for _, _, _, x, n, lang in _batches([batch], model):
                topics += [f"t{t:02d}" if k else "" for t, k in zip(_nearest(x, lang, model), n)]
                tokens.append(n.astype(np.int64))
            kept = [f.name for f in batch.schema if f.name not in ("lang", "text")]
            cols = [*[batch.column(c) for c in kept], pa.array(topics, pa.string()), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "mix_topic", "mix_tokens"])

    return run


def described(rows: DataFrame, model: dict) -> DataFrame:
    """The columns of ``rows`` but lang and text, which it reads, with mix_topic and mix_tokens."""
    kept = [f for f in rows.schema if f.name not in ("lang", "text")]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_described(shared), T.StructType([*kept, T.StructField("mix_topic", T.StringType()), T.StructField("mix_tokens", T.LongType())]))


def _scale(most: float) -> float:
    """The power of two that takes numbers up to ``most`` below 2 ** 60; sums of such whole numbers are the same in any order."""
    return 2.0 ** (60 - math.frexp(most)[1])


def _whole(values: np.ndarray, scale: float) -> float:
    return float(sum(np.rint(values * scale).astype(np.int64).tolist())) / scale


def _by(which: np.ndarray, n: int, values: np.ndarray, scale: float) -> np.ndarray:
    """Sums of ``values`` by the numbers ``which`` below n."""
    out = np.zeros(n, np.int64)
    np.add.at(out, which, np.rint(values * scale).astype(np.int64))
    return out / scale


def _power(have: int, total: int, power: float) -> float:
    """(have / total) ** power by decimals: the same number on every machine."""
    context = decimal.Context(prec=30)
    return float(context.power(context.divide(decimal.Decimal(have), decimal.Decimal(total)), decimal.Decimal(power)))


def _margins(cells: list[tuple[str, str, str]], tokens: np.ndarray, powers: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By axis: the number of each cell's value, the values' target shares and their tokens."""
    total, out = sum(map(int, tokens.tolist())), []
    for axis, power in enumerate(powers.values()):
        known: dict[str, int] = {}
        which = np.array([known.setdefault(c[axis], len(known)) for c in cells], np.int64)
        have = np.zeros(len(known), np.int64)
        np.add.at(have, which, tokens.astype(np.int64))
        goal = np.array([_power(h, total, power) if h else 0.0 for h in have.tolist()])
        out.append((which, goal / _whole(goal, _scale(goal.max())) if total else goal, have.astype(float)))
    return out


def rake(cells: list[tuple[str, str, str]], tokens: np.ndarray, powers=None) -> np.ndarray:
    """Weights of the cells, summing to one, whose margins fit the target shares."""
    powers = powers or POWERS
    weight = tokens / max(1, sum(map(int, tokens.tolist())))
    if not len(cells):
        return weight
    margins, scale = _margins(cells, tokens, powers), _scale(1.0)
    for _ in range(STEPS):
        gap = 0.0
        for which, goal, _ in margins:
            have = _by(which, len(goal), weight, scale)
            gap = max(gap, float(np.abs(have - goal).max()))
            weight = weight * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[which]
        if gap < TOLERANCE:
            break
    return weight


def reachable(goal: np.ndarray, have: np.ndarray, sum_to: float, total: float) -> np.ndarray:
    """Tokens in proportion to ``goal`` that sum to ``sum_to``; where these exceed ``have`` (``total`` in sum), all of ``have``."""
    level, units, shares = sum_to, _scale(total), _scale(goal.max())
    while True:
        aim = np.minimum(have, level * goal)
        free, left = _whole(goal[level * goal < have], shares), sum_to - _whole(aim, units)
        if not free or left <= 1e-12 * sum_to:
            return aim
        level += left / free


def rake_bounded(cells: list[tuple[str, str, str]], tokens: np.ndarray, keep: float, powers=None) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of the cells whose expected tokens fit the reachable targets, each cell's shortfall by axis, and the gap left."""
    powers = powers or POWERS
    total = float(sum(map(int, tokens.tolist())))
    if not total:
        return np.ones(len(cells)), np.zeros((len(cells), len(powers))), 0.0
    scale = _scale(total)
    margins = [(which, goal, reachable(goal, have, keep * total, total)) for which, goal, have in _margins(cells, tokens, powers)]
    up = np.full(len(tokens), float(keep))
    for _ in range(BOUNDED_STEPS):
        gap = 0.0
        for which, _, aim in margins:
            kept = tokens * np.minimum(1, up)
            have, free = _by(which, len(aim), kept, scale), _by(which, len(aim), np.where(up < 1, kept, 0.0), scale)
            gap = max(gap, float(np.abs(have - aim).max()) / total)
            # the sum is concave in a common factor: neither step goes past the aim
            more = 1 + np.divide(aim - have, free, out=np.zeros_like(have), where=free > 0)
            less = np.divide(aim, have, out=np.ones_like(have), where=have > 0)
            up = np.clip(up * np.where(have < aim, more, less)[which], 1 / MOST_RAISE, MOST_RAISE)
        if gap < TOLERANCE:
            break
    kept = tokens * np.minimum(1, up)
    sample = _whole(kept, scale) or 1.0
    short = [(goal - _by(which, len(goal), kept, scale) / sample)[which] for which, goal, _ in margins]
    return np.where(tokens > 0, np.minimum(1, up), 1.0), np.stack(short, axis=1), gap


def _rates_on_driver(cells: DataFrame, keep: float, powers) -> DataFrame:
    # names travel as the hex of their bytes: a name that is no UTF-8 would become another one in Python
    rows = sorted(cells.select(*[F.hex(c).alias(c) for c in CELL], "tokens").collect())  # at most MAX_CELLS
    tokens = np.array([r.tokens for r in rows], float)
    names = [tuple(r[:3]) for r in rows]
    weight = rake(names, tokens, powers)
    p, short, gap = rake_bounded(names, tokens, keep, powers)
    spark = cells.sparkSession
    out = [(*n, float(w), float(q), *map(float, s), float(gap)) for n, w, q, s in zip(names, weight, p, short)]
    shortfalls = ", ".join(f"{axis}_shortfall double" for axis in AXES)
    rates = spark.createDataFrame(out, f"mix_source string, mix_lang string, mix_topic string, cell_weight double, keep_probability double, {shortfalls}, mix_gap double")
    return F.broadcast(rates.withColumns({c: F.unhex(c).cast("string") for c in CELL}))


def _units(value: Column, scale: float) -> Column:
    return F.rint(value * F.lit(scale)).cast("long")


def _sum(value: Column, scale: float) -> Column:
    """The column of ``_by``: sums that come to less than 2 ** 60 units."""
    return F.sum(_units(value, scale)).cast("double") / F.lit(scale)


def _wide_sum(value: Column, scale: float) -> Column:
    """The units of ``_whole``, as a decimal: values below 2 ** 60 units each."""
    return F.sum(_units(value, scale).cast("decimal(38,0)"))


def _powered(total: int, power: float):
    """mapInArrow: (value, tokens) with the power of the share."""

    def run(batches):
        for batch in batches:
            goal = [_power(v, total, power) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(goal, pa.float64())], ["value", "tokens", "goal"])

    return run


def _reachable_distributed(goals: DataFrame, sum_to: float, total: float) -> DataFrame:
    """``goals`` with the column ``aim``, as ``reachable`` has it."""
    level, units = sum_to, _scale(total)
    shares = _scale(goals.agg(F.max("goal")).first()[0] or 1.0)
    have = F.col("tokens").cast("double")
    while True:
        want = F.lit(level) * F.col("goal")
        found = goals.agg(_wide_sum(F.least(have, want), units).alias("aim"), _wide_sum(F.when(want < have, F.col("goal")), shares).alias("free")).first()
        left = sum_to - float(int(found.aim or 0)) / units
        if not found.free or left <= 1e-12 * sum_to:
            return written(goals.withColumn("aim", F.least(have, want)))
        level += left / (float(int(found.free)) / shares)


def _raked(now: DataFrame, goals: dict, steps: int, sums: list[Column], factor: Column, off: Column, moved: Column, column: str) -> tuple[DataFrame, float]:
    """``now`` after rounds that set ``column`` to ``moved``, and the gap of the last round.

    A step sums the cells by an axis and joins a factor for each value.  A round is one job that writes
    the cells; the table of the round before is deleted then, so space doesn't grow with the rounds.
    """
    spark, gap, old = now.sparkSession, 0.0, None
    for _ in range(steps):
        at, apart = shared_dir(spark), []
        for name, goal in goals.items():
            step = now.groupBy(name).agg(*sums).join(goal, name).select(name, factor.alias("factor"), off.alias(f"off_{name}"))
            now = now.join(step, name, "left").withColumn(column, moved).drop("factor")
            apart.append(f"off_{name}")
        now = written(now, at)
        gap = now.agg(F.max(F.greatest(*apart))).first()[0] or 0.0
        now = now.drop(*apart)
        if old:
            delete(spark, old)
        old = at
        if gap < TOLERANCE:
            break
    return now, gap


def _rates_distributed(cells: DataFrame, keep: float, powers) -> DataFrame:
    """The same with cells as a table, to the last bit: the same rounds, sums and factors, each margin an aggregation and a join."""
    tokens = int(cells.agg(F.sum("tokens")).first()[0] or 1)
    total = float(tokens)
    goals = {}
    for axis, power in powers.items():
        name = f"mix_{axis}"
        have = cells.groupBy(name).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        goal = written(have.mapInArrow(_powered(tokens, power), "value string, tokens long, goal double").withColumnRenamed("value", name))
        scale = _scale(goal.agg(F.max("goal")).first()[0] or 1.0)
        whole = float(int(goal.agg(_wide_sum(F.col("goal"), scale)).first()[0] or scale)) / scale
        goals[name] = _reachable_distributed(goal.withColumn("goal", F.col("goal") / F.lit(whole)), keep * total, total).drop("tokens")
    have, free, goal, aim, up, weight, ratio = (F.col(c) for c in ("have", "free", "goal", "aim", "up", "cell_weight", "factor"))
    now = cells.withColumn("cell_weight", F.col("tokens") / F.lit(total))
    step = F.when(have > 0, goal / have).otherwise(0.0)
    now, _ = _raked(now, goals, STEPS, [_sum(weight, _scale(1.0)).alias("have")], step, F.abs(have - goal), weight * F.coalesce(ratio, F.lit(0.0)), "cell_weight")
    kept, scale = F.col("tokens") * F.least(F.lit(1.0), up), _scale(total)
    sums = [_sum(kept, scale).alias("have"), _sum(F.when(up < 1, kept).otherwise(0.0), scale).alias("free")]
    more = F.when(free > 0, 1 + (aim - have) / free).otherwise(1.0)
    less = F.when(have > 0, aim / have).otherwise(1.0)
    moved = F.least(F.lit(MOST_RAISE), F.greatest(F.lit(1 / MOST_RAISE), up * F.coalesce(ratio, F.lit(1.0))))
    now = now.withColumn("up", F.lit(float(keep)))
    now, gap = _raked(now, goals, BOUNDED_STEPS, sums, F.when(have < aim, more).otherwise(less), F.abs(have - aim) / F.lit(total), moved, "up")
    sample = now.agg(_wide_sum(kept, scale)).first()[0]
    sample = float(int(sample or 0)) / scale or 1.0
    for axis in powers:
        name = f"mix_{axis}"
        share = now.groupBy(name).agg((_sum(kept, scale) / F.lit(sample)).alias("share")).join(goals[name], name)
        short = share.select(name, (F.col("goal") - F.col("share")).alias(f"{axis}_shortfall"))
        now = written(now.join(short, name, "left").fillna(0.0, [f"{axis}_shortfall"]))
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("up"))).otherwise(1.0)
    return now.select("mix_source", "mix_lang", "mix_topic", "cell_weight", p.alias("keep_probability"), *[f"{axis}_shortfall" for axis in AXES], F.lit(float(gap)).alias("mix_gap"))


def draw(id_col: str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the id as text."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


CELL = ["mix_source", "mix_lang", "mix_topic"]
RESULTS = [*CELL, "mix_tokens", "cell_weight", "keep_probability", *[f"{axis}_shortfall" for axis in AXES], "mix_gap", "mix_kept"]


def mix(docs: DataFrame, keep: float = KEEP, powers=None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """``docs`` with the columns RESULTS: its cell, tokens, weight, probability, the three shortfalls, the gap and whether it is kept."""
    powers = {axis: (powers or POWERS)[axis] for axis in AXES}
    _text.small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in RESULTS]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    source, lang = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (source_col, lang_col))
    model = learn_topics(docs.select(F.col(f"`{id_col}`").alias("doc_id"), lang.alias("lang"), text))
    # own columns pass through the kernel under numbers, so none clashes with what it adds
    given = docs.select(
        *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(own)],
        draw(f"`{id_col}`").alias("mix_draw"),
        source.alias("mix_source"),
        lang.alias("mix_lang"),
        *([F.coalesce(F.col(f"`{topic_col}`").cast("string"), F.lit("")).alias("given_topic")] if topic_col else []),
        lang.alias("lang"),
        text,
    )
    narrow = given.drop(*[f"own{i}" for i in range(len(own))])

    def celled(rows: DataFrame) -> DataFrame:
        found = described(rows, model)
        return found.withColumn("mix_topic", F.col("given_topic")).drop("given_topic") if topic_col else found

    cells = written(celled(narrow).groupBy(*CELL).agg(F.sum("mix_tokens").alias("tokens")))
    rates = _rates_on_driver(cells, keep, powers) if cells.count() <= MAX_CELLS else _rates_distributed(cells, keep, powers)
    joined = celled(given).join(rates, CELL, "left").withColumn("keep_probability", F.coalesce("keep_probability", F.lit(float(keep))))
    joined = joined.withColumn("mix_kept", F.col("mix_draw") < F.col("keep_probability"))
    return joined.select(*[F.col(f"own{i}").alias(c) for i, c in enumerate(own)], *RESULTS)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of ``docs``, with its own columns only, whatever their names."""
    names = [f"given{i}" for i in range(len(docs.columns))]
    roles = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "lang_col": "lang"}
    roles = {role: names[docs.columns.index(options.pop(role, name))] for role, name in roles.items()}
    if options.get("topic_col"):
        options["topic_col"] = names[docs.columns.index(options["topic_col"])]
    kept = mix(docs.toDF(*names), **roles, **options).where("mix_kept")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
