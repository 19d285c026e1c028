"""N-gram Jaccard self-join by adaptive multi-match prefixes, with its link classes.

A text is the set of its distinct k-word shingles (64-bit hashes).  Two texts
link when ``den * |A & B| >= num * |A | B|``.

1.  One pass hashes each text's set to 128 bits.  Texts with equal sets form a
    class; the class goes on as one.
2.  A second pass takes from each set its tokens whose hash lies in the lowest
    LISTED * (1 - t) of all hashes, and further ones by hash where these do not
    fill the longest prefix.  The frequencies of the listed tokens are counted
    exactly, but for those that a sample of the texts finds in more than one text of
    HOT_SHARE: these get the sample's estimate, so that no task gathers their
    postings (any number will do that is the same for all texts).  The global order
    is: listed tokens by (frequency, hash), then the others by hash; so prefixes
    fill with listed tokens that occur once, which need no posting.  With matches
    required l = 1 a prefix has n - T + 1 tokens, T being the least overlap with any
    partner; each further required match lengthens it by one token.  Each text takes
    the l of 1..MAX_MATCHES with the least estimated cost: the frequencies summed
    over the prefix (postings to read) plus VERIFY times that sum / l (a bound on
    the candidates that reach l matches).  A pair uses the smaller l of the two.
3.  Tokens with one posting left are dropped.  The rest get a 512-bit parity bitmap
    of their set, which bounds the difference of two sets from below.
4.  Star rounds, over lists of LONG or more: every text of a list meets one text of it,
    in the first round the list's most central one, that with the least share of
    tokens no other text has, then the most central one of a random part of about PART
    texts, drawn anew for each round and list.  Links found are merged into classes, so
    that a group of thousands of near copies costs about one pair a posting and round,
    not all pairs.  Rounds go on while the lists hold more than DIRECT pairs of different
    classes a posting and (from the second on) each round lowers that by a tenth.
5.  Full round: pairs in a list that still lie in different classes meet.  A pair
    must pass the size and bitmap bounds, the positional bound (what lies before
    and behind the token in both orders must suffice for the overlap the two sizes
    ask for) and share l tokens of prefixes as short as the two sizes allow.  Each
    text carries its first EARLY posted tokens, by which a pair is made once, at
    its l-th shared token, not once a shared token; where the l-th lies further
    back it is counted.  Pairs whose parity maps of two bits a token (any size of
    set) leave a link possible are verified by the exact sets.  Every pair that may
    link is either verified or already in one class, so the classes are those of
    all links.

The full round's candidates are near misses: pairs of different classes whose
similarity is below the threshold, but not by much.  A group whose members are all
near misses of each other has as many as its pairs; they are one row a pair, made
by many tasks.

Lists longer than BLOCK meet block by block, each pair of blocks in a task.
Sets of candidates alone are hashed again for verification; their ids are
broadcast while there are at most MAX_BROADCAST_IDS, else the texts are joined.

Edge cases.  A text of fewer than k words is one shingle, the whole sequence; a
null text or one without words has an empty set and links with nothing.  Very long
texts are hashed whole, one at a time.  Rows repeated with their id give repeated
rows of one class; an id is taken to name one text.  A row without id gets the
component of an equal set if there is one, else null.  Extra columns are not read,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.llm import _text
from sonogrid.llm._store import written
from sonogrid.llm.components import components, contracted

LISTED = 2.0
MAX_MATCHES = 4
VERIFY = 8.0
BLOCK = 2048
MAX_BROADCAST_IDS = 1_000_000
#: first posted tokens that a text carries into the full round
EARLY = 16
#: pairs a posting that are left to the full round at once
DIRECT = 4
MAX_STARS = 8
LONG = 32
PART = 64
#: texts of which one is sampled for hot tokens; share and least number of sampled texts that make a token hot
SAMPLE = 16
HOT_SHARE = 1000
HOT_LEAST = 64
MAP_WORDS = 8


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch with any."""
    raw, offsets = _text.utf8(batch.column("text"))
    for a, b in _text.slices(offsets):
        word, first = _text.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashed, to = _text.shingles(word, first, k)
        for i in range(b - a):
            if to[i] < to[i + 1]:
                s = np.sort(hashed[to[i] : to[i + 1]])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield a + i, s[keep]


def _summaries(k: int):
    """mapInArrow: size and two sums of hashes of each text's set."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, s in _sets(batch, k):
                size[row] = len(s)
                k1[row] = _text.mix64(s).sum(dtype=np.uint64).view(np.int64)
                k2[row] = _text.mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(k1), pa.array(k2)], ["doc_id", "n", "k1", "k2"])

    return run


def least_overlap(n: int, num: int, den: int) -> int:
    """Smallest overlap of a set of n with any set it links with."""
    return -(-num * n // den)


def matches_by_cost() -> str:
    """SQL: the required matches whose cost f{l} * (1 + VERIFY / l) is least, f{l} being the frequencies summed over the prefix for l."""
    costs = [f"f{m} * {1 + VERIFY / m}D" for m in range(1, MAX_MATCHES + 1)]
    least = f"least({', '.join(costs)})"
    return "case " + " ".join(f"when {c} <= {least} then {m}" for m, c in enumerate(costs, 1)) + " end"


def _listed(k: int, num: int, den: int):
    """mapInArrow: of each text its first tokens by hash, all listed ones and at least the longest prefix."""
    bound = np.uint64(min(2**64 - 1, int(2**64 * LISTED * (den - num) / den)))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out_id, out_n, out_s, out_t = [], [], [], []
            for row, s in _sets(batch, k):
                n = len(s)
                listed = int(np.searchsorted(s, bound))
                out_id.append(ids[row])
                out_n.append(n)
                out_s.append(listed)
                out_t.append(s[: max(listed, min(n, n - least_overlap(n, num, den) + MAX_MATCHES))].view(np.int64))
            lens = np.fromiter(map(len, out_t), np.int32, len(out_t))
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            values = np.concatenate(out_t) if out_t else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.int64()), pa.array(out_n, pa.int32()), pa.array(out_s, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "n", "listed", "tokens"],
            )

    return run


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap as longs: its difference from another's never exceeds the sets' difference."""
    at = np.bincount((_text.mix64(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8)).view(np.int64)


def _bitmaps(k: int):
    """mapInArrow: a bitmap of MAP_WORDS longs, and one of two to four bits a token."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for row, s in _sets(batch, k):
                wide = _parity(s, max(64, 2 << len(s).bit_length()))
                rows.append((ids[row], len(s), wide.tobytes(), *map(int, _parity(s, 64 * MAP_WORDS))))
            cols = list(zip(*rows)) or [[]] * (3 + MAP_WORDS)
            kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * MAP_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n", "wide", *[f"b{i}" for i in range(MAP_WORDS)]])

    return run


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the difference of two sets from their maps; the larger map is folded to the smaller's size."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    # packed bits count from the top of each byte, and map sizes are powers of two: halves fold onto each other
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _near(num: int, den: int):
    """mapInArrow: the pairs whose maps leave a link possible."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
            differ = np.array([least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"))], np.int64)
            mask = pa.array((den + num) * differ <= (den - num) * sizes)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _whole_sets(k: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            got = [(ids[row], s.tobytes()) for row, s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], ["doc_id", "tokens"])

    return run


def _links(num: int, den: int):
    """mapInArrow: the pairs whose sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(a) + len(b) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one of the ids: by broadcast while the ids are few, else by a join."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _verified(docs: DataFrame, maps: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The linking ones of the pairs (a, b): by their maps, then by exact sets."""
    pairs = written(pairs)
    sides = [maps.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{t}"), F.col("wide").alias(t)) for s, t in ("ax", "by")]
    near = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "nx", "ny", "x", "y")
    pairs = written(near.mapInArrow(_near(num, den), "a long, b long"))
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = written(_chosen(docs, ids).mapInArrow(_whole_sets(k), "doc_id long, tokens binary").dropDuplicates(["doc_id"]))
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b"
    )
    return written(joined.select("a", "b", "x", "y").mapInArrow(_links(num, den), "a long, b long"))


def _hot(sampled: DataFrame, n_texts: int) -> DataFrame:
    """(token, about): tokens of a large share of the texts with estimated frequencies, from the tokens of the sampled texts.

    At most HOT_SHARE times a text's tokens.
    """
    least = max(HOT_LEAST, n_texts // (SAMPLE * HOT_SHARE))
    counts = sampled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return written(counts.where(F.col("n") >= least).select("token", (F.col("n") * SAMPLE).alias("about")))


def _prefixes(tokens: DataFrame, hot: DataFrame, num: int, den: int) -> DataFrame:
    """(token, doc_id, n, l, place, rank, alone, len): the postings of the chosen prefixes in lists of ``len`` two or more.

    ``alone`` is the share of a text's tokens of which it is known that no other text has them.
    """
    # at: the token's place by hash; for tokens that are not listed that is its place in the global order
    postings = tokens.select("doc_id", "n", "listed", F.posexplode("tokens").alias("at", "token")).join(F.broadcast(hot), "token", "left")
    part = F.when(F.col("about").isNull(), F.lit(0)).otherwise(F.expr("pmod(xxhash64(doc_id), 4096)"))
    counted = postings.withColumn("part", part)
    counted = counted.withColumn("freq", F.coalesce("about", F.count(F.lit(1)).over(Window.partitionBy("token", "part")))).where("freq > 1")
    counted = counted.withColumns({"is_listed": F.expr("at < listed"), "free": F.expr(f"n - cast(ceil(n * {num}D / {den}) as int)")})  # free: n - T
    own = Window.partitionBy("doc_id")
    # listed tokens that occur once come first and have no posting
    rank = F.row_number().over(own.orderBy(F.col("is_listed").desc(), "freq", "token"))
    placed = counted.withColumns({"rank": rank, "shared": F.sum(F.col("is_listed").cast("int")).over(own)})
    placed = placed.withColumn("place", F.expr("if(is_listed, listed - shared + rank, at + 1)")).where(f"place <= free + {MAX_MATCHES}")
    placed = placed.withColumns({f"f{m}": F.sum(F.expr(f"if(place <= free + {m}, freq, 0)")).over(own) for m in range(1, MAX_MATCHES + 1)})
    # a token is in the prefix for l if its place is among the first n - T + l
    chosen = placed.withColumn("l", F.expr(f"least({matches_by_cost()}, n - free)")).where("place <= free + l")
    chosen = chosen.withColumn("alone", F.expr("cast((listed - shared) / n as float)"))
    lists = written(chosen.select("token", "doc_id", "n", "l", "place", "rank", "alone").dropDuplicates(["token", "doc_id"]))
    # counted before the shuffle and written, so that the join's tasks read lists that can be split
    met_again = written(lists.groupBy("token").agg(F.count(F.lit(1)).alias("len")).where("len > 1"))
    return written(lists.join(met_again, "token").select(*lists.columns, "len"))


def _by_size(small: DataFrame) -> DataFrame:
    """A written table for a join: broadcast while it has at most MAX_BROADCAST_IDS rows."""
    return F.broadcast(small) if small.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else small


def _classed(lists: DataFrame, merged: DataFrame | None) -> DataFrame:
    """The postings with ``c``, a number of the text's class.

    Not all of a class need have one number yet: then some of its pairs are verified in vain.
    """
    if merged is None:
        return lists.withColumn("c", F.col("doc_id"))
    least = written(merged.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("least")))
    return lists.join(_by_size(least), "doc_id", "left").withColumn("c", F.coalesce("least", "doc_id")).drop("least")


def _mixed(marked: DataFrame) -> DataFrame:
    """(token, len, same): the lists of several classes, with the sum of the squares of the classes' sizes."""
    by_class = marked.groupBy("token", "c").agg(F.count(F.lit(1)).cast("double").alias("k"))
    by_token = by_class.groupBy("token").agg(F.sum("k").alias("len"), F.sum(F.col("k") * F.col("k")).alias("same"))
    return written(by_token.where("len * len > same"))


def _star_pairs(marked: DataFrame, mixed: DataFrame, maps: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Distinct (a, b): the texts of each long list, or of each part of it, against its most central one if of another class, by the size and bitmap bounds."""
    parts = mixed.select("token", F.expr(f"cast(ceil(len / {PART}) as int)" if turn else "1").alias("parts"))
    dealt = marked.join(_by_size(parts), "token").withColumn("part", F.expr(f"pmod(xxhash64(doc_id, token, {turn}), parts)"))
    central = F.min(F.struct("alone", F.xxhash64("doc_id", F.lit(turn)).alias("draw"), "doc_id", "n", "c"))
    met = dealt.join(dealt.groupBy("token", "part").agg(central.alias("hub")), ["token", "part"]).where("c <> hub.c")
    met = met.where(f"{den}L * least(n, hub.n) >= {num}L * greatest(n, hub.n)")
    met = met.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"), (F.col("n") + F.col("hub.n")).alias("sizes")).distinct()
    sides = [maps.select(F.col("doc_id").alias(s), *[F.col(f"b{i}").alias(f"{s}{i}") for i in range(MAP_WORDS)]) for s in "ab"]
    differ = " + ".join(f"bit_count(a{i} ^ b{i})" for i in range(MAP_WORDS))
    # J >= num/den: the difference is at most (den - num) / (den + num) of the sizes' sum
    return met.join(sides[0], "a").join(sides[1], "b").where(f"({differ}) * {den + num}L <= {den - num}L * sizes").select("a", "b")


def _full_pairs(marked: DataFrame, mixed: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b) of different classes that share as many prefix tokens as their l asks for, by all bounds."""
    own = Window.partitionBy("doc_id").orderBy("place")
    posted = marked.drop("len", "alone").join(mixed.select("token", F.expr(f"cast(ceil(len / {BLOCK}) as int)").alias("blocks")), "token").withColumn("nth", F.row_number().over(own))
    early = posted.where(F.col("nth") <= EARLY).groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(nth, token))), x -> x.token)").alias("early"))
    small = maps.select("doc_id", *[f"b{i}" for i in range(MAP_WORDS)])
    spread = posted.join(early, "doc_id").join(small, "doc_id").withColumn("mine", F.expr("pmod(xxhash64(doc_id), blocks)").cast("int"))
    spread = spread.withColumn("early", F.expr("slice(early, 1, nth - 1)"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    spread = spread.withColumn("met", F.explode(blocks)).select("*", "met.i", "met.j").drop("met", "blocks")
    overlap = f"cast(ceil((x.n + y.n) * {num}D / {num + den}) as int)"  # the least of a link
    differ = " + ".join(f"bit_count(x.b{i} ^ y.b{i})" for i in range(MAP_WORDS))
    known = "size(array_intersect(x.early, y.early))"
    whole = f"x.nth <= {EARLY} and y.nth <= {EARLY}"  # all that comes before is known
    on = " and ".join(
        [
            "x.token = y.token and x.i = y.i and x.j = y.j and x.doc_id < y.doc_id and x.c <> y.c and (x.i = x.j or x.mine <> y.mine)",
            f"{den}L * least(x.n, y.n) >= {num}L * greatest(x.n, y.n)",
            f"greatest(x.place - x.n, y.place - y.n) + {overlap} <= least(x.l, y.l)",
            f"least(x.rank, y.rank) + least(x.n - x.place, y.n - y.place) >= {overlap}",
            f"({differ}) * {den + num}L <= {den - num}L * (x.n + y.n)",
            f"if({whole}, {known} = least(x.l, y.l) - 1, {known} < least(x.l, y.l))",
        ]
    )
    pairs = spread.alias("x").join(spread.alias("y"), F.expr(on)).select(
        F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.expr("least(x.l, y.l)").alias("l"), F.expr(known).alias("known")
    )
    met = pairs.groupBy("a", "b").agg((F.count(F.lit(1)) + F.max("known")).alias("shared"), F.max("l").alias("l"))
    return met.where("shared >= l").select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least id with an equal set), component_id.

    ``num / den`` is the least Jaccard similarity of a link.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    _text.small_batches(docs.sparkSession)
    rows = written(docs.mapInArrow(_summaries(k), "doc_id long, n long, k1 long, k2 long"))

    full = rows.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("class_id")))
    copies = written(full.join(classes, ["k1", "k2", "n"]).where("doc_id <> class_id").select("doc_id").distinct())

    given = docs.where("doc_id is not null").join(_by_size(copies), "doc_id", "left_anti")

    def tokens(texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(_listed(k, num, den), "doc_id long, n int, listed int, tokens array<bigint>")

    hot = _hot(tokens(given.where(f"pmod(xxhash64(doc_id, 23L), {SAMPLE}) = 0")), rows.count())
    lists = _prefixes(tokens(given), hot, num, den)
    fields = ", ".join(f"b{i} long" for i in range(MAP_WORDS))
    chosen = _chosen(docs, lists.select("doc_id").distinct())
    maps = written(chosen.mapInArrow(_bitmaps(k), f"doc_id long, n long, wide binary, {fields}").dropDuplicates(["doc_id"]))

    merged, before, postings = None, float("inf"), lists.count()
    longer = written(lists.where(f"len >= {LONG}"))
    for turn in range(MAX_STARS):
        marked = written(_classed(longer, merged))
        mixed = _mixed(marked)
        pairs = mixed.agg(F.coalesce(F.sum(F.expr("(len * len - same) / 2")), F.lit(0.0))).first()[0]
        if pairs <= DIRECT * postings or turn > 1 and pairs > 0.9 * before:
            break
        before = pairs
        merged = contracted(_verified(docs, maps, _star_pairs(marked, mixed, maps, turn, num, den), k, num, den), merged)

    links = None if merged is None else merged.toDF("a", "b")
    marked = written(_classed(lists, merged))
    mixed = _mixed(marked)
    if mixed.limit(1).count():
        found = _verified(docs, maps, _full_pairs(marked, mixed, maps, num, den), k, num, den)
        links = found if links is None else links.union(found)
    keyed = classes.withColumn("component", F.col("class_id"))
    if links is not None:
        named = written(components(links)).withColumnRenamed("id", "class_id")
        keyed = classes.join(named, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    found = rows.where("n > 0").join(keyed, ["k1", "k2", "n"], "left")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id")
    ).unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
