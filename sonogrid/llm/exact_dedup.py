"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one hashes every normalised text and marks, in a blocked Bloom filter of
64-bit words with two probes a text, the bits that at least two rows hit.  Pass
two tests every row against that filter.  A row of which a probed bit was hit
once only has no equal, so it passes straight through; only the others (repeated
texts and a few per cent of false positives) shuffle, and are grouped by their
SHA-256.  Both passes work on digests.

To keep one row of each text (``drop_exact_duplicates``), the texts found repeated
go into a second filter of the same make, and the documents are tested against it
where they lie: those it misses pass straight through, text and all, and only the
others shuffle.  No exchange ever carries a text that its filter misses.

Size.  The first filter has about BITS_PER_ROW bits a row, the second as many a
repeated text, and neither more than MAX_WORDS words, packed PACKED to a row and
broadcast (256 MB at most).  A filter that would need more is denser and lets more
rows through to the shuffle, without effect on the result: the first from 134
million rows on (then more digests shuffle, 40 bytes each), the second from 134
million different repeated texts on.  The marking pass shuffles partial counts of
bit positions, never texts.  Groups are pre-aggregated before each shuffle, so one
text that makes up a third of all rows reaches the reducers as one row a task.

Edge cases.  A null text equals the empty one.  Very long texts are hashed whole.
A null id sorts after all others; of rows with equal text and equal (or only null)
ids any one stays.  An empty table gives an empty result.  Other columns are carried
along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonogrid.llm._store import written

BITS_PER_ROW = 16
MAX_WORDS = 1 << 25
PACKED = 64
_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def _probe(digest: str, n_words: int) -> tuple[Column, Column, Column]:
    """Word of the filter and two bit numbers, from disjoint bits of one 64-bit hash."""
    h = F.xxhash64(F.col(digest))
    bits = F.shiftrightunsigned(h, 52)
    return (
        F.pmod(h.bitwiseAND(F.lit((1 << 52) - 1)), F.lit(n_words)),
        bits.bitwiseAND(F.lit(63)).cast("int"),
        F.shiftrightunsigned(bits, 6).bitwiseAND(F.lit(63)).cast("int"),
    )


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n)


def _words_for(n: int) -> int:
    return min(MAX_WORDS, max(1, n * BITS_PER_ROW // 64))


def marked_bits(digests: DataFrame, digest: str, n_words: int, least: int) -> DataFrame:
    """The filter: (word, bits) with the bits that ``least`` rows or more have hit."""
    word, one, two = _probe(digest, n_words)
    hits = digests.select(word.alias("word"), F.explode(F.array_distinct(F.array(one, two))).alias("bit"))
    often = hits.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.groupBy("word").agg(F.bit_or(_bit(F.col("bit"))).alias("bits"))


def _packed(sieve: DataFrame) -> DataFrame:
    """(block, words): PACKED words a row, so a broadcast filter takes little more than its bits."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(PACKED)).cast("int"), "bits")))
    blocks = sieve.groupBy(F.floor(F.col("word") / PACKED).alias("block")).agg(entries.alias("has"))
    words = F.transform(F.sequence(F.lit(0), F.lit(PACKED - 1)), lambda i: F.coalesce(F.try_element_at("has", i), F.lit(0).cast("bigint")))
    return blocks.select("block", words.alias("words"))


def split_by_filter(df: DataFrame, digest: str, sieve: DataFrame, n_words: int) -> tuple[DataFrame, DataFrame]:
    """``df`` cut in two where its rows lie: those the filter hits, and those it misses."""
    word, one, two = _probe(digest, n_words)
    block, words = _fresh(df, "bloom_block"), _fresh(df, "bloom_words")
    # the filter's row of a text: at most MAX_WORDS / PACKED rows of 8 * PACKED bytes
    sieve = F.broadcast(sieve.select(F.col("block").alias(block), F.col("words").alias(words)))
    tested = df.withColumn(block, F.floor(word / PACKED)).join(sieve, block, "left")
    mask = _bit(one).bitwiseOR(_bit(two))
    hit = F.coalesce(F.get(F.col(words), F.pmod(word, F.lit(PACKED)).cast("int")), F.lit(0).cast("bigint")).bitwiseAND(mask) == mask
    return tested.where(hit).drop(block, words), tested.where(~hit).drop(block, words)


def split_repeated(digests: DataFrame, digest: str, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Digests cut in two: rows that may have an equal, and rows that surely have none."""
    n_words = _words_for(n_rows)
    return split_by_filter(digests, digest, written(_packed(marked_bits(digests, digest, n_words, 2))), n_words)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("sha"))
    )
    n_rows = digests.count()
    some, alone = split_repeated(digests, "sha", n_rows)
    per_id = some.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    groups = per_id.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    heavy = F.col("group_size") * F.lit(1000) >= F.lit(max(1, n_rows))
    small_groups, large_groups = groups.where(~heavy), groups.where(heavy)  # at most 1000 large groups
    flagged = per_id.join(F.broadcast(large_groups), "sha", "left")
    in_large = flagged.where(F.col("group_size").isNotNull())
    in_small = flagged.where(F.col("group_size").isNull()).drop("keep_id", "group_size").join(small_groups, "sha")
    cols = ["doc_id", "keep_id", "group_size", "sha", "copies"]
    both = in_large.select(*cols).unionByName(in_small.select(*cols))
    found = both.select(
        "doc_id", "keep_id", "group_size", "sha", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("nth")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))
    single = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha", F.lit(True).alias("kept")
    )
    out = ["doc_id", "keep_id", "group_size", "kept"]
    return found.select(*out, "sha").unionByName(single.select(*out, "sha")).select(*out, F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text; rows whose text no other has are not shuffled."""
    sha, row = _fresh(docs, "text_sha"), _fresh(docs, "kept_row")
    hashed = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256)))
    digests = written(hashed.select(sha))
    some, _ = split_repeated(digests, sha, digests.count())
    repeated = written(some.groupBy(sha).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(sha))
    n_words = _words_for(repeated.count())
    some, alone = split_by_filter(hashed, sha, written(_packed(marked_bits(repeated, sha, n_words, 1))), n_words)
    first = some.groupBy(sha).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(id_col).isNull(), F.col(id_col))).alias(row)
    )
    return alone.select(*[f"`{c}`" for c in docs.columns]).unionByName(first.select(*[F.col(f"{row}.`{c}`") for c in docs.columns]))
