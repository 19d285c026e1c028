"""Order MinHash fingerprints, in SQL functions only.

A text's k-mers are runs of K units.  A unit is a piece of the text of a few
characters (about three in prose in Latin letters): it ends at a white-space
character, at one of the letters a, e, o or any character from U+0370 on, each with a
white-space character that follows, or after MAX_UNIT characters without such an end.  Units cover the whole text, and where they end depends on
the text around alone; so k-mers behind an insertion are found again, also in texts
without spaces and in scripts that need none.

Equal k-mers are numbered by occurrence and each numbered k-mer is hashed once.
Sketch j of SKETCHES ranks them by (hash - j * 2**35 / SKETCHES) modulo 2**35, which
is as random a ranking as the hash itself, takes the TUPLE smallest, puts them back
in text order and hashes the tuple.  Texts with the same k-mers in another order
thus get other signatures, as edit distance demands.  As the rankings are rotations
of one sorted list, a sketch costs one binary search and a text one sort.

Each text is hashed, sorted and sketched inside its own row: no k-mer is ever
shuffled.  The next document is found by dealing documents to ranges of about
RANGE_ROWS rows and looking one row ahead in each.  Rows are ordered by id
downwards, then by a hash of the text; ranges start at keys drawn from the rows
themselves (about DRAWN a range, MAX_RANGES ranges at most; beyond, ranges grow), so
that ids may lie anywhere and repeat.  The first row of the next range is the row of
its starting key: only these texts, one a range, are looked up.

Edge cases.  A null text is empty and has the empty fingerprint.  A text of fewer
than K units is one k-mer.  Two empty fingerprints are alike (1.0), an empty and
another are not (0.0).  A single document is its own next one.  Null ids come after
all others; rows of one id follow each other by the hash of their texts, and rows
that are repeated whole lie in one range.  Very long texts are hashed whole.  Other
columns are not read, whatever their names.  Positions are held in 28 bits: 268
million k-mers a text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
MAX_UNIT = 8
_BLANK, _END = r"\x09-\x0D\x20", r"aeo\x{370}-\x{10FFFF}"
UNIT = rf"(?:[^{_BLANK}{_END}]{{1,{MAX_UNIT}}}+[{_END}]?+|[{_END}])[{_BLANK}]?+|[{_BLANK}]"
TUPLE = 2
SKETCHES = 24
RANGE_ROWS = 512
MAX_RANGES = 1 << 14
DRAWN = 16
_HASH_BITS, _POS_BITS = 35, 28


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _high(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - _HASH_BITS)


def _pack(h: Column, pos: Column) -> Column:
    """Hash above, place below: sorts as a plain long."""
    return F.shiftleft(_high(h), _POS_BITS).bitwiseOR(pos.cast("bigint"))


def place_of(s: Column, target: Column) -> Column:
    """How many of the sorted values lie below the target: halving steps, largest first."""

    def step(at: Column, b: Column) -> Column:
        further = at + F.call_function("shiftleft", F.lit(1), b)
        return F.when((further <= F.size(s)) & (F.get(s, further - 1) < target), further).otherwise(at)

    return F.aggregate(F.sequence(F.ceil(F.log2(F.size(s) + 1)).cast("int"), F.lit(0), F.lit(-1)), F.lit(0), step)


def fingerprint(text: Column, sketches: int = SKETCHES) -> Column:
    """Signature of 8 hex digits a sketch, empty for an empty text."""
    low = (1 << _POS_BITS) - 1

    def of_units(w: Column) -> Column:
        n = F.size(w)
        mers = F.when(
            n >= K, F.transform(_upto(n - (K - 1)), lambda i: _pack(F.xxhash64(*[F.get(w, i + j) for j in range(K)]), i))
        ).otherwise(F.transform(F.slice(w, 1, 1), lambda x: _pack(F.xxhash64(F.array_join(w, " ")), F.lit(0))))
        return _let(F.sort_array(mers), of_sorted)

    def of_sorted(s: Column) -> Column:
        # equal k-mers stand together: those after the first of a run get their number in it mixed in
        same = lambda i: F.shiftright(F.get(s, i), _POS_BITS) == F.shiftright(F.get(s, i - 1), _POS_BITS)
        starts = F.filter(_upto(F.size(s)), lambda i: (i == 0) | ~same(i))

        def again(x: Column, nth: Column) -> Column:
            return F.when(nth == 0, x).otherwise(_pack(F.xxhash64(F.shiftright(x, _POS_BITS), nth), x.bitwiseAND(F.lit(low))))

        def of_runs(runs: Column) -> Column:
            def run(at: Column, j: Column) -> Column:
                n = F.coalesce(F.get(runs, j + 1), F.size(s)) - at
                return F.when(n == 1, F.array(F.get(s, at))).otherwise(F.transform(F.slice(s, at + 1, n), again))

            return F.flatten(F.transform(runs, run))

        numbered = F.when(F.size(s) > 0, _let(starts, lambda runs: F.when(F.size(runs) == F.size(s), s).otherwise(F.sort_array(of_runs(runs)))))
        return _let(numbered, of_numbered)

    def of_numbered(s: Column) -> Column:
        n = F.size(s)

        def tuple_hash(j: Column) -> Column:
            target = F.shiftleft((j * F.lit((1 << _HASH_BITS) // sketches)).cast("bigint"), _POS_BITS)

            def chosen(at: Column) -> Column:
                picked = F.transform(F.slice(F.sequence(F.lit(0), F.lit(TUPLE - 1)), F.lit(1), F.least(n, F.lit(TUPLE))), lambda t: F.get(s, (at + t) % n))
                by_place = F.sort_array(
                    F.transform(picked, lambda y: F.shiftleft(y.bitwiseAND(F.lit(low)), _HASH_BITS).bitwiseOR(F.shiftright(y, _POS_BITS)))
                )
                in_order = F.transform(by_place, lambda y: y.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))
                return F.right(F.concat(F.lit("0000000"), F.lower(F.hex(F.xxhash64(in_order)))), F.lit(8))

            return _let(place_of(s, target), chosen)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)).cast("array<bigint>"), tuple_hash), "")

    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    return _let(units, lambda w: F.when(F.size(w) == 0, F.lit("")).otherwise(of_units(w)))


def likeness(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """Share of sketches in which two fingerprints agree."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(sketches - 1)),
        F.lit(0),
        lambda acc, j: acc
        + F.when(F.substring(a, j * 8 + 1, F.lit(8)) == F.substring(b, j * 8 + 1, F.lit(8)), F.lit(1)).otherwise(F.lit(0)),
    )
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same / F.lit(float(sketches)))


_KEY = ["no_id", "down", "mark"]


def _starts(keyed: DataFrame) -> list[tuple[bool, int, int]]:
    """Sorted keys at which the ranges start; the first is the least of all.  At most MAX_RANGES, from a sample of bounded size."""
    seen = keyed.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY)).alias("least")).first()
    if not seen.n:
        return []
    ranges = min(MAX_RANGES, max(1, seen.n // RANGE_ROWS))
    if ranges == 1:
        return [tuple(seen.least)]
    share = min(1.0, ranges * DRAWN / seen.n)
    drawn = keyed.where(F.pmod(F.xxhash64("down", "mark", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    counts = drawn.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).limit(4 * MAX_RANGES * DRAWN).collect()
    counts = sorted((tuple(r[:3]), r.n) for r in counts)
    step = max(1, sum(n for _, n in counts) // ranges)
    starts, passed = [tuple(seen.least)], 0
    for key, n in counts:
        if passed >= step and key > starts[-1]:
            starts.append(key)
            passed = 0
        passed += n
    return starts


def _range_of(starts: list[tuple[bool, int, int]]) -> Column:
    """Number of the last range whose start is not above the row's key."""
    fields = "array<struct<no_id boolean, down bigint, mark bigint>>"
    table = F.from_json(F.lit(json.dumps([dict(zip(_KEY, k)) for k in starts])), fields)
    # keys below or equal to the row's are those below its successor's place: equal ones are added
    own = F.struct(*[F.col(c) for c in _KEY])
    below = place_of(table, own)
    return _let(below, lambda n: n - F.when(F.get(table, n) == own, F.lit(0)).otherwise(F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint; next by descending id, after the last the first."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = docs.withColumns(
        {"no_id": F.col("doc_id").isNull(), "down": F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("bigint"))), "mark": F.xxhash64("text")}
    )
    starts = _starts(keyed.select(*_KEY))
    heads = docs.sparkSession.createDataFrame([(*k, (r - 1) % len(starts)) for r, k in enumerate(starts)], "no_id boolean, down long, mark long, range int")
    found = keyed.join(F.broadcast(heads), _KEY).groupBy("range").agg(F.min("text").alias("text"))  # at most MAX_RANGES keys
    after = found.select("range", F.struct("text", fingerprint(F.col("text")).alias("fingerprint")).alias("after"))
    dealt = keyed.withColumn("range", _range_of(starts))
    inside = dealt.withColumn("fingerprint", fingerprint(F.col("text"))).withColumn(
        "ahead", F.lead(F.struct("text", "fingerprint")).over(Window.partitionBy("range").orderBy(*_KEY, "text"))
    )
    after_it = F.coalesce(F.col("ahead"), F.col("after"))
    return inside.join(after, "range", "left").select(
        "doc_id", "text", "fingerprint", after_it["text"].alias("next_text"), after_it["fingerprint"].alias("next_fingerprint")
    )


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are (see the module)."""
    third = F.expr("n_chars div 3").cast("int")
    found = fingerprints(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    found = found.withColumn(
        "edited", F.concat(F.substring("text", 1, F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    ).drop("next_text", "text")
    found = found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
