"""Label registry: names by value (0 healthy, -1 unlabelled) and operations on a ``label`` column.

Registries are short tuples on the driver; what they need to know of the data is
one small aggregate over at most 129 values.  Splits never sort a class: the place
of the cut in a seeded order is found on keys alone, by counting slices of the order
and ranking the one slice that holds it.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.model import LABEL_HEALTHY, LABEL_UNLABELED, MAX_LABELS, Scan


def fixed_names(names) -> tuple[str, ...]:
    """A registry whose first name is 'healthy'."""
    names = list(names) or ["healthy"]
    if names[0].lower() != "healthy":
        warnings.warn("label 0 is healthy; its name was replaced", stacklevel=2)
    return ("healthy", *names[1:])


def label_name(value: int, names) -> str:
    if value == LABEL_UNLABELED:
        return "unlabeled"
    if value == LABEL_HEALTHY:
        return "healthy"
    if 0 < value < len(names):
        return names[value]
    return f"label{value}" if value > 0 else "N/A"


def unique_labels(df: DataFrame) -> list[int]:
    """Sorted distinct labels but -1."""
    return sorted(r.label for r in df.where(F.col("label") != -1).select(F.col("label").cast("int").alias("label")).distinct().collect())


def name_to_value(name: str, names, present=()) -> int:
    """Case-insensitive; 'label<N>' if N occurs; else -1."""
    low = name.lower()
    for value, known in enumerate(names):
        if known.lower() == low:
            return value
    numbered = re.fullmatch(r"label(\d+)", low)
    if numbered and int(numbered[1]) in present:
        return int(numbered[1])
    return LABEL_UNLABELED


def _value(ref, names, present) -> int:
    return ref if isinstance(ref, int) else name_to_value(ref, names, present)


def num_classes(df: DataFrame) -> int:
    return len([v for v in unique_labels(df) if v >= 0])


def max_label(df: DataFrame) -> int:
    return df.agg(F.max("label")).first()[0]


def is_labeled(df: DataFrame) -> bool:
    return df.where(F.col("label") != -1).limit(1).count() > 0


def verify(df: DataFrame, names) -> None:
    seen = df.agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    lowered = [n.lower() for n in names]
    if not seen.n or seen.lo < -1 or seen.hi >= len(names) or lowered[:1] != ["healthy"] or len(set(lowered)) < len(names):
        raise ValueError("invalid labels")


def healthy_mask() -> Column:
    return F.col("label") == LABEL_HEALTHY


def labeled_mask() -> Column:
    return F.col("label") != LABEL_UNLABELED


def unlabeled_mask() -> Column:
    return F.col("label") == LABEL_UNLABELED


def mask(ref, names, present=()) -> Column:
    """A name nobody knows counts as unlabelled."""
    return F.col("label") == _value(ref, names, present)


def to_binary(ref, names, present=()) -> Column:
    """-1 stays, the positive is 1, the rest 0; an unknown name has no positives."""
    if isinstance(ref, str) and ref.lower() == "unlabeled":
        value = -1
    else:
        value = _value(ref, names, present)
        if isinstance(ref, str) and value == -1:
            value = None
    label = F.col("label")
    if value is None:
        return F.when(label == -1, F.lit(-1)).otherwise(F.lit(0)).cast("tinyint")
    return F.when(label == value, F.lit(1)).when(label == -1, F.lit(-1)).otherwise(F.lit(0)).cast("tinyint")


def class_distribution(df: DataFrame, names) -> DataFrame:
    """(name, n) of each label; of values that share a name the largest counts."""
    known = F.create_map(*[x for v in range(-1, max(len(names), 1)) for x in (F.lit(v), F.lit(label_name(v, names)))])
    counts = df.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    named = counts.withColumn("name", F.coalesce(F.try_element_at(known, F.col("label")), F.concat(F.lit("label"), F.col("label").cast("string"))))
    return named.groupBy("name").agg(F.max_by("n", "label").alias("n"))


def _mapped(df: DataFrame, mapping: dict[int, int]) -> DataFrame:
    out = F.col("label").cast("int")
    for old, new in mapping.items():
        if old != new:
            out = F.when(F.col("label") == old, F.lit(new)).otherwise(out)
    return df.withColumn("label", out.cast("tinyint"))


def clean(df: DataFrame, names) -> tuple[DataFrame, tuple[str, ...]]:
    """Values without gaps: healthy 0, the others that occur 1, 2, ..."""
    others = [v for v in unique_labels(df) if v > 0]
    return _mapped(df, {v: i for i, v in enumerate(others, 1)}), ("healthy", *[label_name(v, names) for v in others])


def add_label(names, name: str, top: int = 0) -> tuple[str, ...]:
    """``top``: the largest label in the data; names up to it are filled in."""
    if name.lower() in ("healthy", "unlabeled", "") or name.lower() in [n.lower() for n in names]:
        raise ValueError(f"label {name!r} is reserved or exists")
    names = [*names, *[f"label{v}" for v in range(len(names), top + 1)]]
    if len(names) >= MAX_LABELS:
        raise ValueError("the registry is full")
    return (*names, name)


def rename_label(names, ref, name: str, present=()) -> tuple[str, ...]:
    value = _value(ref, names, present)
    if value <= 0:
        raise ValueError("that label can't be renamed")
    if name.lower() in [n.lower() for i, n in enumerate(names) if i != value] or name.lower() in ("healthy", "unlabeled", ""):
        raise ValueError(f"label {name!r} is reserved or exists")
    names = [*names, *[f"label{v}" for v in range(len(names), value + 1)]]
    names[value] = name
    return tuple(names)


def delete_label(df: DataFrame, names, ref) -> tuple[DataFrame, tuple[str, ...]]:
    value = _value(ref, names, unique_labels(df))
    if value <= 0:
        raise ValueError("that label can't be deleted")
    return clean(_mapped(df, {value: -1}), names)


def relabel(df: DataFrame, names, mapping: dict) -> tuple[DataFrame, tuple[str, ...]]:
    """All at once: values or names to values or names; a new name renames, a known one merges."""
    present = unique_labels(df)
    names = [*names, *[f"label{v}" for v in range(len(names), max([0, *present]) + 1)]]
    moves, spelled = {}, {}
    for old, new in mapping.items():
        source = _value(old, names, present)
        if isinstance(old, str) and source == -1 and old.lower() != "unlabeled":
            raise KeyError(old)
        if isinstance(new, int):
            moves[source] = new
            continue
        target = name_to_value(new, names, present)
        if target == -1 and new.lower() != "unlabeled":
            spelled[source] = new
        else:
            moves[source] = target
            if target > 0:
                spelled[target] = new
    for value, name in spelled.items():
        if value > 0:
            names[value] = name
    return clean(_mapped(df, moves), tuple(names))


def merge(parts: list[tuple[DataFrame, tuple[str, ...]]]) -> tuple[DataFrame, tuple[str, ...]]:
    """One table of several, labels joined by name; the first spelling stays."""
    if len(parts) < 2:
        raise ValueError("two label sets are needed")
    joint, frames = ["healthy"], []
    for df, names in parts:
        moves = {}
        for v in unique_labels(df):
            name = label_name(v, names)
            low = [n.lower() for n in joint]
            if name.lower() not in low:
                joint.append(name)
                low.append(name.lower())
            moves[v] = low.index(name.lower())
        frames.append(_mapped(df, moves))
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return clean(whole, tuple(joint))


def has_name(name: str, names, present=()) -> bool:
    return name_to_value(name, names, present) != LABEL_UNLABELED


def create_unlabeled(df: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    return df.withColumn("label", F.lit(LABEL_UNLABELED).cast("tinyint")), ("healthy",)


def take(df: DataFrame, indices: list[int], key: str = "scan_idx") -> DataFrame:
    """The rows of the given numbers, repeated as often as asked for, with ``pos``, their place in the list."""
    if not indices:
        raise ValueError("cannot take an empty index set")
    wanted = df.sparkSession.createDataFrame(list(enumerate(map(int, indices))), f"pos long, {key} long")
    few = len(indices) <= 1_000_000
    return df.join(F.broadcast(wanted) if few else wanted, key).select(*df.columns, "pos")


def set_labels(scan, labels: DataFrame, names) -> Scan:
    """``scan`` with labels (scan_idx, label): one for each A-scan, and a valid registry that covers them."""
    labels = labels.select("scan_idx", F.col("label").cast("tinyint").alias("label"))
    expected = scan.num_scans
    seen = labels.agg(F.count("*").alias("n"), F.count_distinct("scan_idx").alias("places"), F.min("scan_idx").alias("lo"), F.max("scan_idx").alias("hi")).first()
    if (seen.n, seen.places) != (expected, expected) or (seen.lo, seen.hi) != (0, expected - 1):
        raise ValueError("one label is needed for each A-scan")
    names = fixed_names(names)
    verify(labels, names)
    df = scan.df.drop("label").join(labels, "scan_idx").select(*scan.df.columns)
    return replace(scan, df=df, label_names=names)


@dataclass(frozen=True)
class Labels:
    """Labels (scan_idx, label) with their registry: the operations of this module as methods."""

    df: DataFrame
    names: tuple[str, ...] = ("healthy",)

    def __post_init__(self):
        if not self.df.limit(1).count():
            raise ValueError("labels must not be empty")
        object.__setattr__(self, "names", fixed_names(self.names))

    @classmethod
    def of(cls, scan) -> Labels:
        return cls(scan.df.select("scan_idx", "label"), scan.label_names)

    @classmethod
    def from_dict(cls, spark, given: dict) -> Labels:
        """From {"labels": [...], "label_names": [...]}."""
        df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(given["labels"])], "scan_idx int, label tinyint")
        return cls(df, tuple(given.get("label_names", ())))

    def to_dict(self) -> dict:
        """The labels in order, on the driver."""
        return {"labels": [r.label for r in self.df.orderBy("scan_idx").toLocalIterator()], "label_names": list(self.names)}

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, index: int) -> int:
        at = index + len(self) if index < 0 else index
        row = self.df.where(F.col("scan_idx") == at).select("label").first()
        if row is None:
            raise IndexError("label out of range")
        return row.label

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        if copy is False:
            raise ValueError("labels are gathered from the cluster: a copy cannot be avoided")
        return np.array(self.to_dict()["labels"], np.int8 if dtype is None else dtype)

    def copy(self) -> Labels:
        return replace(self)

    def take(self, indices: list[int]) -> Labels:
        """The labels of the given numbers, renumbered in that order; the registry stays."""
        got = take(self.df, indices)
        return Labels(got.select(F.col("pos").cast("int").alias("scan_idx"), "label"), self.names)

    def present(self) -> list[int]:
        return unique_labels(self.df)

    def has_name(self, name: str) -> bool:
        return has_name(name, self.names, self.present())

    def name_to_value(self, name: str) -> int:
        return name_to_value(name, self.names, self.present())

    def label_name(self, index: int) -> str:
        """Name of the label at an index."""
        return label_name(self[index], self.names)

    def verify(self) -> None:
        verify(self.df, self.names)

    def clean(self) -> Labels:
        return Labels(*clean(self.df, self.names))

    def relabel(self, mapping: dict) -> Labels:
        return Labels(*relabel(self.df, self.names, mapping))

    def delete_label(self, ref) -> Labels:
        return Labels(*delete_label(self.df, self.names, ref))

    def add_label(self, name: str) -> Labels:
        return replace(self, names=add_label(self.names, name, max_label(self.df)))

    def rename_label(self, ref, name: str) -> Labels:
        return replace(self, names=rename_label(self.names, ref, name, self.present()))

    def merge(self, other: Labels) -> Labels:
        """Both one after the other, joined by name."""
        n = len(self)
        moved = other.df.withColumn("scan_idx", (F.col("scan_idx") + n).cast("int"))
        return Labels(*merge([(self.df, self.names), (moved, other.names)]))

    def class_distribution(self) -> dict[str, int]:
        return {r["name"]: r["n"] for r in class_distribution(self.df, self.names).collect()}

    def stratified_split(self, test_size: float = 0.2, seed: int = 0) -> tuple[Labels, Labels]:
        """(train, test), each numbered as here."""
        df = stratified_split(self.df, test_size, seed)
        return tuple(Labels(df.where(F.col("split") == part).drop("split"), self.names) for part in ("train", "test"))


#: bits of the seeded order, from the first 15 hexadecimal digits of an MD5
ORDER_BITS = 60
#: keys of a slice of the order, which one task ranks
SLICE_ROWS = 100_000


def seeded(seed: int, key: str) -> Column:
    """A row's place in a seeded order: the MD5 of 'seed:key'."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("bigint")


def split_sizes(n: Column, test_size: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(test_size)).cast("bigint"))


def cuts(df: DataFrame, by: Column, key: str, seed: int, size) -> DataFrame:
    """(by, cut_order, cut_key): of each group the last row among its first ``size(n)`` in the seeded order.

    A group that takes none has no row.  Only keys are read; partial counts and
    one slice of the order a group are shuffled.
    """
    keys = df.select(by.alias("by"), seeded(seed, key).alias("order"), F.col(key).alias("key"))
    bits = min(20, max(1, (keys.count() // SLICE_ROWS).bit_length()))
    keys = keys.withColumn("slice", F.shiftright("order", ORDER_BITS - bits).cast("int"))
    counts = keys.groupBy("by", "slice").agg(F.count("*").alias("n"))
    group = Window.partitionBy("by")
    run = counts.withColumns({"upto": F.sum("n").over(group.orderBy("slice")), "take": size(F.sum("n").over(group))})
    edge = run.where((F.col("upto") - F.col("n") < F.col("take")) & (F.col("take") <= F.col("upto")))
    edge = edge.select("by", "slice", (F.col("take") - F.col("upto") + F.col("n")).alias("need"))  # a row a group
    inside = keys.join(F.broadcast(edge), ["by", "slice"])
    ranked = inside.withColumn("nth", F.row_number().over(Window.partitionBy("by", "slice").orderBy("order", "key")))
    return ranked.where("nth = need").select("by", F.col("order").alias("cut_order"), F.col("key").alias("cut_key"))


def split_by_cuts(df: DataFrame, by: Column, key: str, seed: int, found: DataFrame, first: str, rest: str) -> DataFrame:
    """``df`` with ``split``: ``first`` for rows up to their group's cut; narrow, as there is a cut a group."""
    own = F.struct(seeded(seed, key), F.col(key))
    joined = df.withColumn("_by", by).join(F.broadcast(found.withColumnRenamed("by", "_by")), "_by", "left")
    upto = F.coalesce(own <= F.struct("cut_order", "cut_key"), F.lit(False))
    return joined.withColumn("split", F.when(F.col("cut_order").isNotNull() & upto, first).otherwise(rest)).select(*df.columns, "split")


def stratified_split(df: DataFrame, test_size: float = 0.2, seed: int = 0, by: str = "label", key: str = "scan_idx") -> DataFrame:
    """``df`` with ``split``: of each class the first max(1, int(n * test_size)) in the seeded order go to the test part."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    found = cuts(df, F.col(by), key, seed, lambda n: split_sizes(n, test_size))
    return split_by_cuts(df, F.col(by), key, seed, found, "test", "train")
