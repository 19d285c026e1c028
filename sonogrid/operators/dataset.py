"""Pooling of cubes into training samples, splits, batches and patches.

``samples`` has one row a sample: cube_id, scan_idx, row_id, line, col, x_mm,
y_mm, label (NULL if unsupervised), x.  Row order is explicit: row_id numbers
samples by cube, then by place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.functions import exprs
from sonogrid.functions.arrow import with_kernel
from sonogrid.model import Header, Scan
from sonogrid.operators import imaging
from sonogrid.operators import labels as L


@dataclass(frozen=True)
class Dataset:
    """``df`` may also hold ``z`` (features), ``v`` (extra vectors) and ``split`` ('train' or 'test')."""

    df: DataFrame
    headers: tuple[Header, ...]
    label_names: tuple[str, ...]
    maxlen: int
    unsupervised: bool
    pad_value: float = 0.0
    #: width of ``z``, if known
    num_features: int | None = None
    #: whether the last split shuffled
    shuffled: bool = False

    def __len__(self) -> int:
        return self.num_samples

    def __iter__(self) -> Iterator[tuple]:
        return batches(self)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        """All samples as a matrix on the driver, in row order."""
        if copy is False:
            raise ValueError("samples are gathered from the cluster: a copy cannot be avoided")
        return _gathered(self.df, "x").astype(np.float32 if dtype is None else dtype)

    @property
    def num_samples(self) -> int:
        return sum(self.cube_counts)

    @property
    def cube_shapes(self) -> list[tuple[int, int]]:
        """Whole lines and columns of each cube."""
        return [(h.nlines, h.scanspline) for h in self.headers]

    @property
    def cube_counts(self) -> list[int]:
        """Samples of each cube, those of a last line that is not whole too."""
        return [h.num_scans for h in self.headers]

    @property
    def cube_resolutions(self) -> list[float]:
        return [h.resolution for h in self.headers]

    @property
    def scanlens(self) -> list[int]:
        """Samples of each cube before padding."""
        return [h.scanlen for h in self.headers]

    @property
    def handler_ids(self) -> DataFrame:
        """(row_id, cube_id): the cube of each sample."""
        return self.df.select("row_id", "cube_id")

    @property
    def spatial(self) -> DataFrame:
        """(row_id, idx, x, y): cube and place in mm of each sample, as doubles: past 1 m a float can be off by more than 0.05 µm."""
        return self.df.select("row_id", F.col("cube_id").alias("idx"), F.col("x_mm").alias("x"), F.col("y_mm").alias("y"))

    @property
    def has_z(self) -> bool:
        return "z" in self.df.columns

    def copy(self) -> Dataset:
        return replace(self)

    def need_labels(self) -> None:
        if self.unsupervised:
            raise RuntimeError("the dataset is unsupervised")

    def data_column(self, use_z: bool | None = None) -> str:
        """'z' or 'x'; None takes features if there are any."""
        name = "z" if (use_z if use_z is not None else self.has_z) else "x"
        if name not in self.df.columns:
            raise RuntimeError("no transformed features")
        return name

    def preprocess(self, strategy: str, **options) -> Dataset:
        df, n = imaging.preprocess(self.df, self.maxlen, [(strategy, options)])
        return replace(self, df=df, maxlen=n)

    def preprocess_all(self, steps: list[tuple[str, dict]]) -> Dataset:
        df, n = imaging.preprocess(self.df, self.maxlen, steps)
        return replace(self, df=df, maxlen=n)

    def transform(self, fn: Callable[[np.ndarray], np.ndarray]) -> Dataset:
        """Column z = fn of batches (rows, maxlen): fn must treat rows independently."""

        def run(x):
            z = np.asarray(fn(x.astype(np.float32)), np.float32)
            z = z[:, None] if z.ndim == 1 else z
            return z.T if z.shape[0] == 1 and len(x) != 1 else z

        width = run(np.zeros((2, self.maxlen))).shape[1]
        return replace(self, df=with_kernel(self.df, self.maxlen, run, {"z": ("float", 1)}, "x", drop=False), num_features=width)

    def _with(self, name: str, vectors) -> Dataset:
        kept = self.df.drop(name)
        if vectors is None:
            return replace(self, df=kept)
        if not isinstance(vectors, DataFrame):
            vectors = np.asarray(vectors, np.float32)
            if vectors.ndim != 2 or len(vectors) != self.num_samples:
                raise ValueError("one vector is needed for each sample")
            vectors = self.df.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"row_id long, {name} array<float>")
        return replace(self, df=kept.join(vectors.select("row_id", F.col(name).cast("array<float>").alias(name)), "row_id"))

    def with_z(self, vectors, width: int | None = None) -> Dataset:
        """Features from (row_id, z) or a matrix in row order; None removes them."""
        if vectors is not None and not isinstance(vectors, DataFrame):
            width = np.shape(vectors)[-1]
        return replace(self._with("z", vectors), num_features=None if vectors is None else width)

    def with_v(self, vectors) -> Dataset:
        """Extra vectors from (row_id, v) or a matrix in row order; None removes them."""
        return self._with("v", vectors)

    def with_indices(self, train, test) -> Dataset:
        """A split given by row numbers; rows in neither part have none."""
        rows = [(int(r), "train") for r in train] + [(int(r), "test") for r in test]
        if len({r for r, _ in rows}) < len(rows) or any(not 0 <= r < self.num_samples for r, _ in rows):
            raise ValueError("rows must exist and lie in one part")
        parts = self.df.sparkSession.createDataFrame(rows, "row_id long, split string")
        return replace(self, df=self.df.drop("split").join(parts, "row_id", "left"))

    def indices(self, split: str) -> np.ndarray:
        """Row numbers of a part, a copy on the driver; all rows train before the first split."""
        if split not in ("train", "test"):
            raise ValueError("a split is 'train' or 'test'")
        if "split" not in self.df.columns:
            return np.arange(self.num_samples if split == "train" else 0)
        rows = self.df.where(F.col("split") == split).select("row_id").orderBy("row_id")
        return np.fromiter((r.row_id for r in rows.toLocalIterator()), np.int64)

    @property
    def train_indices(self) -> np.ndarray:
        return self.indices("train")

    @property
    def test_indices(self) -> np.ndarray:
        return self.indices("test")

    def num_train_batches(self, batch_size: int = 64) -> int:
        return num_batches(self, "train", batch_size)

    def num_test_batches(self, batch_size: int = 64) -> int:
        return num_batches(self, "test", batch_size)

    def num_classes(self) -> int:
        self.need_labels()
        return L.num_classes(self.df)

    def class_distribution(self) -> DataFrame:
        self.need_labels()
        return L.class_distribution(self.df, self.label_names)

    def to_binary(self, positive) -> DataFrame:
        """(row_id, label) with 1 for the positive label."""
        self.need_labels()
        return self.df.select("row_id", L.to_binary(positive, self.label_names, L.unique_labels(self.df)).alias("label"))

    def to_one_hot(self) -> DataFrame:
        """(row_id, one_hot)."""
        self.need_labels()
        return self.df.select("row_id", exprs.one_hot(F.col("label"), L.num_classes(self.df)).alias("one_hot"))

    def relabel(self, mapping: dict) -> Dataset:
        self.need_labels()
        df, names = L.relabel(self.df, self.label_names, mapping)
        return replace(self, df=df, label_names=names)

    def load(self) -> Dataset:
        """Hold the rows in the cluster's memory and disks."""
        self.df.persist().count()
        return self

    @property
    def loaded(self) -> bool:
        return self.df.storageLevel.useMemory or self.df.storageLevel.useDisk


def _gathered(df: DataFrame, column: str) -> np.ndarray:
    """An array column in row order, on the driver; partitions arrive one at a time."""
    return np.array([r[0] for r in df.orderBy("row_id").select(column).toLocalIterator()], np.float32)


def pool(scans: list[Scan], pad_value: float = 0.0, unsupervised: bool | None = None, keep_labels: bool = False) -> Dataset:
    """All cubes as float samples, padded on the right to the longest; supervised if all cubes are labelled.

    ``keep_labels`` keeps the merged labels in an unsupervised set, for storing.
    """
    if not scans:
        raise ValueError("no scans")
    labelled = [L.is_labeled(s.df) for s in scans] if not unsupervised else [False]
    if unsupervised is None:
        unsupervised = not all(labelled)
    elif not unsupervised and not all(labelled):
        raise ValueError("a cube has no labels")
    length = max(s.header.scanlen for s in scans)
    parts, first = [], 0
    for cube, s in enumerate(scans):
        mm = s.header.resolution / 1000
        parts.append(
            s.df.select(
                F.lit(cube).alias("cube_id"),
                "scan_idx",
                (F.col("scan_idx") + F.lit(first).cast("bigint")).alias("row_id"),
                "line",
                "col",
                (F.col("col") * mm).alias("x_mm"),
                (F.col("line") * mm).alias("y_mm"),
                "label",
                exprs.padded(F.col("signal"), length, pad_value).alias("x"),
            )
        )
        first += s.num_scans
    names = ("healthy",)
    if unsupervised and not keep_labels:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        whole = whole.withColumn("label", F.lit(None).cast("tinyint"))
    elif len(parts) > 1:
        whole, names = L.merge([(p, s.label_names) for p, s in zip(parts, scans)])
    else:
        whole, names = parts[0], scans[0].label_names
    return Dataset(whole, tuple(s.header for s in scans), names, length, unsupervised, pad_value)


#: place of a sample: cube, and x and y in mm
SPATIAL = [("idx", "i4"), ("x", "f4"), ("y", "f4")]


def _check(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")


def train_test_split(ds: Dataset, test_size: float = 0.2, seed: int = 0, shuffle: bool = True) -> Dataset:
    """The first int(total * (1 - test_size)) of the row order, or of the seeded order, train.

    The seeded order is never sorted: its cut is found on keys, and rows are
    compared with it where they lie.
    """
    _check(test_size)
    n_train = int(ds.num_samples * (1 - test_size))
    if not shuffle:
        return replace(ds, df=ds.df.withColumn("split", F.when(F.col("row_id") < n_train, "train").otherwise("test")), shuffled=False)
    cut = L.cuts(ds.df, F.lit(0), "row_id", seed, lambda n: F.lit(n_train)).first()
    if cut is None:
        return replace(ds, df=ds.df.withColumn("split", F.lit("test")), shuffled=True)
    upto = F.struct(L.seeded(seed, "row_id"), F.col("row_id")) <= F.struct(F.lit(cut.cut_order).cast("bigint"), F.lit(cut.cut_key).cast("bigint"))
    return replace(ds, df=ds.df.withColumn("split", F.when(upto, "train").otherwise("test")), shuffled=True)


def stratified_train_test_split(ds: Dataset, test_size: float = 0.2, seed: int = 0) -> Dataset:
    ds.need_labels()
    return replace(ds, df=L.stratified_split(ds.df, test_size, seed, "label", "row_id"), shuffled=True)


def stratified_split_by_cube(ds: Dataset, test_size: float = 0.2, seed: int = 0) -> Dataset:
    return replace(ds, df=L.stratified_split(ds.df, test_size, seed, "cube_id", "row_id"), shuffled=True)


def split_by_label(ds: Dataset, label, test_size: float | None = None, seed: int = 0) -> Dataset:
    """The label's samples (or a share of them) are the test part, all others train."""
    ds.need_labels()
    if isinstance(label, str):
        value = L.name_to_value(label, ds.label_names, L.unique_labels(ds.df))
        if value == -1 and label.lower() != "unlabeled":
            raise ValueError(f"no label {label!r}")
    elif isinstance(label, int):
        value = label
    else:
        raise TypeError("a label is a name or a number")
    if test_size is not None and not 0 < test_size <= 1:
        raise ValueError("test_size must lie in (0, 1]")
    is_it = F.col("label") == value
    if test_size in (None, 1):
        return replace(ds, df=ds.df.withColumn("split", F.when(is_it, "test").otherwise("train")))
    found = L.cuts(ds.df.where(is_it), F.lit(True), "row_id", seed, lambda n: L.split_sizes(n, test_size))
    return replace(ds, df=L.split_by_cuts(ds.df, is_it, "row_id", seed, found, "test", "train"), shuffled=True)


def cube_data(ds: Dataset, cube: int) -> DataFrame:
    if not 0 <= cube < len(ds.headers):
        raise IndexError("no such cube")
    return ds.df.where(F.col("cube_id") == cube)


def _matrix_shape(ds: Dataset, cube: int) -> tuple[int, int]:
    if ds.headers[cube].rest:
        raise ValueError("the cube's last line is not whole: its samples are no matrix")
    return ds.cube_shapes[cube]


def cube_array(ds: Dataset, cube: int, column: str) -> np.ndarray:
    """A column ('x', 'z', 'v' or 'label') of one cube on the driver, as (nlines, cols) or (nlines, cols, k)."""
    if column == "label":
        ds.need_labels()
    elif column not in ds.df.columns:
        raise RuntimeError(f"the dataset has no {column}")
    df, shape = cube_data(ds, cube), _matrix_shape(ds, cube)
    held = df.orderBy("row_id").select(column).collect()  # one cube
    kind = np.int8 if column == "label" else np.float32
    return np.array([r[0] for r in held], kind).reshape(*shape, *([] if column == "label" else [-1]))


def read_rows(ds: Dataset, rows: list[int], use_z: bool = False) -> DataFrame:
    """(pos, row_id, data) of the given rows in any order, repeats included."""
    if any(not 0 <= r < ds.num_samples for r in rows):
        raise IndexError("row out of range")
    return L.take(ds.df, rows, "row_id").select("pos", "row_id", F.col(ds.data_column(use_z)).alias("data"))


def to_dict(ds: Dataset, split: str = "train", use_z: bool | None = None) -> dict:
    """data, handler_ids and spatial of a part, and labels and label_names if supervised: arrays on the driver."""
    if split not in ("train", "test"):
        raise ValueError("a split is 'train' or 'test'")
    data = ds.data_column(use_z)
    df = ds.df.where(F.col("split") == split) if "split" in ds.df.columns else ds.df if split == "train" else ds.df.limit(0)
    held = list(df.select(data, "cube_id", "x_mm", "y_mm", "label", "row_id").orderBy("row_id").toLocalIterator())
    spatial = np.array([(r.cube_id, r.x_mm, r.y_mm) for r in held], dtype=SPATIAL)
    out = {"data": np.array([r[0] for r in held], np.float32), "handler_ids": spatial["idx"].copy(), "spatial": spatial}
    if ds.unsupervised:
        return out
    return out | {"labels": np.array([r.label for r in held], np.int8), "label_names": list(ds.label_names)}


def to_numpy(ds: Dataset, split: str = "train", use_z: bool | None = None) -> tuple:
    """(X, y, spatial) of a part, or (X, spatial) if unsupervised."""
    got = to_dict(ds, split, use_z)
    return (got["data"], got["spatial"]) if ds.unsupervised else (got["data"], got["labels"], got["spatial"])


def num_batches(ds: Dataset, split: str, batch_size: int = 64) -> int:
    return -(-ds.df.where(F.col("split") == split).count() // batch_size)


def batches(ds: Dataset, split: str | None = None, batch_size: int = 64, shuffle: bool = False, seed: int = 0, use_z: bool | None = None) -> Iterator[tuple]:
    """(X, y, spatial), or (X, spatial) if unsupervised; partitions stream to the driver one at a time."""
    df = ds.df if split is None else ds.df.where(F.col("split") == split)
    data = ds.data_column(use_z)
    ordered = df.orderBy(L.seeded(seed, "row_id"), "row_id") if shuffle else df.orderBy("row_id")
    held: list = []

    def batch():
        x = np.array([r[data] for r in held], np.float32)
        spatial = np.array([(r.cube_id, r.x_mm, r.y_mm) for r in held], dtype=SPATIAL)
        return (x, spatial) if ds.unsupervised else (x, np.array([r.label for r in held], np.int8), spatial)

    for row in ordered.toLocalIterator():
        held.append(row)
        if len(held) == batch_size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def cube_batches(ds: Dataset, use_z: bool | None = None, shuffle: bool = True, seed: int | None = None) -> Iterator[tuple]:
    """(X, y) of a whole cube at a time, of shapes (1, H, W, F) and (1, H, W), or (X,) if unsupervised; one cube is on the driver at once."""
    data = ds.data_column(use_z)
    order = np.arange(len(ds.headers))
    if shuffle:
        np.random.default_rng(seed).shuffle(order)
    for cube in order.tolist():
        h, w = _matrix_shape(ds, cube)
        held = cube_data(ds, cube).select(data, "label").orderBy("row_id").collect()
        x = np.array([r[data] for r in held], np.float32).reshape(1, h, w, -1)
        yield (x,) if ds.unsupervised else (x, np.array([r.label for r in held], np.int8).reshape(1, h, w))


def batch_numbers(ds: Dataset, batch_size: int = 64) -> DataFrame:
    """(row_id, batch) in row order: arithmetic on the explicit order."""
    return ds.df.select("row_id", F.expr(f"row_id div {batch_size}").alias("batch"))


def spatial_patches(ds: Dataset, patch=(32, 32), stride=(16, 16)) -> DataFrame:
    """(cube_id, patch_line, patch_col, row_id, i, j): each sample in each patch that holds it."""
    (ph, pw), (sh, sw) = patch, stride
    shapes = ds.df.sparkSession.createDataFrame([(c, max(0, (h.nlines - ph) // sh + 1), max(0, (h.scanspline - pw) // sw + 1)) for c, h in enumerate(ds.headers)], "cube_id int, np int, mp int")

    def origins(at: str, size: int, step: int, count: str):
        lo = F.greatest(F.lit(0), F.ceil((F.col(at) - (size - 1)) / step).cast("int"))
        hi = F.least(F.col(count) - 1, F.floor(F.col(at) / step).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    df = ds.df.select("cube_id", "row_id", "line", "col").join(F.broadcast(shapes), "cube_id")  # a row a cube
    df = df.withColumn("patch_line", F.explode(origins("line", ph, sh, "np"))).withColumn("patch_col", F.explode(origins("col", pw, sw, "mp")))
    return df.select("cube_id", "patch_line", "patch_col", "row_id", (F.col("line") - F.col("patch_line") * sh).alias("i"), (F.col("col") - F.col("patch_col") * sw).alias("j"))


def patch_arrays(ds: Dataset, patch=(32, 32), stride=(16, 16), use_z: bool | None = None) -> DataFrame:
    """(cube_id, patch_line, patch_col, x, labels): the samples of each patch as [line][column][value], and their labels.

    A group is one patch, so its size is that of the patch whatever the cube's.
    """
    ph, pw = patch
    found = spatial_patches(ds, patch, stride).join(ds.df.select("row_id", F.col(ds.data_column(use_z)).alias("data"), "label"), "row_id")
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "data", "label")))
    grouped = found.groupBy("cube_id", "patch_line", "patch_col").agg(cells.alias("cells"))

    def lines(field: str):
        return F.transform(F.sequence(F.lit(0), F.lit(ph - 1)), lambda i: F.transform(F.slice("cells", i * pw + 1, F.lit(pw)), lambda c: c[field]))

    labels = F.lit(None).cast("array<array<tinyint>>") if ds.unsupervised else lines("label")
    return grouped.select("cube_id", "patch_line", "patch_col", lines("data").alias("x"), labels.alias("labels"))


def patch_batches(ds: Dataset, patch=(32, 32), stride=(16, 16), use_z: bool | None = None, shuffle: bool = True, seed: int = 0) -> Iterator[tuple]:
    """(X, y) of one patch at a time, (ph, pw, F) and (ph, pw), or (X,) if unsupervised."""
    found = patch_arrays(ds, patch, stride, use_z)
    place = F.concat_ws(":", "cube_id", "patch_line", "patch_col")
    by = [L.seeded(seed, "place")] if shuffle else []
    for r in found.withColumn("place", place).orderBy(*by, "cube_id", "patch_line", "patch_col").toLocalIterator():
        x = np.array(r.x, np.float32)
        yield (x,) if ds.unsupervised else (x, np.array(r.labels, np.int8))
