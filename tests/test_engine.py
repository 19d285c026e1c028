"""Kernels against known values, operators against each other, queries against their SQL."""

import hashlib
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import fakes
from sonogrid.functions import exprs, kernels
from sonogrid.model import Header, Scan
from sonogrid.operators import align, dataset, imaging, spatial
from sonogrid.operators import labels as L
from sonogrid.plans import queries as plans
from sonogrid.session import Cube
from sonogrid.sources import hdf5, store, tensors
from sonogrid.streaming import narrow

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(spark, con, plans.QUERIES[name], plans.ORACLES[name], SF) is None


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """A folder whose cube has nine lines and half a line."""
    at = str(tmp_path_factory.mktemp("ragged"))
    compare.connect(SF).execute(f"COPY (SELECT * FROM embeddings WHERE vec_id < 190) TO '{at}/embeddings.parquet'")
    return at


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["set_labels", "batches", "cube_counts", "patch_arrays", "pool_pad", "spatial", "spatial_patches", "split_by_cube", "split_by_label", "split_by_label_share", "stratified_train_test_split", "train_test_split", "train_test_split_ordered", "transform"])
def test_query_equals_sql_on_a_ragged_cube(spark, ragged, name):
    assert compare.difference(spark, compare.connect(ragged), plans.QUERIES[name], plans.ORACLES[name], ragged) is None


def test_ragged_scan(spark, tmp_path):
    x = np.arange(7)[:, None].repeat(3, 1)
    scan = store.from_rows(spark, x, Header(3, 2, 3, rest=1))
    assert len(scan) == 7 and Header.from_json(scan.header.to_json()) == scan.header
    assert spatial.read_rows(scan, -1).first().scan_idx == 6 and spatial.read_rows(scan, (2, 0)).first().scan_idx == 6
    assert [r.scan_idx for r in spatial.read_rows(scan, slice(5, None)).orderBy("scan_idx").collect()] == [5, 6]
    with pytest.raises(IndexError):
        spatial.read_rows(scan, (2, 1))
    assert len(spatial.rectangle_select(scan, 0, 2, 0, 3).validate()) == 6
    store.write_scan(scan, str(tmp_path / "s"))
    assert len(store.read_scan(spark, str(tmp_path / "s")).validate()) == 7 and store.read_scan(spark, str(tmp_path / "s"), 5, 2).df.count() == 2
    with pytest.raises(ValueError):
        L.set_labels(scan, spark.range(6).selectExpr("cast(id as int) as scan_idx", "0 as label"), ("healthy",))


def test_places_of_a_long_cube(spark):
    df = spark.range(30_000).selectExpr("cast(id as int) as scan_idx", "cast(id as int) as line", "0 as col", "cast(null as int) as start", "cast(0 as tinyint) as label", "array(cast(1 as tinyint)) as signal")
    got = dataset.pool([Scan(df, Header(1, 30_000, 1, resolution=400.0))]).spatial
    assert got.where("round(y, 4) <> row_id * 4 / 10d").count() == 0


def test_ragged_dataset(spark, tmp_path):
    scans = [store.from_rows(spark, np.arange(n)[:, None].repeat(3, 1), Header(3, n // 3, 3, rest=n % 3), np.arange(n) % 2, names=("healthy", "a")) for n in (7, 5)]
    store.write_dataset(dataset.pool(scans), str(tmp_path / "d"))
    ds = store.read_dataset(spark, str(tmp_path / "d"))
    assert (len(ds), ds.cube_counts, ds.cube_shapes) == (12, [7, 5], [(2, 3), (1, 3)])
    assert [r.data[0] for r in dataset.read_rows(ds, [7, 11]).orderBy("pos").collect()] == [0, 4]
    assert np.asarray(ds)[:, 0].tolist() == [*range(7), *range(5)] and ds.train_indices.tolist() == list(range(12))
    for bad in (lambda: dataset.cube_array(ds, 0, "x"), lambda: next(dataset.cube_batches(ds))):
        with pytest.raises(ValueError, match="not whole"):
            bad()


def test_ragged_files(spark, monkeypatch):
    monkeypatch.setitem(sys.modules, "h5py", fakes.h5py())
    scan = store.from_rows(spark, np.arange(7)[:, None].repeat(3, 1), Header(3, 2, 3, rest=1), [0] * 7)
    hdf5.write_scan_file(scan, "r.h5sam")
    assert len(hdf5.read_scan_file(spark, "r.h5sam").validate()) == 7
    hdf5.write_dataset_file(dataset.pool([scan, scan]), "r.h5samd")
    back = hdf5.read_dataset_file(spark, "r.h5samd")
    assert back.cube_counts == [7, 7] and np.asarray(back)[:, 0].tolist() == [*range(7), *range(7)]


def grid(spark, nlines=3, cols=4, n=5, fs=25.0, starts=True):
    x = np.zeros((nlines * cols, n), int)
    x[:, 0], x[:, 1] = np.arange(nlines * cols), 7
    return store.from_rows(spark, x, Header(cols, nlines, n, fs), np.arange(nlines * cols) % 3, 2 * np.arange(nlines * cols) if starts else None, ("healthy", "a", "b"))


def pixels(scan):
    out = np.zeros((scan.header.nlines, scan.header.scanspline), int)
    for r in scan.df.collect():
        out[r.line, r.col] = r.signal[0]
        assert r.scan_idx == r.line * scan.header.scanspline + r.col and r.start == 2 * r.signal[0] and r.label == r.signal[0] % 3
    return out


def test_turns(spark):
    scan = grid(spark)
    base = pixels(scan)
    for k in range(5):
        assert (pixels(spatial.rotate(scan, 90 * k)) == np.rot90(base, -k)).all()
    assert (pixels(spatial.mirror(scan, "x")) == base[:, ::-1]).all() and (pixels(spatial.mirror(scan, "Y")) == base[::-1]).all()
    for bad in (lambda: spatial.rotate(scan, 45), lambda: spatial.mirror(scan, "z"), lambda: spatial.rectangle_select(scan, 0, 9, 0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_savgol_and_median_values():
    assert kernels.savgol_matrix(9)[4, 2:7] == pytest.approx(np.array([-3, 12, 17, 12, -3]) / 35, abs=1e-12)
    line = np.arange(20.0)[None]
    assert kernels.savgol(line, 6, 2)[0, [0, 1, 2, 17, 18, 19]] == pytest.approx([0, 1, 2, 17, 18, 19], abs=1e-9)
    for window, order in ((21, 2), (4, 4)):
        with pytest.raises(ValueError):
            kernels.savgol_matrix(20, window, order)
    x = np.random.default_rng(0).integers(-9, 9, (5, 30)).astype(float)
    for k in (1, 3, 5, 59):
        wide = np.pad(x, ((0, 0), (k // 2, k // 2)), mode="reflect")
        assert (kernels.medfilt(x, k) == [[np.median(r[i : i + k]) for i in range(30)] for r in wide]).all()
    for k in (4, 61):
        with pytest.raises(ValueError):
            imaging.preprocess_kernel("medfilt", 30, kernel_size=k)


def test_small_kernels():
    x = np.random.default_rng(1).normal(size=(3, 50))
    assert kernels.irfft(np.fft.rfft(x, axis=1), 50) == pytest.approx(x)
    magnitude, freqs = kernels.fft_spec(np.sin(2 * np.pi * np.arange(64) / 8), 0.5)
    assert magnitude.argmax() == 8 and freqs[8] == 0.25 and len(freqs) == 33
    assert kernels.time_index(1000.0, 2.5, 3).tolist() == [1000.0, 1002.5, 1005.0]
    smooth = kernels.filtfilt(*kernels.butter_lowpass(10, 100), np.ones((2, 40)) * 3)
    assert smooth == pytest.approx(np.full((2, 40), 3.0))
    with pytest.raises(ValueError):
        kernels.filtfilt(*kernels.butter_lowpass(10, 100), np.ones((1, 12)))


def test_medfilt_and_downsample(spark):
    df = spark.createDataFrame([([0, 3, 1, 2, 9, 1, 4, 5, 7], list(range(8)))], "x array<tinyint>, y array<tinyint>")
    m = imaging.preprocess(df.select("x"), 9, [("medfilt", {})])[0].first()
    r = df.select(exprs.downsample(F.col("y"), 8, 2, "mean").alias("d"), exprs.moving_average(F.transform("y", lambda v: F.lit(7)), 8, 5).alias("a")).first()
    assert m.x == [3, 1, 2, 2, 2, 4, 4, 5, 5] and r.d == [0, 2, 4, 6]
    assert r.a[0] == pytest.approx(7 * 3 / 5) and r.a[4] == pytest.approx(7)


def test_filters():
    b, a = kernels.butter_lowpass(10, 100)
    assert b == pytest.approx([0.018099, 0.054297, 0.054297, 0.018099], abs=1e-6) and a == pytest.approx([1, -1.760042, 1.182893, -0.278060], abs=1e-6)
    b, a = kernels.butter_bandpass(5, 20, 100)
    for f in (5, 20):
        z = np.exp(2j * np.pi * f / 100)
        assert abs(np.polyval(b, z) / np.polyval(a, z)) == pytest.approx(0.5**0.5, rel=1e-6)
    x = np.ones((2, 200))
    assert kernels.decimate(x, 4)[:, 20:30] == pytest.approx(np.full((2, 10), (10 ** (-0.05 / 20)) ** 2), rel=1e-6)
    with pytest.raises(ValueError):
        kernels.decimate(np.ones((1, 20)), 2)


def burst(spark):
    def row(*parts):
        j = np.arange(400)
        return np.round(sum((a * np.exp(-(((j - c) / w) ** 2) / 2) * np.sin(0.4 * np.pi * (j - c)) for c, w, a in parts), np.zeros(400))).astype(int)

    rows = [row((100, 8, 100), (250, 6, 60)), row((250, 6, 60)), row((100, 8, 100)), row()]
    return store.from_rows(spark, rows, Header(2, 2, 400, 100.0, 1000))


def test_tof_and_thickness(spark):
    scan = burst(spark)
    got = {r.scan_idx: r.tof for r in imaging.tof(scan).collect()}
    assert got[0] == pytest.approx(2000, abs=6) and got[1] == pytest.approx(3500, abs=6) and got[3] == -1.0
    thick = {r.scan_idx: r.thickness for r in imaging.thickness(scan, 1500.0).collect()}
    assert thick[3] == -1.0 and thick[0] == pytest.approx(got[0] * 1500e-9 / 2, rel=1e-6)
    with pytest.raises(ValueError):
        imaging.thickness(scan, 0)


def test_alignment(spark):
    rng = np.random.default_rng(0)
    template = rng.integers(-100, 100, 240)
    rows = [template[20:220], template[13:213], template[24:224]]
    scan = store.from_rows(spark, rows, Header(3, 1, 200, 100.0))
    out = align.align_xcorr(scan)
    assert out.header.scanlen == 189
    signals = {r.scan_idx: r.signal for r in out.df.collect()}
    assert signals[0] == signals[1] == signals[2]
    with pytest.raises(ValueError):
        align.align_xcorr(scan, max_gate_loss=0.01)
    moved = align.align_tof(burst(spark), 1500.0, 0, 500.0)
    starts = {r.scan_idx: r.start for r in moved.df.collect()}
    assert starts[3] == -1
    same = align.align_xcorr(store.from_rows(spark, [template[:200]] * 3, Header(3, 1, 200, 100.0)))
    assert same.header.scanlen == 200 and same.header.tzero == 0 and same.df.where("start is not null").count() == 0
    gone = store.from_rows(spark, [template[:200]] * 3, Header(3, 1, 200, 100.0), starts=[0, 0, -1])
    assert sorted(r.start for r in align.align_xcorr(gone).df.collect()) == [-1, 0, 0]
    shifted = store.from_rows(spark, [template[:200]] * 2, Header(2, 1, 200, 100.0), starts=[4, 4])
    assert align.align_xcorr(shifted).header.tzero == 40
    collapsed = align.align_manual(scan, scan.df.select("scan_idx", F.lit(5).alias("offset")), 100)
    assert collapsed.header.tzero == 50 and collapsed.df.where("start is not null").count() == 0


def test_start_slices(spark):
    scan = store.from_rows(spark, [[1] * 64] * 3, Header(3, 1, 64, 100.0, 1000), starts=[10, 20, -1])
    assert [r.start for r in spatial.index_range_select(scan, 5, 15).df.orderBy("scan_idx").collect()] == [15, 25, -1]
    assert [r.start for r in spatial.downsample(scan, 4, "sample").df.orderBy("scan_idx").collect()] == [2, 5, -1]


def test_labels(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 1, 1, 2, 2, -1, -1, 0, 1])], "scan_idx int, label tinyint")
    names = ("healthy", "A", "B")
    assert {r.name: r.n for r in L.class_distribution(df, names).collect()} == {"healthy": 3, "A": 3, "B": 2, "unlabeled": 2}
    assert L.num_classes(df) == 3 and L.max_label(df) == 2 and L.is_labeled(df)
    L.verify(df, names)
    with pytest.raises(ValueError):
        L.verify(df, ("healthy", "A"))
    with pytest.raises(ValueError):
        L.add_label(names, "a")
    assert L.add_label(names, "C", 4) == ("healthy", "A", "B", "label3", "label4", "C")
    assert L.rename_label(names, "b", "X") == ("healthy", "A", "X") and L.delete_label(df, names, "A")[1] == ("healthy", "B")
    with pytest.raises(KeyError):
        L.relabel(df, names, {"none": 1})
    with pytest.raises(ValueError):
        L.merge([(df, names)])
    split = L.stratified_split(df, 0.5, 1)
    assert {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}[(2, "test")] == 1


def test_dataset_round_trip(spark, tmp_path):
    a, b = grid(spark, starts=False), grid(spark, 2, 2, 9, starts=False)
    for k, s in enumerate((a, b)):
        store.write_scan(s, str(tmp_path / f"s{k}"))
    assert store.read_scan(spark, str(tmp_path / "s0"), 2, 3).df.count() == 3
    ds = store.convert(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")], str(tmp_path / "d"), pad_value=-1.0)
    assert (ds.num_samples, ds.maxlen, ds.cube_shapes, ds.unsupervised) == (16, 9, [(3, 4), (2, 2)], False)
    split = dataset.train_test_split(ds, 0.25, 3)
    assert split.df.where("split = 'train'").count() == 12 and dataset.num_batches(split, "test", 3) == 2
    got = list(dataset.batches(split, "train", 5, shuffle=True, seed=1))
    assert [len(x) for x, _, _ in got] == [5, 5, 2] and got[0][0].shape == (5, 9)
    assert dataset.spatial_patches(ds, (2, 2), (1, 1)).select("cube_id", "patch_line", "patch_col").distinct().count() == 2 * 3 + 1
    with pytest.raises(ValueError):
        dataset.split_by_label(ds, "none")
    with pytest.raises(RuntimeError):
        dataset.stratified_train_test_split(dataset.pool([a], unsupervised=True))


def test_row_access(spark):
    scan = grid(spark)
    assert spatial.read_rows(scan, -1).first().scan_idx == 11 and spatial.read_rows(scan, (1, 2)).first().scan_idx == 6
    assert sorted(r.scan_idx for r in spatial.read_rows(scan, slice(None, None, -5)).collect()) == [1, 6, 11]
    with pytest.raises(IndexError):
        spatial.read_rows(scan, 12)


def test_stream(spark, tmp_path):
    scan = grid(spark, starts=False)
    store.write_scan(scan, str(tmp_path / "in"))
    live = narrow.stream_scan(spark, str(tmp_path / "in/ascans"), scan.header)
    narrow.write_stream(imaging.image(live, "max"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_pushdown(spark, tmp_path):
    scan = grid(spark, starts=False)
    store.write_scan(scan, str(tmp_path / "in"))
    df = imaging.image(spatial.rectangle_select(store.read_scan(spark, str(tmp_path / "in")), 1, 2, 0, 2), "max")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(line,1)" in plan and "label" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_header():
    h = Header(4, 3, 5, 25.0, 10, extra={"k": 1})
    assert Header.from_json(h.to_json()) == h and h.spacing == 40.0 and h.time(1, 3) == [50.0, 90.0] and h.sample_index(50) == 1
    assert Header.from_json('{"scanspline":1,"nlines":1,"scanlen":2,"odd":3}').extra == {"odd": 3}


def test_cube_batches(spark):
    a, b = grid(spark), grid(spark, 2, 5)
    ds = dataset.pool([a, b])
    got = list(dataset.cube_batches(ds, shuffle=False))
    assert [(x.shape, y.shape) for x, y in got] == [((1, 3, 4, 5), (1, 3, 4)), ((1, 2, 5, 5), (1, 2, 5))]
    for (x, y), shape in zip(got, ds.cube_shapes):
        n = shape[0] * shape[1]
        assert (x[0, :, :, 0] == np.arange(n).reshape(shape)).all() and (x[0, :, :, 1] == 7).all()
        assert (y[0] == (np.arange(n) % 3).reshape(shape)).all()
    order = np.arange(2)
    np.random.default_rng(4).shuffle(order)
    assert [x.shape[1] for x, _ in dataset.cube_batches(ds, seed=4)] == [ds.cube_shapes[i][0] for i in order]
    assert [len(t) for t in dataset.cube_batches(dataset.pool([a], unsupervised=True))] == [1]
    with pytest.raises(RuntimeError):
        next(dataset.cube_batches(ds, use_z=True))


def in_order(seed, keys):
    """Keys in the seeded order, worked out here."""
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], k))


@pytest.mark.parametrize("rows", [100_000, 7])
def test_members_of_splits(spark, monkeypatch, rows):
    monkeypatch.setattr(L, "SLICE_ROWS", rows)
    df = spark.range(400).selectExpr("cast(id as int) as scan_idx", "cast(if(id = 7, 5, id % 3 - 1) as tinyint) as label", "'x' as by").repartition(5)
    got = {r.scan_idx: r.split for r in L.stratified_split(df, 0.3, 9).collect()}
    for label in (-1, 0, 1, 5):
        members = [i for i in range(400) if (5 if i == 7 else i % 3 - 1) == label]
        assert {i for i in members if got[i] == "test"} == set(in_order(9, members)[: max(1, int(len(members) * 0.3))])
    assert L.stratified_split(df.limit(0)).count() == 0
    plan = L.stratified_split(df, 0.3, 9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def labelled_set(spark):
    return dataset.pool([grid(spark, starts=False), grid(spark, 2, 2, 9, starts=False)], pad_value=-1.0)


def test_split_members_of_a_dataset(spark):
    ds = labelled_set(spark)
    got = dataset.train_test_split(ds, 0.3, 5)
    assert got.shuffled and sorted(got.train_indices.tolist()) == sorted(in_order(5, range(16))[:11])
    assert (got.num_train_batches(4), got.num_test_batches(4)) == (3, 2) and len(got.test_indices) == 5
    assert dataset.train_test_split(ds, 0.99, 5).train_indices.tolist() == []
    whole = dataset.split_by_label(ds, "a", 0.5, 2)
    members = [r.row_id for r in ds.df.where("label = 1").collect()]
    assert sorted(whole.test_indices.tolist()) == sorted(in_order(2, members)[: max(1, len(members) // 2)])
    assert ds.train_indices.tolist() == list(range(16)) and ds.test_indices.tolist() == []
    own = ds.with_indices([3, 1], [2])
    assert own.train_indices.tolist() == [1, 3] and own.test_indices.tolist() == [2]
    with pytest.raises(ValueError):
        ds.with_indices([1], [1])


def test_dataset_arrays(spark):
    ds = labelled_set(spark)
    assert (len(ds), ds.scanlens, ds.cube_resolutions, ds.num_features, ds.has_z) == (16, [5, 9], [1.0, 1.0], None, False)
    x = np.asarray(ds)
    assert x.shape == (16, 9) and (x[:12, 5:] == -1).all() and (x[:, 0] == [*range(12), *range(4)]).all()
    assert dataset.cube_array(ds, 1, "x").shape == (2, 2, 9) and (dataset.cube_array(ds, 0, "label") == np.arange(12).reshape(3, 4) % 3).all()
    for bad in (lambda: dataset.cube_array(ds, 0, "z"), lambda: dataset.cube_array(ds, 0, "v"), lambda: dataset.read_rows(ds, [0], use_z=True)):
        with pytest.raises(RuntimeError):
            bad()
    with pytest.raises(IndexError):
        dataset.cube_array(ds, 2, "x")
    z = np.arange(32, dtype=np.float32).reshape(16, 2)
    more = ds.with_z(z).with_v(z[:, :1] * 2)
    assert more.num_features == 2 and (dataset.cube_array(more, 1, "z") == z[12:].reshape(2, 2, 2)).all() and (dataset.cube_array(more, 0, "v")[..., 0] == 2 * z[:12, 0].reshape(3, 4)).all()
    assert more.with_z(None).num_features is None and not more.with_z(None).has_z
    got = dataset.read_rows(more, [5, 0, 5], use_z=True).orderBy("pos").collect()
    assert [(r.pos, r.row_id, r.data) for r in got] == [(0, 5, [10.0, 11.0]), (1, 0, [0.0, 1.0]), (2, 5, [10.0, 11.0])]
    with pytest.raises(IndexError):
        dataset.read_rows(ds, [16])
    with pytest.raises(ValueError):
        ds.with_z(z[:3])
    assert ds.transform(lambda m: m[:, :3]).num_features == 3
    split = dataset.train_test_split(more, 0.25, shuffle=False)
    held = dataset.to_dict(split, "test")
    assert (held["data"] == z[12:]).all() and held["handler_ids"].tolist() == [1] * 4 and held["labels"].tolist() == [0, 1, 2, 0] and held["label_names"] == ["healthy", "a", "b"]
    assert held["spatial"]["x"].tolist() == pytest.approx([0, 0.001, 0, 0.001])
    assert [len(v) for v in dataset.to_numpy(split, "train", use_z=False)] == [12, 12, 12] and len(dataset.to_numpy(ds, "test")[0]) == 0
    plain = dataset.pool([grid(spark)], unsupervised=True)
    assert set(dataset.to_dict(plain)) == {"data", "handler_ids", "spatial"} and len(dataset.to_numpy(plain)) == 2
    with pytest.raises(RuntimeError):
        plain.class_distribution()
    assert sum(len(b[0]) for b in ds) == 16


def test_dataset_labels(spark):
    ds = labelled_set(spark)
    assert {r["name"]: r["n"] for r in ds.class_distribution().collect()} == {"healthy": 6, "a": 5, "b": 5} and ds.num_classes() == 3
    assert sorted(r.label for r in ds.to_binary("a").collect()) == [0] * 11 + [1] * 5
    assert all(len(r.one_hot) == 3 and sum(r.one_hot) == 1 for r in ds.to_one_hot().collect())
    assert ds.relabel({"a": "b"}).label_names == ("healthy", "b")


def test_patches(spark):
    ds = labelled_set(spark)
    got = {(r.cube_id, r.patch_line, r.patch_col): np.array(r.x) for r in dataset.patch_arrays(ds, (2, 3), (1, 1)).collect()}
    cube = dataset.cube_array(ds, 0, "x")
    assert set(got) == {(0, i, j) for i in range(2) for j in range(2)}
    for (_, i, j), x in got.items():
        assert (x == cube[i : i + 2, j : j + 3]).all()
    first = [x for x, _ in dataset.patch_batches(ds, (2, 2), (2, 2), seed=3)]
    assert len(first) == 3 and all(x.shape == (2, 2, 9) for x in first)
    assert all(len(t) == 1 for t in dataset.patch_batches(dataset.pool([grid(spark)], unsupervised=True), (2, 2), (2, 2)))


def test_label_sets(spark):
    got = L.Labels.from_dict(spark, {"labels": [0, 1, -1, 2], "label_names": ["healthy", "A", "B"]})
    assert len(got) == 4 and got[-1] == 2 and got[2] == -1 and got.label_name(1) == "A" and np.asarray(got).tolist() == [0, 1, -1, 2]
    assert got.take([3, 3, 0]).to_dict() == {"labels": [2, 2, 0], "label_names": ["healthy", "A", "B"]}
    assert got.has_name("b") and not got.has_name("C") and not got.has_name("label7") and got.copy().to_dict() == got.to_dict()
    assert got.merge(got.rename_label("A", "C")).class_distribution() == {"healthy": 2, "A": 1, "B": 2, "C": 1, "unlabeled": 2}
    assert [len(p) for p in L.Labels(got.df.withColumn("label", F.lit(0).cast("tinyint"))).stratified_split(0.5)] == [2, 2]
    for bad in (lambda: got.take([]), lambda: L.Labels(got.df.limit(0)), lambda: np.array(got, copy=False)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        got[4]
    scan = grid(spark)
    names = ("healthy", "X")
    done = L.set_labels(scan, scan.df.selectExpr("scan_idx", "scan_idx % 2 as label"), names)
    assert done.label_names == names and L.create_unlabeled(done.df)[0].where("label <> -1").count() == 0
    for bad in (scan.df.selectExpr("scan_idx", "scan_idx % 3 as label"), scan.df.selectExpr("scan_idx", "0 as label").limit(5), scan.df.selectExpr("0 as scan_idx", "0 as label")):
        with pytest.raises(ValueError):
            L.set_labels(scan, bad, names)


def test_scan_as_an_object(spark):
    scan = grid(spark, starts=True)
    assert (len(scan), scan.rows, scan.cols, scan.scanlen, scan.samplerate) == (12, 3, 4, 5, 25.0) and np.asarray(scan)[:, 0].tolist() == list(range(12))
    assert [r.scan_idx for r in scan] == list(range(12)) and isinstance(hash(scan), int)
    assert scan.time(3)[0] == 240.0 and scan.time(0) == scan.relative_time() and scan.absolute_time(2)[0] == 160.0
    with pytest.raises(IndexError):
        scan.absolute_time(12)
    h = scan.header.set_extra("k", 2)
    assert h.extra == {"k": 2} and h.copy() == h and scan.header.extra == {} and Header.from_json(h.to_json()) == h
    assert Header.from_attributes({"scanspline": 1.0, "nlines": 2, "scanlen": 3, "quality": np.uint8(1), "version": 4, "odd": "x"}) == Header(1, 2, 3, quality=True, extra={"odd": "x"})
    with pytest.raises(TypeError):
        scan.header.set_extra("k", [1])
    assert not scan.loaded and scan.materialize().materialized
    scan.df.unpersist()


def test_in_place(spark, tmp_path):
    cube = Cube(grid(spark))
    assert cube.rotate(90) is cube and cube.shape == (4, 3, 5)
    other = cube.mirror("x", in_place=False)
    assert other is not cube and cube.downsample(1, "sample") is cube
    assert cube.rectangle_select(0, 1, 0, 2) is not cube and cube.rectangle_select(0, 1, 0, 2, in_place=True) is cube and cube.shape == (1, 2, 5)
    assert len(cube) == 2 and cube[0].count() == 1 and len(cube.label_set) == 2 and np.asarray(cube).shape == (2, 5)
    cube.header = cube.header.set_extra("k", 1)
    cube.starts = cube.df.selectExpr("scan_idx", "scan_idx + 5 as start")
    cube.path = "here"
    assert cube.header.extra == {"k": 1} and cube.path == "here" and sorted(r.start for r in cube.starts.collect()) == [5, 6]
    cube.starts = None
    assert cube.starts.where("start is not null").count() == 0 and cube.validate()
    cube.save(str(tmp_path / "c"))
    assert Cube.open(spark, str(tmp_path / "c")).path and cube.image("max").count() == 2 and cube.copy().scan is cube.scan


def test_hdf5(spark, monkeypatch):
    with pytest.raises(RuntimeError):
        hdf5.read_scan_file(spark, "x.h5sam")
    monkeypatch.setitem(sys.modules, "h5py", fakes.h5py())
    scan = grid(spark)
    hdf5.write_scan_file(scan, "a.H5SAM")
    back = hdf5.read_scan_file(spark, "a.H5SAM")
    assert back.header == scan.header and back.label_names == scan.label_names and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, scan.df.collect()))
    assert [r.scan_idx for r in hdf5.read_scan_file(spark, "a.H5SAM", 2, 3)] == [2, 3, 4]
    for bad in (lambda: hdf5.read_scan_file(spark, "a.H5SAM", 9, 9), lambda: hdf5.read_scan_file(spark, "a.txt"), lambda: hdf5.write_dataset_file(labelled_set(spark), "a.H5SAMD")):
        with pytest.raises(ValueError):
            bad()
    ds = labelled_set(spark).with_z(np.ones((16, 2)))
    hdf5.write_dataset_file(ds, "d.h5samd")
    got = hdf5.read_dataset_file(spark, "d.h5samd")
    assert (got.headers, got.label_names, got.maxlen, got.num_features, got.unsupervised) == (ds.headers, ds.label_names, 9, 2, False)
    assert (np.asarray(got) == np.asarray(ds)).all() and (dataset.cube_array(got, 1, "label") == dataset.cube_array(ds, 1, "label")).all()
    hdf5.write_dataset_file(dataset.pool([grid(spark)], unsupervised=True), "u.h5samd")
    assert hdf5.read_dataset_file(spark, "u.h5samd").unsupervised


def test_stored_datasets(spark, tmp_path):
    ds = labelled_set(spark).with_z(np.ones((16, 2)))
    store.write_dataset(ds, str(tmp_path / "d"), codec="gzip", block_bytes=1 << 20)
    got = store.read_dataset(spark, str(tmp_path / "d"))
    assert got.num_features == 2 and got.has_z and any(f.endswith(".gz.parquet") for f in os.listdir(tmp_path / "d/samples"))
    store.write_scan(grid(spark), str(tmp_path / "s"))
    kept = store.convert(spark, [str(tmp_path / "s")], str(tmp_path / "u"), unsupervised=True)
    assert kept.unsupervised and kept.df.where("label is not null").count() == 0
    assert spark.read.parquet(str(tmp_path / "u/samples")).where("label = 1").count() == 4  # stored all the same


def test_tensors(spark, monkeypatch):
    ds = labelled_set(spark)
    with pytest.raises(RuntimeError):
        tensors.tensor(ds)
    monkeypatch.setitem(sys.modules, "torch", fakes.torch())
    assert tensors.tensor(ds, np.float64, "gpu").value.shape == (16, 9)
    split = dataset.train_test_split(ds, 0.25, shuffle=False)
    got = list(tensors.loader(split, "test", 2))
    assert len(got) == 4 and got[0][0].shape == (9,) and got[0][2] == {"idx": 1, "x": 0.0, "y": 0.0} and got[1][1] == 1
    mixed = [x[0][0] for x in tensors.loader(split, "train", seed=2, with_spatial=False)]
    assert sorted(mixed) == list(range(12)) and mixed != sorted(mixed)
    assert all(len(t) == 1 for t in tensors.items(dataset.pool([grid(spark)], unsupervised=True), with_spatial=False))
