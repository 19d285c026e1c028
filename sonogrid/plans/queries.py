"""One query an operator over the canonical cube, and its SQL.

Outputs are long and rounded alike on both sides.  The SQL side says filters and
spectra as explicit sums; their weights are worked out in this module from the
textbook forms, not taken from the kernels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sonogrid.functions import exprs, kernels
from sonogrid.operators import align, dataset, imaging, spatial
from sonogrid.operators import labels as L
from sonogrid.plans import cube as C
from sonogrid.plans.cube import NAMES, SQL_CUBE, SQL_EDGE, SQL_LONG, canonical, edge, long, sized
from sonogrid.functions.arrow import with_kernel

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HZ = C.FS * 1e6


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _doubles(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _signal_long(scan):
    return scan.df.select("scan_idx", F.posexplode("signal").alias("i", "v")).withColumn("v", F.col("v").cast("int"))


def _placed(scan, *more):
    return scan.df.select("scan_idx", "line", "col", F.col("label").cast("int").alias("label"), F.aggregate("signal", F.lit(0), lambda a, v: a + v.cast("int")).alias("total"), *more)


# --- images -----------------------------------------------------------------------------------------------------
_ABS = "least(127, greatest(abs(list_max(s)), abs(list_min(s))))"
for _mode, _sql, _kind in (
    ("max", "list_max(s)::INT", "int"),
    ("absmax", f"{_ABS}::INT", "int"),
    ("power", "list_sum(list_transform(s, lambda v: v * v))::DOUBLE", "double"),
):

    @query(f"image_{_mode}", f"WITH {SQL_CUBE} SELECT line, col, {_sql} AS value FROM cube")
    def _image(spark, d, mode=_mode, kind=_kind):
        return imaging.image(canonical(spark, d), mode).select("line", "col", F.col("value").cast(kind).alias("value"))


@query("image_edge", f"WITH {SQL_EDGE} SELECT scan_idx, list_max(s)::INT AS top, {_ABS}::INT AS absmax, list_sum(list_transform(s, lambda v: v * v))::DOUBLE AS power FROM edge")
def _image_edge(spark, d):
    s = F.col("signal")
    return edge(spark).df.select("scan_idx", exprs.image(s, "max").cast("int").alias("top"), exprs.image(s, "absmax").cast("int").alias("absmax"), exprs.image(s, "power").cast("double").alias("power"))


@query("normalized_data", f"WITH {SQL_LONG} SELECT scan_idx, i, v / 128 AS v FROM long")
def _normalized(spark, d):
    return long(imaging.normalized_data(canonical(spark, d)), "signal", digits=None)


# --- selections -------------------------------------------------------------------------------------------------
@query("rectangle_select", f"WITH {SQL_CUBE} SELECT ((line - 2) * 7 + col - 5)::INT AS scan_idx, line - 2 AS line, col - 5 AS col, label, list_sum(s)::INT AS total FROM cube WHERE line >= 2 AND line < 6 AND col >= 5 AND col < 12")
def _rectangle(spark, d):
    return _placed(spatial.rectangle_select(sized(spark, d), 2, 6, 5, 12))


@query("index_range_select", f"WITH {SQL_LONG} SELECT scan_idx, i - 10 AS i, v::INT AS v, 1100 AS tzero FROM long WHERE i >= 10 AND i < 30")
def _index_range(spark, d):
    cut = spatial.index_range_select(canonical(spark, d), 10, 30, aligned=False)
    return _signal_long(cut).withColumn("tzero", F.lit(cut.header.tzero))


@query("time_range_select", f"WITH {SQL_LONG} SELECT scan_idx, i - 20 AS i, v::INT AS v FROM long WHERE i >= 20 AND i < 50")
def _time_range(spark, d):
    return _signal_long(spatial.time_range_select(canonical(spark, d), 1200.0, 1500.0, aligned=False))


@query("gate", f"WITH {SQL_LONG} SELECT scan_idx, i - 8 AS i, v FROM long WHERE i >= 8 AND i < 24")
def _gate(spark, d):
    return long(canonical(spark, d).df.withColumn("x", exprs.gate(F.col("signal"), 64, 8, 24)), "x", digits=None)


@query("row_access", f"WITH {SQL_CUBE} SELECT scan_idx, list_sum(s)::INT AS total FROM cube WHERE scan_idx >= 10 AND scan_idx < 200 AND (scan_idx - 10) % 7 = 0")
def _rows(spark, d):
    got = spatial.read_rows(sized(spark, d), slice(10, 200, 7))
    return got.select("scan_idx", F.aggregate("signal", F.lit(0), lambda a, v: a + v.cast("int")).alias("total"))


# --- permutations -----------------------------------------------------------------------------------------------
_NL = "(SELECT count(*) // 20 FROM cube)"
for _name, _f, _line, _col, _width in (
    ("rotate_90", lambda s: spatial.rotate(s, 90), "col", f"{_NL} - 1 - line", _NL),
    ("rotate_180", lambda s: spatial.rotate(s, -180), f"{_NL} - 1 - line", "19 - col", "20"),
    ("rotate_270", lambda s: spatial.rotate(s, 270), "19 - col", "line", _NL),
    ("mirror_x", lambda s: spatial.mirror(s, "x"), "line", "19 - col", "20"),
    ("mirror_y", lambda s: spatial.mirror(s, "Y"), f"{_NL} - 1 - line", "col", "20"),
):

    @query(_name, f"WITH {SQL_CUBE}, m AS (SELECT ({_line})::INT AS l, ({_col})::INT AS c, label, list_sum(s)::INT AS total, {_width} AS w FROM cube) SELECT (l * w + c)::INT AS scan_idx, l AS line, c AS col, label, total FROM m")
    def _turn(spark, d, f=_f):
        return _placed(f(sized(spark, d)))


# --- time -------------------------------------------------------------------------------------------------------
@query("time_axis", f"WITH {SQL_CUBE} SELECT scan_idx, i::INT AS i, round(1000 + (CASE WHEN scan_idx % 5 = 0 THEN 0 ELSE scan_idx % 10 END + i) / 100.0::DOUBLE * 1e3, 4) + 0.0 AS v FROM cube, range(64) t(i)")
def _time(spark, d):
    scan = canonical(spark, d)
    start = F.when(F.col("scan_idx") % 5 == 0, -1).otherwise(F.col("scan_idx") % 10)
    return long(scan.df.withColumn("t", exprs.time_axis(start, scan.header)), "t")


@query("sample_index", f"WITH {SQL_CUBE} SELECT scan_idx, round_even((1000 + scan_idx * 3.7::DOUBLE - 1000) / 10, 0)::INT AS idx FROM cube")
def _sample_index(spark, d):
    scan = canonical(spark, d)
    t = F.lit(1000) + F.col("scan_idx") * F.lit(3.7)
    return scan.df.select("scan_idx", exprs.sample_index(t, scan.header).alias("idx"))


@query("sample_time", f"WITH {SQL_CUBE} SELECT scan_idx, 1000 + scan_idx * 10.0::DOUBLE AS t FROM cube")
def _sample_time(spark, d):
    scan = canonical(spark, d)
    return scan.df.select("scan_idx", exprs.sample_time(F.col("scan_idx"), scan.header).alias("t"))


# --- downsampling -----------------------------------------------------------------------------------------------
_BLOCK = "list_sort(s[i * 4 + 1 : i * 4 + 4])"
for _mode, _sql in (("sample", "s[i * 4 + 1]"), ("mean", "trunc(list_sum(s[i * 4 + 1 : i * 4 + 4]) / 4.0)"), ("median", f"trunc(({_BLOCK}[2] + {_BLOCK}[3]) / 2.0)")):

    @query(f"downsample_{_mode}", f"WITH {SQL_CUBE} SELECT scan_idx, i::INT AS i, ({_sql})::INT AS v FROM cube, range(16) t(i)")
    def _down(spark, d, mode=_mode):
        return _signal_long(spatial.downsample(canonical(spark, d), 4, mode))


def _linear(matrix: np.ndarray, table: str = "long") -> str:
    """SQL of matrix @ signal, long."""
    rows, n = matrix.shape
    flat = _doubles(matrix.ravel())
    return f"m AS (SELECT unnest(range({rows * n})) AS k, unnest({flat}) AS w), o AS (SELECT scan_idx, (k // {n})::INT AS o, sum(w * v) AS v FROM {table} JOIN m ON k % {n} = i WHERE w <> 0 GROUP BY ALL)"


def _bilinear(zeros: int, poles, gain_at: float = 0.0):
    """(b, a) in powers of 1/z of an analogue filter of ``zeros`` zeros at 0 and given poles, gain one at an angle; s = (1 - 1/z) / (1 + 1/z)."""
    minus, plus = np.array([1.0, -1.0]), np.array([1.0, 1.0])
    b, a = np.array([1.0 + 0j]), np.array([1.0 + 0j])
    for _ in range(zeros):
        b = np.convolve(b, minus)
    for p in poles:
        a = np.convolve(a, minus - p * plus)
    for _ in range(len(poles) - zeros):
        b = np.convolve(b, plus)
    z = np.exp(-1j * gain_at * np.arange(len(a)))
    b = b / abs((b * z).sum() / (a * z).sum())
    return (b / a[0]).real, (a / a[0]).real


#: order three: the cube roots of -1 but for the right half plane
_BUTTER3 = [-1.0, complex(-0.5, math.sqrt(0.75)), complex(-0.5, -math.sqrt(0.75))]


def _lowpass3(cutoff: float, fs: float):
    return _bilinear(0, [p * math.tan(math.pi * cutoff / fs) for p in _BUTTER3])


def _bandpass3(low: float, high: float, fs: float):
    lo, hi = (math.tan(math.pi * f / fs) for f in (low, high))
    pairs = [np.roots([1, -p * (hi - lo), lo * hi]) for p in _BUTTER3]
    return _bilinear(3, np.concatenate(pairs), 2 * math.atan(math.sqrt(lo * hi)))


def _chebyshev8(cutoff: float, ripple: float = 0.05):
    """Type one of order eight; the gain at zero is the ripple's floor, as the order is even."""
    spread = math.asinh(1 / math.sqrt(10 ** (ripple / 10) - 1)) / 8
    angles = [math.pi * (2 * k + 1) / 16 for k in range(8)]
    b, a = _bilinear(0, [complex(-math.sinh(spread) * math.sin(t), math.cosh(spread) * math.cos(t)) * math.tan(math.pi * cutoff / 2) for t in angles])
    return b * 10 ** (-ripple / 20), a


def _recursion(b, a, x):
    """Plain difference equation over columns, from rest."""
    y = np.zeros_like(x)
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(min(i + 1, len(b)))) - sum(a[k] * y[i - k] for k in range(1, min(i + 1, len(a))))
    return y


def _there_and_back(b, a, edge: int, n: int = 64, lead: int = 1000) -> np.ndarray:
    """Matrix of zero-phase filtering: odd reflection by ``edge``, and constants for so long that the filter is at rest."""
    x = np.eye(n)
    wide = np.vstack([2 * x[:1] - x[edge:0:-1], x, 2 * x[-1:] - x[-2 : -edge - 2 : -1]])
    for _ in range(2):
        wide = _recursion(b, a, np.vstack([np.repeat(wide[:1], lead, axis=0), wide]))[lead:][::-1]
    return wide[edge : edge + n]


@query("downsample_decimate", f"WITH {SQL_LONG}, {_linear(_there_and_back(*_chebyshev8(0.8 / 4), 27)[::4])} SELECT scan_idx, o AS i, trunc(greatest(-128, least(127, v)))::INT AS v FROM o")
def _decimate(spark, d):
    return _signal_long(spatial.downsample(canonical(spark, d), 4, "decimate"))


# --- normalising, detrending, smoothing ---------------------------------------------------------------------------
_SAFE = "CASE WHEN {0} = 0 THEN 1 ELSE {0} END"
for _mode, _sql in (
    ("max", f"v / {_SAFE.format('max(abs(v)) OVER w')}"),
    ("zscore", f"(v - avg(v) OVER w) / {_SAFE.format('stddev_pop(v) OVER w')}"),
    ("minmax", f"(v - min(v) OVER w) / {_SAFE.format('(max(v) OVER w - min(v) OVER w)')}"),
):

    @query(f"normalize_{_mode}", f"WITH {SQL_LONG} SELECT scan_idx, i, round({_sql}, 4) + 0.0 AS v FROM long WINDOW w AS (PARTITION BY scan_idx)")
    def _normalise(spark, d, mode=_mode):
        return long(canonical(spark, d).df.withColumn("x", exprs.normalize(F.col("signal"), mode)), "x")


@query("detrend", f"WITH {SQL_LONG}, f AS (SELECT scan_idx, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM long GROUP BY 1) SELECT scan_idx, i, round(v - a - b * i + 0.0000123, 4) + 0.0 AS v FROM long JOIN f USING (scan_idx)")
def _detrend(spark, d):
    # many values end in a five at the rounded place: both sides move off it alike
    return long(canonical(spark, d).df.withColumn("x", F.transform(exprs.detrend(F.col("signal")), lambda v: v + 0.0000123)), "x")


@query("moving_average", f"WITH {SQL_LONG} SELECT scan_idx, i, round(sum(v) OVER (PARTITION BY scan_idx ORDER BY i ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) / 4, 4) + 0.0 AS v FROM long")
def _moving(spark, d):
    return long(canonical(spark, d).df.withColumn("x", exprs.moving_average(F.col("signal"), 64, 4)), "x")


@query("medfilt", f"WITH {SQL_LONG}, n AS (SELECT a.scan_idx, a.i, b.v FROM long a CROSS JOIN range(-2, 3) t(o) JOIN long b ON b.scan_idx = a.scan_idx AND b.i = CASE WHEN a.i + o < 0 THEN -(a.i + o) WHEN a.i + o > 63 THEN 126 - a.i - o ELSE a.i + o END) SELECT scan_idx, i, median(v) AS v FROM n GROUP BY ALL")
def _medfilt(spark, d):
    df = canonical(spark, d).df.select("scan_idx", F.col("signal").alias("x"))
    return long(imaging.preprocess(df, 64, [("medfilt", {"kernel_size": 5})])[0], "x", digits=None)


def _savgol_matrix(window: int = 5, order: int = 2, n: int = 64) -> np.ndarray:
    """Running fits of unit impulses, their weights in reverse; fits of the first and last window at the ends."""
    half = window // 2
    fits = [np.polyval(np.polyfit(np.arange(window), unit, order), np.arange(window)) for unit in np.eye(window)]
    m = np.zeros((n, n))
    for k in range(window):
        for i in range(half, n - half):
            m[i, i - half + window - 1 - k] = fits[k][half]
        m[:half, k] = fits[k][:half]
        m[n - half :, n - window + k] = fits[k][window - half :]
    return m


def _kernel_query(name: str, sql_matrix, steps):
    sql = f"WITH {SQL_LONG}, {_linear(sql_matrix)} SELECT scan_idx, o AS i, round(v, 4) + 0.0 AS v FROM o"

    @query(name, sql)
    def _run(spark, d):
        df = canonical(spark, d).df.select("scan_idx", F.col("signal").alias("x"))
        return long(imaging.preprocess(df, 64, steps, kind="double")[0], "x")


def _impulse(b, a, n: int = 64) -> np.ndarray:
    """Causal convolution matrix from the impulse response, by plain recursion."""
    h = []
    for i in range(n):
        h.append((b[i] if i < len(b) else 0.0) - sum(a[k] * h[i - k] for k in range(1, min(i, len(a) - 1) + 1)))
    return np.array([[h[i - j] if i >= j else 0.0 for j in range(n)] for i in range(n)])


_kernel_query("savgol", _savgol_matrix(), [("savgol", {})])
_kernel_query("savgol_even", _savgol_matrix(6, 3), [("savgol", {"window_length": 6, "polyorder": 3})])
_kernel_query("lp", _impulse(*_lowpass3(10.0, 100.0)), [("lp", {"cutoff": 10.0, "fs": 100.0})])
_kernel_query("bp", _impulse(*_bandpass3(5.0, 20.0, 100.0)), [("bp", {"lo": 5.0, "hi": 20.0, "fs": 100.0})])
_kernel_query("preprocess_chain", _savgol_matrix() @ _impulse(*_lowpass3(10.0, 100.0)), [("lp", {"cutoff": 10.0, "fs": 100.0}), ("savgol", {})])


def _direct_query(name: str, sql_matrix, kernel):
    sql = f"WITH {SQL_LONG}, {_linear(sql_matrix)} SELECT scan_idx, o AS i, round(v, 4) + 0.0 AS v FROM o"

    @query(name, sql)
    def _run(spark, d):
        return long(with_kernel(canonical(spark, d).df.select("scan_idx", "signal"), 64, kernel, {"x": ("double", 1)}), "x")


_direct_query("filtfilt", _there_and_back(*_lowpass3(10.0, 100.0), 12), lambda x: kernels.filtfilt(*kernels.butter_lowpass(10.0, 100.0), x))
_direct_query("irfft", np.eye(64), lambda x: kernels.irfft(np.fft.rfft(x, axis=1), 64))

# --- Hilbert family -----------------------------------------------------------------------------------------------
# the imaginary part is a circular convolution with (2 / n) / tan(pi m / n) at odd m
_HILBERT = np.array([[(2 / 64) / math.tan(math.pi * (i - j) / 64) if (i - j) % 2 else 0.0 for j in range(64)] for i in range(64)])
_ENV = f"WITH {SQL_LONG}, {_linear(_HILBERT)}, e AS (SELECT o.scan_idx, o.o AS i, long.v AS re, o.v AS im, sqrt(long.v * long.v + o.v * o.v) AS env FROM o JOIN long ON long.scan_idx = o.scan_idx AND long.i = o.o)"


@query("envelope", f"{_ENV} SELECT scan_idx, i, round(env, 4) AS v FROM e")
def _envelope(spark, d):
    df = canonical(spark, d).df.select("scan_idx", F.col("signal").alias("x"))
    return long(imaging.preprocess(df, 64, [("envelope", {})], kind="double")[0], "x")


@query("analytic", f"{_ENV} SELECT scan_idx, i, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM e")
def _analytic(spark, d):
    got = imaging.analytic(canonical(spark, d)).select("scan_idx", F.posexplode(F.arrays_zip("re", "im")).alias("i", "z"))
    return got.select("scan_idx", "i", (F.round("z.re", 4) + 0.0).alias("re"), (F.round("z.im", 4) + 0.0).alias("im"))


@query("phase_stats", f"{_ENV}, p AS (SELECT scan_idx, avg(im / env) AS s, avg(re / env) AS c FROM e GROUP BY 1) SELECT scan_idx, round(atan2(s, c), 4) + 0.0 AS phase_mean, round(1 - sqrt(s * s + c * c), 4) + 0.0 AS phase_variance FROM p")
def _phase(spark, d):
    got = imaging.phase_stats(canonical(spark, d))
    return got.select("scan_idx", *[(F.round(c, 4) + 0.0).alias(c) for c in ("phase_mean", "phase_variance")])


def _tof_sql(tail: str, lo: int = 4, hi: int = 60) -> str:
    return f"""{_ENV}, g AS (SELECT scan_idx, i, env, lag(env) OVER w AS y0, lead(env) OVER w AS y2, row_number() OVER (PARTITION BY scan_idx ORDER BY env DESC, i) AS r
  FROM e WHERE i >= {lo} AND i < {hi} WINDOW w AS (PARTITION BY scan_idx ORDER BY i)),
t AS (SELECT scan_idx, i + CASE WHEN y0 IS NULL OR y2 IS NULL THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (y0 - y2) / (y0 - 2 * env + y2))) END AS pos FROM g WHERE r = 1) {tail}"""


@query("tof", _tof_sql("SELECT scan_idx, round((1000 + pos * 10)::FLOAT::DOUBLE, 2) AS tof FROM t"))
def _tof(spark, d):
    return imaging.tof(canonical(spark, d), 4, 60).select("scan_idx", F.round(F.col("tof").cast("double"), 2).alias("tof"))


@query("thickness", _tof_sql("SELECT scan_idx, round(((1000 + pos * 10)::FLOAT * (1500e-9 / 2)::FLOAT)::DOUBLE * 1e6, 1) AS um FROM t"))
def _thickness(spark, d):
    return imaging.thickness(canonical(spark, d), 1500.0, 4, 60).select("scan_idx", F.round(F.col("thickness").cast("double") * 1e6, 1).alias("um"))


# silent: no peak; else the first of the largest values, and no refinement at the ends of the gate
@query("tof_edge", f"""WITH {SQL_EDGE}, long AS (SELECT scan_idx, unnest(range(64))::INT AS i, unnest(s)::DOUBLE AS v FROM edge), {_linear(_HILBERT)},
e AS (SELECT long.scan_idx, long.i, round(sqrt(long.v * long.v + coalesce(o.v, 0) * coalesce(o.v, 0)), 9) AS env FROM long LEFT JOIN o ON long.scan_idx = o.scan_idx AND long.i = o.o),
g AS (SELECT scan_idx, i, env, lag(env) OVER w AS y0, lead(env) OVER w AS y2, row_number() OVER (PARTITION BY scan_idx ORDER BY env DESC, i) AS r FROM e WHERE i >= 2 AND i < 62 WINDOW w AS (PARTITION BY scan_idx ORDER BY i))
SELECT scan_idx, CASE WHEN env = 0 THEN -1.0::DOUBLE ELSE round(1000 + 10 * (i + CASE WHEN y0 IS NULL OR y2 IS NULL OR y0 - 2 * env + y2 = 0 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (y0 - y2) / (y0 - 2 * env + y2))) END), 2) END AS tof FROM g WHERE r = 1""")
def _tof_edge(spark, d):
    return imaging.tof(edge(spark), 2, 62).select("scan_idx", F.round(F.col("tof").cast("double"), 2).alias("tof"))


# --- statistics ---------------------------------------------------------------------------------------------------
@query("kurtosis", f"WITH {SQL_LONG} SELECT scan_idx, round(kurtosis_pop(v) + 3, 4) AS kurt FROM long GROUP BY 1")
def _kurt(spark, d):
    return canonical(spark, d).df.select("scan_idx", F.round(exprs.kurtosis(F.col("signal")), 4).alias("kurt"))


# --- spectra --------------------------------------------------------------------------------------------------------
def _dft_sql(n: int) -> str:
    """Real and imaginary matrices of a DFT, as lists indexed k * n + j."""
    k, j = np.arange(n // 2 + 1)[:, None], np.arange(n)[None, :]
    angle = 2 * np.pi * ((k * j) % n) / n
    return f"SELECT unnest(range({(n // 2 + 1) * n})) AS q, unnest({_doubles(np.cos(angle).ravel())}) AS c, unnest({_doubles(-np.sin(angle).ravel())}) AS d"


_SPECTRUM = f"WITH {SQL_LONG}, m AS ({_dft_sql(64)}), z AS (SELECT scan_idx, (q // 64)::INT AS k, sum(v * c) AS re, sum(v * d) AS im FROM long JOIN m ON q % 64 = i GROUP BY ALL)"


@query("fft_spectrum", f"{_SPECTRUM} SELECT scan_idx, k AS i, round(sqrt(re * re + im * im), 4) + 0.0 AS v FROM z")
def _spectrum(spark, d):
    return long(imaging.spectrum(canonical(spark, d), "double")[1], "spectrum")


#: the sum of squares of a periodic Hann window of n is 3 n / 8
_W2 = 3 * 16 / 8
_FRAMES = f"""WITH {SQL_LONG}, f AS (SELECT scan_idx, t.t::INT AS t, (i - t * 8)::INT AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i - t * 8) / 16)) AS x FROM long JOIN range(7) t(t) ON i >= t * 8 AND i < t * 8 + 16),
m AS ({_dft_sql(16)}), z AS (SELECT scan_idx, t, (q // 16)::INT AS k, sum(x * c) AS re, sum(x * d) AS im FROM f JOIN m ON q % 16 = j GROUP BY ALL),
p AS (SELECT *, (re * re + im * im) / ({HZ}::DOUBLE * {_W2!r}::DOUBLE) * CASE WHEN k > 0 AND k < 8 THEN 2 ELSE 1 END * 1e6::DOUBLE AS p FROM z)"""


def _matrix_long(df, column: str):
    frames = df.select("scan_idx", F.posexplode(column).alias("k", "row"))
    return frames.select("scan_idx", "k", F.posexplode("row").alias("t", "v"))


@query("stft", f"{_FRAMES} SELECT scan_idx, k, t, round(re / 8, 4) + 0.0 AS re, round(im / 8, 4) + 0.0 AS im FROM z")
def _stft(spark, d):
    df = imaging.compute_stft(canonical(spark, d), 16, 8, kind="double")[2]
    both = df.select("scan_idx", F.posexplode(F.zip_with("re", "im", lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("re"), y.alias("im"))))).alias("k", "row"))
    cells = both.select("scan_idx", "k", F.posexplode("row").alias("t", "z"))
    return cells.select("scan_idx", "k", "t", (F.round(F.col("z.re"), 4) + 0.0).alias("re"), (F.round(F.col("z.im"), 4) + 0.0).alias("im"))


@query("spectrogram", f"{_FRAMES} SELECT scan_idx, k, t, round(p, 4) + 0.0 AS v FROM p")
def _spectrogram(spark, d):
    got = _matrix_long(imaging.power_spectrogram(canonical(spark, d), 16, 8, kind="double")[2], "power")
    return got.withColumn("v", F.round(F.col("v") * 1e6, 4) + 0.0)


_PSD = f"{_FRAMES}, w AS (SELECT scan_idx, k, avg(p) AS p, k * {HZ / 16!r}::DOUBLE AS f FROM p GROUP BY ALL)"


def _psd_df(spark, d):
    freqs, df = imaging.psd(canonical(spark, d), 16, 8, kind="double")
    return freqs, df.withColumn("psd", F.transform("psd", lambda v: v * 1e6))


@query("psd", f"{_PSD} SELECT scan_idx, k AS i, round(p, 4) + 0.0 AS v FROM w")
def _psd(spark, d):
    return long(_psd_df(spark, d)[1], "psd")


@query("psd_band", f"{_PSD} SELECT scan_idx, (k - 2)::INT AS i, round(p, 4) + 0.0 AS v FROM w WHERE k BETWEEN 2 AND 5")
def _psd_band(spark, d):
    _, df = imaging.psd(canonical(spark, d), 16, 8, 10e6, 33e6, kind="double")
    return long(df.withColumn("psd", F.transform("psd", lambda v: v * 1e6)), "psd")


for _name, _sql, _f in (
    ("spectral_entropy", "-sum(p / t * ln(p / t)) / ln(2.0)", lambda f, p: exprs.spectral_entropy(p)),
    ("spectral_flatness", "exp(avg(ln(p + 1e-10))) / avg(p)", lambda f, p: exprs.spectral_flatness(p)),
    ("spectral_centroid", "sum(f * p) / sum(p) / 1e6", lambda f, p: exprs.spectral_centroid(f, p) / 1e6),
    ("spectral_energy_ratio", "sum(p) FILTER (f >= 20e6) / sum(p) FILTER (f < 20e6)", lambda f, p: exprs.spectral_energy_ratio(f, p, 20e6)),
):

    @query(_name, f"{_PSD}, t AS (SELECT *, sum(p) OVER (PARTITION BY scan_idx) AS t FROM w) SELECT scan_idx, round({_sql}, 4) + 0.0 AS v FROM t GROUP BY 1")
    def _summary(spark, d, f=_f):
        freqs, df = _psd_df(spark, d)
        return df.select("scan_idx", (F.round(f(freqs, F.col("psd")), 4) + 0.0).alias("v"))


_PEAK = f"{_FRAMES}, a AS (SELECT scan_idx, k, t, round(sqrt(re * re + im * im), 9) AS a FROM z)"


@query("stft_peak_frequency", f"{_PEAK}, b AS (SELECT scan_idx, k, max(a) AS a FROM a GROUP BY ALL) SELECT scan_idx, arg_max(k, (a, -k))::INT AS peak_bin, arg_max(k, (a, -k)) * {HZ / 16!r}::DOUBLE AS peak_frequency FROM b GROUP BY 1")
def _peak_frequency(spark, d):
    return imaging.stft_peaks(canonical(spark, d), 16, 8).select("scan_idx", "peak_bin", "peak_frequency")


@query("stft_peak_time", f"{_PEAK}, b AS (SELECT scan_idx, t, max(a) AS a FROM a GROUP BY ALL) SELECT scan_idx, arg_max(t, (a, -t))::INT AS peak_frame, round((8 + arg_max(t, (a, -t)) * 8) / 100.0::DOUBLE * 1e3 + 1000, 4) AS peak_ns FROM b GROUP BY 1")
def _peak_time(spark, d):
    return imaging.stft_peaks(canonical(spark, d), 16, 8).select("scan_idx", "peak_frame", F.round(F.col("peak_time") * 1e9, 4).alias("peak_ns"))


# --- gates ------------------------------------------------------------------------------------------------------------
_GATE = {"max": "list_max(g)::DOUBLE", "absmax": "greatest(abs(list_max(g)), abs(list_min(g)))::DOUBLE", "power": "list_sum(list_transform(g, lambda v: v * v))::DOUBLE"}


def _xgate_sql(pick: str, mode: str) -> str:
    return f"""{pick}, q AS (SELECT scan_idx, gate_start, k::INT AS i, CASE WHEN gate_start >= 0 AND k < (64 - gate_start) // 3 THEN s[gate_start + k * 3 + 1 : gate_start + k * 3 + 3] END AS g FROM picked, range(6) t(k))
SELECT scan_idx, gate_start, i, coalesce({_GATE[mode]}, 0.0) AS v FROM q"""


_NONE = f"WITH {SQL_CUBE}, picked AS (SELECT *, 0 AS gate_start FROM cube)"
_OVER = f"WITH {SQL_CUBE}, picked AS (SELECT *, coalesce(list_position(list_transform(s, lambda v: v > 63.5), true), 0)::INT - 1 AS gate_start FROM cube)"
_FROM_TOF = _tof_sql(", picked AS (SELECT cube.scan_idx, s, round(((1000 + pos * 10)::FLOAT::DOUBLE - 1000) / 10)::INT AS gate_start FROM t JOIN cube USING (scan_idx))", 0, 64)
for _mode in ("max", "absmax", "power"):
    for _pick, _sql in (("none", _NONE), ("threshold", _OVER), ("tof", _FROM_TOF)):

        @query(f"xgate_{_pick}_{_mode}", _xgate_sql(_sql, _mode))
        def _xgate(spark, d, pick=_pick, mode=_mode):
            return long(imaging.xgate(canonical(spark, d), 30.0, 6, pick, 0.5, mode), "gates", "scan_idx", "gate_start", digits=None)


# --- alignment --------------------------------------------------------------------------------------------------------
def _aligned(scan):
    out = scan.df.select("scan_idx", F.coalesce("start", F.lit(-9)).alias("start"), F.posexplode("signal").alias("i", "v"))
    return out.withColumns({"v": F.col("v").cast("int"), "tzero": F.lit(scan.header.tzero)})


def _cut_sql(n: int) -> str:
    return f"SELECT scan_idx, o AS start, i::INT AS i, CASE WHEN o < 0 THEN 0 ELSE s[o + i + 1] END AS v, 1000 AS tzero FROM p, range({n}) t(i)"


@query("align_manual", f"WITH {SQL_CUBE}, p AS (SELECT *, CASE WHEN scan_idx % 5 = 0 THEN -1 ELSE scan_idx % 10 END AS o FROM cube) {_cut_sql(48)}")
def _manual(spark, d):
    scan = canonical(spark, d)
    offsets = scan.df.select("scan_idx", F.when(F.col("scan_idx") % 5 == 0, -1).otherwise(F.col("scan_idx") % 10).alias("offset"))
    return _aligned(align.align_manual(scan, offsets, 48))


@query("align_zgate", f"WITH {SQL_CUBE}, f AS (SELECT *, coalesce(list_position(list_transform(s, lambda v: abs(v) >= 63.5 AND v <> -128), true), 0)::INT - 1 AS first FROM cube), p AS (SELECT *, CASE WHEN first < 0 THEN -1 ELSE least(first, 16) END AS o FROM f) {_cut_sql(48)}")
def _zgate(spark, d):
    return _aligned(align.align_zgate(canonical(spark, d), 0.5, 48))


@query("collapse_starts", f"WITH {SQL_LONG} SELECT scan_idx, -9 AS start, i - 5 AS i, v::INT AS v, 1050 AS tzero FROM long WHERE i >= 5 AND i < 45")
def _collapse(spark, d):
    scan = canonical(spark, d)
    return _aligned(align.align_manual(scan, scan.df.select("scan_idx", F.lit(5).alias("offset")), 40))


@query(
    "align_xcorr",
    f"""WITH {SQL_LONG}, x AS (SELECT scan_idx, i, v - avg(v) OVER (PARTITION BY scan_idx) AS x FROM long),
c AS (SELECT a.scan_idx, lag::INT AS lag, round(sum(a.x * b.x), 6) AS c FROM range(-16, 17) t(lag) JOIN x b ON b.scan_idx = 0 JOIN x a ON a.i = b.i + lag GROUP BY ALL),
l AS (SELECT scan_idx, arg_max(lag, (c, -abs(lag), lag)) AS lag FROM c GROUP BY 1), r AS (SELECT min(lag) AS lo, max(lag) AS hi FROM l)
SELECT scan_idx, (lag - lo)::INT AS start, i::INT AS i, s[lag - lo + i + 1] AS v, 1000 AS tzero FROM l JOIN cube USING (scan_idx), r, range(64) t(i) WHERE i < 64 - (hi - lo)""",
)
def _xcorr(spark, d):
    return _aligned(align.align_xcorr(canonical(spark, d)))


@query(
    "align_tof",
    _tof_sql(
        """, l AS (SELECT scan_idx, round(pos - (SELECT pos FROM t WHERE scan_idx = 0))::INT AS lag FROM t), r AS (SELECT min(lag) AS lo, max(lag) AS hi FROM l)
SELECT scan_idx, (lag - lo)::INT AS start, i::INT AS i, s[lag - lo + i + 1] AS v, 1000 AS tzero FROM l JOIN cube USING (scan_idx), r, range(64) t(i) WHERE i < 64 - (hi - lo)""",
        16,
        40,
    ),
)
def _align_tof(spark, d):
    return _aligned(align.align_tof(canonical(spark, d), 240.0, 0, 160.0))


# --- labels -------------------------------------------------------------------------------------------------------------
_NAME = "CASE WHEN label = -1 THEN 'unlabeled' WHEN label = 0 THEN 'healthy' ELSE 'Defect_' || label END"


@query("class_distribution", f"WITH {SQL_CUBE} SELECT {_NAME} AS name, count(*) AS n FROM cube GROUP BY 1")
def _distribution(spark, d):
    return L.class_distribution(canonical(spark, d).df, NAMES)


@query("label_masks", f"WITH {SQL_CUBE} SELECT scan_idx, label = 0 AS healthy, label <> -1 AS labeled, label = -1 AS unlabeled, label = 2 AS named, label = -1 AS unknown FROM cube")
def _masks(spark, d):
    masks = {"healthy": L.healthy_mask(), "labeled": L.labeled_mask(), "unlabeled": L.unlabeled_mask(), "named": L.mask("DEFECT_2", NAMES), "unknown": L.mask("nope", NAMES)}
    return canonical(spark, d).df.select("scan_idx", *[m.alias(n) for n, m in masks.items()])


@query("to_binary", f"WITH {SQL_CUBE} SELECT scan_idx, CASE WHEN label = -1 THEN -1 WHEN label = 3 THEN 1 ELSE 0 END AS named, CASE WHEN label = -1 THEN 1 ELSE 0 END AS unlabeled, CASE WHEN label = -1 THEN -1 ELSE 0 END AS unknown FROM cube")
def _binary(spark, d):
    refs = {"named": "defect_3", "unlabeled": "unlabeled", "unknown": "nope"}
    return canonical(spark, d).df.select("scan_idx", *[L.to_binary(r, NAMES).cast("int").alias(n) for n, r in refs.items()])


@query("one_hot", f"WITH {SQL_CUBE} SELECT scan_idx, i::INT AS i, CASE WHEN label = i THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM cube, range(9) t(i)")
def _one_hot(spark, d):
    df = canonical(spark, d).df
    return long(df.withColumn("hot", exprs.one_hot(F.col("label"), L.num_classes(df))), "hot", digits=None)


@query("unique_labels", f"WITH {SQL_CUBE} SELECT DISTINCT label FROM cube WHERE label <> -1")
def _unique(spark, d):
    return spark.createDataFrame([(v,) for v in L.unique_labels(canonical(spark, d).df)], "label int")


def _labelled(pair):
    df, names = pair
    known = F.create_map(*[x for v in range(-1, len(names)) for x in (F.lit(v), F.lit(L.label_name(v, names)))])
    return df.select("scan_idx", F.col("label").cast("int").alias("label"), F.try_element_at(known, F.col("label").cast("int")).alias("name"))


_GAPPY = f"WITH {SQL_CUBE}, k AS (SELECT scan_idx, CASE WHEN label % 2 = 0 OR label = -1 THEN label ELSE -1 END AS label FROM cube)"


@query("clean_labels", f"{_GAPPY}, m AS (SELECT label, dense_rank() OVER (ORDER BY label)::INT AS r FROM (SELECT DISTINCT label FROM k WHERE label > 0)) SELECT scan_idx, coalesce(r, k.label) AS label, CASE WHEN k.label = -1 THEN 'unlabeled' WHEN k.label = 0 THEN 'healthy' ELSE 'Defect_' || k.label END AS name FROM k LEFT JOIN m ON m.label = k.label")
def _clean(spark, d):
    df = canonical(spark, d).df.withColumn("label", F.when((F.col("label") % 2 == 0) | (F.col("label") == -1), F.col("label")).otherwise(-1).cast("tinyint"))
    return _labelled(L.clean(df, NAMES))


@query("delete_label", f"WITH {SQL_CUBE} SELECT scan_idx, CASE WHEN label = 4 THEN -1 WHEN label > 4 THEN label - 1 ELSE label END AS label, CASE WHEN label IN (-1, 4) THEN 'unlabeled' WHEN label = 0 THEN 'healthy' ELSE 'Defect_' || label END AS name FROM cube")
def _delete(spark, d):
    return _labelled(L.delete_label(canonical(spark, d).df, NAMES, "Defect_4"))


@query("relabel", f"""WITH {SQL_CUBE}, k AS (SELECT scan_idx, CASE WHEN label = 1 THEN 2 WHEN label = 8 THEN 0 WHEN label = -1 THEN 3 ELSE label END AS label FROM cube)
SELECT scan_idx, CASE WHEN label >= 2 THEN label - 1 ELSE label END AS label, CASE WHEN label = 0 THEN 'healthy' WHEN label = 2 THEN 'DEFECT_2' WHEN label = 5 THEN 'Crack' ELSE 'Defect_' || label END AS name FROM k""")
def _relabel(spark, d):
    return _labelled(L.relabel(canonical(spark, d).df, NAMES, {1: "DEFECT_2", "defect_8": 0, -1: 3, "Defect_5": "Crack"}))


@query("merge_labels", f"""WITH {SQL_CUBE}, u AS (SELECT 0 AS part, scan_idx, {_NAME} AS name FROM cube UNION ALL SELECT 1, scan_idx, CASE WHEN label = 3 THEN 'Void' ELSE {_NAME} END FROM cube)
SELECT part, scan_idx, name FROM u""")
def _merge(spark, d):
    a = canonical(spark, d).df.withColumn("part", F.lit(0))
    names = tuple("Void" if n == "Defect_3" else n.upper() if n != "healthy" else n for n in NAMES)
    df, joint = L.merge([(a, NAMES), (a.withColumn("part", F.lit(1)), names)])
    known = F.create_map(*[x for v in range(-1, len(joint)) for x in (F.lit(v), F.lit(L.label_name(v, joint)))])
    return df.select("part", "scan_idx", F.try_element_at(known, F.col("label").cast("int")).alias("name"))


def _order_sql(seed: int, key: str) -> str:
    return f"substr(md5('{seed}:' || {key}), 1, 15), {key}"


@query("stratified_split", f"""WITH {SQL_CUBE}, r AS (SELECT scan_idx, row_number() OVER (PARTITION BY label ORDER BY {_order_sql(7, "scan_idx")}) AS r, count(*) OVER (PARTITION BY label) AS n FROM cube)
SELECT scan_idx, CASE WHEN r <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM r""")
def _stratified(spark, d):
    return L.stratified_split(canonical(spark, d).df, 0.2, 7).select("scan_idx", "split")


@query("labels_take", f"WITH {SQL_CUBE}, w AS (SELECT unnest(range(5))::BIGINT AS pos, unnest([7, 3, 7, 0, 19])::INT AS scan_idx) SELECT pos, scan_idx, label FROM w JOIN cube USING (scan_idx)")
def _take(spark, d):
    got = L.take(canonical(spark, d).df, [7, 3, 7, 0, 19])
    return got.select("pos", F.col("scan_idx").cast("int").alias("scan_idx"), F.col("label").cast("int").alias("label"))


@query("set_labels", f"WITH {SQL_CUBE} SELECT scan_idx, scan_idx % 3 - 1 AS label, CASE scan_idx % 3 WHEN 0 THEN 'unlabeled' WHEN 1 THEN 'healthy' ELSE 'Void' END AS name, list_sum(s)::INT AS total FROM cube")
def _set_labels(spark, d):
    scan = sized(spark, d)
    done = L.set_labels(scan, scan.df.select("scan_idx", (F.col("scan_idx") % 3 - 1).alias("label")), ("healthy", "Void"))
    total = F.aggregate("signal", F.lit(0), lambda a, v: a + v.cast("int")).alias("total")
    return _labelled((done.df, done.label_names)).join(done.df.select("scan_idx", total), "scan_idx")


# --- datasets -----------------------------------------------------------------------------------------------------------
def _pool(spark, d, **options):
    return dataset.pool([sized(spark, d), sized(spark, d, 48)], **options)


_POOL = f"WITH {SQL_CUBE}, pool AS (SELECT 0 AS cube_id, scan_idx, scan_idx::BIGINT AS row_id, line, col, label, s, 64 AS n FROM cube UNION ALL SELECT 1, scan_idx, scan_idx + (SELECT count(*) FROM cube), line, col, label, s, 48 FROM cube)"


@query("pool_pad", f"{_POOL} SELECT cube_id, row_id, i::INT AS i, CASE WHEN i < n THEN s[i + 1]::DOUBLE ELSE -5.0 END AS v FROM pool, range(64) t(i)")
def _pool_pad(spark, d):
    return long(_pool(spark, d, pad_value=-5.0).df, "x", "cube_id", "row_id", digits=None)


@query("spatial", f"{_POOL} SELECT row_id, round(col * 0.4, 4)::DOUBLE AS x_mm, round(line * 0.4, 4)::DOUBLE AS y_mm FROM pool")
def _spatial(spark, d):
    return _pool(spark, d).df.select("row_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("x_mm", "y_mm")])


@query("cube_counts", f"{_POOL} SELECT cube_id, count(*) AS n FROM pool GROUP BY 1")
def _counts(spark, d):
    return spark.createDataFrame(list(enumerate(_pool(spark, d, unsupervised=True).cube_counts)), "cube_id int, n long")


@query("cube_extract", f"{_POOL} SELECT line, col, label, list_sum(s[1:48])::DOUBLE AS total FROM pool WHERE cube_id = 1")
def _extract(spark, d):
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total")
    return dataset.cube_data(_pool(spark, d), 1).select("line", "col", F.col("label").cast("int").alias("label"), total)


def _split_of(ds):
    return ds.df.select("row_id", "split")


@query("train_test_split", f"""{_POOL}, r AS (SELECT row_id, row_number() OVER (ORDER BY {_order_sql(11, "row_id")}) AS r, count(*) OVER () AS n FROM pool)
SELECT row_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""")
def _split(spark, d):
    return _split_of(dataset.train_test_split(_pool(spark, d), 0.3, 11))


@query("train_test_split_ordered", f"{_POOL} SELECT row_id, CASE WHEN row_id < floor((SELECT count(*) FROM pool) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM pool")
def _split_ordered(spark, d):
    return dataset.train_test_split(_pool(spark, d), 0.3, shuffle=False).df.select("row_id", "split")


def _group_split_sql(by: str, share: str) -> str:
    return f"""{_POOL}, r AS (SELECT row_id, row_number() OVER (PARTITION BY {by} ORDER BY {_order_sql(1, "row_id")}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM pool)
SELECT row_id, CASE WHEN r <= greatest(1, floor(n * {share}::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM r"""


@query("split_by_cube", _group_split_sql("cube_id", "0.25"))
def _by_cube(spark, d):
    return _split_of(dataset.stratified_split_by_cube(_pool(spark, d), 0.25, 1))


@query("stratified_train_test_split", _group_split_sql("label", "0.2"))
def _stratified_pool(spark, d):
    return _split_of(dataset.stratified_train_test_split(_pool(spark, d), 0.2, 1))


@query("split_by_label_share", f"""{_POOL}, r AS (SELECT row_id, row_number() OVER (ORDER BY {_order_sql(1, "row_id")}) AS r, count(*) OVER () AS c FROM pool WHERE label = 3)
SELECT row_id, CASE WHEN r <= greatest(1, floor(c * 0.4::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM pool LEFT JOIN r USING (row_id)""")
def _by_label_share(spark, d):
    return _split_of(dataset.split_by_label(_pool(spark, d), 3, 0.4, 1))


@query("split_by_label", f"{_POOL} SELECT row_id, CASE WHEN label = 2 THEN 'test' ELSE 'train' END AS split FROM pool")
def _by_label(spark, d):
    return dataset.split_by_label(_pool(spark, d), "defect_2").df.select("row_id", "split")


@query("batches", f"{_POOL} SELECT row_id // 64 AS batch, count(*) AS n, min(row_id) AS first FROM pool GROUP BY 1")
def _batches(spark, d):
    return dataset.batch_numbers(_pool(spark, d, unsupervised=True), 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))


@query("spatial_patches", f"""{_POOL}, h AS (SELECT count(*) // 20 AS nl FROM cube), o AS (SELECT c.c::INT AS cube_id, a.a::INT AS patch_line, b.b::INT AS patch_col FROM h, range(2) c(c), range(100000) a(a), range(5) b(b) WHERE a.a < greatest(0, (nl - 8) // 4 + 1) AND b.b < (20 - 8) // 4 + 1)
SELECT o.cube_id, patch_line, patch_col, row_id, line - patch_line * 4 AS i, col - patch_col * 4 AS j FROM o JOIN pool p ON p.cube_id = o.cube_id AND line BETWEEN patch_line * 4 AND patch_line * 4 + 7 AND col BETWEEN patch_col * 4 AND patch_col * 4 + 7""")
def _patches(spark, d):
    return dataset.spatial_patches(_pool(spark, d, unsupervised=True), (8, 8), (4, 4))


@query("patch_arrays", f"""{_POOL}, h AS (SELECT count(*) // 20 AS nl FROM cube), o AS (SELECT c.c::INT AS cube_id, a.a::INT AS patch_line, b.b::INT AS patch_col FROM h, range(2) c(c), range(100000) a(a), range(5) b(b) WHERE a.a < greatest(0, (nl - 8) // 8 + 1) AND b.b < (20 - 8) // 8 + 1)
SELECT o.cube_id, patch_line, patch_col, (line - patch_line * 8)::INT AS i, (col - patch_col * 8)::INT AS j, label, list_sum(s[1:n])::DOUBLE AS total FROM o JOIN pool p ON p.cube_id = o.cube_id AND line BETWEEN patch_line * 8 AND patch_line * 8 + 7 AND col BETWEEN patch_col * 8 AND patch_col * 8 + 7""")
def _patch_arrays(spark, d):
    got = dataset.patch_arrays(_pool(spark, d), (8, 8), (8, 8))
    lines = got.select("cube_id", "patch_line", "patch_col", F.posexplode(F.arrays_zip("x", "labels")).alias("i", "row"))
    cells = lines.select("cube_id", "patch_line", "patch_col", "i", F.posexplode(F.arrays_zip(F.col("row.x").alias("x"), F.col("row.labels").alias("label"))).alias("j", "cell"))
    total = F.aggregate("cell.x", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total")
    return cells.select("cube_id", "patch_line", "patch_col", "i", "j", F.col("cell.label").cast("int").alias("label"), total)


@query("dataset_rows", f"{_POOL}, w AS (SELECT unnest(range(4))::BIGINT AS pos, unnest([9, 501, 9, 2])::BIGINT AS row_id) SELECT pos, row_id, list_sum(s[1:n])::DOUBLE AS total FROM w JOIN pool USING (row_id)")
def _dataset_rows(spark, d):
    got = dataset.read_rows(_pool(spark, d), [9, 501, 9, 2])
    return got.select("pos", "row_id", F.aggregate("data", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"))


@query("transform", f"{_POOL} SELECT row_id, list_max(CASE WHEN n < 64 THEN list_append(s[1:48], 0) ELSE s END)::DOUBLE AS top FROM pool")
def _transform(spark, d):
    ds = _pool(spark, d, unsupervised=True).transform(lambda x: x.max(axis=1))
    return ds.df.select("row_id", F.col("z")[0].cast("double").alias("top"))


# the noise is Box-Muller on a recursion modulo 2**31 - 1, the burst a windowed sine at the middle
@query("synthetic_scan", """WITH n AS (SELECT s.s AS id, i.i AS i, k.k AS k, (s.s * 1000003 + i.i * 7919 + k.k * 104729 + 42 * 611953) % 2147483647 AS x FROM range(400) s(s), range(500) i(i), range(1, 3) k(k)),
y AS (SELECT id, i, k, (((x * x + 12820163) % 2147483647) * 48271 + x) % 2147483647 AS y FROM n),
u AS (SELECT id, i, max(((y * y + 362437) % 2147483647 + 1) / 2147483648.0::DOUBLE) FILTER (k = 1) AS u1, max(((y * y + 362437) % 2147483647 + 1) / 2147483648.0::DOUBLE) FILTER (k = 2) AS u2 FROM y GROUP BY ALL),
v AS (SELECT id, greatest(-128, least(127, round_even(19.0::DOUBLE + 2.0::DOUBLE * sqrt(-2 * ln(u1)) * cos(u2 * 6.283185307179586::DOUBLE) + 90 * exp(-pow((i - 250) / 11.0::DOUBLE, 2)) * sin((i - 250) * 0.4::DOUBLE), 0))) AS v FROM u)
SELECT id::INT AS scan_idx, (id // 20)::INT AS line, (id % 20)::INT AS col, sum(v)::BIGINT AS total, least(127, max(abs(v)))::INT AS absmax FROM v GROUP BY id""")
def _synthetic(spark, d):
    from sonogrid.model import Header
    from sonogrid.sources.store import synthetic

    df = synthetic(spark, Header(20, 20, 500, 2500.0, 15000, 400.0)).df
    total = F.aggregate("signal", F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint")).alias("total")
    return df.select("scan_idx", "line", "col", total, exprs.image(F.col("signal"), "absmax").cast("int").alias("absmax"))
