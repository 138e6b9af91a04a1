import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.config import CycleConfig
from tidemark.operators import cycles as C
from tidemark.operators import hidden_states as H
from tidemark.operators import spectrum as S
from tidemark.operators import wavelet as V
from tidemark.operators.frame import position
from tidemark.session import cut


def table(spark, values, symbol="X"):
    pdf = pd.DataFrame({"symbol": symbol, "rn": np.arange(1, len(values) + 1), "n": len(values), "value": np.asarray(values, float)})
    return spark.createDataFrame(pdf, "symbol string, rn long, n long, value double")


def test_acf_matches_pandas(spark, bars):
    df, pdf = bars
    got = C.acf(C.series_of(position(df)), CycleConfig(max_lag=30), size=64).toPandas()
    x = pdf[pdf.symbol == "X"].close.reset_index(drop=True)
    g = got[got.symbol == "X"].sort_values("lag").acf.to_numpy()
    np.testing.assert_allclose(g, [x.autocorr(k) for k in range(1, 31)], rtol=1e-9)


def test_pacf_solves_the_toeplitz_system(spark, bars):
    df, pdf = bars
    got = C.pacf(C.series_of(position(df)), CycleConfig(max_lag=12), size=64).toPandas()
    x = pdf[pdf.symbol == "X"].close.to_numpy()
    x = x - x.mean()
    gamma = np.array([(x[k:] * x[: len(x) - k]).sum() for k in range(13)])
    want = [np.corrcoef(x[:-1], x[1:])[0, 1]]
    for k in range(2, 13):
        m = np.array([[gamma[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(m, gamma[1 : k + 1])[-1])
    np.testing.assert_allclose(got[got.symbol == "X"].sort_values("lag").pacf, want, rtol=1e-7, atol=1e-9)


def test_peaks_and_plateaus(spark):
    v = [1, 3, 1, 2, 2, 2, 1, 5, 5, 6, 0, 7, 7]
    got = C.peaks(table(spark, v), size=4).orderBy("rn").toPandas()
    assert list(got.rn) == [2, 5, 10]


def test_prominence_crosses_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 300)
    tops = [i for i in range(1, 299) if v[i] > v[i - 1] and v[i] > v[i + 1]]

    def prominence(p):
        sides = []
        for part in (v[:p][::-1], v[p + 1 :]):
            above = np.flatnonzero(part > v[p])
            seen = part[: above[0]] if len(above) else part
            sides.append(min(seen.min() if len(seen) else v[p], v[p]))
        return v[p] - max(sides)

    series = cut(table(spark, v))
    for block in (8, 64, 1024):
        got = C.prominences(series, C.peaks(series), block).orderBy("rn").toPandas()
        assert list(got.rn) == [t + 1 for t in tops]
        np.testing.assert_allclose(got.prominence, [prominence(t) for t in tops], rtol=1e-12)


def test_spectrum_matches_numpy_for_odd_lengths(spark):
    rng = np.random.default_rng(4)
    for n in (97, 500, 1001):
        v = rng.normal(0, 1, n).cumsum()
        t = np.arange(n)
        line = np.polyval(np.polyfit(t, v, 1), t)
        want = np.abs(np.fft.fft(v - line))
        got = S.amplitudes(table(spark, v)).orderBy("k").toPandas()
        ks = [k for k in range(1, (n + 1) // 2) if 5 <= n / k <= 252]
        assert list(got.k) == ks
        np.testing.assert_allclose(got.power, want[ks], rtol=1e-8, atol=1e-8)


def test_wavelet_power_does_not_depend_on_shards(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, 700).cumsum()
    config = CycleConfig(scales=tuple(range(1, 40)))
    whole = V.scale_power(table(spark, v), config, size=2048).orderBy("scale").toPandas()
    parts = V.scale_power(table(spark, v), config, size=100).orderBy("scale").toPandas()
    np.testing.assert_allclose(whole.avg_power, parts.avg_power, rtol=1e-9)
    wave = np.sin(2 * np.pi * np.arange(700) / 20)
    power = V.scale_power(table(spark, wave), config).toPandas()
    # The wavelet's centre frequency 5/(2 pi) answers a period of 20 at scale ~16.
    assert abs(power.loc[power.avg_power.idxmax(), "scale"] - 16) <= 1


def test_wavelet_equals_direct_convolution(spark):
    v = np.random.default_rng(6).normal(0, 1, 500).cumsum() + 100
    scales = (1, 2, 3, 10, 33, 60)
    config = CycleConfig(scales=scales)

    def direct(s):
        full = np.convolve(v, V.kernel(s))[1:-1]
        spare = (len(full) - len(v)) / 2
        return full[int(np.floor(spare)):len(full) - int(np.ceil(spare))] ** 2

    want = np.array([direct(s) for s in scales])
    got = V.scale_power(table(spark, v), config, size=90).orderBy("scale").toPandas()
    np.testing.assert_allclose(got.avg_power, want.mean(1), rtol=1e-9)
    rows = V.strongest_scales(table(spark, v), config, size=90).orderBy("rn").toPandas()
    assert list(rows.rn) == list(range(1, 501)) and list(rows.scale) == [scales[i] for i in want.argmax(0)]
    np.testing.assert_allclose(rows.power, want.max(0), rtol=1e-9)


def test_hidden_states_long_and_short_paths_agree(bars):
    df, _ = bars
    placed = cut(position(df.filter("symbol = 'X'")))
    config = CycleConfig(max_iterations=6)
    obs = cut(H.observations(placed))
    whole, packed = H.fit(obs, config, tolerance=-1.0, length=16384)
    split, pieces = H.fit(obs, config, tolerance=-1.0, length=150)
    a, b = whole.first(), split.first()
    for c in ("start", "trans", "mean", "cov"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-6, atol=1e-8)
    one = H.decode(packed, whole, config).orderBy("rn").toPandas()
    many = H.decode(pieces, whole, config, length=150).orderBy("rn").toPandas()
    assert list(one.rn) == list(many.rn) and list(one.state) == list(many.state)


def test_hidden_states_of_a_series_do_not_depend_on_others_and_plans_stay_small(spark):
    rng = np.random.default_rng(6)

    def obs_of(symbol, n):
        calm = rng.integers(0, 2, n // 50 + 1).repeat(50)[:n]
        r = rng.normal(0.001 - 0.002 * calm, 0.005 + 0.02 * calm)
        return pd.DataFrame({"symbol": symbol, "rn": np.arange(1, n + 1), "n": n, "x": [[a, abs(a)] for a in r.tolist()]})

    pdf = pd.concat([obs_of("A", 17000), obs_of("B", 18000), obs_of("S", 400)])
    obs = cut(spark.createDataFrame(pdf, "symbol string, rn long, n long, x array<double>"))
    config = CycleConfig(max_iterations=100)
    together, _ = H.fit(obs, config)
    alone, _ = H.fit(cut(obs.filter("symbol = 'A'")), config)
    a, b = together.filter("symbol = 'A'").first(), alone.first()
    for c in ("start", "trans", "mean", "cov"):
        np.testing.assert_allclose(a[c], b[c], rtol=1e-6, atol=1e-8)
    assert together.count() == 3
    size = together._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(size)) < 12
