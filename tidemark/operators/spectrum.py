"""Amplitude spectrum of long series by a distributed Fourier transform.

A transform of M = R*C points runs as C transforms of length R, a twist, and R transforms of
length C, so no task handles more than about sqrt(M) points at once. Series lengths are not
powers of two; the chirp identity turns length N into a convolution of length M >= 2N-1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.config import CycleConfig


def _shape(n: int) -> tuple[int, int, int]:
    bits = int(2 * n - 2).bit_length()
    rows = 1 << (bits // 2)
    return 1 << bits, rows, (1 << bits) // rows


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(-i*pi*t^2/n), with the square reduced first to keep its precision."""
    t = np.asarray(t, dtype=np.int64) % (2 * n)
    if 2 * n < 3_000_000_000:  # squares fit in 64 bits
        square = (t * t) % (2 * n)
    else:
        square = np.array([(int(x) * int(x)) % (2 * n) for x in t])
    return np.exp(-1j * np.pi * square.astype(float) / n)


def _twist(a: int, b: np.ndarray, m: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * ((a * b) % m) / m)


def detrended(series: DataFrame) -> DataFrame:
    """Residuals of a straight line fitted per symbol."""
    t = F.col("rn").cast("double")
    line = series.groupBy("symbol").agg(F.regr_slope("value", t).alias("_b"), F.regr_intercept("value", t).alias("_a"))
    fitted = F.coalesce(F.col("_a") + F.col("_b") * t, F.col("value"))
    return series.join(line, "symbol").withColumn("value", F.col("value") - fitted).drop("_a", "_b")


def amplitudes(series: DataFrame, config: CycleConfig = CycleConfig()) -> DataFrame:
    """(symbol, k, period, power): |transform| at k with min_period <= n/k <= max_period."""
    source = detrended(series.filter(F.col("n") >= 10))
    bits = F.length(F.bin(2 * F.col("n") - 2))
    cols = F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("long")
    points = source.select("symbol", "n", ((F.col("rn") - 1) % cols).alias("c"), (F.col("rn") - 1).alias("t"), "value")

    def columns(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, n, c = key
        m, rows, cols = _shape(n)
        t = pdf["t"].values
        a = np.zeros(rows, dtype=complex)
        a[t // cols] = pdf["value"].values * _chirp(t, n)
        at = c + cols * np.arange(rows)
        away = np.minimum(at, m - at)
        b = np.where(away < n, np.conj(_chirp(away, n)), 0)
        turn = _twist(c, np.arange(rows), m, -1)
        a, b = np.fft.fft(a) * turn, np.fft.fft(b) * turn
        return pd.DataFrame(
            {"symbol": symbol, "n": n, "i": np.arange(rows), "j": c, "ar": a.real, "ai": a.imag, "br": b.real, "bi": b.imag}
        )

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, n, i = key
        m, rows, cols = _shape(n)
        order = np.argsort(pdf["j"].values)
        a = (pdf["ar"].values + 1j * pdf["ai"].values)[order]
        b = (pdf["br"].values + 1j * pdf["bi"].values)[order]
        product = np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)) * _twist(i, np.arange(cols), m, 1)
        return pd.DataFrame({"symbol": symbol, "n": n, "j": np.arange(cols), "i": i, "re": product.real, "im": product.imag})

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, n, j = key
        m, rows, cols = _shape(n)
        order = np.argsort(pdf["i"].values)
        y = np.fft.ifft((pdf["re"].values + 1j * pdf["im"].values)[order])
        k = j + cols * np.arange(rows)
        power = np.abs(y)  # the closing chirp has modulus one
        keep = (k > 0) & (2 * k < n) & (k * config.max_period >= n) & (k * config.min_period <= n)
        return pd.DataFrame({"symbol": symbol, "k": k[keep], "period": n / k[keep].astype(float), "power": power[keep]})

    one = points.groupBy("symbol", "n", "c").applyInPandas(
        columns, "symbol string, n long, i long, j long, ar double, ai double, br double, bi double"
    )
    two = one.groupBy("symbol", "n", "i").applyInPandas(multiply, "symbol string, n long, j long, i long, re double, im double")
    return two.groupBy("symbol", "n", "j").applyInPandas(finish, "symbol string, k long, period double, power double")
