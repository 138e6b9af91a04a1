"""Wavelet power per scale with the real Morlet wavelet exp(-t^2/2) cos(5t) on [-8, 8]."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.config import CycleConfig
from tidemark.operators.cycles import peaks
from tidemark.operators.frame import SIZE, with_halo

POINTS = 1024
REACH = 8.0


@lru_cache(maxsize=512)
def kernel(scale: int) -> np.ndarray:
    """Filter taps: differences of the wavelet's running integral, stretched to ``scale``."""
    grid = np.linspace(-REACH, REACH, POINTS)
    step = grid[1] - grid[0]
    integral = np.cumsum(np.exp(-(grid**2) / 2) * np.cos(5 * grid)) * step
    at = np.floor(np.arange(scale * 2 * REACH + 1) / (scale * step)).astype(int)
    stretched = integral[at[at < POINTS]][::-1]
    return -np.sqrt(scale) * np.diff(np.concatenate([[0.0], stretched, [0.0]]))


@lru_cache(maxsize=512)
def _spectrum(scale: int, points: int) -> np.ndarray:
    return np.fft.rfft(kernel(scale), points)


def _responses(values: np.ndarray, scales: list[int]) -> Iterator[np.ndarray]:
    """Centred response at every value for each scale; values outside count as zero.

    The block is transformed once; a scale is a product and one transform back.
    """
    if not scales:
        return
    longest = max(len(kernel(s)) for s in scales)
    points = 1 << (len(values) + longest - 2).bit_length()
    turned = np.fft.rfft(values, points)
    for s in scales:
        taps = len(kernel(s))
        full = np.fft.irfft(turned * _spectrum(s, points), points)[1:len(values) + taps - 2]
        spare = (len(full) - len(values)) / 2
        yield full[int(np.floor(spare)) : len(full) - int(np.ceil(spare))]


def _framed(series: DataFrame, config: CycleConfig, size: int) -> DataFrame:
    """Shards with all values that reach their rows (overlap-save: the halo's own responses are thrown away)."""
    reach = int(REACH * max(config.scales)) + 2
    return with_halo(series.filter(F.col("n") >= 10).select("symbol", "rn", "n", "value"), reach, reach, size)


def _usable(pdf: pd.DataFrame, scales: list[int]) -> list[int]:
    return scales[: min(int(pdf["n"].iloc[0]) // 4, len(scales))]


def scale_power(series: DataFrame, config: CycleConfig = CycleConfig(), size: int = SIZE) -> DataFrame:
    """(symbol, scale, avg_power): mean squared response over time.

    A shard with its halo holds all values that reach its rows; it returns one partial sum
    per scale. Scales above a quarter of the series are left out.
    """
    scales = list(config.scales)

    def partial(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        core, usable = pdf["core"].values, _usable(pdf, scales)
        total = [float((found[core] ** 2).sum()) for found in _responses(pdf["value"].values, usable)]
        return pd.DataFrame({"symbol": key[0], "scale": usable, "total": total, "rows": int(core.sum())})

    parts = _framed(series, config, size).groupBy("symbol", "shard").applyInPandas(partial, "symbol string, scale long, total double, rows long")
    return parts.groupBy("symbol", "scale").agg((F.sum("total") / F.sum("rows")).alias("avg_power"))


def strongest_scales(series: DataFrame, config: CycleConfig = CycleConfig(), size: int = SIZE) -> DataFrame:
    """(symbol, rn, scale, power): the scale with the largest squared response at each row, the smaller one in ties."""
    scales = list(config.scales)

    def strongest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        core, usable = pdf["core"].values, _usable(pdf, scales)
        power = np.array([found[core] ** 2 for found in _responses(pdf["value"].values, usable)])
        best = power.argmax(axis=0)
        return pd.DataFrame({"symbol": key[0], "rn": pdf["rn"].values[core], "scale": np.array(usable)[best], "power": power.max(axis=0)})

    return _framed(series, config, size).groupBy("symbol", "shard").applyInPandas(strongest, "symbol string, rn long, scale long, power double")


def dominant_scales(power: DataFrame, size: int = SIZE) -> DataFrame:
    """Scales at which the mean power has a local maximum."""
    counts = power.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    series = power.join(counts, "symbol").select("symbol", F.col("scale").alias("rn"), "n", F.col("avg_power").alias("value"))
    return peaks(series, size=size).select("symbol", F.col("rn").alias("scale"), F.col("value").alias("avg_power"))
