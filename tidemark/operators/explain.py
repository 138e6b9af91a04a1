"""Attributions of boosted trees and the tables and texts built from them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.models import class_columns
from tidemark.session import ensure_checkpoint_dir


def leaf_table(stage, spark: SparkSession) -> list[dict]:
    """Leaves of all trees of a boosted model with the conditions on their paths.

    Read from the saved model, in the shared folder. Its size is set by the number and depth
    of trees, not by data. A condition is (feature, low, high, share): the value must lie in
    (low, high], and ``share`` is the part of the training weight that followed the branches.
    """
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/trees-{uuid.uuid4().hex}"
    stage.write().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    weights = stage.treeWeights
    leaves = []
    for tree, table in nodes.items():
        open_paths = [(0, {})]
        while open_paths:
            at, path_now = open_paths.pop()
            node = table[at]
            if node["leftChild"] < 0:
                leaves.append({"value": node["prediction"] * weights[tree], "path": path_now})
                continue
            feature = node["split"]["featureIndex"]
            threshold = node["split"]["leftCategoriesOrThreshold"][0]
            low, high, share = path_now.get(feature, (-math.inf, math.inf, 1.0))
            for child, bounds in (
                (node["leftChild"], (low, min(high, threshold))), (node["rightChild"], (max(low, threshold), high)),
            ):
                part = table[child]["impurityStats"][0] / node["impurityStats"][0]
                open_paths.append((child, {**path_now, feature: (*bounds, share * part)}))
    return leaves


def base_value(leaves: list[dict]) -> float:
    return sum(leaf["value"] * math.prod(c[2] for c in leaf["path"].values()) for leaf in leaves)


def grouped(leaves: list[dict], deepest: int = 10, entries: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """Path matrices (features, low, high, share, value) of leaves with equally many features, a bounded number at a time."""
    by_depth: dict[int, list[dict]] = {}
    for leaf in leaves:
        by_depth.setdefault(len(leaf["path"]), []).append(leaf)
    for depth, found in by_depth.items():
        step = max(1, entries // ((1 << min(depth, deepest)) * max(depth, 1)))
        for i in range(0, len(found) if depth else 0, step):
            part = found[i:i + step]
            conditions = np.array([[leaf["path"][f] for f in leaf["path"]] for leaf in part])
            features = np.array([list(leaf["path"]) for leaf in part])
            yield features, conditions[:, :, 0], conditions[:, :, 1], conditions[:, :, 2], np.array([leaf["value"] for leaf in part])


def shapley(known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of games that are products over features: each is ``known`` (0 or 1) inside a coalition and ``share`` outside it.

    Both are (..., features). The sum over coalitions is a polynomial in the number of members, built from the other features.
    """
    depth = known.shape[-1]
    weight = [math.factorial(s) * math.factorial(depth - 1 - s) / math.factorial(depth) for s in range(depth)]
    out = np.empty(np.broadcast_shapes(known.shape, share.shape))
    for i in range(depth):
        poly = np.zeros((*out.shape[:-1], depth))
        poly[..., 0] = 1
        for j in range(depth):
            if j != i:
                taken = poly[..., :-1] * known[..., j, None]
                poly *= share[..., j, None]
                poly[..., 1:] += taken
        out[..., i] = (known[..., i] - share[..., i]) * (poly @ np.array(weight))
    return out


def attribute(x: np.ndarray, leaves: list[dict], deepest: int = 10, batch: int = 64) -> np.ndarray:
    """Path-dependent Shapley values of the summed trees for rows ``x``.

    For one leaf, a feature on its path is either known (1 if the row satisfies its condition, else 0) or averaged
    (its share). Which conditions a row satisfies is one of 2^features patterns, so a leaf's values are tabulated once by pattern
    for all rows of ``x`` and each row looks its own up, ``batch`` rows at a time; paths of more than ``deepest`` features are
    worked out for each row.
    """
    phi = np.zeros(x.shape)
    for features, low, high, share, value in grouped(leaves, deepest):
        depth = features.shape[1]
        if depth <= deepest:
            patterns = (np.arange(1 << depth)[:, None] >> np.arange(depth)) & 1
            table = shapley(patterns[None].astype(float), share[:, None, :]) * value[:, None, None]
        # places of all paths in order of the feature they ask, and where each feature's places begin
        order = np.argsort(features, axis=None, kind="stable")
        asked, starts = np.unique(features.ravel()[order], return_index=True)
        for i in range(0, len(x), batch):
            rows = x[i:i + batch]
            met = [(rows[:, features[:, j]] > low[:, j]) & (rows[:, features[:, j]] <= high[:, j]) for j in range(depth)]
            if depth <= deepest:
                own = table[np.arange(len(value))[None, :], sum(m.astype(np.int32) << j for j, m in enumerate(met))]
            else:
                own = shapley(np.stack(met, axis=2).astype(float), share[None]) * value[None, :, None]
            phi[i:i + batch, asked] += np.add.reduceat(own.reshape(len(rows), -1)[:, order], starts, axis=1)
    return phi


def attributions(model: PipelineModel, rows: DataFrame, names: list[str], batch: int = 64) -> DataFrame:
    """(symbol, ts, values, base, margin, attribution: one number per feature) for each row; with several classes
    a row for each ``class``, explained by that class's own trees.

    The trees go to every task once. What depends on them alone is worked out once for each Arrow batch, whose rows are then
    explained ``batch`` at a time.
    """
    spark = rows.sparkSession
    classes = sorted(class_columns(model))
    # stages after the assembler are the boosted models, in order of their classes
    tables = [leaf_table(stage, spark) for stage in model.stages[1:]]
    shared = spark.sparkContext.broadcast(tables)  # bounded by models * trees * 2^depth
    starts = [base_value(leaves) for leaves in tables]
    width = len(names)
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf["values"].values).reshape(len(pdf), width)
            for k, leaves in enumerate(shared.value):
                phi = attribute(x, leaves, batch=batch)
                own = {"symbol": pdf["symbol"], "ts": pdf["ts"], "values": pdf["values"], "base": starts[k], "margin": starts[k] + phi.sum(1), "attribution": list(phi)}
                yield pd.DataFrame({**own, "class": classes[k]} if classes else own)

    schema = "symbol string, ts timestamp_ntz, values array<double>, base double, margin double, attribution array<double>"
    return rows.select("symbol", "ts", values.alias("values")).mapInPandas(explain, schema + (", class double" if classes else ""))


def global_importance(explained: DataFrame, names: list[str], top: int = 20) -> DataFrame:
    """Mean absolute attribution per feature, as one aggregation without exploding rows."""
    sums = explained.agg(F.array(*[F.avg(F.abs(F.get("attribution", F.lit(i)))) for i in range(len(names))]).alias("m"))
    labels = F.array(*[F.lit(n) for n in names])
    tall = sums.select(F.inline(F.arrays_zip(labels.alias("feature"), F.col("m").alias("importance"))))
    return tall.orderBy(F.desc("importance"), "feature").limit(top)


def ranked(explained: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    """Each row's features by absolute attribution; sorted inside the row, without a shuffle."""
    labels = F.array(*[F.lit(n) for n in names])
    zipped = F.transform(
        F.arrays_zip(labels.alias("feature"), F.col("attribution").alias("a"), F.col("values").alias("v")),
        lambda s: F.struct((-F.abs(s["a"])).alias("key"), s["feature"].alias("feature"), s["a"].alias("attribution"), s["v"].alias("value")),
    )
    order = F.array_sort(zipped)
    return explained.withColumn("factors", F.slice(order, 1, top) if top else order)


def instance_explanations(explained: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    out = ranked(explained, names, top).select("symbol", "ts", F.posexplode("factors").alias("_i", "f"))
    return out.select("symbol", "ts", (F.col("_i") + 1).alias("rank"), "f.feature", "f.attribution", "f.value")


def window_of(name: str, windows: tuple[int, ...]) -> int | None:
    """First window whose size occurs in a feature's name as ``_w`` or ``wd``."""
    return next((w for w in windows if f"_{w}" in name or f"{w}d" in name), None)


def window_attributions(explained: DataFrame, names: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Sum of absolute attributions per look-back window and row; windows without a feature get 0."""
    parts = []
    for w in windows:
        mine = [F.abs(F.get("attribution", F.lit(i))) for i, n in enumerate(names) if window_of(n, windows) == w]
        parts.append(F.struct(F.lit(w).alias("window"), sum(mine, F.lit(0.0)).alias("attribution")))
    return explained.select("symbol", "ts", F.inline(F.array(*parts)))


# ---- patterns --------------------------------------------------------------------------


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text of the exact binary value; ``format_string`` rounds its decimal form."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def pattern_report(stats: DataFrame, shapes: DataFrame) -> DataFrame:
    """Text and best-horizon metrics per pattern, best Sharpe ratio first.

    The text names the horizon with the highest win rate, the metrics the one with the highest
    Sharpe ratio; the shorter horizon wins ties.
    """
    fields = F.struct("horizon", "win_rate", "mean_return", "sharpe_ratio")
    best = stats.groupBy("symbol", "pattern_name").agg(
        F.max_by(fields, F.struct("win_rate", -F.col("horizon"))).alias("w"),
        F.max_by(fields, F.struct("sharpe_ratio", -F.col("horizon"))).alias("s"),
    )
    joined = shapes.select("symbol", "pattern_name", "occurrences").join(best, ["symbol", "pattern_name"], "left")
    seen = F.format_string("Pattern: %s. Observed %d times in the dataset", "pattern_name", F.col("occurrences").cast("long"))
    power = F.when(
        F.col("w.win_rate") > 0,
        F.format_string(
            ". Best predictive power at %d-day horizon: %s%% win rate, %s%% mean return",
            F.col("w.horizon").cast("long"), fixed(F.col("w.win_rate") * 100, 1), fixed(F.col("w.mean_return") * 100, 2),
        ),
    ).otherwise("")
    return joined.select(
        "symbol", "pattern_name", F.concat(seen, power, F.lit(".")).alias("description"), "occurrences",
        F.col("s.horizon").alias("best_horizon_days"), F.coalesce("s.win_rate", F.lit(0.0)).alias("win_rate"),
        F.coalesce("s.mean_return", F.lit(0.0)).alias("mean_return"), F.coalesce("s.sharpe_ratio", F.lit(0.0)).alias("sharpe_ratio"),
    ).orderBy(F.desc("sharpe_ratio"), "symbol", "pattern_name")


# ---- signals ---------------------------------------------------------------------------


def top_importance(importance: DataFrame, k: int = 10) -> list[tuple[str, float]]:
    return [(r["feature"], r["importance"]) for r in importance.orderBy(F.desc("importance"), "feature").limit(k).collect()]


def decision(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "BUY").otherwise("HOLD/SELL")


def explain_signals(scored: DataFrame, importance: list[tuple[str, float]], threshold: float = 0.5) -> DataFrame:
    """Signal, confidence, contributing features present in the table, and a short text."""
    present = [(n, v) for n, v in importance if n in scored.columns]
    score = F.col("score")
    parts = F.array(
        *[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), F.lit(float(v)).alias("importance")) for n, v in present]
    )
    lines = [
        F.format_string("  - %s: %s (importance: %s)", F.lit(n), fixed(F.col(n).cast("double"), 3), fixed(F.lit(float(v)), 3)) for n, v in present[:5]
    ]
    out = scored.withColumns(
        {"signal": decision(score, threshold), "confidence": F.abs(score - 0.5) * 2, "threshold": F.lit(threshold), "top_features": parts}
    )
    head = [F.format_string("Signal: %s", "signal"), F.format_string("Confidence: %s%%", fixed(F.col("confidence") * 100, 1))]
    body = [F.lit("Key factors:"), *lines] if lines else []
    return out.withColumn("narrative", F.concat_ws("\n", *head, *body))


def prediction_report(scored: DataFrame, explained: DataFrame, names: list[str], matches: DataFrame | None = None, regimes: DataFrame | None = None) -> DataFrame:
    """One structured row per prediction: score, signal, five factors, all matched patterns by name, regime."""
    factors = ranked(explained, names, 5).select(
        "symbol", "ts", F.transform("factors", lambda f: F.struct(f["feature"].alias("feature"), f["value"].alias("value"), F.abs(f["attribution"]).alias("attribution"))).alias("factors")
    )
    out = scored.select("symbol", "ts", "score", decision(F.col("score"), 0.5).alias("signal")).join(factors, ["symbol", "ts"])
    if matches is not None:
        named = matches.groupBy("symbol", "ts").agg(F.sort_array(F.collect_set("pattern_name")).alias("patterns"))
        out = out.join(named, ["symbol", "ts"], "left")
    if regimes is not None:
        out = out.join(regimes.select("symbol", "ts", F.col("market_regime").alias("regime")), ["symbol", "ts"], "left")
    return out
