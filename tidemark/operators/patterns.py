"""Recurring shapes: windows, motifs, clusters, occurrences and what follows them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import PatternConfig
from tidemark.functions.exprs import EPS, distance, lead, ratio, rows, sorted_quantile, zscale
from tidemark.operators.frame import SIZE, core_rows, grouped_quantile, with_halo
from tidemark.operators.neighbours import nearest, signature
from tidemark.session import cut


def windows(positioned: DataFrame, m: int = 20, c: str = "close", size: int = SIZE) -> DataFrame:
    """Sliding windows by start row: raw values and z-normalised values."""
    framed = with_halo(positioned.select("symbol", "ts", "rn", "n", c), after=m - 1, size=size)
    raw = core_rows(framed.withColumn("raw", F.collect_list(c).over(rows(0, m - 1))))
    return raw.filter(F.size("raw") == m).withColumn("z", zscale(F.col("raw"))).select("symbol", "ts", "rn", "n", "raw", "z")


def profile(wins: DataFrame, m: int) -> DataFrame:
    """Matrix profile: each window's nearest non-overlapping neighbour."""
    found = nearest(wins, m, 1, int(np.ceil(m / 4)))
    best = F.get("neighbours", F.lit(0))
    return found.select("symbol", "rn", best["distance"].alias("distance"), best["rn"].alias("neighbour"))


def motifs(wins: DataFrame, prof: DataFrame, m: int, top_k: int = 10, max_matches: int = 5) -> DataFrame:
    """Up to ``top_k`` motifs per symbol, best profile value first.

    A seed must have a profile value of at most max(mean - 2 deviations, min). It collects the
    nearest windows within the profile's lower quartile, each outside the exclusion zone of the
    ones taken before; those zones are closed for later seeds. A chosen window excludes at
    most 2*zone+1 windows, so the first max_matches*(2*zone+1) candidates decide exactly.
    """
    zone = int(np.ceil(m / 4))
    need = max_matches * (2 * zone + 1)
    wins, prof = cut(wins.filter(F.col("n") >= 2 * m).select("symbol", "rn", "raw", "z")), cut(prof)
    limits = prof.groupBy("symbol").agg(
        F.greatest(F.avg("distance") - 2 * F.stddev_pop("distance"), F.min("distance")).alias("cutoff")
    ).join(grouped_quantile(prof, ["symbol"], "distance", 0.25, "reach"), "symbol")
    open_rows = cut(prof.join(limits, "symbol").filter(F.col("distance") <= F.col("cutoff")))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["distance", "rn"])
        taken: list[int] = []
        keep = []
        for i, at in zip(pdf.index, pdf["rn"]):
            if all(abs(at - t) > zone for t in taken):
                taken.append(at)
                keep.append(i)
                if len(taken) == max_matches:
                    break
        return pdf.loc[keep]

    all_found = None
    for motif_id in range(top_k):
        seeds = open_rows.groupBy("symbol").agg(F.min_by(F.struct("rn", "reach"), F.struct("distance", "rn")).alias("s"))
        seeds = seeds.select("symbol", F.col("s.rn").alias("seed"), F.col("s.reach").alias("reach"))
        with_z = seeds.join(wins.select("symbol", F.col("rn").alias("seed"), F.col("z").alias("sz")), ["symbol", "seed"])
        near = wins.join(with_z, "symbol").withColumn("distance", distance(F.col("z"), F.col("sz")))
        near = near.filter(F.col("distance") <= F.col("reach")).withColumn(
            "_r", F.row_number().over(Window.partitionBy("symbol").orderBy("distance", "rn"))
        ).filter(F.col("_r") <= need).select("symbol", "rn", "distance", "raw")
        found = cut(near.groupBy("symbol").applyInPandas(choose, near.schema).withColumn("motif_id", F.lit(motif_id)))
        if found.isEmpty():
            break
        all_found = found if all_found is None else all_found.unionByName(found)
        closed = found.groupBy("symbol").agg(F.collect_list("rn").alias("_t"))
        free = ~F.coalesce(F.exists("_t", lambda t: F.abs(F.col("rn") - t) <= zone), F.lit(False))
        open_rows = cut(open_rows.join(closed, "symbol", "left").filter(free).drop("_t"))
    if all_found is None:
        all_found = wins.select("symbol", "rn", F.lit(0.0).alias("distance"), "raw", F.lit(0).alias("motif_id")).limit(0)
    return all_found


def motif_table(matches: DataFrame, m: int) -> DataFrame:
    """One row per motif; the prototype is the median of its members at each position."""
    raws = F.col("raws")

    def median_at(i: Column) -> Column:
        return sorted_quantile(F.sort_array(F.transform(raws, lambda r: F.get(r, i))), 0.5)

    return (
        matches.groupBy("symbol", "motif_id")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.avg("distance").alias("mean_distance"),
            F.sort_array(F.collect_list("rn")).alias("indices"),
            F.collect_list("raw").alias("raws"),
        )
        .withColumn("prototype", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), median_at))
        .drop("raws")
    )


def kmeans_labels(wins: DataFrame, k: int = 15, seed: int = 42, max_iter: int = 100) -> DataFrame:
    """One vocabulary of shapes for all symbols: z-normalised windows are comparable."""
    vectors = cut(wins.withColumn("v", array_to_vector("z")))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="label", maxIter=max_iter).fit(vectors)
    return model.transform(vectors).drop("v")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Connected components of (keys, a, b) edges by alternating large and small stars.

    Returns (keys, node, root) with the smallest member as root; rounds grow with the
    logarithm of the graph, also for long chains.
    """
    def large(e: DataFrame) -> DataFrame:
        both = e.select(*keys, "a", "b").union(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.filter(F.col("b") > F.col("a")).join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        linked = down.join(low, [*keys, "a"])
        return linked.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(*keys, "a", F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter(F.col("a") != F.col("b")).distinct()

    current, mark = cut(tidy(edges.select(*keys, "a", "b"))), None
    while True:  # each round but the last moves a node to a smaller root
        current = cut(tidy(small(tidy(large(current)))))
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    roots = current.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def density_labels(wins: DataFrame, m: int, min_samples: int = 5, min_size: int = 10) -> DataFrame:
    """Density clusters per symbol; label -1 is noise.

    A window is dense when its ``min_samples``-th neighbour is within the median of that
    distance. Dense windows link to their dense near neighbours; connected groups of at least
    ``min_size`` are clusters, numbered from the largest.
    """
    wins = cut(wins)
    near = nearest(wins, m, min_samples)
    core = near.withColumn("core", F.when(F.size("neighbours") == min_samples, F.get("neighbours", F.lit(min_samples - 1))["distance"]))
    core = cut(core)
    limit = grouped_quantile(core, ["symbol"], "core", 0.5, "limit")
    dense = cut(core.join(limit, "symbol").filter(F.col("core") <= F.col("limit")))
    links = dense.select("symbol", F.col("rn").alias("a"), "limit", F.inline("neighbours")).filter(F.col("distance") <= F.col("limit"))
    links = links.select("symbol", "a", F.col("rn").alias("b"))
    links = links.join(dense.select("symbol", F.col("rn").alias("b")), ["symbol", "b"], "left_semi")
    roots = cut(components(links, ["symbol"]))
    sizes = roots.groupBy("symbol", "root").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") >= min_size)
    named = sizes.withColumn(
        "label", (F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("_size"), "root")) - 1).cast("int")
    )
    labels = roots.join(named, ["symbol", "root"]).select("symbol", F.col("node").alias("rn"), "label")
    return wins.join(labels, ["symbol", "rn"], "left").fillna(-1, ["label"])


def cluster_info(labelled: DataFrame, m: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Centroid, size and mean per-position deviation of each cluster, noise left out."""
    points = [F.get("z", F.lit(i)) for i in range(m)]
    return labelled.filter(F.col("label") >= 0).groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("size"),
        F.array(*[F.avg(p) for p in points]).alias("centroid"),
        (sum(F.stddev_pop(p) for p in points) / m).alias("std"),
    )


def occurrences(wins: DataFrame, templates: DataFrame, radius: float = 0.1, m: int = 20) -> DataFrame:
    """Windows (of length ``m``) within ``radius`` of the normalised patterns of a table (pattern_name, pattern), any number of them.

    Signatures never lie further apart than the shapes do, so a pattern only meets windows in the cells of side
    ``2 * radius`` that its own ball touches, eight at most. The join is on cells; Spark broadcasts the
    patterns while their measured size allows and shuffles both sides beyond it.
    """
    side = max(2 * radius, EPS)
    corner = ("_c0", "_c1", "_c2")

    def cell(c: Column) -> Column:
        return F.floor(c / side)

    marked = signature(wins, m)
    placed = marked.withColumns({c: cell(F.col(f"q{i}")) for i, c in enumerate(corner)}).drop("q0", "q1", "q2")
    asked = signature(templates.select("pattern_name", F.col("pattern").alias("z")), m)
    for i, c in enumerate(corner):
        slack = radius * (1 + 1e-9) + EPS
        asked = asked.withColumn(c, F.explode(F.sequence(cell(F.col(f"q{i}") - slack), cell(F.col(f"q{i}") + slack))))
    near = placed.join(asked.select(*corner, "pattern_name", F.col("z").alias("_pattern")), list(corner))
    near = near.withColumn("distance", distance(F.col("z"), F.col("_pattern"))).filter(F.col("distance") <= radius)
    return near.drop(*corner, "_pattern")


def forward_power(
    occurred: DataFrame, positioned: DataFrame, horizons: tuple[int, ...] = (3, 5, 10, 20), anchor: str = "start", m: int = 20,
    by: tuple[str, ...] = ("symbol", "pattern_name"), size: int = SIZE,
) -> DataFrame:
    """Return statistics after each occurrence (symbol, pattern_name, rn), per horizon.

    ``anchor="start"`` measures from the first row of the pattern, so the outcome overlaps the
    pattern; ``"end"`` measures from its last row.
    """
    shift = 0 if anchor == "start" else m - 1
    c = F.col("close")
    framed = with_halo(positioned.select("symbol", "rn", "n", "close"), after=max(horizons), size=size)
    ahead = [
        F.struct(
            F.lit(h).alias("horizon"),
            (ratio(lead("close", h), c) - 1).alias("end"),
            (ratio(F.max("close").over(rows(1, h)), c) - 1).alias("top"),
            (ratio(F.min("close").over(rows(1, h)), c) - 1).alias("bottom"),
            ((F.col("rn") + h <= F.col("n")) & (c > 0)).alias("valid"),
        )
        for h in horizons
    ]
    series = core_rows(framed.withColumn("_a", F.array(*ahead))).select("symbol", F.col("rn").alias("_at"), "_a")
    hits = occurred.select(*by, "rn").withColumn("_at", F.col("rn") + shift)
    on = hits if "symbol" in by else occurred.select("symbol", *by, "rn").withColumn("_at", F.col("rn") + shift)
    tall = on.join(series, ["symbol", "_at"]).select(*by, F.inline("_a"))
    tall = cut(tall.withColumn("end", F.when(F.col("valid"), F.col("end"))))
    valid = F.col("valid")
    stats = tall.groupBy(*by, "horizon").agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.count_if(valid).alias("n_valid"),
        F.avg("end").alias("mean_return"),
        F.stddev_pop("end").alias("std_return"),
        F.avg(F.when(valid, F.col("top"))).alias("mean_max_return"),
        F.avg(F.when(valid, F.col("bottom"))).alias("mean_min_return"),
        F.avg(F.when(valid, (F.col("end") > 0).cast("double"))).alias("win_rate"),
    ).filter(F.col("n_valid") > 0)
    middle = grouped_quantile(tall, [*by, "horizon"], "end", 0.5, "median_return")
    sharpe = F.col("mean_return") / (F.col("std_return") + EPS) * F.sqrt(F.lit(252.0) / F.col("horizon"))
    return stats.join(middle, [*by, "horizon"]).withColumn("sharpe_ratio", sharpe)


def library(positioned: DataFrame, config: PatternConfig = PatternConfig(), method: str = "density", size: int = SIZE) -> dict[str, DataFrame]:
    """Motifs and clusters with statistics per horizon, as two tables.

    ``stats``: (symbol, pattern_name, horizon, ...), ``shapes``: (symbol, pattern_name,
    occurrences, shape).
    """
    m = config.window
    positioned = cut(positioned)
    wins = cut(windows(positioned, m, size=size))
    found = cut(motifs(wins, profile(wins, m), m, config.top_motifs, config.max_matches))
    table = motif_table(found, m)
    name = F.concat(F.lit("motif_"), F.col("motif_id"))
    if method == "density":
        labelled = density_labels(wins, m, config.min_samples, config.min_cluster_size)
    elif method == "kmeans":
        labelled = kmeans_labels(wins, config.kmeans_k)
    else:
        raise ValueError(f"unknown method {method}")
    labelled = cut(labelled)
    cluster = F.concat(F.lit("cluster_"), F.col("label"))
    hits = found.select("symbol", name.alias("pattern_name"), "rn").unionByName(
        labelled.filter("label >= 0").select("symbol", cluster.alias("pattern_name"), "rn")
    )
    shapes = table.select("symbol", name.alias("pattern_name"), "occurrences", F.col("prototype").alias("shape")).unionByName(
        cluster_info(labelled, m).select("symbol", cluster.alias("pattern_name"), F.col("size").alias("occurrences"), F.col("centroid").alias("shape"))
    )
    return {"stats": forward_power(hits, positioned, config.horizons, m=m, size=size), "shapes": shapes}


def significant(stats: DataFrame, shapes: DataFrame, config: PatternConfig = PatternConfig()) -> DataFrame:
    """Patterns seen often enough whose win rate is high enough at some horizon."""
    good = stats.groupBy("symbol", "pattern_name").agg(F.max("win_rate").alias("_w")).filter(F.col("_w") >= config.min_win_rate)
    return shapes.filter(F.col("occurrences") >= config.min_occurrences).join(good.drop("_w"), ["symbol", "pattern_name"], "left_semi")


def summary(stats: DataFrame, shapes: DataFrame) -> DataFrame:
    """Best horizon by Sharpe ratio per pattern; the shorter horizon wins a tie."""
    best = F.max_by(
        F.struct(F.col("horizon").alias("best_horizon"), "mean_return", "win_rate", "sharpe_ratio"),
        F.struct("sharpe_ratio", -F.col("horizon")),
    )
    picked = stats.groupBy("symbol", "pattern_name").agg(best.alias("b")).select("symbol", "pattern_name", "b.*")
    return shapes.select("symbol", "pattern_name", "occurrences").join(picked, ["symbol", "pattern_name"], "left").orderBy(
        F.desc_nulls_last("sharpe_ratio"), "symbol", "pattern_name"
    )


def dtw(pattern: list[float], band: int | None = None):
    """Column function: dynamic time warping distance to ``pattern``; with ``band`` only places at most that far apart are matched.

    The recurrence runs once per cell for a whole Arrow batch of windows.
    """

    @F.pandas_udf("double")
    def measure(z: pd.Series) -> pd.Series:
        if not len(z):
            return pd.Series([], dtype="float64")
        a = np.vstack(z.values)
        b = np.asarray(pattern, dtype=float)
        reach = max(a.shape[1], len(b)) if band is None else max(band, abs(a.shape[1] - len(b)))
        previous = np.full((len(a), len(b) + 1), np.inf)
        previous[:, 0] = 0.0
        for i in range(a.shape[1]):
            current = np.full_like(previous, np.inf)
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                step = np.minimum(np.minimum(previous[:, j + 1], current[:, j]), previous[:, j])
                current[:, j + 1] = np.abs(a[:, i] - b[j]) + step
            if i == 0:
                previous[:, 0] = np.inf
            previous = current
        return pd.Series(previous[:, -1])

    return measure


def envelope(pattern: list[float], band: int | None) -> tuple[list[float], list[float]]:
    """The smallest and the largest value of ``pattern`` that each place may be matched with."""
    reach = len(pattern) if band is None else band
    near = [pattern[max(0, i - reach):i + reach + 1] for i in range(len(pattern))]
    return [min(x) for x in near], [max(x) for x in near]


def warped_bound(z: Column, pattern: list[float], band: int | None) -> Column:
    """Never above the warping distance: ends meet ends, and every other value lies at least its distance to the envelope away.

    Built-in functions only. Without a band the envelope is the pattern's whole range, so windows of any length may be compared; each value of the
    pattern then lies as far from the window's range, too, and the larger of both sums counts. On noise this excludes little; a band does.
    """
    low, high = envelope(pattern, band)
    if band is None:
        lo, hi = F.lit(low[0]), F.lit(high[0])
        gaps = F.transform(z, lambda x: F.greatest(F.lit(0.0), x - hi, lo - x))
    else:
        lows, highs = (F.array(*[F.lit(v) for v in side]) for side in (low, high))
        gaps = F.transform(z, lambda x, i: F.greatest(F.lit(0.0), x - F.get(highs, i), F.get(lows, i) - x))
    inner = F.aggregate(F.slice(gaps, F.lit(2), F.greatest(F.size(z) - 2, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    if band is None:
        least, most = F.array_min(z), F.array_max(z)
        far = F.transform(F.array(*[F.lit(v) for v in pattern[1:-1] or pattern[:1]]), lambda v: F.greatest(F.lit(0.0), v - most, least - v))
        inner = F.greatest(inner, F.aggregate(far, F.lit(0.0), lambda s, x: s + x) if len(pattern) > 2 else F.lit(0.0))
    ends = F.abs(F.get(z, F.lit(0)) - pattern[0]) + F.abs(F.get(z, F.size(z) - 1) - pattern[-1])
    return F.when((F.size(z) > 1) & F.lit(len(pattern) > 1), inner + ends).otherwise(F.lit(0.0))


def warped_candidates(wins: DataFrame, pattern: list[float], k: int, band: int | None = None, salts: int = 64) -> DataFrame:
    """The windows whose bound does not exclude them from the ``k`` nearest of their symbol.

    The ``k`` windows with the smallest bounds are measured first; no window whose bound is above the largest of their
    distances can be nearer. That limit meets the windows by (symbol, salt), so a long series stays spread.
    """
    bounded = cut(wins.select("symbol", "ts", "rn", "z").withColumn("_bound", warped_bound(F.col("z"), pattern, band)))
    first = Window.partitionBy("symbol").orderBy("_bound", "rn")
    seeds = bounded.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= k)
    limits = seeds.withColumn("_d", dtw(pattern, band)("z")).groupBy("symbol").agg(
        F.when(F.count("_d") == k, F.max("_d") * (1 + 1e-12)).otherwise(float("inf")).alias("_limit"))
    spread = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = bounded.withColumn("_salt", F.pmod("rn", F.lit(salts)).cast("int")).join(spread, ["symbol", "_salt"])
    return met.filter(F.col("_bound") <= F.col("_limit")).drop("_bound", "_limit", "_salt")


def normalized_template(values: list[float]) -> list[float]:
    x = np.asarray(values, dtype=float)
    return ((x - x.mean()) / (x.std() + EPS)).tolist()


def similar(wins: DataFrame, template: list[float], k: int = 10, method: str = "euclidean", band: int | None = None) -> DataFrame:
    """The ``k`` windows per symbol closest to ``template``, nearest first.

    ``band`` limits warping to places that far apart; it needs windows as long as the template.
    """
    pattern = normalized_template(template)
    if method == "euclidean":
        d = distance(F.col("z"), F.array(*[F.lit(x) for x in pattern]))
    elif method == "dtw":
        wins, d = warped_candidates(wins, pattern, k, band), dtw(pattern, band)("z")
    else:
        raise ValueError(f"unknown method {method}")
    w = Window.partitionBy("symbol").orderBy("distance", "rn")
    return wins.select("symbol", "ts", "rn", d.alias("distance")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
