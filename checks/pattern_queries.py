"""Windows, motifs, clusters, occurrences and shape search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import BARS_SQL, SYM, out, placed, r, span
from tidemark.config import PatternConfig
from tidemark.operators import hierarchy as H, patterns as P
from tidemark.session import cut

QUERIES, SQL = {}, {}
KEY = "symbol, CAST(ts AS VARCHAR) AS ts"
M = 20


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def wins(s, d):
    return P.windows(placed(s, d), M)


WIN_SQL = BARS_SQL + f""",
w0 AS (SELECT *, list(close) OVER {span(0, M - 1)} AS raw FROM placed),
w1 AS (SELECT *, list_avg(raw) AS mu FROM w0 WHERE len(raw) = {M}),
w2 AS (SELECT *, sqrt(list_sum(list_transform(raw, lambda x: (x - mu) * (x - mu))) / {M}) AS sd FROM w1),
wins AS MATERIALIZED (SELECT symbol, ts, rn, n, raw, list_transform(raw, lambda x: (x - mu) / (sd + 1e-8)) AS z FROM w2),
templates AS MATERIALIZED (SELECT CASE rn WHEN 100 THEN 'first' ELSE 'second' END AS pattern_name, z AS pattern, raw FROM wins WHERE symbol = 'A' AND rn IN (100, 500))"""


def templates(w):
    picked = w.filter((F.col("symbol") == "A") & F.col("rn").isin(100, 500))
    return picked.select(F.when(F.col("rn") == 100, "first").otherwise("second").alias("pattern_name"), F.col("z").alias("pattern"), "raw")


register(
    "subsequences",
    lambda s, d: out(wins(s, d).withColumns({f"z{i}": F.get("z", F.lit(i)) for i in range(M)}), **{f"z{i}": 6 for i in range(M)}),
    f"WITH {WIN_SQL} SELECT {KEY}, {', '.join(r(f'z[{i + 1}]', f'z{i}') for i in range(M))} FROM wins",
)
register(
    "matrix_profile",
    lambda s, d: out(P.profile(cut(wins(s, d)), M), ("rn", "neighbour"), keys=("symbol",), distance=6),
    f"""WITH {WIN_SQL}, f AS (SELECT symbol, rn, CAST(z AS DOUBLE[{M}]) AS z FROM wins)
    SELECT a.symbol, a.rn, {r('min(array_distance(a.z, b.z))', 'distance')}, arg_min(b.rn, (array_distance(a.z, b.z), b.rn)) AS neighbour FROM f a JOIN f b ON a.symbol = b.symbol AND abs(a.rn - b.rn) > 5 GROUP BY a.symbol, a.rn""",
)


def _motifs(s, d):
    w = cut(wins(s, d))
    return P.motif_table(P.motifs(w, P.profile(w, M), M), M)


register("motifs", lambda s, d: _motifs(s, d).select("symbol", "motif_id", "occurrences", F.round("mean_distance", 6).alias("mean_distance"), F.to_json("indices").alias("indices"), F.to_json(F.transform("prototype", lambda x: F.round(x, 4))).alias("prototype")))
register(
    "kmeans_clusters",
    lambda s, d: P.cluster_info(P.kmeans_labels(wins(s, d)), M, ()).select("label", "size", F.round("std", 5).alias("std"), F.to_json(F.transform("centroid", lambda x: F.round(x, 4))).alias("centroid")),
)
register(
    "density_clusters",
    lambda s, d: P.density_labels(wins(s, d), M).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("size")),
)
register(
    "density_hierarchy",
    lambda s, d: H.hierarchy_labels(wins(s, d), M).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("size"), F.round(F.max("stability"), 6).alias("stability")),
)


def _tagged(w):
    """A label that SQL can give too: the third of the window in which its peak lies."""
    at = F.array_position("z", F.array_max("z"))
    return w.withColumn("label", F.floor((at - 1) / 7).cast("int"))


register(
    "cluster_info",
    lambda s, d: P.cluster_info(_tagged(wins(s, d)), M).select(
        "symbol", F.col("label").cast("bigint").alias("label"), "size", F.round("std", 6).alias("std"),
        *[(F.round(F.get("centroid", F.lit(i)), 6) + 0.0).alias(f"c{i}") for i in range(M)],
    ),
    f"""WITH {WIN_SQL}, t AS (SELECT *, (list_position(z, list_max(z)) - 1) // 7 AS label FROM wins),
    e AS (SELECT symbol, label, i, avg(z[i]) AS c, stddev_pop(z[i]) AS sd FROM t, range(1, 21) g(i) GROUP BY ALL),
    k AS (SELECT symbol, label, count(*) AS size FROM t GROUP BY ALL)
    SELECT symbol, CAST(label AS BIGINT) AS label, any_value(size) AS size, {r('avg(sd)', 'std')}, {', '.join(r(f'max(CASE WHEN i = {i + 1} THEN c END)', f'c{i}') for i in range(M))}
    FROM e JOIN k USING (symbol, label) GROUP BY symbol, label""",
)


def _hits(s, d):
    w = cut(wins(s, d))
    return P.occurrences(w, templates(w), 5.0, M)


HITS_SQL = WIN_SQL + """,
hits AS MATERIALIZED (SELECT w.*, t.pattern_name, list_distance(w.z, t.pattern) AS distance FROM wins w, templates t WHERE list_distance(w.z, t.pattern) <= 5.0)"""
register(
    "pattern_occurrences",
    lambda s, d: out(_hits(s, d), keys=("symbol", "ts", "pattern_name"), distance=6),
    f"WITH {HITS_SQL} SELECT {KEY}, pattern_name, {r('distance', 'distance')} FROM hits",
)
POWER = dict(mean_return=6, median_return=6, std_return=6, mean_max_return=6, mean_min_return=6, win_rate=6, sharpe_ratio=4)


def power_sql(anchor):
    return f"""fut AS MATERIALIZED (SELECT a.symbol, a.rn, h AS horizon, a.n, a.close AS c, list(b.close ORDER BY b.rn) AS f FROM placed a CROSS JOIN (VALUES (3), (5), (10), (20)) v(h)
      JOIN placed b ON a.symbol = b.symbol AND b.rn > a.rn AND b.rn <= a.rn + h GROUP BY ALL),
    ev AS (SELECT t.symbol, pattern_name, horizon, f[horizon] / c - 1 AS e, list_max(f) / c - 1 AS hi, list_min(f) / c - 1 AS lo, len(f) = horizon AND c > 0 AS ok
      FROM hits t LEFT JOIN fut ON t.symbol = fut.symbol AND fut.rn = t.rn + {anchor}),
    tot AS (SELECT symbol, pattern_name, count(*) AS n_occurrences FROM hits WHERE rn + {anchor} <= n GROUP BY ALL),
    power AS MATERIALIZED (SELECT ev.symbol, ev.pattern_name, CAST(horizon AS BIGINT) AS horizon, any_value(n_occurrences) AS n_occurrences, count(*) AS n_valid, avg(e) AS mean_return, median(e) AS median_return,
      stddev_pop(e) AS std_return, avg(hi) AS mean_max_return, avg(lo) AS mean_min_return, avg(CAST(e > 0 AS DOUBLE)) AS win_rate, avg(e) / (stddev_pop(e) + 1e-8) * sqrt(252.0 / horizon) AS sharpe_ratio
      FROM ev JOIN tot USING (symbol, pattern_name) WHERE ok GROUP BY ev.symbol, ev.pattern_name, horizon)"""


for anchor, shift in (("start", 0), ("end", M - 1)):
    register(
        f"forward_power_{anchor}",
        lambda s, d, anchor=anchor: out(P.forward_power(_hits(s, d), placed(s, d), anchor=anchor), ("horizon", "n_occurrences", "n_valid"), keys=("symbol", "pattern_name"), **POWER),
        f"WITH {HITS_SQL}, {power_sql(shift)} SELECT symbol, pattern_name, horizon, n_occurrences, n_valid, {', '.join(r(c, c, k) for c, k in POWER.items())} FROM power",
    )


def _tables(s, d):
    hits = cut(_hits(s, d))
    stats = cut(P.forward_power(hits, cut(placed(s, d))))
    shapes = hits.groupBy("symbol", "pattern_name").agg(F.count(F.lit(1)).alias("occurrences"))
    return stats, shapes


LIBRARY_SQL = f"{HITS_SQL}, {power_sql(0)}, shapes AS (SELECT symbol, pattern_name, count(*) AS occurrences FROM hits GROUP BY ALL)"
register(
    "significant_patterns",
    lambda s, d: P.significant(*_tables(s, d), PatternConfig(min_win_rate=0.55)),
    f"WITH {LIBRARY_SQL} SELECT * FROM shapes WHERE occurrences >= 5 AND (symbol, pattern_name) IN (SELECT symbol, pattern_name FROM power WHERE win_rate >= 0.55)",
)
register(
    "pattern_summary",
    lambda s, d: out(P.summary(*_tables(s, d)), ("occurrences", "best_horizon"), keys=("symbol", "pattern_name"), mean_return=6, win_rate=6, sharpe_ratio=4),
    f"""WITH {LIBRARY_SQL}, b AS (SELECT * FROM power QUALIFY row_number() OVER (PARTITION BY symbol, pattern_name ORDER BY sharpe_ratio DESC, horizon) = 1)
    SELECT symbol, pattern_name, occurrences, horizon AS best_horizon, {r('mean_return', 'mean_return')}, {r('win_rate', 'win_rate')}, {r('sharpe_ratio', 'sharpe_ratio', 4)}
    FROM shapes LEFT JOIN b USING (symbol, pattern_name)""",
)


def _similar(s, d, method, band=None):
    w = cut(wins(s, d))
    shape = list(w.filter("symbol = 'A' AND rn = 100").select("raw").first()["raw"])
    return out(P.similar(w, shape, 10, method, band), ("rn", "rank"), distance=6)


register(
    "similar_shapes_euclidean",
    lambda s, d: _similar(s, d, "euclidean"),
    f"""WITH {WIN_SQL}, x AS (SELECT w.*, list_distance(w.z, t.pattern) AS distance FROM wins w, templates t WHERE pattern_name = 'first')
    SELECT {KEY}, rn, row_number() OVER (PARTITION BY symbol ORDER BY distance, rn) AS rank, {r('distance', 'distance')} FROM x
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY distance, rn) <= 10""",
)
register("similar_shapes_dtw", lambda s, d: _similar(s, d, "dtw"))
register("similar_shapes_dtw_band", lambda s, d: _similar(s, d, "dtw", 3))


def _library(s, d):
    return P.library(placed(s, d))["stats"]


register(
    "pattern_library",
    lambda s, d: out(_library(s, d), ("horizon", "n_occurrences", "n_valid"), keys=("symbol", "pattern_name"), **POWER),
)
