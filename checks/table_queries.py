"""The whole feature table and the whole label table, against the SQL of their families joined on the bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import feature_queries, label_queries, quality_queries
from checks.fixtures import placed
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.plans import stages
from tidemark.session import cut

#: Families whose SQL compares fewer than six digits.
DIGITS = {"volume_zscore": 5, "rsi": 4, "stoch": 5, "risk_adjusted_return": 5}
FEATURES = [feature_queries.SQL[q] for q in feature_queries.SQL if not q.startswith("stored_")] + [quality_queries.SQL[q] for q in ("atr", "calendar")]
LABELS = [
    label_queries.SQL[q]
    for q in (*[f"label_move_{h}d" for h in (3, 5, 10, 20)], "consolidation", "consolidation_breakout", "false_breakout",
              "trend_reversal", "market_regime", "days_in_regime", "momentum_burst", "v_reversal")
]


def digits(name: str) -> int:
    return next((d for start, d in DIGITS.items() if name.startswith(start)), 6)


def table(df, names, texts=()):
    """Keys, ``texts``, and ``names`` as rounded doubles."""
    return df.select(
        "symbol", F.col("ts").cast("string").alias("ts"), *texts,
        *[(F.round(F.col(n).cast("double"), digits(n)) + 0.0).alias(n) for n in names],
    )


def joined(families, names, texts=()):
    """One row per bar from all families."""
    parts = ", ".join(f"f{i} AS MATERIALIZED ({sql})" for i, sql in enumerate(families))
    joins = " ".join(f"JOIN f{i} USING (symbol, ts)" for i in range(1, len(families)))
    cols = ", ".join([*texts, *[f"CAST({n} AS DOUBLE) + 0.0 AS {n}" for n in names]])
    return f"WITH {parts} SELECT symbol, ts, {cols} FROM f0 {joins}"


def label_names():
    return [n for n in L.label_columns()["all_outputs"] if n != "market_regime"]


QUERIES = {
    "all_features": lambda s, d: table(stages.feature_table(cut(placed(s, d))), X.feature_names()),
    "all_labels": lambda s, d: table(stages.label_table(cut(placed(s, d))), label_names(), ["market_regime"]),
}
SQL = {
    "all_features": joined(FEATURES, X.feature_names()),
    "all_labels": joined(LABELS, label_names(), ["market_regime"]),
}
