"""End-to-end plans: the stages in order, each a table the next one reads."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from tidemark.config import Settings
from tidemark.operators import backtest as B
from tidemark.operators import cycles, explain, features as X, labels as L, metrics, models as M, patterns, quality as Q, spectrum, wavelet
from tidemark.session import cut
from tidemark.sources.bars import date_range


def prepared(bars: DataFrame, settings: Settings = Settings(), method: str = "forward_fill") -> DataFrame:
    """Clean rows with positions, written once: features, labels and the rest read them."""
    return cut(Q.clean(bars, settings.quality, method))


def feature_table(clean: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return Q.calendar(X.features(clean, settings.features))


def label_table(clean: DataFrame, settings: Settings = Settings(), compat: bool = False) -> DataFrame:
    return L.labels(clean, settings.labels, compat)


def training_rows(clean: DataFrame, target: str = "label_up_10d", settings: Settings = Settings()) -> dict[str, object]:
    """Feature columns with label and role, stored, and the names of the features."""
    names = X.feature_names(settings.features)
    rows = M.training_set(feature_table(clean, settings), label_table(clean, settings), target, names, settings.models)
    return {"rows": rows, "names": names}


def fitted(rows: DataFrame, names: list[str], kind: str = "binary", settings: Settings = Settings()) -> dict[str, object]:
    """Model, scored test rows, test metrics and importance."""
    model = M.boosted_trees(rows, names, kind, settings.models)
    test = cut(M.predict(model, rows.filter("role = 'test'"), names).drop("features"))
    scores = metrics.regression(test) if kind == "regression" else metrics.classification(test)
    out = {"model": model, "test": test, "metrics": scores, "importance": M.importance(model, names)}
    if kind == "multiclass":
        labels = sorted(M.class_columns(model))
        out["auc"] = metrics.one_vs_rest_auc(test, len(labels), classes=labels)
    return out


def train(clean: DataFrame, target: str = "label_up_10d", kind: str = "binary", settings: Settings = Settings()) -> dict[str, object]:
    """Training rows, model, scored test rows, test metrics and importance."""
    ready = training_rows(clean, target, settings)
    return {**ready, **fitted(ready["rows"], ready["names"], kind, settings)}


def backtest_scores(clean: DataFrame, scored: DataFrame, threshold: float = 0.5, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Backtest of out-of-sample scores: only the scored rows are traded, renumbered."""
    from tidemark.operators.frame import position

    rows = clean.select("symbol", "ts", "open", "high", "low", "close", "volume").join(scored.select("symbol", "ts", "score"), ["symbol", "ts"])
    return B.strategy(position(cut(rows)), threshold, settings.evaluation)


def detect_cycles(clean: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    from tidemark.operators import hidden_states

    series = cut(cycles.series_of(clean))
    acf = cut(cycles.acf(series, settings.cycles))
    power = cut(spectrum.amplitudes(series, settings.cycles))
    waves = cut(wavelet.scale_power(series, settings.cycles))
    tops, strong, scales = cycles.cycle_peaks(acf, settings.cycles), cycles.dominant_periods(power, settings.cycles), wavelet.dominant_scales(waves)
    return {
        "acf": acf, "pacf": cycles.pacf(series, settings.cycles), "spectrum": power, "wavelet": waves,
        "summary": cycles.summarize(tops, strong, scales), **hidden_states.regimes(clean, settings.cycles),
    }


def run(bars: DataFrame, target: str = "label_up_10d", settings: Settings = Settings(), method: str = "density") -> dict[str, object]:
    """Everything from raw bars to the backtest of the test rows."""
    clean = prepared(bars, settings)
    trained = train(clean, target, settings=settings)
    return {
        "clean": clean,
        "patterns": patterns.library(clean, settings.patterns, method),
        "cycles": detect_cycles(clean, settings),
        "training": trained,
        "backtest": backtest_scores(clean, trained["test"], settings=settings),
    }


def score_and_explain(
    bars: DataFrame, model: PipelineModel, start: str | None = None, end: str | None = None, settings: Settings = Settings()
) -> DataFrame:
    """Scores and reports for the requested dates.

    ``bars`` must reach back over the warm-up and hold at least the minimum history; symbols
    below it are left out. Whole-series operators see the rows given.
    """
    names = X.feature_names(settings.features)
    quality = replace(settings.quality, end_date=end)
    table = date_range(feature_table(prepared(bars, replace(settings, quality=quality)), settings), start, end)
    rows = cut(table.select("symbol", "ts", *names))
    scored = M.predict(model, rows, names).select("symbol", "ts", "score")
    return explain.prediction_report(scored, explain.attributions(model, rows, names), names)
