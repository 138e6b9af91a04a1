"""Settings. Every operator takes what it needs as an argument; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QualityConfig:
    start_date: str | None = None
    end_date: str | None = None
    min_rows: int = 252
    max_missing_share: float = 0.05
    outlier_sigmas: float = 10.0
    outlier_return: float = 0.5
    large_gap: float = 0.1
    normalization: str = "zscore"
    normalization_window: int = 252


@dataclass(frozen=True)
class FeatureConfig:
    windows: tuple[int, ...] = (3, 5, 10, 20, 40, 80)
    use_volume: bool = True
    use_shapes: bool = True
    shape_window: int = 20
    sax_bins: int = 10
    causal_divergence: bool = False


@dataclass(frozen=True)
class LabelConfig:
    horizons: tuple[int, ...] = (3, 5, 10, 20)
    atr_up: float = 1.5
    atr_down: float = 1.5
    min_days: int = 10
    max_days: int = 30
    width_multiplier: float = 1.2
    confirm_days: int = 3
    breakout_atr: float = 0.5
    breakout_volume: float = 1.5
    false_window: int = 10
    false_atr: float = 0.5
    reversal_prior_atr: float = 2.0
    reversal_change_atr: float = 2.0
    reversal_window: int = 10
    regime_rows: int = 40
    regime_return: float = 0.10


@dataclass(frozen=True)
class CycleConfig:
    max_lag: int = 100
    threshold: float = 0.3
    min_period: int = 5
    max_period: int = 252
    top_periods: int = 10
    scales: tuple[int, ...] = tuple(range(1, 128))
    n_states: int = 3
    max_iterations: int = 100


@dataclass(frozen=True)
class PatternConfig:
    window: int = 20
    top_motifs: int = 10
    max_matches: int = 5
    min_cluster_size: int = 10
    min_samples: int = 5
    kmeans_k: int = 15
    horizons: tuple[int, ...] = (3, 5, 10, 20)
    min_occurrences: int = 5
    min_win_rate: float = 0.6


@dataclass(frozen=True)
class ModelConfig:
    trees: int = 500
    depth: int = 7
    learning_rate: float = 0.05
    train_share: float = 0.8
    validation_share: float = 0.1
    validation_tolerance: float = 0.0
    patience: int = 50
    class_weights: bool = True
    focal_alpha: float = 0.25
    focal_gamma: float = 2.0
    seed: int = 42


@dataclass(frozen=True)
class EvaluationConfig:
    train_years: int = 5
    validation_months: int = 6
    test_months: int = 6
    step_months: int = 3
    capital: float = 100000.0
    position_share: float = 0.05
    spread_bps: float = 5.0
    slippage_bps: float = 2.0
    commission: float = 0.001
    delay_days: int = 1


@dataclass(frozen=True)
class Settings:
    quality: QualityConfig = field(default_factory=QualityConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    labels: LabelConfig = field(default_factory=LabelConfig)
    cycles: CycleConfig = field(default_factory=CycleConfig)
    patterns: PatternConfig = field(default_factory=PatternConfig)
    models: ModelConfig = field(default_factory=ModelConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)
