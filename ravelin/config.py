"""Settings of the linkage engine, with the defaults of the three record-linkage recipes it offers."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Blocking:
    """Deterministic channels: postings beyond the caps are dropped (exact, numeric) or cut (rare tokens)."""

    rare_df_cap: int = 300
    posting_cap: int = 20_000
    query_tokens: int = 12
    name_tokens: int = 8
    same_country: bool = True


@dataclass(frozen=True)
class Retrieval:
    """IDF-sum token retrieval."""

    top_k: int = 100
    df_cap: int = 2000
    query_tokens: int = 12
    boosters: int = 10
    score_weight: float = 0.7
    name_weight: float = 0.3


@dataclass(frozen=True)
class Lists:
    """Channels and limits of the multi-block union."""

    exact_limit: int = 50
    rare_df: int = 2000
    least_length: int = 2
    name_top: int = 120
    address_top: int = 80
    char_top: int = 40
    char_df_share: float = 0.02
    char_df_least: int = 50
    numeric_top: int = 40
    numeric_cap: int = 5000
    postal_weight: float = 3.0
    house_weight: float = 1.5
    signature_weight: float = 2.0
    translit_factor: float = 0.8
    keep: int = 150
    inner: int = 25
    final: int = 15


@dataclass(frozen=True)
class Ranking:
    """Prescore weights and candidate counts."""

    top_k: int = 22
    pool: int = 150
    recall_grid: tuple[int, ...] = (10, 15, 20, 22, 24, 26)
    exact: float = 5.0
    core: float = 3.0
    translit: float = 2.5
    house: float = 2.0
    numeric: float = 1.5
    rare: float = 1.0
    rare_scale: float = 5.0
    rare_most: float = 2.0
    ann: float = 2.0
    address: float = 1.0
    block: float = 0.3


@dataclass(frozen=True)
class Nearest:
    per_source: int = 12
    lists: int = 4096
    probes: int = 8


@dataclass(frozen=True)
class Decision:
    """Thresholds of the singleton gate and of the margin rule."""

    threshold: float = 0.78
    singleton: float = 0.6
    lone_margin: float = 0.10
    lone_top: float = 0.85
    margin: float = 0.15
    multi_least: float = 0.65
    most: int = 11
    blend_low: float = 0.3
    blend_high: float = 0.7
    grid: tuple[float, ...] = tuple(round(0.3 + 0.05 * k, 2) for k in range(14))
    singleton_grid: tuple[float, ...] = (0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85)
    margin_grid: tuple[float, ...] = (0.1, 0.15, 0.2)


@dataclass(frozen=True)
class Sampling:
    train: int = 250_000
    validation: int = 50_000
    negatives_per_positive: int = 3
    least_negatives: int = 2
    banded_negatives: int = 6
    top_share: float = 0.5
    middle_share: float = 0.3
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    blocking: Blocking = field(default_factory=Blocking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    lists: Lists = field(default_factory=Lists)
    ranking: Ranking = field(default_factory=Ranking)
    nearest: Nearest = field(default_factory=Nearest)
    decision: Decision = field(default_factory=Decision)
    sampling: Sampling = field(default_factory=Sampling)


DEFAULTS = Settings()
