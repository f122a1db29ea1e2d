"""Parameters of the transforms, with the defaults that the semantics assume."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    shard_count: int = 20
    customer_prefixes: tuple[str, ...] = ("wm", "wo")
    session_gap_minutes: int = 30
    min_text_len: int = 5
    top_n: int = 20
    top_words: int = 10
    breadth_weight: float = 0.3
    repr_docs: int = 5
    picked_docs: int = 8
    pool_size: int = 40
    pca_components: int = 10
    clusters: int = 150
    seed: int = 42
    init_sample: int = 3000
    train_batches: int = 4
    train_epochs: int = 2
    moment_days: int = 1  # days whose vectors the principal components are of
    max_distance: float = 0.0  # 0: no gate
    min_margin: float = 0.0
    merge_similarity: float = 0.85
    merge_linkage: str = "single"
    trend_similarity: float = 0.3
    surge_pct: float = 0.5
    surge_min_heat: int = 20
    department_min_sessions: int = 3
    department_min_share: float = 0.005
    drift_similarity: float = 0.9
    split_min_sessions: int = 30
    split_max_parts: int = 3
    window_days: int = 30
    line_chars: int = 300
    item_chars: int = 80
    evidence_chars: int = 60
    signals_per_day: int = 12
    notes_budget: int = 2500
    batch_tokens: int = 6000
    call_tokens: int = 8000
    tokens_per_cjk: float = 0.7
    tokens_per_other: float = 0.35
    need_confirm_days: int = 2
    signal_lookback_days: int = 90
    embed_chars: int = 7500
    cacheable_chars: int = 24
    cache_days: int = 7


DEFAULTS = Settings()
