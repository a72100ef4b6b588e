"""Run parameters. One frozen dataclass; `replace()` is the override mechanism."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults of the published configuration.
    delta_t_seconds: float = 60
    candidate_delta_t_seconds: tuple = (30, 60, 120, 300)
    horizon_multiple: int = 30
    candidate_horizon_multiples: tuple = (10, 30, 60)
    max_seq_len: int = 60
    drop_unconfirmed_negatives: bool = True
    min_distinct_assets: int = 5
    min_calendar_date_frac: float = 0.95
    min_forecast_instances: int = 10
    train_frac: float = 0.6
    val_frac: float = 0.2
    test_frac: float = 0.2
    seed: int = 42
    bootstrap_iterations: int = 1000
    bootstrap_ci: float = 0.95
    capture_at_percents: tuple = (1, 2, 5, 10)
    alert_threshold: float = 0.5

    def __post_init__(self):
        if abs(self.train_frac + self.val_frac + self.test_frac - 1.0) >= 1e-6:
            raise ValueError("split fractions must sum to 1")

    def canonical_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)


# Binding used for the generic `events` table (hours-wide windows suit its event rate).
EVENTS_SETTINGS = Settings(
    delta_t_seconds=21600,
    candidate_delta_t_seconds=(10800, 21600, 43200, 86400),
    horizon_multiple=3,
    candidate_horizon_multiples=(1, 3, 6),
)
