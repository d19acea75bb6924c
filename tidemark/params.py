"""Parameters as frozen values; they become literals of the plans that are built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The two regimes and the two venues.
PRE_MATCH, IN_GAME = "pre_match", "in_game"
REFERENCE_VENUE, TARGET_VENUE = "K", "P"


@dataclass(frozen=True)
class Bootstrap:
    resamples: int = 10_000
    seed: int = 20260709
    ci_level: float = 0.95


@dataclass(frozen=True)
class Calibration:
    buckets: tuple[float, ...] = tuple(i / 20 for i in range(1, 20))
    eps: float = 1e-9
    pass_margin: float = 0.0
    min_points: int = 50
    checkpoint_s: int = 600


@dataclass(frozen=True)
class LeadLag:
    threshold: float = 0.02
    confirmations: int = 3
    window_s: int = 300
    min_divergences: int = 30
    bucket_s: int = 6 * 3600  # of a key's grid that one task folds


@dataclass(frozen=True)
class Census:
    min_depth_usd: float = 250.0
    min_covered: int = 60
    families: tuple[str, ...] = ("series_winner", "map_winner")
    day_tolerance: int = 1
    match_threshold: float = 0.85
    min_acronym: int = 1
    leagues: tuple[str, ...] = ("LCK", "LPL", "LEC", "LCS", "LTA", "LCP", "MSI", "Worlds")
    window_start: str = "2025-01-01T00:00:00.000Z"


@dataclass(frozen=True)
class Parity:
    min_pass_rate: float = 0.95
    min_aligned: int = 30


@dataclass(frozen=True)
class Recorder:
    poll_seconds: int = 20
    cap_per_venue: int = 400
    catalog_ttl_s: int = 300
    cooldown_s: int = 3600


@dataclass(frozen=True)
class SportParams:
    key: str
    census: Census = field(default_factory=Census)
    parity: Parity = field(default_factory=Parity)
    calibration: Calibration = field(default_factory=Calibration)
    lead_lag: LeadLag = field(default_factory=LeadLag)
    bootstrap: Bootstrap = field(default_factory=Bootstrap)
    recorder: Recorder = field(default_factory=Recorder)
    bounded_date: str = "2026-09-30"
