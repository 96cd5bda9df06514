"""Detector and retention settings."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1024 * 1024


@dataclass(frozen=True)
class Settings:
    # fixed default values
    spike_ratio: float = 5.0
    spike_min_conns: int = 1000
    spike_min_average: float = 10.0
    spike_cooldown_min: int = 60
    spike_top_talkers: int = 5
    alert_max_severity: int = 2
    alert_cooldown_min: int = 30
    volume_threshold_mb: int = 500
    volume_cooldown_min: int = 60
    volume_top: int | None = None  # report only so many, busiest first
    watch_countries: tuple[str, ...] = ("CN", "RU", "KP", "IR", "BY")
    country_cooldown_min: int = 60
    country_top: int | None = None
    behavior_ratio: float = 10.0
    behavior_cooldown_min: int = 60
    min_samples: int = 3
    fanout_ratio: float = 5.0
    fanout_min_ips: int = 10
    fanout_cooldown_min: int = 60
    ema_alpha: float = 0.3
    retention_hours: int = 72
    compact_every: int = 100  # cycles between two compactions of the stored batches; 0 for none
    # look-back windows; the hourly average is split into `trend / recent` slices
    recent: str = "5 minutes"
    trend: str = "1 hour"
    trend_slices: float = 12.0
    first_sight: str = "2 minutes"
