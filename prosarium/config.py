"""Parameters of a pipeline run, with their defaults (fixed values), from a mapping or a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ProsodyConfig:
    baseline_window: int | None = 10
    pitch_semitones: float = 1.3
    pitch_lower_clip_factor: float = 0.7
    volume_percent: float = 10.0
    rate_percent: float = 10.0
    slow_down_threshold_s: float = 1.0
    slow_down_percent_per_s: float = 2.0
    smoothing_alpha: float = 0.2
    max_jump: float = 8.0
    end_pause_ms: int = 500
    pause_factor: float = 1.0
    silence_min_ms: int = 1000
    silence_dbfs: float = -50.0
    silence_keep_ms: int = 300
    least_break_ms: int = 50
    lead_in_ms: int = 150
    break_tolerance_ms: int = 5
    pack_target_s: float = 60.0
    pack_margin_s: float = 15.0

    def __post_init__(self) -> None:
        if not 0 < self.smoothing_alpha <= 1 or self.max_jump <= 0 or self.pack_margin_s > self.pack_target_s:
            raise ValueError("smoothing_alpha must lie in (0, 1], max_jump above 0, pack_margin_s within pack_target_s")

    @staticmethod
    def of(values: dict | None) -> ProsodyConfig:
        """Unknown names are an error, missing and empty ones take the default."""
        known = {f.name for f in fields(ProsodyConfig)}
        given = {k: v for k, v in (values or {}).items() if v is not None and v != ""}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return ProsodyConfig(**given)

    @staticmethod
    def read(path: str) -> ProsodyConfig:
        """From a YAML file, if a YAML library is there."""
        import yaml

        with open(path, encoding="utf-8") as f:
            return ProsodyConfig.of(yaml.safe_load(f))
