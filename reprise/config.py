"""Settings of an analysis: defaults, presets, and where a value comes from when several say it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

# Weight sets as (lcs, levenshtein, positional).
WEIGHT_SETS = {"balanced": (0.40, 0.40, 0.20), "strict": (0.35, 0.50, 0.15), "structural": (0.35, 0.30, 0.35), "lenient": (0.45, 0.35, 0.20)}
# Presets as (threshold, min_units).
PRESETS = {"strict": (0.90, 5), "lenient": (0.60, 3)}
# The paths that an analysis leaves out unless told otherwise.
EXCLUDES = ("**/test/**", "**/*Test.java", "**/target/**", "**/build/**", "**/.git/**")


@dataclass(frozen=True)
class Settings:
    """Parameters of an analysis. A threshold over 1 is a percentage."""

    min_units: int = 5
    threshold: float = 0.75
    window_growth: int = 5
    maximal_only: bool = True
    enable_lsh: bool = True
    bands: int = 25
    rows_per_band: int = 4
    size_ratio: float = 0.30
    prefilter: float = 0.5
    weights: tuple[float, float, float] = WEIGHT_SETS["balanced"]
    exclude: tuple[str, ...] = EXCLUDES
    target: str | None = None

    def __post_init__(self):
        if self.threshold > 1:
            object.__setattr__(self, "threshold", self.threshold / 100)
        if self.min_units < 1 or self.window_growth < 0:
            raise ValueError("min_units must be at least 1 and window_growth at least 0")
        if not 0 <= self.threshold <= 1 or not 0 <= self.size_ratio <= 1 or not 0 <= self.prefilter <= 1:
            raise ValueError("threshold, size_ratio and prefilter must be between 0 and 1")
        if not 1 <= self.bands <= 256 or self.rows_per_band < 1:
            raise ValueError("bands must be between 1 and 256 and rows_per_band at least 1")
        if abs(sum(self.weights) - 1) > 0.001:
            raise ValueError("weights must sum to 1")

    @property
    def hashes(self) -> int:
        return self.bands * self.rows_per_band


def resolve(cli: Mapping | None = None, nested: Mapping | None = None, outer: Mapping | None = None, preset: str | None = None) -> Settings:
    """Settings from, in falling priority: the command line, a nested section, the outer configuration, a preset, the defaults.

    On the command line 0 and None mean "not given".
    """
    names = {f.name for f in fields(Settings)}
    values: dict = {}
    if preset:
        values["threshold"], values["min_units"] = PRESETS[preset]
    for level in (outer or {}, nested or {}, {k: v for k, v in (cli or {}).items() if v or v is False}):
        unknown = set(level) - names
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        values |= {k: (tuple(v) if isinstance(v, list) else v) for k, v in level.items()}
    return replace(Settings(), **values)
