"""Settings of a cleaning run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanConfig:
    # The defaults decide which cells are flagged and reviewed.
    confidence_threshold: float = 0.7
    max_passes: int = 3
    chunk_rows: int = 50_000
    zscore_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    fuzzy_threshold: float = 0.9
    drift_alpha: float = 0.01
    rare_max_values: int | None = 50
    """A column with more rare values than this has none reported; None sets no limit and finds them by a join."""

    strict_nulls: bool = False
    """Leave NULL and the text ``None`` unimputed; only blank text is filled."""
    dtype_gated: bool = False
    """Run the boolean, phone and numeric rules only on columns of a fitting type."""
    fixpoint: bool = False
    """Chain format rules on a cell until none fires."""
    replay: bool = False
    """Repeat passes re-apply the rules to the original findings and log them again."""
