"""Checks on the repaired table: types, remaining nulls, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import CleanConfig
from ..functions.text import is_profile_null
from .anomalies import flagged, type_test
from .drift import ks_p_value, ks_statistics
from .rows import ROW, col, data_columns
from .schema import ColumnFacts

FINDINGS = "row bigint, column string, value string, anomaly_type string, severity string, details string"
NULL_SHARE = 0.5  # fixed value
DRIFT_MIN = 10  # fixed value


def type_errors(df: DataFrame, facts: dict[str, ColumnFacts], row_col: str = ROW) -> DataFrame:
    cols = [c for c in data_columns(df, row_col) if c in facts]
    return flagged(df, [type_test(col(c), facts[c]) for c in cols], row_col)


def null_errors(counts: DataFrame) -> DataFrame:
    """Columns more than half null, one row each, from the counts."""
    gone, total = F.col("gone"), F.col("total")
    per = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(is_profile_null(F.col("value")), F.col("n"))), F.lit(0)).alias("gone"), F.sum("n").alias("total")
    )
    return per.where((gone > 0) & (gone / total > NULL_SHARE)).select(
        F.lit(-1).cast("bigint").alias("row"), "column",
        F.format_string("%d nulls remaining", gone).alias("value"),
        F.lit("high_null_rate").alias("anomaly_type"), F.lit("warning").alias("severity"),
        F.format_string(
            "Column '%s' still has %d/%d (%.1f%%) null values after cleaning", F.col("column"), gone, total, gone / total * 100
        ).alias("details"),
    )


def drift_errors(
    before: DataFrame, after: DataFrame, columns: list[str] | None = None, config: CleanConfig = CleanConfig()
) -> list[tuple]:
    """Drifted columns as finding rows. Columns without a change cannot drift and are left out."""
    if columns is not None:
        if not columns:
            return []
        before, after = before.where(F.col("column").isin(columns)), after.where(F.col("column").isin(columns))
    rows = []
    for r in ks_statistics(before, after).orderBy("column").collect():
        if min(r["n_before"], r["n_after"]) < DRIFT_MIN:
            continue
        p = ks_p_value(r["d"], r["n_before"], r["n_after"])
        if p < config.drift_alpha:
            rows.append(
                (
                    -1, r["column"], f"KS stat={r['d']:.4f}, p={p:.6f}", "distribution_drift", "critical",
                    f"Cleaning caused significant distribution shift in '{r['column']}' (p={p:.6f})",
                )
            )
    return rows


def validate(
    cleaned: DataFrame,
    before: DataFrame,
    after: DataFrame,
    facts: dict[str, ColumnFacts],
    changed: list[str] | None = None,
    config: CleanConfig = CleanConfig(),
    row_col: str = ROW,
) -> tuple[bool, DataFrame]:
    """``(passed, errors)``: only drift is critical, so the verdict needs one row per changed column."""
    drift = drift_errors(before, after, changed, config)
    errors = type_errors(cleaned, facts, row_col).unionByName(null_errors(after))
    if drift:
        errors = errors.unionByName(cleaned.sparkSession.createDataFrame(drift, FINDINGS))
    return not drift, errors
