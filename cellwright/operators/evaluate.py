"""Precision, recall, F1, false positives and coverage of applied fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluate(applied: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All measures in one pass, for the whole table or per ``by`` columns (e.g. a dataset id).

    ``applied(row, column, new_value)`` and ``truth(row, column, expected_value)`` meet in one union that is
    collapsed per value and then per cell; the second step reuses nothing but partial sums, and no
    join is needed. NULL values compare as the text ``None``.
    """
    by = by or []
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    cell = [*by, "row", "column"]
    a = applied.select(*cell, F.coalesce("new_value", F.lit("None")).alias("v"), one.alias("a"), none.alias("t"))
    t = truth.select(*cell, F.coalesce("expected_value", F.lit("None")).alias("v"), none.alias("a"), one.alias("t"))
    per_value = a.unionByName(t).groupBy(*cell, "v").agg(F.sum("a").alias("a"), F.sum("t").alias("t"))
    both = (F.col("a") > 0) & (F.col("t") > 0)
    per_cell = per_value.groupBy(*cell).agg(
        F.sum("a").alias("a"), F.sum("t").alias("t"),
        F.sum(F.when(both, F.col("a")).otherwise(0)).alias("right"),
        F.sum(F.when(both, F.col("t")).otherwise(0)).alias("found"),
    )
    totals = per_cell.groupBy(*by).agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_applied"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("total_ground_truth"),
        F.coalesce(F.sum("right"), F.lit(0)).alias("right"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"),
        F.coalesce(F.sum(F.when(F.col("t") == 0, F.col("a"))), F.lit(0)).alias("stray"),
        F.count_if((F.col("a") > 0) & (F.col("t") > 0)).alias("touched"),
        F.count_if(F.col("t") > 0).alias("truth_cells"),
    )

    def share(n: str, d: str) -> Column:
        return F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(d).cast("double")), F.lit(0.0))

    p, r = share("right", "total_applied"), share("found", "total_ground_truth")
    return totals.select(
        *by,
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1_score"),
        F.round(share("stray", "total_applied"), 4).alias("false_positive_rate"),
        F.round(share("touched", "truth_cells"), 4).alias("coverage"),
        "total_applied", "total_ground_truth",
    )


def precision(applied: DataFrame, truth: DataFrame) -> float:
    return _unrounded(applied, truth)[0]


def recall(applied: DataFrame, truth: DataFrame) -> float:
    return _unrounded(applied, truth)[1]


def f1_score(applied: DataFrame, truth: DataFrame) -> float:
    p, r = _unrounded(applied, truth)
    return 2 * p * r / (p + r) if p + r else 0.0


def _unrounded(applied: DataFrame, truth: DataFrame) -> tuple[float, float]:
    a = applied.select("row", "column", F.coalesce("new_value", F.lit("None")).alias("v"))
    t = truth.select("row", "column", F.coalesce("expected_value", F.lit("None")).alias("v"))
    total_a, total_t = a.count(), t.count()
    right = a.join(t.distinct(), ["row", "column", "v"], "left_semi").count()
    found = t.join(a.distinct(), ["row", "column", "v"], "left_semi").count()
    return (right / total_a if total_a else 0.0), (found / total_t if total_t else 0.0)


def wrong_cells(applied: DataFrame, truth: DataFrame) -> DataFrame:
    """Applied fixes on cells the truth does not mention: the false positives themselves."""
    return applied.join(truth.select("row", "column").distinct(), ["row", "column"], "left_anti")


def covered_cells(applied: DataFrame, truth: DataFrame) -> DataFrame:
    """Cells of the truth that were touched at all."""
    return applied.select("row", "column").intersect(truth.select("row", "column"))
