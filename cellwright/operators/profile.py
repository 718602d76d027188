"""Column profiles, the quality score and the ad-hoc column reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import is_blank, is_info_null, is_profile_null
from ..session import cut
from .counts import cell_counts, numeric_summary, top_values
from .rows import ROW, cells, col, data_columns

TOP_VALUES = 10


def profile(
    df: DataFrame,
    columns: list[str] | None = None,
    counts: DataFrame | None = None,
    row_col: str = ROW,
    summary: DataFrame | None = None,
) -> DataFrame:
    """One row per column: null and distinct shares, then the numeric or the categorical part."""
    if counts is None:
        counts = cut(cell_counts(df, columns or data_columns(df, row_col), row_col), "counts")
    v, n = F.col("value"), F.col("n")
    present = ~is_profile_null(v)
    size = F.length(v)
    base = counts.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("null_count"),
        F.count_if(present).alias("unique_count"),
        F.min(F.when(present, size)).alias("min_length"),
        F.max(F.when(present, size)).alias("max_length"),
        (F.sum(F.when(present, size * n)) / F.sum(F.when(present, n))).alias("mean_length"),
    )
    top = (
        top_values(counts, TOP_VALUES, present)
        .groupBy("column")
        # at most ten entries per column
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", F.col("n").alias("count")))).alias("top"))
        .select("column", F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top_values"))
    )
    # every table joined below has one row per column
    if summary is None:
        summary = numeric_summary(counts)
    wide = base.join(F.broadcast(summary), "column", "left").join(F.broadcast(top), "column", "left")
    filled = F.col("total") - F.col("null_count")
    numeric = F.coalesce(F.col("numeric_count") / filled > 0.5, F.lit(False))

    def num(name: str, digits: int | None = 6):
        # rounding to ten places first hides the order in which partial sums were added
        c = F.round(F.round(F.col(name), 10), digits) if digits is not None else F.col(name)
        return F.when(numeric, c).alias(name)

    return wide.select(
        "column", "total", "null_count",
        F.round(F.col("null_count") / F.col("total") * 100, 2).alias("null_pct"),
        "unique_count",
        F.round(F.col("unique_count") / F.col("total") * 100, 2).alias("unique_pct"),
        numeric.alias("is_numeric"),
        num("mean"), num("median"), num("std"), num("min", None), num("max", None),
        num("skew", 4), num("q1"), num("q3"),
        F.when(~numeric, F.col("top_values")).alias("top_values"),
        F.when(~numeric, F.col("min_length")).alias("min_length"),
        F.when(~numeric, F.col("max_length")).alias("max_length"),
        F.when(~numeric, F.round("mean_length", 2)).alias("mean_length"),
    )


def quality_score(profiles: DataFrame) -> DataFrame:
    """Mean over columns of 0.7 completeness and 0.3 variety; 0 for a table without columns."""
    complete = F.greatest(F.lit(0.0), (100 - F.col("null_pct")) / 100)
    variety = F.when(F.col("unique_pct") > 1, 1.0).otherwise(0.5)
    return profiles.agg(F.round(F.coalesce(F.avg(complete * 0.7 + variety * 0.3), F.lit(0.0)), 4).alias("quality_score"))


def column_statistics(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Unrounded descriptive statistics; columns without numbers carry an ``error``."""
    _require(df, columns)
    if counts is None:
        counts = cut(cell_counts(df, columns), "counts")
    totals = counts.groupBy("column").agg(F.sum("n").alias("count"))
    out = totals.join(F.broadcast(numeric_summary(counts)), "column", "left")
    return out.select(
        "column", "count",
        F.coalesce("numeric_count", F.lit(0)).alias("numeric_count"),
        (F.col("count") - F.coalesce("numeric_count", F.lit(0))).alias("non_numeric_count"),
        "mean", "median", "std", "min", "max", "skew", "kurtosis", "q1", "q3",
        F.when(F.col("numeric_count").isNull(), "No numeric values").alias("error"),
    )


def value_counts(df: DataFrame, column: str, top_n: int | None = 20) -> DataFrame:
    """Frequencies of the non-null values, most frequent first."""
    _require(df, [column])
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    out = out.orderBy(F.desc("count"), F.asc("value"))
    return out if top_n is None else out.limit(top_n)


def column_info(df: DataFrame, column: str, samples: int = 10, row_col: str = ROW) -> DataFrame:
    """Type, total, null and distinct counts, and the first values of one column."""
    _require(df, [column])
    c = F.col(column)
    per_value = df.groupBy(c.alias("value")).agg(F.count("*").alias("n"))
    stats = per_value.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(is_info_null(F.col("value").cast("string")), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
    )
    head = (
        df.where(c.isNotNull()).select(row_col, c.alias("value")).orderBy(row_col).limit(samples)
        .agg(F.array_sort(F.collect_list(F.struct(row_col, "value"))).alias("head"))
        .select(F.transform("head", lambda h: h["value"]).alias("sample_values"))
    )
    # two one-row tables, joined on a constant
    return (
        stats.withColumn("_one", F.lit(1))
        .join(F.broadcast(head.withColumn("_one", F.lit(1))), "_one")
        .select(
            F.lit(column).alias("column"), F.lit(df.schema[column].dataType.simpleString()).alias("dtype"),
            "total", "null_count", "unique_count", "sample_values",
        )
    )


def duplicate_rows(df: DataFrame, subset: list[str] | None = None, row_col: str = ROW) -> DataFrame:
    """Rows that repeat an earlier row, with the row they repeat. NULLs equal each other.

    The first row of each key comes from a partial aggregate. Only keys that do repeat take part
    in the join back; their side holds one row per key, so a hot key's rows can be split over tasks
    at run time (adaptive skew join) with that one row repeated.
    """
    keys = subset or data_columns(df, row_col)
    _require(df, keys)
    marked = df.select(col(row_col).alias("row"), F.struct(*[col(k) for k in keys]).alias("_key"))
    first = marked.groupBy("_key").agg(F.min("row").alias("first_row"), F.count("*").alias("_n")).where("_n > 1")
    return (
        marked.join(first, "_key")
        .where(F.col("row") > F.col("first_row"))
        .select("row", "first_row")
    )


def duplicate_count(df: DataFrame, subset: list[str] | None = None, row_col: str = ROW) -> DataFrame:
    """Number of repeated rows from one partial aggregate, without the join."""
    keys = subset or data_columns(df, row_col)
    _require(df, keys)
    per_key = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"))


def null_cells(df: DataFrame, columns: list[str] | None = None, row_col: str = ROW) -> DataFrame:
    """``(row, column, value)`` of every blank cell; a map-only scan."""
    return cells(df, columns, row_col).where(is_blank(F.col("value")))


def _require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Column '{missing[0]}' not found")
