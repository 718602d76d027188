"""Type and format inference from value counts, and the per-column facts a repair needs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CleanConfig
from ..functions.text import FORMAT_PATTERNS, is_blank, is_profile_null, looks_numeric, plain_text
from ..session import cut
from .counts import cell_counts, numeric_summary
from .rows import ROW, check_names, col, data_columns, spread

# The share of values a type or format must exceed, in order of precedence.
NUMERIC_SHARE = 0.8
BOOLEAN_SHARE = 0.8
FORMAT_SHARE = 0.6
DATE_FORMATS = ["date_iso", "date_us", "date_eu"]
TEXT_FORMATS = ["email", "phone_us", "url", "uuid"]


def sample_rows(df: DataFrame, rows: int, total: int, seed: int = 17, row_col: str = ROW) -> DataFrame:
    """Head half plus a seeded pseudo-random half of the rest: the sampling operator."""
    half = min(rows, total) // 2
    head = df.where(F.col(row_col) < half)
    rest = df.where(F.col(row_col) >= half).orderBy(F.xxhash64(F.col(row_col), F.lit(seed)), row_col).limit(half)
    return head.unionByName(rest)


def type_counts(counts: DataFrame) -> DataFrame:
    """One row per column: how many cells pass each type and format test.

    Every regex runs once per distinct value, and all tests share one pass.
    """
    v, n = F.col("value"), F.col("n")
    text = plain_text(v)

    def cells_where(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, n)), F.lit(0))

    tested = counts.withColumn("text", text).select(
        "column", "value", "n",
        (~is_blank(v)).alias("filled"),
        (~is_profile_null(v)).alias("present"),
        looks_numeric(v).alias("num"),
        *[F.col("text").rlike(f"(?i)^(?:{p})").alias(f"p_{k}") for k, p in FORMAT_PATTERNS.items()],
    )
    filled, present, num = F.col("filled"), F.col("present"), F.col("num")
    return tested.groupBy("column").agg(
        F.sum("n").alias("total"),
        cells_where(filled).alias("filled_n"),
        F.count_if(filled).alias("filled_distinct"),
        cells_where(present).alias("present_n"),
        F.count_if(present).alias("present_distinct"),
        cells_where(filled & num).alias("numeric_n"),
        F.coalesce(F.bool_or(filled & num & v.contains(".")), F.lit(False)).alias("has_point"),
        *[cells_where(filled & F.col(f"p_{k}")).alias(f"n_{k}") for k in FORMAT_PATTERNS],
        F.min_by(v, F.when(filled, F.struct(-n, v))).alias("mode_all"),
        F.min_by(v, F.when(filled & (v != "None"), F.struct(-n, v))).alias("mode"),
    )


def schema_report(types: DataFrame) -> DataFrame:
    """Cascade of the type tests: numeric, boolean, dates, text formats, else plain text."""
    filled = F.col("filled_n")
    share = {k: F.col(f"n_{k}") / filled for k in FORMAT_PATTERNS}
    numeric = F.col("numeric_n") / filled
    dtype, fmt = F.lit("string"), F.lit(None).cast("string")
    match = F.lit(None).cast("double")
    for k in reversed(TEXT_FORMATS):
        hit = share[k] > FORMAT_SHARE
        fmt, match = F.when(hit, k).otherwise(fmt), F.when(hit, share[k]).otherwise(match)
    unique = F.when(fmt.isNull(), F.col("filled_distinct") / filled)
    for k in reversed(DATE_FORMATS):
        hit = share[k] > FORMAT_SHARE
        dtype, fmt = F.when(hit, "date").otherwise(dtype), F.when(hit, k).otherwise(fmt)
        match = F.when(hit, share[k]).otherwise(match)
    hit = share["boolean"] > BOOLEAN_SHARE
    dtype, fmt = F.when(hit, "boolean").otherwise(dtype), F.when(hit, "boolean").otherwise(fmt)
    match = F.when(~hit, match)
    hit = numeric > NUMERIC_SHARE
    point = F.col("has_point")
    dtype = F.when(hit, F.when(point, "float").otherwise("integer")).otherwise(dtype)
    fmt = F.when(hit, F.when(point, "decimal").otherwise("integer")).otherwise(fmt)
    match = F.when(~hit, match)
    dtype = F.when(filled == 0, "empty").otherwise(dtype)
    fmt = F.when(filled > 0, fmt)
    plain = (dtype == "string") & fmt.isNull()
    return types.select(
        "column",
        dtype.alias("dtype"),
        ((filled < F.col("total")) | (filled == 0)).alias("nullable"),
        fmt.alias("format_pattern"),
        F.round(F.when(dtype.isin("integer", "float"), numeric), 4).alias("numeric_rate"),
        F.round(F.when(filled > 0, match), 4).alias("match_rate"),
        F.round(F.when(plain, unique), 4).alias("unique_rate"),
    )


def schema_issues(types: DataFrame) -> DataFrame:
    """Mixed columns (10 to 90 % numeric) and empty columns."""
    filled = F.col("filled_n")
    rate = F.col("numeric_n") / filled

    def percent(r: Column) -> Column:
        return F.format_string("%.1f", F.bround(r * 100, 1))

    mixed = (filled >= 2) & (rate > 0.1) & (rate < 0.9)
    found = F.array_compact(
        F.array(
            F.when(
                mixed,
                F.struct(
                    F.lit("mixed_types").alias("issue_type"),
                    F.concat(
                        F.lit("mixed_types: "), percent(rate), F.lit("% numeric, "), percent(1 - rate), F.lit("% non-numeric")
                    ).alias("details"),
                    F.lit("warning").alias("severity"),
                ),
            ),
            F.when(
                filled == 0,
                F.struct(
                    F.lit("all_empty").alias("issue_type"),
                    F.lit("Column contains no non-empty values").alias("details"),
                    F.lit("critical").alias("severity"),
                ),
            ),
        )
    )
    return types.select("column", F.inline(found))


def infer_schema(
    df: DataFrame,
    columns: list[str] | None = None,
    counts: DataFrame | None = None,
    row_col: str = ROW,
) -> tuple[DataFrame, DataFrame]:
    """``(schema_report, schema_issues)``, both lazy and one row per column or issue."""
    columns = columns or data_columns(df, row_col)
    if counts is None:
        counts = cell_counts(df, columns, row_col)
    types = type_counts(counts)
    return schema_report(types), schema_issues(types)


def format_pattern(types: DataFrame) -> DataFrame:
    """Best catalogue pattern per column; the first one wins ties."""
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("name"))
                for i, k in enumerate(FORMAT_PATTERNS)
            ]
        )
    )
    return types.select(
        "column",
        F.when(best["n"] > 0, best["name"]).alias("pattern"),
        F.round(F.when(F.col("filled_n") > 0, best["n"] / F.col("filled_n")).otherwise(0.0), 4).alias("match_rate"),
        F.col("filled_n").alias("total_checked"),
    )


@dataclass
class ColumnFacts:
    """What is known about one column: a few scalars, and its rare values, or the column of the table that counts them."""

    column: str
    dtype: str = "string"
    format_pattern: str | None = None
    total: int = 0
    present_n: int = 0
    present_distinct: int = 0
    numeric_count: int = 0
    mean: float | None = None
    std_pop: float | None = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    mode: str | None = None
    rare: dict[str, int] = field(default_factory=dict)
    rare_column: str | None = None

    @property
    def is_number(self) -> bool:
        return self.dtype in ("integer", "float")

    @property
    def median_text(self) -> str | None:
        return None if self.median is None else repr(round(float(self.median), 6))


# Fixed values of the rare-category test.
RARE_MIN_CELLS = 20
RARE_MAX_DISTINCT_SHARE = 0.5
RARE_SHARE = 0.01
RARE_MAX_VALUES = 50


def rare_values(counts: DataFrame, types: DataFrame, most: int | None = RARE_MAX_VALUES) -> DataFrame:
    """``(column, value, n)`` of rare categories. Columns with more than ``most`` of them have none; None keeps them all."""
    cut_off = F.greatest(F.lit(1), F.floor(F.col("present_n") * F.lit(RARE_SHARE)))
    eligible = types.where(
        (F.col("present_n") >= RARE_MIN_CELLS)
        & (F.col("present_distinct") / F.col("present_n") <= RARE_MAX_DISTINCT_SHARE)
    ).select("column", cut_off.alias("cut_off"))
    # one row per column on the broadcast side
    low = counts.join(F.broadcast(eligible), "column").where(
        ~is_profile_null(F.col("value")) & (F.col("n") <= F.col("cut_off"))
    )
    if most is None:
        return low.select("column", "value", "n")
    few = low.groupBy("column").count().where(F.col("count") <= most).select("column")
    return low.join(F.broadcast(few), "column").select("column", "value", "n")


def with_rare_counts(df: DataFrame, facts: dict[str, ColumnFacts], counts: DataFrame, types: DataFrame) -> tuple[DataFrame, dict[str, ColumnFacts]]:
    """The table with a helper column for each column that has rare values: how often the row's value occurs, if it is rare.

    For ``rare_max_values=None``: any number of rare values meets the rows in a join by value, and none reaches the driver. A rare
    value holds a hundredth of a column's cells at most, so no key of the join is hot.
    """
    rare = cut(rare_values(counts, types, None), "rare")
    marked, known = df, dict(facts)
    # a name per column
    for i, name in enumerate(sorted(r["column"] for r in rare.select("column").distinct().collect() if r["column"] in facts)):
        helper, key = f"_rare_{i}", f"_rare_value_{i}"
        check_names(df.columns, (helper, key))
        part = rare.where(F.col("column") == name).select(F.col("value").alias(key), F.col("n").alias(helper))
        marked = marked.join(part, col(name) == F.col(key), "left").drop(key)
        known[name] = replace(facts[name], rare={}, rare_column=helper)
    return marked, known


def collect_facts(
    counts: DataFrame,
    config: CleanConfig = CleanConfig(),
    with_rare: bool = True,
    types: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> dict[str, ColumnFacts]:
    """Bring the facts to the driver: one row per column, plus at most ``config.rare_max_values`` rare values each (none if that is None).

    ``types`` and ``summary`` are the counts' ``type_counts`` and ``numeric_summary`` where they exist already.
    """
    if types is None:
        # one row per column: written once, so its four readers do not each redo the pass
        types = cut(type_counts(spread(counts)), "types")
    if summary is None:
        summary = numeric_summary(spread(counts))
    mode = "mode_all" if config.strict_nulls else "mode"
    report = (
        schema_report(types)
        .join(types.select("column", "total", "present_n", "present_distinct", F.col(mode).alias("mode")), "column")
        .join(summary.drop("min", "max", "std", "skew", "kurtosis"), "column", "left")
    )
    facts = {}
    for r in report.collect():
        facts[r["column"]] = ColumnFacts(
            r["column"], r["dtype"], r["format_pattern"], r["total"], r["present_n"], r["present_distinct"],
            r["numeric_count"] or 0, r["mean"], r["std_pop"], r["q1"], r["median"], r["q3"], r["mode"],
        )
    if with_rare and config.rare_max_values is not None:
        for r in rare_values(counts, types, config.rare_max_values).orderBy("column", F.desc("n"), "value").collect():
            facts[r["column"]].rare[r["value"]] = r["n"]
    return facts


def facts_with_rare(
    df: DataFrame, columns: list[str] | None = None, config: CleanConfig = CleanConfig(), row_col: str = ROW
) -> tuple[DataFrame, dict[str, ColumnFacts]]:
    """The table and its facts, with the helper columns of ``with_rare_counts`` where ``config`` sets no limit of rare values."""
    columns = columns or data_columns(df, row_col)
    counts = cut(cell_counts(df, columns, row_col), "counts")
    types = cut(type_counts(spread(counts)), "types")
    facts = collect_facts(counts, config, types=types)
    facts = {c: facts.get(c, ColumnFacts(c, "empty")) for c in columns}
    return with_rare_counts(df, facts, counts, types) if config.rare_max_values is None else (df, facts)


def facts_of(
    df: DataFrame, columns: list[str] | None = None, config: CleanConfig = CleanConfig(), row_col: str = ROW
) -> dict[str, ColumnFacts]:
    """Facts straight from a table."""
    columns = columns or data_columns(df, row_col)
    facts = collect_facts(cut(cell_counts(df, columns, row_col), "counts"), config)
    return {c: facts.get(c, ColumnFacts(c, "empty")) for c in columns}
