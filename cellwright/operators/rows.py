"""Row identity and the cell form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

ROW = "_row"
# Columns that the repair pass adds beside those of a table.
HELPERS = ("_changes", "_flags", "_fixes", "_new")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def data_columns(df: DataFrame, row_col: str = ROW) -> list[str]:
    """Every column but the row number."""
    return [c for c in df.columns if c != row_col]


def check_names(columns: list[str], reserved: tuple[str, ...] = HELPERS) -> None:
    """Fail when a table brings a column that an operator is about to add."""
    taken = [c for c in columns if c in reserved]
    if taken:
        raise ValueError(f"Column '{taken[0]}' is reserved; rename it first")


def with_row_index(df: DataFrame, order_by: list[str | Column] | None = None, row_col: str = ROW) -> DataFrame:
    """Dense 0-based row numbers in the order of ``order_by`` (else in partition order).

    One range shuffle when an order is asked for, none otherwise. The position inside each
    partition is frozen by writing the table, then the rows before each partition (one number
    per partition, so bounded by the partition count) are broadcast and added.
    """
    check_names(df.columns, (row_col, "_arrival", "_at", "_block", "_n", "_first", "_shift"))
    out = df
    if order_by:
        # The arrival position splits ties, so one hot key spreads over several partitions.
        keys = [col(k) if isinstance(k, str) else k for k in order_by]
        out = (
            df.withColumn("_arrival", F.monotonically_increasing_id())
            .repartitionByRange(*keys, F.col("_arrival"))
            .sortWithinPartitions(*keys, F.col("_arrival"))
            .drop("_arrival")
        )
    placed = cut(out.withColumn("_at", F.monotonically_increasing_id()), "rows")
    return _number(placed, F.shiftright("_at", 33), row_col).drop("_at")


def with_file_row_index(df: DataFrame, row_col: str = ROW) -> DataFrame:
    """Dense row numbers in file order for a frame read straight from files; no data shuffle.

    The offsets hold one row per file split, a list the driver already keeps to schedule the scan.
    """
    placed = cut(
        df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "rows",
    )
    splits = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n")
    offsets = splits.select("_file", "_start", (before - F.col("_first")).alias("_shift"))
    return (
        placed.join(F.broadcast(offsets), ["_file", "_start"])
        .withColumn(row_col, F.col("_at") + F.col("_shift"))
        .select(quoted(row_col), *map(quoted, df.columns))
    )


def _number(placed: DataFrame, block: Column, row_col: str) -> DataFrame:
    blocks = placed.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")
    offsets = blocks.select("_block", (before - F.col("_first")).alias("_shift"))
    cols = [quoted(c) for c in placed.columns if c != row_col]
    # one number per partition
    return (
        placed.withColumn("_block", block)
        .join(F.broadcast(offsets), "_block")
        .withColumn(row_col, F.col("_at") + F.col("_shift"))
        .select(quoted(row_col), *cols)
    )


def with_chunk_id(df: DataFrame, chunk_rows: int = 50_000, row_col: str = ROW) -> DataFrame:
    """Number the contiguous slices of ``chunk_rows`` rows."""
    return df.withColumn("chunk_id", F.floor(F.col(row_col) / chunk_rows).cast("bigint"))


def spread(df: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """The rows dealt out over tasks of about ``rows_per_task``, for work on a row that costs far more than reading it.

    A scan deals out bytes, and a few megabytes of packed columns hold millions of short rows, which would go to one task.
    Small tables stay as they are. Counts the rows first; on files that is read from their footers.
    """
    parts = -(-df.count() // rows_per_task)
    if parts <= 1:
        return df
    check_names(df.columns, ("_deal",))
    return df.withColumn("_deal", F.monotonically_increasing_id()).repartition(parts, "_deal").drop("_deal")


def cells(df: DataFrame, columns: list[str] | None = None, row_col: str = ROW) -> DataFrame:
    """Long form ``(row, column, value)``; a narrow, map-side step."""
    columns = columns or data_columns(df, row_col)
    return df.select(col(row_col).alias("row"), _inline(columns))


def all_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)`` of every cell."""
    return df.select(_inline(columns))


def _inline(columns: list[str]) -> Column:
    pairs = [F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns]
    return F.inline(F.array(*pairs) if pairs else F.array().cast("array<struct<column:string,value:string>>"))


def top_rows(df: DataFrame, limit: int | None, by: list[str], order: list[str | Column]) -> DataFrame:
    """First ``limit`` rows of each group. Spark trims each task's share before the shuffle."""
    if limit is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


# Slices of the three-level carry: at most 2^15 rows meet in one task at the two lower levels,
# and the top level holds one row per 2^30 input rows.
SLICE_BITS = 15


def carry_forward(df: DataFrame, order: str, values: list[str], through: bool = True) -> DataFrame:
    """Last non-null of each of ``values`` over the whole order, as ``<value>_last``.

    ``order`` is a non-negative, unique BIGINT. No window ever spans the table: rows are scanned in slices,
    slices in super-slices, and only the totals of the slices travel between them.
    ``through=False`` looks at earlier rows only.
    """
    sliced = df.withColumn("_slice", F.shiftright(order, SLICE_BITS))
    tails = sliced.groupBy("_slice").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    )
    tails = tails.withColumn("_super", F.shiftright("_slice", SLICE_BITS))
    tops = tails.groupBy("_super").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_slice"))).alias(v) for v in values]
    )
    earlier = (Window.unboundedPreceding, -1)
    in_top = Window.orderBy("_super").rowsBetween(*earlier)
    in_super = Window.partitionBy("_super").orderBy("_slice").rowsBetween(*earlier)
    in_slice = (
        Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    )
    top_in = tops.select("_super", *[F.last(v, True).over(in_top).alias(f"_top_{v}") for v in values])
    slice_in = tails.join(top_in, "_super").select(
        "_slice", *[F.coalesce(F.last(v, True).over(in_super), F.col(f"_top_{v}")).alias(f"_in_{v}") for v in values]
    )
    return sliced.join(slice_in, "_slice").select(
        *df.columns,
        *[F.coalesce(F.last(v, True).over(in_slice), F.col(f"_in_{v}")).alias(f"{v}_last") for v in values],
    )
