"""Reads over results: pages, previews, filters, search and cell differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .rows import ROW, col, data_columns

def page(df: DataFrame, number: int = 1, size: int = 100, row_col: str = ROW) -> DataFrame:
    """One page of rows. A range on the row number, so it is pushed down to the scan."""
    number, size = max(1, number), max(1, size)
    start = (number - 1) * size
    return df.where(F.col(row_col).between(start, start + size - 1)).orderBy(row_col)


def page_info(df: DataFrame, number: int = 1, size: int = 100) -> DataFrame:
    number, size = max(1, number), max(1, size)
    return df.agg(F.count("*").alias("total_rows")).select(
        F.lit(number).alias("page"), F.lit(size).alias("page_size"), "total_rows",
        F.ceil(F.col("total_rows") / size).cast("bigint").alias("total_pages"),
    )


def preview(df: DataFrame, limit: int = 100, row_col: str = ROW) -> tuple[DataFrame, DataFrame]:
    """The first rows, and ``(row_count, column_names, truncated)``."""
    cols = data_columns(df, row_col)
    names = F.when(F.count("*") > 0, F.array(*[F.lit(c) for c in cols])).otherwise(F.array().cast("array<string>"))
    info = df.agg(
        F.count("*").alias("row_count"), names.alias("column_names"), (F.count("*") > limit).alias("truncated")
    )
    return df.where(F.col(row_col) < limit).orderBy(row_col), info


def filter_findings(findings: DataFrame, severity: str | None = None, column: str | None = None) -> DataFrame:
    if severity:
        findings = findings.where(F.lower("severity") == severity.lower())
    if column:
        findings = findings.where(F.lower("column") == column.lower())
    return findings


def filter_actions(actions: DataFrame, method: str | None = None) -> DataFrame:
    return actions.where(F.col("rule").startswith(method)) if method else actions


def listing(log: DataFrame, order_by: list[str], number: int = 1, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """One page of a log in a given order, and ``page_info`` with the count of the whole log.

    The page is a top-k of the rows up to its end, never a full sort.
    """
    number, size = max(1, number), max(1, size)
    return log.orderBy(*order_by).offset((number - 1) * size).limit(size), page_info(log, number, size)


def search_sort(
    df: DataFrame,
    query: str = "",
    sort_key: str | None = None,
    descending: bool = False,
    number: int = 1,
    size: int = 12,
    row_col: str = ROW,
) -> DataFrame:
    """Rows with the query in any column, one sorted page of them.

    Sorting is a top-k of the rows up to the page's end, never a full sort.
    """
    cols = data_columns(df, row_col)

    def shown(c: str):
        text = col(c).cast("string")
        return F.lower(F.when(text.isNull() | (text == ""), "—").otherwise(text))

    wanted = query.strip().lower()
    if wanted:
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.contains(shown(c), F.lit(wanted))
        df = df.where(hit)
    order = [F.col(row_col).asc()]
    if sort_key:
        order.insert(0, shown(sort_key).desc() if descending else shown(sort_key).asc())
    return df.orderBy(*order).limit(number * size).offset((number - 1) * size)


def table_diff(raw: DataFrame, cleaned: DataFrame, row_col: str = ROW) -> DataFrame:
    """Changed cells between two versions of a table.

    Rows are joined once in wide form and compared in place; only cells that differ become rows.
    """
    left, right = data_columns(raw, row_col), data_columns(cleaned, row_col)
    both = raw.select(F.col(row_col).alias("row"), *[col(c).alias(f"_a_{c}") for c in left]).join(
        cleaned.select(F.col(row_col).alias("row"), *[col(c).alias(f"_b_{c}") for c in right]), "row", "full_outer"
    )

    def pair(c: str):
        none = F.lit(None).cast("string")
        a = col(f"_a_{c}").cast("string") if c in left else none
        b = col(f"_b_{c}").cast("string") if c in right else none
        return F.when(~a.eqNullSafe(b), F.struct(F.lit(c).alias("column"), a.alias("old_value"), b.alias("new_value")))

    union = left + [c for c in right if c not in left]
    return (
        both.select("row", F.explode(F.array(*[pair(c) for c in union])).alias("d"))
        .where(F.col("d").isNotNull())
        .select("row", "d.*")
    )
