"""Readers: every source becomes a table of text columns."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import as_text
from ..operators.rows import ROW, col, with_file_row_index
from ..session import cut
from . import delimited
from .delimited import FILE

EXTENSIONS = (".csv", ".tsv", ".parquet")  # fixed values


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def load_file(
    spark: SparkSession, path: str, *, sep: str | None = None, encoding: str | None = None, multi_line: bool | None = None,
    row_index: bool = False, **options
) -> DataFrame:
    """CSV, TSV or Parquet as text. Blank cells of a text file are ``""``, never NULL.

    Without ``encoding`` each file is UTF-8 if all its bytes are, else Latin-1. Quoted cells may hold line feeds: one scan tells
    whether any does, and then records are put together across lines and file ranges, in many tasks. ``multi_line=False`` takes
    every line for a record. With an ``encoding``, ``multi_line=True`` reads a file in one task. ``row_index`` adds the row
    number in file order, as ``_row``.
    """
    ext = extension(path)
    if ext not in EXTENSIONS:
        raise ValueError(f"Unsupported file extension '{ext}'. Supported: {sorted(EXTENSIONS)}")
    try:
        if ext == ".parquet":
            df = spark.read.options(**options).parquet(path)
            return as_text(with_file_row_index(df), [ROW]) if row_index else as_text(df)
        return _load_delimited(spark, path, sep or ("\t" if ext == ".tsv" else ","), encoding, multi_line, row_index, options)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Data file not found: {path}") from e
        raise


def _load_delimited(spark, path, sep, encoding, multi_line, row_index, options) -> DataFrame:
    def read(charset: str) -> DataFrame:
        return (
            spark.read.option("header", True).option("inferSchema", False).option("multiLine", bool(multi_line))
            .option("quote", '"').option("escape", '"').option("sep", sep).option("encoding", charset)
            .options(**options).csv(path)
        )

    if encoding:
        df = read(encoding)
        columns = [F.coalesce(col(c), F.lit("")).alias(c) for c in df.columns]
        return with_file_row_index(df).select(ROW, *columns) if row_index else df.select(*columns)
    # one scan decides: the encoding of each file, and whether a quoted cell goes over a line's end
    lines = delimited.text_lines(spark, path)
    facts = cut(delimited.file_facts(lines, sep), "files")
    latin_files, spanning = facts.agg(F.count_if(~F.col("utf8")), F.count_if("spans")).first()
    if spanning and multi_line is not False:
        return delimited.read_records(lines, facts, sep, row_index, options)
    # Latin-1 keeps every byte, so each file's bytes can still be read as UTF-8 where all of them are valid
    df = read("ISO-8859-1")
    names = [_header(c) for c in df.columns]
    utf8 = {c: F.encode(F.coalesce(col(c), F.lit("")), "ISO-8859-1").cast("string") for c in df.columns}
    placed = df.select("*", F.col("_metadata.file_path").alias(FILE))
    number = [ROW] if row_index else []
    if row_index:
        placed = with_file_row_index(placed)
    if not latin_files:
        return placed.select(*number, *[utf8[c].alias(n) for c, n in zip(df.columns, names, strict=True)])
    # one row per file that isn't UTF-8
    known = placed.join(facts.where("not utf8").select(F.col(FILE).alias("_latin_file")), F.col(FILE) == F.col("_latin_file"), "left")
    latin = F.col("_latin_file").isNotNull()
    return known.select(
        *number,
        *[F.when(latin, F.coalesce(col(c), F.lit(""))).otherwise(utf8[c]).alias(n) for c, n in zip(df.columns, names, strict=True)],
    )


def _header(name: str) -> str:
    try:
        return name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return name


def load_sql(
    spark: SparkSession,
    query: str,
    url: str | None = None,
    *,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    **options,
) -> DataFrame:
    """A query over the catalog, or over JDBC when a ``url`` is given; read in parallel ranges if bounds are."""
    if url is None:
        return as_text(spark.sql(query))
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if partition_column:
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
            .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8)
        )
    return as_text(reader.load())


def load(
    spark: SparkSession, source: str, *, sql_query: str | None = None, connection_string: str | None = None, **options
) -> DataFrame:
    """A query when both query and connection are given, else a file."""
    if sql_query and connection_string:
        return load_sql(spark, sql_query, connection_string, **options)
    return load_file(spark, source, **options)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes NULL."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if kinds[c] in ("double", "float") else col(c) for c in df.columns]
    )


def from_records(spark: SparkSession, records: list[dict], columns: list[str] | None = None) -> DataFrame:
    """A table from a short list of dicts; all values as text, missing keys NULL."""
    columns = columns or (list(records[0]) if records else [])
    rows = [tuple(None if r.get(c) is None else str(r.get(c)) for c in columns) for r in records]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
