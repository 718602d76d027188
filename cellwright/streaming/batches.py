"""Cleaning on streams: per micro-batch with its own facts, or cell by cell without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CleanConfig
from ..operators.counts import cell_counts
from ..operators.repair import normalize_all
from ..operators.rows import ROW, check_names, with_row_index
from ..operators.schema import schema_report, type_counts
from ..plans.clean import clean

FILE, PLACE = "_file", "_place"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files in which each row knows its file and its place there, so that batches keep the order of rows."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE))


def clean_batches(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    config: CleanConfig = CleanConfig(),
    order_by: list[str] | None = None,
    after_batch: Callable[[int, object], None] | None = None,
    row_col: str | None = None,
) -> StreamingQuery:
    """Clean each micro-batch on its own: its types, medians and findings are the batch's.

    Everything of batch ``n`` is written under ``<output>/<kind>/batch_id=n`` and overwritten as a whole,
    so a replayed batch leaves one copy. Rows are those of ``row_col`` where the stream has numbers, else they are numbered from 0 in
    every batch: in the order of ``order_by``, of the files (``file_stream``), or of arrival.

    The value counts of each batch are written too. They add up (``merged_counts``), so what is known of a column's values over all
    batches costs each batch its own distinct values and no second reading.
    """
    order = order_by or ([FILE, PLACE] if {FILE, PLACE} <= set(stream.columns) else None)

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        if not row_col:
            check_names(batch.columns)
            batch = with_row_index(batch, order)
        result = clean(batch.drop(FILE, PLACE), config=config, row_col=row_col or ROW, dataset_id=f"batch-{batch_id}")
        parts = {
            "cleaned": result.cleaned, "actions": result.actions, "audit": result.audit, "report": result.report,
            "counts": cell_counts(result.raw, result.columns),
        }
        for kind, df in parts.items():
            df.write.mode("overwrite").parquet(f"{output}/{kind}/batch_id={batch_id}")
        if after_batch:
            after_batch(batch_id, result)

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def merged_counts(spark: SparkSession, output: str) -> DataFrame:
    """``(column, value, n)`` over all batches written so far: the state that the stream carries, as good as counts of one table."""
    return read_batches(spark, output, "counts").groupBy("column", "value").agg(F.sum("n").alias("n"))


def merged_schema(spark: SparkSession, output: str) -> DataFrame:
    """Types of the columns over all batches, where each batch's report holds its own."""
    return schema_report(type_counts(merged_counts(spark, output)))


def normalize_stream(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Format rules on every cell of a stream: stateless, in append mode, with any sink."""
    return normalize_all(stream, columns)


def read_batches(spark: SparkSession, output: str, kind: str = "cleaned") -> DataFrame:
    """All batches written so far, with their ``batch_id``."""
    return spark.read.option("mergeSchema", True).parquet(f"{output}/{kind}").withColumn("batch_id", F.col("batch_id").cast("bigint"))
