"""Writers: results as directories of part files, with sidecars beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def save_csv(df: DataFrame, path: str) -> str:
    """CSV that reads back as it was: quotes doubled, white space at the ends of cells kept."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def save_json(df: DataFrame, path: str) -> str:
    """JSON lines, NULL fields kept; values JSON has no type for are written as text."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def sidecar(path: str, kind: str) -> str:
    stem, dot, _ = path.rstrip("/").rpartition(".")
    return f"{stem if dot else path.rstrip('/')}.{kind}.json"


def save_result(
    table: DataFrame, audit: DataFrame, report: DataFrame, path: str, output_format: str = "csv", row_col: str = "_row"
) -> str:
    """The cleaned table, with its audit trail and report in sidecars."""
    (save_json if output_format == "json" else save_csv)(table.drop(row_col), path)
    save_json(audit, sidecar(path, "audit"))
    save_json(report, sidecar(path, "report"))
    return path


def append_audit(audit: DataFrame, path: str) -> None:
    """Append-only audit log; ``.parquet`` paths get Parquet, others JSON lines."""
    writer = audit.write.mode("append")
    writer.parquet(path) if path.rstrip("/").endswith(".parquet") else writer.json(path)


def export_audit(audit: DataFrame, path: str) -> None:
    save_json(audit, path)


def save_evaluation(metrics: DataFrame, reports: DataFrame, path: str) -> None:
    """One JSON row ``{dataset, pipeline_report, evaluation_metrics}`` per dataset, partitioned by dataset.

    Both inputs hold one row per dataset.
    """
    m = metrics.select("dataset", F.struct(*[c for c in metrics.columns if c != "dataset"]).alias("evaluation_metrics"))
    r = reports.select(F.col("dataset_id").alias("dataset"), F.struct(*reports.columns).alias("pipeline_report"))
    r.join(m, "dataset").write.mode("overwrite").partitionBy("dataset").json(path)
