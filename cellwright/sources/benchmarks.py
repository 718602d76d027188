"""Benchmark pairs: ``<name>_dirty.csv`` beside ``<name>_ground_truth.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import CleanConfig
from ..operators.evaluate import evaluate
from ..operators.rows import ROW
from ..plans.clean import clean
from .readers import load_file
from .writers import save_evaluation, save_result

TRUTH_SCHEMA = "row bigint, column string, expected_value string"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH_SCHEMA).option("multiLine", True).json(path)


def find_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``(dataset, dirty_path, truth_path)`` in name order; files without a partner are left out.

    Only the listing is read, through Spark, so any file system it knows will do.
    """

    def listed(suffix: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
        return files.select(F.regexp_extract("path", rf"([^/]*)\Q{suffix}\E$", 1).alias("dataset"), F.col("path").alias(name))

    dirty, truth = listed("_dirty.csv", "dirty_path"), listed("_ground_truth.json", "truth_path")
    return dirty.join(truth, "dataset").orderBy("dataset")


def run_benchmarks(
    spark: SparkSession, folder: str, output: str | None = None, config: CleanConfig = CleanConfig()
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Clean and evaluate every pair; ``(measures per dataset, [(dataset, error)])``.

    The loop is over datasets, each of which is a distributed run of its own with its own columns.
    """
    applied, truths, reports, errors = [], [], [], []
    for r in find_pairs(spark, folder).collect():
        name = r["dataset"]
        try:
            result = clean(load_file(spark, r["dirty_path"], row_index=True), config=config, row_col=ROW, dataset_id=name)
            if output:
                save_result(result.cleaned, result.audit, result.report, f"{output}/{name}_cleaned.csv")
            applied.append(result.actions.select(F.lit(name).alias("dataset"), "row", "column", "new_value"))
            truths.append(read_truth(spark, r["truth_path"]).withColumn("dataset", F.lit(name)))
            reports.append(result.report)
        except Exception as e:  # one broken dataset must not stop the others
            errors.append((name, str(e)))
    if not applied:
        return spark.createDataFrame([], "dataset string"), errors

    def together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    metrics = evaluate(together(applied), together(truths), ["dataset"])
    if output:
        save_evaluation(metrics, together(reports), f"{output}/evaluation")
    return metrics, errors
