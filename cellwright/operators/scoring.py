"""Confidence tiers, audit trail, review queue and reports over the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .repair import apply_fixes
from .rows import ROW, with_row_index

# Tier by rule prefix.
TIERS = {"rule:": "tier1_deterministic", "pattern:": "tier2_pattern", "llm:": "tier3_llm"}


def tier(rule: Column) -> Column:
    out = F.lit("unknown")
    for prefix, name in TIERS.items():
        out = F.when(rule.startswith(prefix), name).otherwise(out)
    return out


def audit_log(actions: DataFrame) -> DataFrame:
    return actions.select(
        F.current_timestamp().alias("timestamp"), F.col("row").alias("row_index"), F.col("column").alias("column_name"),
        F.col("old_value").alias("original_value"), "new_value", "issue_type", F.col("rule").alias("fix_method"),
        "confidence", "reasoning", F.lit("cleaner").alias("agent_name"), tier(F.col("rule")).alias("tier"),
        F.lit("").alias("trace_id"),
    )


def low_confidence(actions: DataFrame, threshold: float = 0.7) -> DataFrame:
    return actions.where(F.col("confidence") < threshold)


def confidence_summary(actions: DataFrame) -> DataFrame:
    """Overall confidence and the fixes per tier, zero-filled; one row."""
    t = tier(F.col("rule"))
    return actions.agg(
        F.count("*").alias("fixes"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("overall_confidence"),
        *[F.count_if(t == name).alias(name) for name in TIERS.values()],
        F.count_if(t == "unknown").alias("unknown"),
    )


def review_queue(actions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Numbered review items of the low-confidence fixes, in row and column order."""
    low = low_confidence(actions, threshold).select(
        "row", "column", "old_value", "new_value", "confidence", "reasoning", "issue_type", "rule"
    )
    return with_row_index(low, ["row", "column"], "_item").select(
        F.concat(F.lit("review-"), F.col("_item").cast("string")).alias("id"), F.lit("pending").alias("status"),
        "row", "column", "old_value", F.col("new_value").alias("suggested_value"), "confidence", "reasoning", "issue_type",
        F.col("rule").alias("fix_method"),
    )


def apply_review(
    cleaned: DataFrame, queue: DataFrame, decisions: DataFrame, row_col: str = ROW
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Carry out ``(id, action, new_value)`` decisions; returns ``(cleaned, queue, audit rows)``.

    ``accept`` keeps the suggestion, ``reject`` puts the old value back, ``edit`` writes a new one
    and fails if it brings none. Of several decisions on one item the last counts: the one with the highest ``order`` if
    the table has that column, else the last row. Of several items on one cell the last item's decision is written.
    """
    order = F.col("order") if "order" in decisions.columns else F.monotonically_increasing_id()
    placed = decisions.select("id", F.struct("action", "new_value").alias("d"), order.alias("o"))
    decisions = placed.groupBy("id").agg(F.max_by("d", "o").alias("d"))
    decisions = decisions.select("id", "d.action", "d.new_value")
    action = F.col("action")
    value = (
        F.when(action == "accept", F.col("suggested_value"))
        .when(action == "reject", F.col("old_value"))
        .when(F.col("edited").isNull(), F.raise_error(F.lit("new_value is required for edit action")).cast("string"))
        .otherwise(F.col("edited"))
    )
    status = F.when(action == "accept", "accepted").when(action == "reject", "rejected").when(action.isNotNull(), "edited")
    wanted = decisions.select("id", "action", F.col("new_value").alias("edited"))
    reviewed = queue.join(wanted, "id", "left").select(
        *queue.columns, "action",
        F.when(action.isNotNull(), value).alias("reviewed_value"),
        F.when(action.isNotNull(), F.current_timestamp()).alias("reviewed_at"),
        status.alias("_status"),
    )
    done = reviewed.where(action.isNotNull())
    item = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint"), F.lit(-1))
    last = done.groupBy("row", "column").agg(F.max_by(F.struct("action", "reviewed_value"), F.struct(item, "id")).alias("d"))
    fixes = last.where("d.action != 'accept'").select("row", "column", F.col("d.reviewed_value").alias("new_value"))
    out_queue = reviewed.withColumn("status", F.coalesce("_status", "status")).drop("_status", "action")
    audit = done.select(
        F.current_timestamp().alias("timestamp"), F.col("row").alias("row_index"), F.col("column").alias("column_name"),
        F.col("old_value").alias("original_value"), F.col("reviewed_value").alias("new_value"), "issue_type",
        F.concat(F.lit("review:"), action).alias("fix_method"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit("Reviewer decided: "), action).alias("reasoning"),
        F.lit("human_review").alias("agent_name"), F.lit("human_review").alias("tier"), F.lit("").alias("trace_id"),
    )
    return apply_fixes(cleaned, fixes, row_col), out_queue, audit


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row: all fixes, fixes per issue type (NULL: ``unknown``) and mean confidence."""
    per = audit.groupBy(F.coalesce("issue_type", F.lit("unknown")).alias("issue_type")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_fixes"),
        # one entry per issue type
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("issue_type", "n")))).alias("by_issue_type"),
        F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)).alias("avg_confidence"),
    )


def quality_report(
    actions: DataFrame,
    *,
    dataset_id: str,
    total_rows: int,
    total_columns: int,
    issues_detected: int,
    score_before: float,
    iterations: int,
    validation_passed: bool,
    threshold: float = 0.7,
    duration_seconds: float = 0.0,
    chunks: int = 1,
) -> DataFrame:
    """The one-row report; the change log is aggregated once, by issue type first."""
    per = actions.groupBy(F.coalesce("issue_type", F.lit("unknown")).alias("issue_type")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("c"), F.count_if(F.col("confidence") < threshold).alias("low")
    )
    fixed = F.coalesce(F.sum("n"), F.lit(0))
    return per.agg(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(total_rows).cast("bigint").alias("total_rows"),
        F.lit(total_columns).alias("total_columns"),
        F.lit(issues_detected).cast("bigint").alias("issues_detected"),
        fixed.alias("issues_fixed"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("issues_skipped"),
        F.round(F.coalesce(F.sum("c") / F.sum("n"), F.lit(0.0)), 4).alias("overall_confidence"),
        F.lit(score_before).alias("data_quality_score_before"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("issue_type", "n")))).alias("fix_breakdown"),
        F.lit(iterations).alias("iterations"),
        F.lit(validation_passed).alias("validation_passed"),
        fixed.alias("total_fixes"),
        F.lit(round(duration_seconds, 2)).alias("duration_seconds"),
        F.lit(chunks).alias("chunks_processed"),
    )


def stage_rollup(runs: DataFrame) -> DataFrame:
    """Per stage: total duration, runs, mean known confidence, status and the last run's summary.

    ``runs`` is ``(stage, run, status, duration_ms, confidence_score, summary)``.
    """
    return runs.groupBy("stage").agg(
        F.when(F.bool_and(F.col("status") == "success"), "success").otherwise("partial").alias("status"),
        F.round(F.sum("duration_ms"), 2).alias("duration_ms"),
        F.count("*").alias("chunk_runs"),
        F.round(F.avg("confidence_score"), 4).alias("confidence_score"),
        F.max_by("summary", "run").alias("summary"),
    )


def chunk_summary(chunked: DataFrame, findings: DataFrame, actions: DataFrame, chunk_rows: int = 50_000, threshold: float = 0.7) -> DataFrame:
    """Rows, findings, fixes and review items per chunk of rows; ``chunked`` carries ``chunk_id``."""
    chunk = F.floor(F.col("row") / chunk_rows).cast("bigint").alias("chunk_id")
    zero = F.lit(0).cast("bigint")
    parts = [
        chunked.groupBy("chunk_id").agg(F.count("*").alias("rows")).select("chunk_id", "rows", zero.alias("findings"), zero.alias("fixes"), zero.alias("reviews")),
        findings.groupBy(chunk).agg(F.count("*").alias("n")).select("chunk_id", zero.alias("rows"), F.col("n").alias("findings"), zero.alias("fixes"), zero.alias("reviews")),
        actions.groupBy(chunk).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < threshold).alias("low"))
        .select("chunk_id", zero.alias("rows"), zero.alias("findings"), F.col("n").alias("fixes"), F.col("low").alias("reviews")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("chunk_id").agg(*[F.sum(c).alias(c) for c in ("rows", "findings", "fixes", "reviews")])
