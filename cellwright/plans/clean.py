"""The whole run: index, rebuild, infer, profile, flag, repair until valid, score."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from ..config import CleanConfig
from ..functions.text import as_text
from ..operators import scoring
from ..operators.anomalies import detect
from ..operators.counts import cell_counts, counts_after, numeric_summary
from ..operators.profile import profile, quality_score
from ..operators.reconstruct import RECORD_CONFIDENCE, RecordSpec, reconstruct
from ..operators.repair import external_log, repair
from ..operators.rows import HELPERS, ROW, check_names, col, data_columns, quoted, with_chunk_id, with_row_index
from ..operators.schema import ColumnFacts, collect_facts, schema_issues, schema_report, type_counts, with_rare_counts
from ..operators.validate import validate
from ..session import cut

STAGE_RUN = "stage string, run bigint, status string, duration_ms double, confidence_score double, summary map<string,string>"


@dataclass
class CleaningResult:
    raw: DataFrame
    cleaned: DataFrame
    actions: DataFrame
    anomalies: DataFrame
    schema: DataFrame
    schema_issues: DataFrame
    profile: DataFrame
    validation_errors: DataFrame
    validation_passed: bool
    iterations: int
    reconstruction: DataFrame
    report: DataFrame
    stages: DataFrame
    facts: dict[str, ColumnFacts]
    config: CleanConfig
    dataset_id: str
    columns: list[str] = field(default_factory=list)

    @property
    def audit(self) -> DataFrame:
        return scoring.audit_log(self.actions)

    @property
    def low_confidence(self) -> DataFrame:
        return scoring.low_confidence(self.actions, self.config.confidence_threshold)

    @property
    def review_queue(self) -> DataFrame:
        return scoring.review_queue(self.actions, self.config.confidence_threshold)

    @property
    def external_log(self) -> DataFrame:
        return external_log(self.actions)

    @property
    def pipeline_stages(self) -> DataFrame:
        return scoring.stage_rollup(self.stages)

    @property
    def chunk_results(self) -> DataFrame:
        size = self.config.chunk_rows
        return scoring.chunk_summary(
            with_chunk_id(self.raw, size), self.anomalies, self.actions, size, self.config.confidence_threshold
        )


class _Stages:
    """Durations and short summaries of the stages of one run, kept on the driver."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.mark = time.perf_counter()

    def done(self, name: str, confidence: float | None = None, **summary) -> None:
        now = time.perf_counter()
        run = sum(r[0] == name for r in self.rows)
        self.rows.append(
            (name, run, "success", round((now - self.mark) * 1000, 2), confidence, {k: str(v) for k, v in summary.items()})
        )
        self.mark = now


def clean(
    df: DataFrame,
    spec: RecordSpec | None = None,
    patterns: DataFrame | None = None,
    proposals: DataFrame | None = None,
    config: CleanConfig = CleanConfig(),
    row_col: str | None = None,
    order_by: list[str] | None = None,
    dataset_id: str | None = None,
) -> CleaningResult:
    """Clean a table.

    ``row_col`` names a dense row number the table already has; otherwise rows are numbered in the
    order of ``order_by``. Per table and pass only column facts and a verdict reach the driver: one
    row per column, and up to ``config.rare_max_values`` rare values each.
    """
    start, stages = time.time(), _Stages()
    dataset_id = dataset_id or uuid4().hex[:8]
    check_names(df.columns, (ROW, *HELPERS) if row_col != ROW else HELPERS)
    if row_col:
        text = as_text(df, [row_col]).withColumnRenamed(row_col, ROW).withColumn(ROW, F.col(ROW).cast("bigint"))
    else:
        text = as_text(with_row_index(df, order_by), [ROW])
    stages.done("ingest", columns=len(text.columns) - 1)

    given = data_columns(text)
    text, reconstruction = reconstruct(text, spec)
    stages.done("structure_reconstruction", **({"skipped": True} if spec is None else reconstruction.first().asDict()))
    # a rebuilt table carries the confidence of its records beside the columns of the specification
    columns = [c for c in data_columns(text) if c in given or c != RECORD_CONFIDENCE]
    raw = text.select(ROW, *map(quoted, columns))

    counts = cut(cell_counts(raw, columns), "counts")
    types, summary = cut(type_counts(counts), "types"), cut(numeric_summary(counts), "summary")
    facts = collect_facts(counts, config, types=types, summary=summary)
    facts = {c: facts.get(c, ColumnFacts(c, "empty")) for c in columns}
    stages.done("schema_analysis", columns_inferred=len(columns))

    profiles = cut(profile(raw, columns, counts, summary=summary), "profile")
    before = quality_score(profiles).first()["quality_score"]
    stages.done("data_profiling", profile_columns=len(columns), data_quality_score=before)

    marked = raw
    if config.rare_max_values is None:
        marked, facts = with_rare_counts(raw, facts, counts, types)
    # read twice: counted here and handed to the caller
    anomalies = cut(detect(marked, facts, config), "anomalies")
    found = anomalies.count()
    stages.done("anomaly_detection", anomaly_count=found)

    # each pass carries the first text along, because findings are made on it
    first = {c: f"_first_{i}" for i, c in enumerate(columns)}
    check_names(columns, tuple(first.values()))
    current = marked.select("*", *[col(c).alias(first[c]) for c in columns])
    logs: list[DataFrame] = []
    changed: set[str] = set()
    now, pass_facts, passed, errors, done = counts, facts, False, None, 0
    # What a pass does to a column follows from the column's cells, its first findings and its facts. From the second pass on, which
    # adds the type errors, a column without a change is at its fixed point: only those that moved are tested again.
    while done < config.max_passes:
        fixed = repair(
            current, pass_facts, patterns, proposals, config, original=first, original_facts=facts, revisit=done > 0,
            keep=lambda t: cut(t, "repaired"),
        )
        if fixed.external is not None:
            fixed.external = cut(fixed.external, "external")
        actions = fixed.actions
        logs.append(actions)
        current = fixed.cleaned if fixed.external is None else cut(fixed.cleaned, "cleaned")
        done += 1
        per_column = {r["column"]: r["n"] for r in actions.groupBy("column").agg(F.count("*").alias("n")).collect()}
        changed |= set(per_column)
        stages.done("cleaning", iteration_count=done, fix_count=sum(per_column.values()))
        now = cut(counts_after(now, actions), "counts")
        passed, errors = validate(
            current.select(ROW, *map(quoted, columns)), counts, now, facts, sorted(changed), config
        )
        stages.done("validation", validation_passed=passed)
        if passed or (not config.replay and not per_column):
            break
        if done < config.max_passes:
            moved = columns if done == 1 or config.replay else [c for c in columns if c in per_column]
            pass_facts = collect_facts(now.where(F.col("column").isin(moved)), config, with_rare=False)
            pass_facts = {c: _with_type(pass_facts.get(c, ColumnFacts(c, "empty")), facts[c]) for c in moved}

    actions = reduce(DataFrame.unionByName, logs)
    report = cut(
        scoring.quality_report(
            actions, dataset_id=dataset_id, total_rows=facts[columns[0]].total if columns else 0,
            total_columns=len(columns), issues_detected=found, score_before=before, iterations=done,
            validation_passed=passed, threshold=config.confidence_threshold, duration_seconds=time.time() - start,
            chunks=-(-max(1, facts[columns[0]].total if columns else 0) // config.chunk_rows),
        ),
        "report",
    )
    overall = report.first()["overall_confidence"]
    stages.done("confidence_scoring", overall, overall_confidence=overall)
    return CleaningResult(
        raw, current.select(ROW, *map(quoted, columns)), actions, anomalies, schema_report(types), schema_issues(types), profiles,
        errors, passed, done, reconstruction, report, df.sparkSession.createDataFrame(stages.rows, STAGE_RUN),
        facts, config, dataset_id, columns,
    )


def _with_type(now: ColumnFacts, first: ColumnFacts) -> ColumnFacts:
    """Types and formats stay as inferred from the raw table."""
    now.dtype, now.format_pattern = first.dtype, first.format_pattern
    return now
