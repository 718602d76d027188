"""Repair in tiers: rules, learned patterns, then fixes proposed from outside.

The first two tiers depend on the row and a few facts per column, so a pass is one scan without
a shuffle: each row carries its own change list, and only that list leaves it as the log.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CleanConfig
from ..functions.rules import FIX, chained_format_fix, fill_median, fill_mode, fill_unknown, format_fix
from ..functions.text import is_blank
from .anomalies import FINDING, format_test, missing_test, outlier_test, rare_test, type_test
from .counts import cell_counts
from .patterns import match_patterns
from .rows import HELPERS, ROW, all_cells, check_names, col, data_columns
from .schema import ColumnFacts

ACTION = (
    "struct<column:string,old_value:string,value:string,new_value:string,rule:string,confidence:double,"
    "reasoning:string,issue_type:string,details:string>"
)


@dataclass
class Repaired:
    """A repaired table whose rows carry their change lists in ``_changes``."""

    table: DataFrame
    columns: list[str]
    row_col: str = ROW
    external: DataFrame | None = None

    def _log(self, fixed: bool) -> DataFrame:
        """The changes with or without a fix.

        The list is filtered before it is taken apart: a bare list would be tested for entries below the explode, and for that
        every rule run a second time, outside of generated code.
        """
        wanted = F.filter("_changes", lambda x: x["rule"].isNotNull() if fixed else x["rule"].isNull())
        return self.table.select(F.col(self.row_col).alias("row"), F.explode(wanted).alias("c")).select("row", "c.*")

    @property
    def actions(self) -> DataFrame:
        out = action_rows(self._log(True))
        return out if self.external is None else out.unionByName(self.external)

    @property
    def unresolved(self) -> DataFrame:
        """Flagged cells that no rule could fix."""
        return self._log(False).select("row", "column", "value", "old_value", "issue_type", "details")

    @property
    def cleaned(self) -> DataFrame:
        wide = self.table.drop("_changes")
        return wide if self.external is None else apply_fixes(wide, self.external, self.row_col)


def action_rows(log: DataFrame) -> DataFrame:
    return log.select(
        "row", "column", "old_value", "new_value", "rule", "confidence", "reasoning", "issue_type",
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def merge_issues(*groups: DataFrame) -> DataFrame:
    """First issue per cell, in the order of the groups, for findings that arrive as tables."""
    ranked = [g.withColumn("_src", F.lit(i)) for i, g in enumerate(groups)]
    out = ranked[0]
    for g in ranked[1:]:
        out = out.unionByName(g)
    best = out.groupBy("row", "column").agg(
        F.min_by(
            F.struct("value", "anomaly_type", "severity", "details"), F.struct("_src", "anomaly_type")
        ).alias("i")
    )
    return best.select("row", "column", "i.*")


def rule_fix(
    column: Column, value: Column, issue_type: Column, facts: dict[str, ColumnFacts], config: CleanConfig
) -> Column:
    """Tier one: fill what is missing, else the first format rule that fires."""

    def lookup(pick) -> Column:
        known = {c: pick(f) for c, f in facts.items() if pick(f) is not None}
        if not known:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*[F.lit(p) for kv in known.items() for p in kv]), column)

    missing = is_blank(value) | (value == "None") | (issue_type == "missing")
    median = lookup(lambda f: f.median_text if f.is_number else None)
    mode = lookup(lambda f: f.mode)
    fill = F.coalesce(fill_median(column, median), fill_mode(column, mode), fill_unknown(column))
    if config.strict_nulls:
        fill = F.when(value.isNotNull() & is_blank(value), fill)
    dtype = lookup(lambda f: f.dtype) if config.dtype_gated else None
    rules = chained_format_fix if config.fixpoint else format_fix
    return F.when(missing, fill).otherwise(rules(value, column, dtype))


def repair(
    df: DataFrame,
    facts: dict[str, ColumnFacts],
    patterns: DataFrame | None = None,
    proposals: DataFrame | None = None,
    config: CleanConfig = CleanConfig(),
    row_col: str = ROW,
    original: dict[str, str] | None = None,
    original_facts: dict[str, ColumnFacts] | None = None,
    revisit: bool = False,
    domain: str = "generic",
    keep: Callable[[DataFrame], DataFrame] = lambda table: table,
) -> Repaired:
    """One repair pass over every flagged or blank cell.

    ``original`` names, per column, the column that still holds the first text: findings are then
    made on that text and with ``original_facts``, and only where it still stands (or, with
    ``config.replay``, everywhere). Blanks and ``revisit``'s type errors are looked for in the current
    text. ``keep`` may write the repaired table before fixes by join are looked up.
    """
    columns = [c for c in data_columns(df, row_col) if c in facts]
    check_names(df.columns, HELPERS)
    first = original_facts or facts

    def flag(c: str) -> Column:
        seen, f = col((original or {}).get(c, c)), first[c]
        tests = [t for t in (outlier_test(seen, f, config), rare_test(seen, f), format_test(seen, f)) if t is not None]
        if revisit and not config.replay:
            tests = [F.when(seen.eqNullSafe(col(c)), t) for t in tests]
        tests.append(missing_test(col(c), f))
        if revisit and f.is_number:
            tests.append(type_test(col(c), f))
        hit = F.coalesce(*tests)
        return F.when(hit.isNotNull(), F.struct(hit.alias("f"), col(c).alias("old_value")))

    flags = F.array(*[flag(c) for c in columns]) if columns else F.array().cast(
        f"array<struct<f:{FINDING},old_value:string>>"
    )

    def change(x: Column) -> Column:
        f, value = x["f"], x["f"]["value"]
        fix = rule_fix(f["column"], value, f["anomaly_type"], facts, config)
        return F.struct(f, x["old_value"].alias("old_value"), fix.cast(FIX).alias("fix"))

    # ``_flags`` is read twice on purpose: it keeps the tests in generated code and leaves only
    # the flagged cells to the per-element rules.
    marked = df.withColumn("_flags", flags)
    fixes = F.when(F.size("_flags") >= 0, F.transform(F.filter("_flags", lambda x: x.isNotNull()), change))
    changes = F.transform(
        "_fixes",
        lambda x: F.struct(
            x["f"]["column"].alias("column"), x["old_value"].alias("old_value"), x["f"]["value"].alias("value"),
            x["fix"]["new_value"].alias("new_value"), x["fix"]["rule"].alias("rule"),
            x["fix"]["confidence"].alias("confidence"), x["fix"]["reasoning"].alias("reasoning"),
            x["f"]["anomaly_type"].alias("issue_type"), x["f"]["details"].alias("details"),
        ),
    )
    fixed = marked.withColumn("_fixes", fixes).withColumn("_changes", changes.cast(f"array<{ACTION}>"))
    new = F.map_from_entries(
        F.transform(F.filter("_changes", lambda x: x["rule"].isNotNull()), lambda x: F.struct(x["column"], x["new_value"]))
    )
    with_new = fixed.withColumn("_new", new)
    table = with_new.select(
        *[
            F.coalesce(F.try_element_at(F.col("_new"), F.lit(c)), col(c)).alias(c) if c in columns else col(c)
            for c in df.columns
        ],
        "_changes",
    )
    out = Repaired(keep(table), columns, row_col)
    if patterns is None and proposals is None:
        return out
    out.external = _external(out.unresolved, patterns, proposals, columns, domain)
    return out


def _external(unresolved, patterns, proposals, columns, domain) -> DataFrame:
    """Fixes by join for the cells that are still open."""
    parts, open_cells = [], unresolved
    if patterns is not None:
        values = open_cells.select("column", F.coalesce("value", F.lit("None")).alias("value"))
        best = match_patterns(values, patterns, columns, domain)
        # a NULL value is matched as the text "None"
        hit = open_cells.withColumn("value", F.coalesce("value", F.lit("None"))).join(best, ["column", "value"])
        parts.append(
            hit.select(
                "row", "column", "old_value", "new_value",
                F.concat(F.lit("pattern:"), "column_pattern").alias("rule"), "confidence",
                F.format_string(
                    "Applied learned pattern #%d (success rate: %.0f%%)", "pattern_id", F.col("confidence") * 100
                ).alias("reasoning"),
                "issue_type", F.create_map().cast("map<string,string>").alias("metadata"),
            )
        )
        open_cells = open_cells.join(parts[0].select("row", "column"), ["row", "column"], "left_anti")
    if proposals is not None:
        parts.append(proposed_actions(open_cells, proposals))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def proposed_actions(open_cells: DataFrame, proposals: DataFrame) -> DataFrame:
    """Turn proposals ``(row, column, corrected_value, confidence, reasoning, model)`` into actions on open cells."""
    one = proposals.groupBy("row", "column").agg(
        F.max_by(
            F.struct("corrected_value", "confidence", "reasoning", "model"), F.struct("confidence", "corrected_value")
        ).alias("p")
    )
    return open_cells.join(one, ["row", "column"]).select(
        "row", "column", "old_value", F.col("p.corrected_value").alias("new_value"),
        F.concat(F.lit("llm:"), "p.model").alias("rule"), F.col("p.confidence").cast("double").alias("confidence"),
        F.col("p.reasoning").alias("reasoning"), "issue_type",
        F.create_map(F.lit("model"), F.col("p.model"), F.lit("output"), F.to_json("p")).alias("metadata"),
    )


def external_log(actions: DataFrame) -> DataFrame:
    """The log of outside fixes: what was proposed and by whom."""
    return actions.where(F.col("rule").startswith("llm:")).select(
        "row", "column", F.col("metadata")["model"].alias("model"), F.col("metadata")["output"].alias("structured_output"),
        "old_value", "new_value", "confidence", "reasoning", "issue_type",
    )


def apply_fixes(df: DataFrame, fixes: DataFrame, row_col: str = ROW) -> DataFrame:
    """Write ``(row, column, new_value)`` into the table; a NULL new value is written as NULL.

    Of several fixes for one cell the last row of ``fixes`` counts. Fixes are gathered per row and joined once. Rows without a fix are not
    touched, and a short fix list is broadcast by the optimizer from its measured size.
    """
    cols = data_columns(df, row_col)
    placed = fixes.where(F.col("column").isin(cols)).select("row", "column", "new_value", F.monotonically_increasing_id().alias("at"))
    per_cell = placed.groupBy("row", "column").agg(F.max_by(F.struct("new_value"), "at").alias("last"))
    per_row = (
        per_cell.select("row", "column", "last.new_value")
        .groupBy(F.col("row").alias(row_col))
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "new_value"))).alias("_new"))
    )
    joined = df.join(per_row, row_col, "left")

    def cell(c: str) -> Column:
        has = F.coalesce(F.map_contains_key("_new", F.lit(c)), F.lit(False))
        return F.when(has, F.try_element_at(F.col("_new"), F.lit(c))).otherwise(col(c)).alias(c)

    return joined.select(*[cell(c) if c in cols else col(c) for c in df.columns])


def normalize_all(df: DataFrame, columns: list[str] | None = None, row_col: str = ROW, chained: bool = True) -> DataFrame:
    """Format rules on every cell, flagged or not. Stateless, so it also runs on a stream."""
    rules = chained_format_fix if chained else format_fix
    chosen = set(columns or data_columns(df, row_col))
    return df.select(
        *[
            F.coalesce(rules(col(c), F.lit(c))["new_value"], col(c)).alias(c) if c in chosen else col(c)
            for c in df.columns
        ]
    )


def repair_context(
    issues: DataFrame, df: DataFrame, facts: dict[str, ColumnFacts], samples: int = 15, head: int | None = None, row_col: str = ROW,
    counts: DataFrame | None = None,
) -> DataFrame:
    """What a reviewer or model needs per open issue: type, samples of the column, rest of the row.

    Samples are the ``samples`` distinct values of a column with the smallest hashes, out of the whole table's value counts (given or
    made here): a bottom-k, cut in every task before the columns meet. With ``head`` they are the first values by spelling
    in the first ``head`` rows.
    """
    cols = data_columns(df, row_col)
    if head is None:
        values, order = cell_counts(df, cols, row_col) if counts is None else counts, F.md5("value")
    else:
        values, order = all_cells(df.where(col(row_col) < head), cols).select("column", "value").distinct(), F.col("value")
    filled = values.where("value is not null and value != ''").withColumn("_order", order)
    picked = filled.withColumn("_rank", F.row_number().over(Window.partitionBy("column").orderBy("_order", "value"))).where(F.col("_rank") <= samples)
    # at most ``samples`` values per column
    texts = picked.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    spark = df.sparkSession
    known = spark.createDataFrame(
        [(c, f.dtype, f.format_pattern) for c, f in facts.items()],
        "column string, dtype string, format_pattern string",
    )
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[col(c) for c in cols]))
    rows = df.select(F.col(row_col).alias("row"), pairs.alias("_pairs"))
    return (
        issues.join(rows, "row")
        .join(F.broadcast(texts), "column", "left")
        .join(F.broadcast(known), "column", "left")
        .select(
            "row", "column", "value",
            F.coalesce("dtype", F.lit("unknown")).alias("dtype"),
            F.coalesce("format_pattern", F.lit("none")).alias("format_pattern"),
            "sample_values",
            F.to_json(F.map_filter("_pairs", lambda k, _: k != F.col("column")), {"ignoreNullFields": "false"}).alias("other_columns"),
        )
    )
