"""Every registered query with its SQL counterpart.

Queries read the given tables whole, directly or through the derived dirty views.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import CleanConfig
from ..functions.rules import FORMAT_RULES, format_fix, normalize
from ..functions.text import DOMAIN_PATTERNS, FORMAT_PATTERNS, matches
from ..operators import anomalies as an, browse, drift, evaluate as ev, fuzzy, patterns as pt, profile as pr
from ..operators import reconstruct as rc, repair as rp, rows, schema as sc, scoring, validate as va
from ..operators.counts import cell_counts, counts_after
from ..session import cut, shared_dir
from ..sources import readers, writers
from ..streaming import batches
from .clean import clean
from .views import COLUMNS, VIEWS, cells_sql, table, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
R = "row_no"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- shared SQL -------------------------------------------------------------------------

NUM = "TRY_CAST(v AS DOUBLE)"
FILLED = "(v IS NOT NULL AND trim(v) <> '')"
PRESENT = "(v IS NOT NULL AND v NOT IN ('', 'None'))"
LOOSE = "(TRY_CAST(regexp_replace(v, '[,$%\\s]', '', 'g') AS DOUBLE) IS NOT NULL)"


def _type_cte(cells: str) -> str:
    """Per column: how many cells pass each test."""
    tests = ", ".join(
        f"count(*) FILTER (WHERE {FILLED} AND regexp_matches(trim(v), '{p}', 'i')) AS n_{k}" for k, p in FORMAT_PATTERNS.items()
    )
    return f"""types AS (
        SELECT col, count(*) AS total, count(*) FILTER (WHERE {FILLED}) AS filled,
               count(DISTINCT v) FILTER (WHERE {FILLED}) AS filled_distinct,
               count(*) FILTER (WHERE {PRESENT}) AS present, count(DISTINCT v) FILTER (WHERE {PRESENT}) AS present_distinct,
               count(*) FILTER (WHERE {FILLED} AND {LOOSE}) AS nums,
               coalesce(bool_or({FILLED} AND {LOOSE} AND contains(v, '.')), false) AS point, {tests}
        FROM ({cells}) GROUP BY col),
    schema_of AS (
        SELECT *, CASE WHEN filled = 0 THEN 'empty' WHEN nums / filled > 0.8 THEN CASE WHEN point THEN 'float' ELSE 'integer' END
                    WHEN n_boolean / filled > 0.8 THEN 'boolean'
                    WHEN n_date_iso / filled > 0.6 OR n_date_us / filled > 0.6 OR n_date_eu / filled > 0.6 THEN 'date'
                    ELSE 'string' END AS dtype,
               CASE WHEN filled = 0 THEN NULL WHEN nums / filled > 0.8 THEN CASE WHEN point THEN 'decimal' ELSE 'integer' END
                    WHEN n_boolean / filled > 0.8 THEN 'boolean'
                    WHEN n_date_iso / filled > 0.6 THEN 'date_iso' WHEN n_date_us / filled > 0.6 THEN 'date_us'
                    WHEN n_date_eu / filled > 0.6 THEN 'date_eu' WHEN n_email / filled > 0.6 THEN 'email'
                    WHEN n_phone_us / filled > 0.6 THEN 'phone_us' WHEN n_url / filled > 0.6 THEN 'url'
                    WHEN n_uuid / filled > 0.6 THEN 'uuid' END AS fmt
        FROM types)"""


TYPED_VIEWS = ["customer_text", "events_text", "dirty_customer", "dirty_contacts"]


def _all_cells_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}.' || col AS col, v FROM ({cells_sql(n, row=False)})" for n in TYPED_VIEWS
    )


def _all_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Value counts of four derived tables, with the table in the column name."""
    parts = []
    for n in TYPED_VIEWS:
        c = cell_counts(view(spark, sf, n), COLUMNS[n], R)
        parts.append(c.withColumn("column", F.concat(F.lit(f"{n}."), "column")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out, "counts")


# ---- schema -----------------------------------------------------------------------------


@query(
    "schema_inference",
    f"""{with_views(*TYPED_VIEWS)}, {_type_cte(_all_cells_sql())}
    SELECT col AS "column", dtype, (filled < total OR filled = 0) AS nullable, fmt AS format_pattern,
           round(CASE WHEN dtype IN ('integer', 'float') THEN nums / filled END, 4) AS numeric_rate,
           round(CASE WHEN dtype IN ('date', 'string') THEN CASE fmt WHEN 'date_iso' THEN n_date_iso WHEN 'date_us' THEN n_date_us
                 WHEN 'date_eu' THEN n_date_eu WHEN 'email' THEN n_email WHEN 'phone_us' THEN n_phone_us WHEN 'url' THEN n_url
                 WHEN 'uuid' THEN n_uuid END / filled END, 4) AS match_rate,
           round(CASE WHEN dtype = 'string' AND fmt IS NULL THEN filled_distinct / filled END, 4) AS unique_rate
    FROM schema_of""",
)
def _schema(spark, sf):
    return sc.schema_report(sc.type_counts(_all_counts(spark, sf)))


@query(
    "schema_issues",
    f"""{with_views(*TYPED_VIEWS)}, {_type_cte(_all_cells_sql())}
    SELECT col AS "column", 'mixed_types' AS issue_type,
           printf('mixed_types: %.1f%% numeric, %.1f%% non-numeric', nums / filled * 100, (1 - nums / filled) * 100) AS details,
           'warning' AS severity
    FROM types WHERE filled >= 2 AND nums / filled > 0.1 AND nums / filled < 0.9
    UNION ALL SELECT col, 'all_empty', 'Column contains no non-empty values', 'critical' FROM types WHERE filled = 0""",
)
def _schema_issues(spark, sf):
    return sc.schema_issues(sc.type_counts(_all_counts(spark, sf)))


_BEST = ", ".join(f"n_{k}" for k in FORMAT_PATTERNS)
_PICK = " ".join(f"WHEN n_{k} = greatest({_BEST}) THEN '{k}'" for k in FORMAT_PATTERNS)


@query(
    "format_pattern",
    f"""{with_views(*TYPED_VIEWS)}, {_type_cte(_all_cells_sql())}
    SELECT col AS "column", CASE WHEN greatest({_BEST}) = 0 THEN NULL {_PICK} END AS pattern,
           round(CASE WHEN filled = 0 THEN 0.0 ELSE greatest({_BEST}) / filled END, 4) AS match_rate, filled AS total_checked
    FROM types""",
)
def _format_pattern(spark, sf):
    return sc.format_pattern(sc.type_counts(_all_counts(spark, sf)))


@query("schema_sampled")
def _schema_sampled(spark, sf):
    v = view(spark, sf, "events_text")
    report, _ = sc.infer_schema(sc.sample_rows(v, 1000, v.count(), row_col=R), COLUMNS["events_text"], row_col=R)
    return report


# ---- profiles ---------------------------------------------------------------------------


def _profile_cte(cells: str) -> str:
    return f"""cells AS ({cells}),
    base AS (SELECT col, count(*) AS total, count(*) FILTER (WHERE NOT {PRESENT}) AS null_count,
                    count(DISTINCT v) FILTER (WHERE {PRESENT}) AS unique_count,
                    min(length(v)) FILTER (WHERE {PRESENT}) AS min_length, max(length(v)) FILTER (WHERE {PRESENT}) AS max_length,
                    avg(length(v)) FILTER (WHERE {PRESENT}) AS mean_length
             FROM cells GROUP BY col),
    nums AS (SELECT col, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, min(x) AS lo,
                    max(x) AS hi, skewness(x) AS skew, kurtosis(x) AS kurt, quantile_cont(x, 0.25) AS q1,
                    quantile_cont(x, 0.75) AS q3, stddev_pop(x) AS std_pop
             FROM (SELECT col, {NUM} AS x FROM cells) WHERE x IS NOT NULL GROUP BY col),
    ranked AS (SELECT col, v, count(*) AS n, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v) AS place
               FROM cells WHERE {PRESENT} GROUP BY col, v),
    tops AS (SELECT col, string_agg(v || ':' || n, '|' ORDER BY place) AS top FROM ranked WHERE place <= 10 GROUP BY col),
    profiles AS (
        SELECT base.col, total, null_count, round(null_count / total * 100, 2) AS null_pct, unique_count,
               round(unique_count / total * 100, 2) AS unique_pct,
               coalesce(nums.n / (total - null_count) > 0.5, false) AS is_numeric, nums.*, top, min_length, max_length, mean_length
        FROM base LEFT JOIN nums USING (col) LEFT JOIN tops USING (col))"""


_PROFILE_OUT = """SELECT profiles.col AS "column", total, null_count, null_pct, unique_count, unique_pct, is_numeric,
    round(round(CASE WHEN is_numeric THEN mean END, 10), 6) AS mean, round(round(CASE WHEN is_numeric THEN median END, 10), 6) AS median,
    round(round(CASE WHEN is_numeric THEN std END, 10), 6) AS std, CASE WHEN is_numeric THEN lo END AS min,
    CASE WHEN is_numeric THEN hi END AS max, round(round(CASE WHEN is_numeric THEN skew END, 10), 4) AS skew,
    round(round(CASE WHEN is_numeric THEN q1 END, 10), 6) AS q1, round(round(CASE WHEN is_numeric THEN q3 END, 10), 6) AS q3,
    CASE WHEN NOT is_numeric THEN top END AS top_values, CASE WHEN NOT is_numeric THEN min_length END AS min_length,
    CASE WHEN NOT is_numeric THEN max_length END AS max_length,
    round(CASE WHEN NOT is_numeric THEN mean_length END, 2) AS mean_length FROM profiles"""


def _flat_profile(p: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("top_values", lambda t: F.concat(t["value"], F.lit(":"), t["count"].cast("string"))), "|")
    return p.withColumn("top_values", shown)


@query("profile_columns", f"{with_views('lineitem_text')}, {_profile_cte(cells_sql('lineitem_text', row=False))} {_PROFILE_OUT}")
def _profile(spark, sf):
    return _flat_profile(pr.profile(view(spark, sf, "lineitem_text"), COLUMNS["lineitem_text"]))


@query(
    "profile_dirty_columns",
    f"{with_views('dirty_customer')}, {_profile_cte(cells_sql('dirty_customer', row=False))} {_PROFILE_OUT}",
)
def _profile_dirty(spark, sf):
    return _flat_profile(pr.profile(view(spark, sf, "dirty_customer"), COLUMNS["dirty_customer"]))


@query(
    "quality_score",
    f"""{with_views('dirty_customer')}, {_profile_cte(cells_sql('dirty_customer', row=False))}
    SELECT round(avg(greatest(0.0, (100 - null_pct) / 100) * 0.7 + CASE WHEN unique_pct > 1 THEN 1.0 ELSE 0.5 END * 0.3), 4) AS quality_score
    FROM profiles""",
)
def _quality(spark, sf):
    return pr.quality_score(pr.profile(view(spark, sf, "dirty_customer"), COLUMNS["dirty_customer"]))


@query(
    "column_statistics",
    f"""{with_views('lineitem_text')}, {_profile_cte(cells_sql('lineitem_text', row=False))}
    SELECT base.col AS "column", base.total AS "count", coalesce(nums.n, 0) AS numeric_count, base.total - coalesce(nums.n, 0) AS non_numeric_count,
           round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, lo AS min, hi AS max,
           round(skew, 4) AS skew, round(kurt, 4) AS kurtosis, round(q1, 4) AS q1, round(q3, 4) AS q3,
           CASE WHEN nums.n IS NULL THEN 'No numeric values' END AS error
    FROM base LEFT JOIN nums USING (col)""",
)
def _statistics(spark, sf):
    out = pr.column_statistics(view(spark, sf, "lineitem_text"), COLUMNS["lineitem_text"])
    shown = ["mean", "median", "std", "skew", "kurtosis", "q1", "q3"]
    return out.select(*[F.round(c, 4).alias(c) if c in shown else c for c in out.columns])


@query(
    "column_statistics_micros",
    f"""{with_views('event_clock')}, {_profile_cte(cells_sql('event_clock', row=False))}
    SELECT base.col AS "column", base.total AS "count", coalesce(nums.n, 0) AS numeric_count, round(mean, 1) AS mean, median, lo AS min, hi AS max, q1, q3
    FROM base LEFT JOIN nums USING (col)""",
)
def _statistics_micros(spark, sf):
    """Quantiles of times in microseconds, which agree in all their leading bits."""
    out = pr.column_statistics(view(spark, sf, "event_clock"), COLUMNS["event_clock"]).withColumn("mean", F.round("mean", 1))
    return out.select("column", "count", "numeric_count", "mean", "median", "min", "max", "q1", "q3")


@query("value_counts", "SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _value_counts(spark, sf):
    return pr.value_counts(table(spark, sf, "part"), "p_name", 20)


@query("document_sources", "SELECT source AS value, count(*) AS count FROM documents GROUP BY 1")
def _document_sources(spark, sf):
    return pr.value_counts(table(spark, sf, "documents"), "source", None)


@query(
    "column_info",
    f"""{with_views('dirty_customer')}
    SELECT 'segment' AS "column", 'string' AS dtype, count(*) AS total, count(*) FILTER (WHERE segment IS NULL OR segment = '') AS null_count,
           count(DISTINCT segment) AS unique_count,
           (SELECT string_agg(segment, '|' ORDER BY row_no) FROM
              (SELECT row_no, segment FROM dirty_customer WHERE segment IS NOT NULL ORDER BY row_no LIMIT 10)) AS sample_values
    FROM dirty_customer""",
)
def _column_info(spark, sf):
    out = pr.column_info(view(spark, sf, "dirty_customer"), "segment", 10, R)
    return out.withColumn("sample_values", F.array_join("sample_values", "|"))


@query(
    "null_cells",
    f"""{with_views('dirty_customer')}
    SELECT row_no AS "row", col AS "column", v AS value FROM ({cells_sql('dirty_customer')}) WHERE v IS NULL OR trim(v) = ''""",
)
def _null_cells(spark, sf):
    return pr.null_cells(view(spark, sf, "dirty_customer"), COLUMNS["dirty_customer"], R)


_DUP_KEYS = ["c_nationkey", "c_mktsegment"]


@query(
    "duplicate_rows",
    """SELECT c_custkey AS "row", min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS first_row FROM customer
       QUALIFY c_custkey > first_row""",
)
def _duplicate_rows(spark, sf):
    return pr.duplicate_rows(table(spark, sf, "customer"), _DUP_KEYS, "c_custkey")


@query(
    "duplicate_count",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem
       GROUP BY l_orderkey, l_linenumber)""",
)
def _duplicate_count(spark, sf):
    return pr.duplicate_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], R)


# ---- findings ---------------------------------------------------------------------------

_EVENT_NUMS = f"{with_views('events_text')}, {_profile_cte(cells_sql('events_text', ['value'], row=False))}"
_EVENT_X = "(SELECT row_no, value, TRY_CAST(value AS DOUBLE) AS x FROM events_text) t, nums"


def _event_facts(spark, sf) -> sc.ColumnFacts:
    return sc.facts_of(view(spark, sf, "events_text"), ["value"], row_col=R)["value"]


@query(
    "outliers_z",
    f"""{_EVENT_NUMS} SELECT row_no AS "row", 'value' AS "column", value, round(abs(x - mean) / std_pop, 3) AS zscore
    FROM {_EVENT_X} WHERE abs(x - mean) / std_pop > 3""",
)
def _outliers_z(spark, sf):
    return an.zscore_outliers(view(spark, sf, "events_text"), _event_facts(spark, sf), row_col=R)


@query(
    "outliers_iqr",
    f"""{_EVENT_NUMS} SELECT row_no AS "row", 'value' AS "column", value, round(q1 - 1.5 * (q3 - q1), 3) AS lower_bound,
           round(q3 + 1.5 * (q3 - q1), 3) AS upper_bound
    FROM {_EVENT_X} WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)""",
)
def _outliers_iqr(spark, sf):
    out = an.iqr_outliers(view(spark, sf, "events_text"), _event_facts(spark, sf), row_col=R)
    return out.select("row", "column", "value", F.col("bounds.lower").alias("lower_bound"), F.col("bounds.upper").alias("upper_bound"))


_BOTH = """abs(x - mean) / std_pop > 3 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))"""


@query(
    "outliers_both",
    f"""{_EVENT_NUMS} SELECT row_no AS "row", 'value' AS "column", value, 'numeric_outlier' AS anomaly_type, 'warning' AS severity,
           concat('Value outside Z-score (3.0) AND IQR bounds [', round(q1 - 1.5 * (q3 - q1), 2), ', ', round(q3 + 1.5 * (q3 - q1), 2), ']') AS details
    FROM {_EVENT_X} WHERE {_BOTH}""",
)
def _outliers_both(spark, sf):
    v = view(spark, sf, "events_text")
    facts = sc.facts_of(v, ["value"], row_col=R)
    return an.detect(v.select(R, "value"), facts, row_col=R).where("anomaly_type = 'numeric_outlier'")


def _finding_cte(name: str) -> str:
    """All findings of a derived table, with their rank within the cell."""
    cells = cells_sql(name)
    fmt = " ".join(f"WHEN '{k}' THEN regexp_matches(trim(v), '{p}', 'i')" for k, p in FORMAT_PATTERNS.items())
    return f"""{with_views(name)}, {_type_cte(cells)}, {_profile_cte(cells)},
    freq AS (SELECT col, v, count(*) AS n FROM cells WHERE {PRESENT} GROUP BY col, v),
    low AS (SELECT freq.col, v, n FROM freq JOIN types USING (col)
            WHERE present >= 20 AND present_distinct / present <= 0.5 AND n <= greatest(1, floor(present * 0.01))),
    rare AS (SELECT * FROM low WHERE col IN (SELECT col FROM low GROUP BY col HAVING count(*) <= 50)),
    x AS (SELECT row_no, cells.col, v, {NUM} AS x, mean, std_pop, q1, q3, n, dtype, fmt, median, cells.v AS v0
          FROM cells JOIN schema_of USING (col) LEFT JOIN nums USING (col)),
    findings AS (
        SELECT row_no, col, v, 'numeric_outlier' AS kind, 1 AS place,
               concat('Value outside Z-score (3.0) AND IQR bounds [', round(q1 - 1.5 * (q3 - q1), 2), ', ', round(q3 + 1.5 * (q3 - q1), 2), ']') AS details
        FROM x WHERE dtype IN ('integer', 'float') AND n >= 10 AND {_BOTH}
        UNION ALL SELECT row_no, x.col, x.v, 'rare_category', 2, concat('Value ''', x.v, ''' appears only ', rare.n, ' time(s)')
        FROM x JOIN rare ON x.col = rare.col AND x.v = rare.v
        UNION ALL SELECT row_no, col, v, 'format_violation', 3, concat('Does not match expected pattern ''', fmt, '''')
        FROM x WHERE fmt IS NOT NULL AND {FILLED} AND NOT CASE fmt {fmt} END),
    issues AS (SELECT * FROM findings UNION ALL SELECT row_no, col, v, 'missing', 4, NULL FROM x WHERE NOT {FILLED}),
    firsts AS (SELECT * FROM issues QUALIFY row_number() OVER (PARTITION BY row_no, col ORDER BY place) = 1)"""


_FINDING_OUT = """SELECT row_no AS "row", col AS "column", v AS value, kind AS anomaly_type,
    CASE kind WHEN 'rare_category' THEN 'info' ELSE 'warning' END AS severity, details FROM findings"""


def _found(spark, sf, name: str, config: CleanConfig = CleanConfig()) -> DataFrame:
    v = view(spark, sf, name)
    return an.detect(v, sc.facts_of(v, COLUMNS[name], row_col=R), config, R)


@query("anomalies", f"{_finding_cte('dirty_customer')} {_FINDING_OUT}")
def _anomalies(spark, sf):
    return _found(spark, sf, "dirty_customer")


@query("rare_categories", f"{_finding_cte('dirty_customer')} {_FINDING_OUT} WHERE kind = 'rare_category'")
def _rare(spark, sf):
    return _found(spark, sf, "dirty_customer").where("anomaly_type = 'rare_category'")


@query("format_violations", f"{_finding_cte('dirty_contacts')} {_FINDING_OUT} WHERE kind = 'format_violation'")
def _formats(spark, sf):
    return _found(spark, sf, "dirty_contacts").where("anomaly_type = 'format_violation'")


@query(
    "report_sized_findings",
    f"""{_finding_cte('dirty_contacts')} {_FINDING_OUT} WHERE kind = 'format_violation'
    QUALIFY row_number() OVER (PARTITION BY col ORDER BY row_no) <= 500""",
)
def _report_sized(spark, sf):
    # a top-k report: the first 500 findings of each column
    return rows.top_rows(_found(spark, sf, "dirty_contacts").where("anomaly_type = 'format_violation'"), 500, ["column"], ["row"])


@query("anomaly_filter", f"{_finding_cte('dirty_customer')} {_FINDING_OUT} WHERE kind <> 'rare_category' AND col = 'balance'")
def _anomaly_filter(spark, sf):
    return browse.filter_findings(_found(spark, sf, "dirty_customer"), severity="WARNING", column="Balance")


@query(
    "pattern_violations",
    f"""{with_views('dirty_contacts')} SELECT row_no AS "row", 'phone' AS "column", phone AS value FROM dirty_contacts
    WHERE NOT regexp_matches(trim(phone), '{FORMAT_PATTERNS['phone_us']}', 'i')""",
)
def _pattern_violations(spark, sf):
    return an.pattern_violations(view(spark, sf, "dirty_contacts"), "phone", "phone_us", R)


_CURRENCY = DOMAIN_PATTERNS["finance"]["currency_pattern"]


@query(
    "domain_violations",
    f"""{with_views('dirty_customer')} SELECT row_no AS "row", 'balance' AS "column", balance AS value FROM dirty_customer
    WHERE NOT regexp_matches(trim(balance), '{_CURRENCY}')""",
)
def _domain(spark, sf):
    return an.domain_violations(view(spark, sf, "dirty_customer"), "balance", "finance", "currency_pattern", R)


_DOMAIN_CHECKS = [
    ("healthcare", "icd_code_pattern", "icd"), ("healthcare", "npi_pattern", "npi"), ("finance", "cusip_pattern", "cusip"),
    ("finance", "currency_pattern", "price"), ("retail", "sku_pattern", "sku"), ("retail", "upc_pattern", "upc"),
]


@query(
    "domain_violations_all",
    f"{with_views('coded_parts')} "
    + " UNION ALL ".join(
        f"""SELECT row_no AS "row", '{c}' AS "column", {c} AS value FROM coded_parts WHERE NOT regexp_matches(trim({c}), '{DOMAIN_PATTERNS[d][k]}')"""
        for d, k, c in _DOMAIN_CHECKS
    ),
)
def _domains(spark, sf):
    v = view(spark, sf, "coded_parts")
    parts = [an.domain_violations(v, c, d, k, R) for d, k, c in _DOMAIN_CHECKS]
    return reduce(DataFrame.unionByName, parts)


@query(
    "missing_required",
    f"""{with_views('dirty_customer')} SELECT row_no AS "row", 'amount' AS "column", balance AS value, 'missing_required' AS anomaly_type,
    'warning' AS severity, 'Required value is missing' AS details FROM dirty_customer WHERE trim(balance) = ''
    UNION ALL SELECT -1, 'transaction_id', NULL, 'missing_required', 'critical', 'Required column ''transaction_id'' is missing'""",
)
def _missing_required(spark, sf):
    return an.missing_required(view(spark, sf, "dirty_customer").withColumnRenamed("balance", "amount"), "finance", R)


@query(
    "date_order_violations",
    f"""{with_views('dirty_periods')} SELECT row_no AS "row", 'start_date > end_date' AS "column",
    concat(start_date, ' > ', end_date) AS value, 'cross_column_constraint' AS anomaly_type, 'critical' AS severity,
    'Start date (start_date) is after end date (end_date)' AS details
    FROM dirty_periods WHERE cast(start_date AS date) > cast(end_date AS date)""",
)
def _date_order(spark, sf):
    return an.date_order_violations(view(spark, sf, "dirty_periods"), R)


# the same texts, shapes and precedence: place, name, shape, format
_MOMENTS = [
    (0, "iso", r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d.*)?$", None), (1, "yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"),
    (2, "M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"), (3, "d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"),
    (4, "M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "%m-%d-%Y"), (5, "d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "%d-%m-%Y"),
    (6, "M.d.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%m.%d.%Y"), (7, "d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"),
]
_READ = " UNION ALL ".join(
    f"""SELECT row_no, col, v, {place} AS place, '{name}' AS format, CASE WHEN regexp_matches(trim(v), '{shape}')
        THEN {f"try_strptime(trim(v), '{fmt}')" if fmt else "TRY_CAST(trim(v) AS TIMESTAMP)"} END AS moment FROM cells"""
    for place, name, shape, fmt in _MOMENTS
)
_DATED = f"""{with_views('dated_orders')}, cells AS ({cells_sql('dated_orders')}), readings AS ({_READ}),
    tally AS (SELECT col, format, place, count(*) FILTER (trim(v) <> '') AS filled, count(moment) AS n FROM readings GROUP BY ALL),
    ranked AS (SELECT *, n > 0 AND row_number() OVER (PARTITION BY col ORDER BY n DESC, place) = 1 AS chosen FROM tally)"""


@query("date_formats", f"""{_DATED} SELECT col AS "column", format, filled, n AS read, chosen FROM ranked""")
def _date_formats(spark, sf):
    return an.date_formats(rows.spread(view(spark, sf, "dated_orders"), 500_000), COLUMNS["dated_orders"])


@query(
    "date_order_formats",
    f"""{_DATED}, dates AS (SELECT row_no, col, v, moment FROM readings JOIN ranked USING (col, format) WHERE chosen)
    SELECT s.row_no AS "row", concat(s.col, ' > ', e.col) AS "column", concat(s.v, ' > ', e.v) AS value, 'cross_column_constraint' AS anomaly_type,
           'critical' AS severity, concat('Start date (', s.col, ') is after end date (', e.col, ')') AS details
    FROM dates s JOIN dates e USING (row_no)
    WHERE regexp_matches(s.col, 'start|begin') AND regexp_matches(e.col, 'end|finish') AND s.moment > e.moment""",
)
def _date_order_formats(spark, sf):
    return an.date_order_violations(rows.spread(view(spark, sf, "dated_orders"), 500_000), R)


# ---- rules ------------------------------------------------------------------------------

_EMAIL = FORMAT_PATTERNS["email"]
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_TEN = f"CASE WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '1%' THEN substr({_DIGITS}, 2) ELSE {_DIGITS} END"
_PHONE = f"concat('(', substr({_TEN}, 1, 3), ') ', substr({_TEN}, 4, 3), '-', substr({_TEN}, 7, 4))"
_KEPT = "regexp_replace(trim(v), '[^0-9.\\-]', '', 'g')"


def _day(shape: str, fmt: str) -> str:
    return f"CASE WHEN regexp_matches(trim(v), '{shape}') THEN strftime(try_strptime(trim(v), '{fmt}'), '%Y-%m-%d') END"


_D4, _M = "[0-9]{4}", "[0-9]{1,2}"
_DAYS = [
    ("date_us", _day(f"^{_M}/{_M}/{_D4}$", "%m/%d/%Y")), ("date_eu_slash", _day(f"^{_M}/{_M}/{_D4}$", "%d/%m/%Y")),
    ("date_us_dash", _day(f"^{_M}-{_M}-{_D4}$", "%m-%d-%Y")), ("date_eu_dot", _day(f"^{_M}\\.{_M}\\.{_D4}$", "%d.%m.%Y")),
    ("date_iso_slash", _day(f"^{_D4}/{_M}/{_M}$", "%Y/%m/%d")), ("date_us_short", _day(f"^{_M}/{_M}/[0-9]{{2}}$", "%m/%d/%y")),
    ("date_eu_dash", _day(f"^{_M}-{_M}-{_D4}$", "%d-%m-%Y")),
]
_SQL_RULES = {
    "trim": ("trim(regexp_replace(v, '\\s+', ' ', 'g')) <> v", "trim(regexp_replace(v, '\\s+', ' ', 'g'))", "'rule:trim_whitespace'", 0.99),
    "date": (
        f"coalesce({', '.join(d for _, d in _DAYS)}) IS NOT NULL", f"coalesce({', '.join(d for _, d in _DAYS)})",
        "'rule:date_normalize_' || CASE " + " ".join(f"WHEN {d} IS NOT NULL THEN '{n}'" for n, d in _DAYS) + " END", 0.95,
    ),
    "phone": (f"length({_TEN}) = 10 AND {_PHONE} <> trim(v)", _PHONE, "'rule:phone_normalize'", 0.95),
    "email": (f"lower(trim(v)) <> v AND regexp_matches(lower(trim(v)), '{_EMAIL}')", "lower(trim(v))", "'rule:email_normalize'", 0.98),
    "boolean": (
        "lower(trim(v)) IN ('yes', 'y', '1', 't', 'no', 'n', '0', 'f')",
        "CASE WHEN lower(trim(v)) IN ('yes', 'y', '1', 't') THEN 'true' ELSE 'false' END", "'rule:boolean_coerce'", 0.95,
    ),
    "numeric": (
        f"NOT regexp_matches(trim(v), '^-?[0-9]+\\.?[0-9]*$') AND {_KEPT} <> trim(v) AND regexp_matches({_KEPT}, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')",
        _KEPT, "'rule:numeric_coerce'", 0.90,
    ),
}
_CONTACT_CELLS = f"{cells_sql('dirty_contacts')} UNION ALL {cells_sql('dirty_customer')}"


def _rule_sql(name: str) -> str:
    when, new, rule, confidence = _SQL_RULES[name]
    return f"""{with_views('dirty_contacts', 'dirty_customer')} SELECT row_no AS "row", col AS "column", v AS old_value, {new} AS new_value,
        {rule} AS rule, cast({confidence} AS double) AS confidence FROM ({_CONTACT_CELLS}) WHERE trim(v) <> '' AND {when}"""


def _first_rule_sql() -> tuple[str, str, str]:
    """Condition, new value and rule name of the first rule that fires."""
    rules = list(_SQL_RULES.values())
    fires = " OR ".join(f"({r[0]})" for r in rules)
    new = "CASE " + " ".join(f"WHEN {r[0]} THEN {r[1]}" for r in rules) + " END"
    name = "CASE " + " ".join(f"WHEN {r[0]} THEN {r[2]}" for r in rules) + " END"
    conf = "CASE " + " ".join(f"WHEN {r[0]} THEN {r[3]}" for r in rules) + " END"
    return fires, new, name, conf


_FIRES, _NEW, _NAME, _CONF = _first_rule_sql()


def _contact_cells(spark, sf) -> DataFrame:
    parts = [rows.cells(rows.spread(view(spark, sf, n)), COLUMNS[n], R) for n in ("dirty_contacts", "dirty_customer")]
    return parts[0].unionByName(parts[1])


def _rule_rows(df: DataFrame, fix) -> DataFrame:
    # a list of one or none: a filter on the fix would run every rule once to test and once more to show it
    out = df.select("row", "column", "value", F.explode(F.array_compact(F.array(fix))).alias("fix"))
    return out.select("row", "column", F.col("value").alias("old_value"), "fix.new_value", "fix.rule", "fix.confidence")


for _rule_name, _rule in FORMAT_RULES.items():

    @query(f"rule_{_rule_name}", _rule_sql(_rule_name))
    def _one_rule(spark, sf, rule=_rule):
        cells = _contact_cells(spark, sf).where(F.trim("value") != "")
        return _rule_rows(cells, rule(F.col("value"), F.col("column")))


@query(
    "rules_first_match",
    f"""{with_views('dirty_contacts', 'dirty_customer')} SELECT row_no AS "row", col AS "column", v AS old_value, {_NEW} AS new_value,
    {_NAME} AS rule, cast({_CONF} AS double) AS confidence FROM ({_CONTACT_CELLS}) WHERE trim(v) <> '' AND ({_FIRES})""",
)
def _first_match(spark, sf):
    return _rule_rows(_contact_cells(spark, sf), format_fix(F.col("value"), F.col("column")))


@query(
    "normalize_format",
    f"""{with_views('dirty_contacts')} SELECT row_no AS "row",
    (SELECT lower(trim(email))) AS email,
    (SELECT CASE WHEN length({_TEN}) = 10 THEN {_PHONE} ELSE trim(v) END FROM (SELECT phone AS v)) AS phone,
    (SELECT coalesce({', '.join(d for n, d in _DAYS if n != 'date_eu_dash')}, trim(v)) FROM (SELECT signup_date AS v)) AS signup_date,
    CASE WHEN lower(trim(flag)) IN ('true', 'yes', '1', 't', 'y') THEN 'true' WHEN lower(trim(flag)) IN ('false', 'no', '0', 'f', 'n')
         THEN 'false' ELSE trim(flag) END AS flag FROM dirty_contacts""",
)
def _normalize_format(spark, sf):
    v = view(spark, sf, "dirty_contacts")
    targets = {"email": "email", "phone": "phone_us", "signup_date": "date_iso", "flag": "boolean"}
    return v.select(F.col(R).alias("row"), *[normalize(F.col(c), t).alias(c) for c, t in targets.items()])


# ---- repair -----------------------------------------------------------------------------

_MODES = """modes AS (SELECT col, v AS mode FROM freq WHERE trim(v) <> ''
    QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, v) = 1)"""


def _actions_cte(name: str) -> str:
    """The change log of one repair pass."""
    return f"""{_finding_cte(name)}, {_MODES},
    open_cells AS (SELECT firsts.*, dtype, median, mode FROM firsts JOIN schema_of USING (col) LEFT JOIN nums USING (col) LEFT JOIN modes USING (col)),
    fixes AS (
        SELECT row_no, col, v, kind,
               CASE WHEN kind <> 'missing' THEN CASE WHEN {_FIRES} THEN {_NEW} END
                    WHEN dtype IN ('integer', 'float') AND median IS NOT NULL THEN cast(round(median, 6) AS varchar)
                    WHEN mode IS NOT NULL THEN mode ELSE 'Unknown' END AS new_value,
               CASE WHEN kind <> 'missing' THEN CASE WHEN {_FIRES} THEN {_NAME} END
                    WHEN dtype IN ('integer', 'float') AND median IS NOT NULL THEN 'rule:median_impute'
                    WHEN mode IS NOT NULL THEN 'rule:mode_impute' ELSE 'rule:unknown_fill' END AS rule,
               CASE WHEN kind <> 'missing' THEN CASE WHEN {_FIRES} THEN {_CONF} END
                    WHEN dtype IN ('integer', 'float') AND median IS NOT NULL THEN 0.90
                    WHEN mode IS NOT NULL THEN 0.85 ELSE 0.70 END AS confidence
        FROM open_cells),
    actions AS (SELECT * FROM fixes WHERE rule IS NOT NULL)"""


_ACTION_OUT = """SELECT row_no AS "row", col AS "column", v AS old_value, new_value, rule, cast(confidence AS double) AS confidence,
    kind AS issue_type FROM actions"""


def _repaired(spark, sf, name="dirty_customer", patterns=None, proposals=None, config=CleanConfig()):
    v = rows.spread(view(spark, sf, name))
    # fixes by join read the open cells more than once
    joined = proposals is not None or patterns is not None
    keep = {"keep": lambda t: cut(t, "repaired")} if joined else {}
    return rp.repair(v, sc.facts_of(v, COLUMNS[name], row_col=R), patterns, proposals, config, R, **keep)


def _action_cols(df: DataFrame) -> DataFrame:
    return df.select("row", "column", "old_value", "new_value", "rule", "confidence", "issue_type")


@query("actions_log", f"{_actions_cte('dirty_customer')} {_ACTION_OUT}")
def _actions_log(spark, sf):
    return _action_cols(_repaired(spark, sf).actions)


for _n, _r in (("median", "median_impute"), ("mode", "mode_impute"), ("unknown", "unknown_fill")):

    @query(f"impute_{_n}", f"{_actions_cte('dirty_customer')} {_ACTION_OUT} WHERE rule = 'rule:{_r}'")
    def _impute(spark, sf, rule=f"rule:{_r}"):
        return _action_cols(browse.filter_actions(_repaired(spark, sf).actions, rule))


@query("action_filter", f"{_actions_cte('dirty_customer')} {_ACTION_OUT} WHERE rule LIKE 'rule:n%'")
def _action_filter(spark, sf):
    return _action_cols(browse.filter_actions(_repaired(spark, sf).actions, "rule:n"))


_FIXED = ", ".join(
    f"coalesce((max(new_value) FILTER (WHERE a.col = '{c}')), any_value({c})) AS {c}" for c in COLUMNS["dirty_customer"]
)


@query(
    "apply_fixes",
    f"{_actions_cte('dirty_customer')} SELECT d.row_no, {_FIXED} FROM dirty_customer d LEFT JOIN actions a ON a.row_no = d.row_no GROUP BY d.row_no",
)
def _apply_fixes(spark, sf):
    return _repaired(spark, sf).cleaned


@query(
    "apply_fixes_by_join",
    f"""{with_views('applied_fixes', 'customer_text')} SELECT c.row_no, id, CASE WHEN column_name = 'name' THEN old_value ELSE name END AS name,
    nation, balance, CASE WHEN column_name = 'segment' THEN old_value ELSE segment END AS segment
    FROM customer_text c JOIN applied_fixes a USING (row_no)""",
)
def _apply_by_join(spark, sf):
    fixes = view(spark, sf, "applied_fixes").select(
        F.col(R).alias("row"), F.col("column_name").alias("column"), F.col("old_value").alias("new_value")
    )
    return rp.apply_fixes(view(spark, sf, "customer_text"), fixes, R)


@query(
    "issue_merge",
    f"""{_finding_cte('dirty_customer')} SELECT row_no AS "row", col AS "column", v AS value, kind AS anomaly_type, details FROM firsts""",
)
def _issue_merge(spark, sf):
    v = view(spark, sf, "dirty_customer")
    found = an.detect(v, sc.facts_of(v, COLUMNS["dirty_customer"], row_col=R), row_col=R)
    # findings of one cell are ranked outlier, rare, format
    kinds = [found.where(F.col("anomaly_type") == k) for k in ("numeric_outlier", "rare_category", "format_violation")]
    blank = pr.null_cells(v, COLUMNS["dirty_customer"], R).select(
        "*", F.lit("missing").alias("anomaly_type"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("details")
    )
    return rp.merge_issues(*kinds, blank).select("row", "column", "value", "anomaly_type", "details")


@query(
    "unresolved_issues",
    f"""{_actions_cte('dirty_customer')} SELECT row_no AS "row", col AS "column", v AS value, kind AS issue_type FROM fixes WHERE rule IS NULL""",
)
def _unresolved(spark, sf):
    return _repaired(spark, sf).unresolved.select("row", "column", "value", "issue_type")


def _segment_patterns(spark: SparkSession) -> DataFrame:
    rows_ = [
        (1, ".*seg.*", "HOUSH.*", "{value}.lower()", "generic", 3, 1), (2, "segment", "hous", "HOUSEHOLD", "generic", 5, 0),
        (3, ".*", "(", "broken", "generic", 9, 0), (4, "bal.*", "9{3,}", "0.00", "finance", 9, 0), (5, "bal.*", "\\d+", "{value}.title()", "generic", 0, 0),
    ]
    return spark.createDataFrame(rows_, pt.PATTERN_SCHEMA)


_PATTERNED = f"""{_actions_cte('dirty_customer')},
    best AS (SELECT row_no, col, v, kind, CASE WHEN col = 'segment' AND regexp_matches(v, '^(hous)', 'i') THEN 'HOUSEHOLD'
                    WHEN col = 'balance' AND regexp_matches(v, '^([0-9]+)') THEN v END AS new_value,
                    CASE WHEN col = 'segment' AND regexp_matches(v, '^(hous)', 'i') THEN 'pattern:segment'
                         WHEN col = 'balance' AND regexp_matches(v, '^([0-9]+)') THEN 'pattern:bal.*' END AS rule,
                    CASE WHEN col = 'segment' THEN 1.0 ELSE 0.85 END AS confidence
             FROM fixes WHERE rule IS NULL),
    everything AS (SELECT * FROM actions UNION ALL SELECT row_no, col, v, kind, new_value, rule, confidence FROM best WHERE rule IS NOT NULL)
    SELECT row_no AS "row", col AS "column", v AS old_value, new_value, rule, cast(confidence AS double) AS confidence, kind AS issue_type FROM everything"""


@query("pattern_repair", _PATTERNED)
def _pattern_repair(spark, sf):
    return _action_cols(_repaired(spark, sf, patterns=_segment_patterns(spark)).actions)


@query("pattern_repair_by_join", _PATTERNED)
def _pattern_repair_join(spark, sf):
    found = _repaired(spark, sf, patterns=_segment_patterns(spark))
    return _action_cols(found.external.unionByName(rp.action_rows(found._log(True))))


@query(
    "pattern_match",
    f"""{with_views('dirty_customer')}, vals AS (SELECT DISTINCT col, v FROM ({cells_sql('dirty_customer')}) WHERE v IS NOT NULL)
    SELECT col AS "column", v AS value, CASE WHEN col = 'segment' THEN 2 ELSE 5 END::BIGINT AS pattern_id,
           CASE WHEN col = 'segment' THEN 'HOUSEHOLD' ELSE v END AS new_value,
           CASE WHEN col = 'segment' THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence
    FROM vals WHERE (col = 'segment' AND regexp_matches(v, '^(hous)', 'i')) OR (col = 'balance' AND regexp_matches(v, '^([0-9]+)'))""",
)
def _pattern_match(spark, sf):
    v = view(spark, sf, "dirty_customer")
    values = cell_counts(v, COLUMNS["dirty_customer"], R).where(F.col("value").isNotNull())
    out = pt.match_patterns(values, _segment_patterns(spark), COLUMNS["dirty_customer"])
    return out.select("column", "value", "pattern_id", "new_value", "confidence")


@query(
    "pattern_match_many",
    f"""{with_views('dirty_customer')}, vals AS (SELECT DISTINCT name AS v FROM dirty_customer WHERE name IS NOT NULL),
    live AS (SELECT c_custkey * 4 AS id, v, 0.75 AS confidence, 3 AS won FROM vals, customer WHERE starts_with(lower(v), lower(c_name))
             UNION ALL
             SELECT c_custkey * 4 + 1, v, 0.5, 1 FROM vals, customer WHERE regexp_matches(v, '^ ') AND starts_with(lower(ltrim(v)), lower(c_name))
             UNION ALL
             SELECT 2, v, 1.0, 1 FROM vals WHERE v LIKE '%99%'),
    best AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY v ORDER BY won DESC, id) = 1)
    SELECT 'name' AS "column", v AS value, id AS pattern_id, upper(v) AS new_value, cast(confidence AS DOUBLE) AS confidence FROM best""",
)
def _pattern_match_many(spark, sf):
    # two patterns for each customer, one by the beginning of a value and one by a text inside it, and two that are no texts at all
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), pt.escape_regex(F.col("c_name")).alias("name"))

    def told(key, pattern, won: int, lost: int) -> DataFrame:
        return names.select(
            key.cast("bigint").alias("id"), F.lit("na.*").alias("column_pattern"), pattern.alias("value_pattern"), F.lit("{value}.upper()").alias("fix_template"),
            F.lit("generic").alias("domain"), F.lit(won).cast("bigint").alias("success_count"), F.lit(lost).cast("bigint").alias("fail_count"),
        )

    others = [(2, "name", ".*9{2}", "{value}.upper()", "generic", 1, 0), (3, ".*", "[A-", "broken", "generic", 9, 0)]
    patterns = told(F.col("k") * 4, F.col("name"), 3, 1).unionByName(told(F.col("k") * 4 + 1, F.concat(F.lit(r"\s+"), F.col("name")), 1, 1))
    patterns = patterns.unionByName(spark.createDataFrame(others, pt.PATTERN_SCHEMA))
    values = cell_counts(view(spark, sf, "dirty_customer"), COLUMNS["dirty_customer"], R).where(F.col("value").isNotNull())
    out = pt.match_patterns(values, patterns, COLUMNS["dirty_customer"])
    return out.select("column", "value", "pattern_id", "new_value", "confidence")


# The strip step runs while the text still ends in the next marker, so it takes leading blanks only.
@query(
    "pattern_template",
    f"""{with_views('dirty_contacts')} SELECT row_no AS "row", upper(concat('<', trim(email), '>')) AS upper_value,
    lower(ltrim(concat(' ', email))) AS lower_value, 'fixed' AS fixed_value FROM dirty_contacts""",
)
def _pattern_template(spark, sf):
    e = F.col("email")
    return view(spark, sf, "dirty_contacts").select(
        F.col(R).alias("row"), pt.apply_template(F.lit("<{value}>.upper()"), F.trim(e)).alias("upper_value"),
        pt.apply_template(F.lit(" {value}.strip().lower()"), e).alias("lower_value"), pt.apply_template(F.lit("fixed"), e).alias("fixed_value"),
    )


@query(
    "pattern_outcomes",
    """WITH o AS (SELECT 1 + o_orderkey % 3 AS id, o_totalprice > 250000 AS success FROM orders)
    SELECT id, CAST(count(*) FILTER (WHERE success) AS BIGINT) AS success_count, CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS fail_count,
           round(count(*) FILTER (WHERE success) / count(*), 6) AS confidence FROM o GROUP BY id""",
)
def _pattern_outcomes(spark, sf):
    outcomes = table(spark, sf, "orders").select((F.lit(1) + F.col("o_orderkey") % 3).alias("id"), (F.col("o_totalprice") > 250000).alias("success"))
    known = outcomes.select("id").distinct().select(
        "id", F.lit(".*").alias("column_pattern"), F.lit(".*").alias("value_pattern"), F.lit("{value}").alias("fix_template"),
        F.lit("generic").alias("domain"), F.lit(0).cast("bigint").alias("success_count"), F.lit(0).cast("bigint").alias("fail_count"),
    )
    out = pt.list_patterns(pt.record_outcomes(known, outcomes), "generic")
    return out.select("id", "success_count", "fail_count", F.round("confidence", 6).alias("confidence"))


def _proposals(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    both = [
        c.select(F.col("c_custkey").alias("row"), F.lit(col).alias("column"), value.alias("corrected_value"))
        for col, value in (("balance", F.col("c_acctbal").cast("decimal(18,2)").cast("string")), ("segment", F.col("c_mktsegment")))
    ]
    return both[0].unionByName(both[1]).select(
        "*", F.when(F.col("column") == "segment", 0.9).otherwise(0.6).alias("confidence"), F.lit("source system").alias("reasoning"), F.lit("ext").alias("model")
    )


_PROPOSED = f"""{_actions_cte('dirty_customer')},
    proposed AS (SELECT row_no, col, v, kind, CASE col WHEN 'balance' THEN cast(cast(c_acctbal AS decimal(18,2)) AS varchar) ELSE c_mktsegment END AS new_value,
                        'llm:ext' AS rule, CASE col WHEN 'segment' THEN 0.9 ELSE 0.6 END AS confidence
                 FROM fixes JOIN customer ON c_custkey = row_no WHERE rule IS NULL AND col IN ('balance', 'segment'))"""


@query(
    "proposals_apply",
    f"""{_PROPOSED}, everything AS (SELECT * FROM actions UNION ALL SELECT * FROM proposed)
    SELECT row_no AS "row", col AS "column", v AS old_value, new_value, rule, cast(confidence AS double) AS confidence, kind AS issue_type FROM everything""",
)
def _proposals_apply(spark, sf):
    return _action_cols(_repaired(spark, sf, proposals=_proposals(spark, sf)).actions)


@query(
    "learn_patterns",
    f"""{_PROPOSED} SELECT '.*segment.*' AS column_pattern, v AS value_pattern, new_value AS fix_template, 'generic' AS domain,
    1::BIGINT AS success_count, 0::BIGINT AS fail_count FROM proposed WHERE confidence >= 0.7""",
)
def _learn(spark, sf):
    return pt.learn_patterns(_repaired(spark, sf, proposals=_proposals(spark, sf)).actions)


@query(
    "repair_context",
    f"""{_actions_cte('dirty_customer')},
    heads AS (SELECT DISTINCT col, v FROM cells WHERE row_no < 50 AND v IS NOT NULL AND v <> ''),
    samples AS (SELECT col, string_agg(v, '|' ORDER BY v) AS s FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS i FROM heads) WHERE i <= 15 GROUP BY col)
    SELECT f.row_no AS "row", f.col AS "column", f.v AS value, dtype, coalesce(fmt, 'none') AS format_pattern, s AS sample_values
    FROM fixes f JOIN schema_of USING (col) LEFT JOIN samples USING (col) WHERE rule IS NULL""",
)
def _context(spark, sf):
    v = view(spark, sf, "dirty_customer")
    facts = sc.facts_of(v, COLUMNS["dirty_customer"], row_col=R)
    issues = rp.repair(v, facts, row_col=R).unresolved
    out = rp.repair_context(issues, v, facts, head=50, row_col=R)
    return out.withColumn("sample_values", F.array_join("sample_values", "|")).drop("other_columns")


@query(
    "patterns_added",
    """SELECT row_number() OVER (ORDER BY c_name) + 5 AS id, '.*name.*' AS column_pattern, c_name AS value_pattern, upper(c_name) AS fix_template,
              'generic' AS domain, c_custkey % 3 AS success_count, 0::BIGINT AS fail_count FROM customer
       UNION ALL SELECT * FROM (VALUES (1, '.*seg.*', 'HOUSH.*', '{value}.lower()', 'generic', 3, 1), (2, 'segment', 'hous', 'HOUSEHOLD', 'generic', 5, 0),
              (3, '.*', '(', 'broken', 'generic', 9, 0), (4, 'bal.*', '9{3,}', '0.00', 'finance', 9, 0), (5, 'bal.*', '\\d+', '{value}.title()', 'generic', 0, 0)) t""",
)
def _patterns_added(spark, sf):
    new = table(spark, sf, "customer").select(
        F.lit(".*name.*").alias("column_pattern"), F.col("c_name").alias("value_pattern"), F.upper("c_name").alias("fix_template"),
        F.lit("generic").alias("domain"), (F.col("c_custkey") % 3).cast("bigint").alias("success_count"), F.lit(0).cast("bigint").alias("fail_count"),
    )
    return pt.add_patterns(_segment_patterns(spark), new)


# ---- fuzzy ------------------------------------------------------------------------------


@query(
    "fuzzy_canonical",
    f"""{with_views('part_typos')}, v AS (SELECT DISTINCT name FROM part_typos), c AS (SELECT DISTINCT p_name FROM part),
    s AS (SELECT name, p_name, 1 - levenshtein(lower(name), lower(p_name)) / greatest(length(name), length(p_name)) AS score FROM v, c),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, p_name) = 1)
    SELECT name AS value, p_name AS canonical, round(score, 6) AS score FROM b WHERE score >= 0.8 AND name <> p_name""",
)
def _fuzzy_lev(spark, sf):
    return _fuzzy(spark, sf, 0.8, "levenshtein")


# common subsequences by rows of lengths: each character of the shorter list moves the row of all prefixes on
@query(
    "fuzzy_ratio",
    f"""{with_views('part_typos').replace('WITH', 'WITH RECURSIVE', 1)}, v AS (SELECT DISTINCT name FROM part_typos), c AS (SELECT DISTINCT p_name FROM part),
    pairs AS (SELECT name, p_name, string_split(lower(name), '') AS a, string_split(lower(p_name), '') AS b FROM v, c),
    lcs AS (SELECT name, p_name, a, b, 0 AS j, list_transform(a, lambda x: 0) AS lengths FROM pairs
            UNION ALL
            SELECT name, p_name, a, b, j + 1, list_transform(range(1, len(a) + 1), lambda i: list_max(list_transform(range(1, i + 1),
                   lambda q: greatest(lengths[q], (CASE WHEN q > 1 THEN lengths[q - 1] ELSE 0 END) + (CASE WHEN a[q] = b[j + 1] THEN 1 ELSE 0 END)))))
            FROM lcs WHERE j < len(b)),
    s AS (SELECT name, p_name, round_even(200.0::DOUBLE * list_max(lengths) / (len(a) + len(b)), 0) / 100 AS score FROM lcs WHERE j = len(b)),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, p_name) = 1)
    SELECT name AS value, p_name AS canonical, round(score, 6) AS score FROM best WHERE score >= 0.9 AND name <> p_name""",
)
def _fuzzy_ratio(spark, sf):
    return _fuzzy(spark, sf, 0.9, "ratio")


def _fuzzy(spark, sf, threshold, metric) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("canonical")).distinct()
    # alphabetical place of each canonical spelling
    canonicals = rows.with_row_index(names, ["canonical"], "place")
    out = fuzzy.fuzzy_canonical(view(spark, sf, "part_typos"), "name", canonicals, threshold, metric)
    return out.select("value", "canonical", F.round("score", 6).alias("score"))


# ---- validation -------------------------------------------------------------------------


@query(
    "validate_types",
    f"""{_finding_cte('dirty_customer')} SELECT row_no AS "row", col AS "column", v AS value, 'type_mismatch' AS anomaly_type, 'warning' AS severity,
    'Expected ' || dtype || ' but got non-numeric value' AS details
    FROM x WHERE dtype IN ('integer', 'float') AND {PRESENT} AND {NUM} IS NULL""",
)
def _validate_types(spark, sf):
    v = view(spark, sf, "dirty_customer")
    return va.type_errors(v, sc.facts_of(v, COLUMNS["dirty_customer"], row_col=R), row_col=R)


@query(
    "validate_nulls",
    f"""{with_views('dirty_customer')}, p AS (SELECT col, count(*) AS total, count(*) FILTER (WHERE NOT {PRESENT}) AS gone
    FROM ({cells_sql('dirty_customer', row=False)} UNION ALL SELECT 'gone', CASE WHEN row_no % 4 < 3 THEN NULL ELSE name END FROM dirty_customer) GROUP BY col)
    SELECT -1::BIGINT AS "row", col AS "column", printf('%d nulls remaining', gone) AS value, 'high_null_rate' AS anomaly_type, 'warning' AS severity,
    printf('Column ''%s'' still has %d/%d (%.1f%%) null values after cleaning', col, gone, total, gone / total * 100) AS details
    FROM p WHERE gone > 0 AND gone / total > 0.5""",
)
def _validate_nulls(spark, sf):
    v = view(spark, sf, "dirty_customer").withColumn("gone", F.when(F.col(R) % 4 == 3, F.col("name")))
    return va.null_errors(cell_counts(v, [*COLUMNS["dirty_customer"], "gone"], R))


@query(
    "ks_drift",
    f"""{with_views('drift_before', 'drift_after')},
    x AS (SELECT cast(value AS double) AS x, 1 AS a, 0 AS b FROM drift_before UNION ALL SELECT cast(value AS double), 0, 1 FROM drift_after),
    g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM x GROUP BY x),
    r AS (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g)
    SELECT 'value' AS "column", CAST(max(na) AS BIGINT) AS n_before, CAST(max(nb) AS BIGINT) AS n_after, round(max(abs(ca / na - cb / nb)), 6) AS d FROM r""",
)
def _ks(spark, sf):
    before, after = (cell_counts(view(spark, sf, n), ["value"], R) for n in ("drift_before", "drift_after"))
    return drift.ks_statistics(before, after).withColumn("d", F.round("d", 6))


_KS = """g AS (SELECT col, x, sum(a) AS a, sum(b) AS b FROM sides WHERE x IS NOT NULL GROUP BY col, x),
    r AS (SELECT col, sum(a) OVER (PARTITION BY col ORDER BY x) AS ca, sum(b) OVER (PARTITION BY col ORDER BY x) AS cb,
                 sum(a) OVER (PARTITION BY col) AS n, sum(b) OVER (PARTITION BY col) AS m FROM g),
    d AS (SELECT col, any_value(n) AS n, any_value(m) AS m, max(abs(ca / nullif(n, 0) - cb / nullif(m, 0))) AS d FROM r GROUP BY col),
    l AS (SELECT *, n * m / (n + m) AS size, sqrt(n * m / (n + m)) * d AS y FROM d),
    law AS (SELECT *, y + 1 / (6 * sqrt(size)) + (y - 1) / (4 * size) AS x FROM l),
    p AS (SELECT col, n, m, d, CASE WHEN d <= 0 OR x <= 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
        2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * x * x)) FROM (SELECT unnest(range(1, 101)) AS k)))) END AS p FROM law)"""


@query(
    "ks_test",
    f"""{with_views('drift_before', 'drift_after')},
    sides AS (SELECT 'value' AS col, TRY_CAST(value AS DOUBLE) AS x, 1 AS a, 0 AS b FROM drift_before
              UNION ALL SELECT 'value', TRY_CAST(value AS DOUBLE), 0, 1 FROM drift_after
              UNION ALL SELECT 'small', TRY_CAST(value AS DOUBLE) + row_no % 7, 1, 0 FROM drift_before
              UNION ALL SELECT 'small', TRY_CAST(value AS DOUBLE) + (row_no + 1) % 7, 0, 1 FROM drift_before
              UNION ALL SELECT 'gone', TRY_CAST(value AS DOUBLE), 1, 0 FROM drift_before), {_KS}
    SELECT col AS "column", CASE WHEN least(n, m) >= 2 THEN round(d, 6) END AS ks_statistic, CASE WHEN least(n, m) >= 2 THEN round(p, 6) END AS p_value,
           CASE WHEN least(n, m) >= 2 THEN p < 0.05 END AS significant_drift,
           CASE WHEN least(n, m) < 2 THEN 'Not enough numeric values for comparison' END AS error FROM p""",
)
def _ks_test(spark, sf):
    """The whole test by the limiting law: statistic, p-value, flag, and a column that has numbers on one side only."""
    before, after = (view(spark, sf, n) for n in ("drift_before", "drift_after"))
    number = F.col("value").cast("double")
    moved = lambda t, by: t.select(R, (number + by % 7).cast("string").alias("small"))
    sides = [
        before.join(moved(before, F.col(R)), R).withColumn("gone", F.col("value")),
        after.join(moved(before, F.col(R) + 1), R).withColumn("gone", F.lit("none")),
    ]
    counts = [cell_counts(t, ["value", "small", "gone"], R) for t in sides]
    return drift.ks_test(*counts, method="series")


@query(
    "counts_after_repair",
    f"""{_actions_cte('dirty_customer')}, fixed AS (SELECT cells.col, coalesce(new_value, cells.v) AS v FROM cells LEFT JOIN actions USING (row_no, col))
    SELECT col AS "column", v AS value, count(*) AS n FROM fixed GROUP BY 1, 2""",
)
def _counts_after(spark, sf):
    v = view(spark, sf, "dirty_customer")
    return counts_after(cell_counts(v, COLUMNS["dirty_customer"], R), _repaired(spark, sf).actions)


# ---- scoring ----------------------------------------------------------------------------


def _fix_log(spark, sf) -> DataFrame:
    return view(spark, sf, "applied_fixes").select(
        F.col(R).alias("row"), F.col("column_name").alias("column"), "old_value", "new_value", "rule",
        F.col("confidence").cast("double").alias("confidence"), F.lit("because").alias("reasoning"), "issue_type",
    )


_TIER = """CASE WHEN rule LIKE 'rule:%' THEN 'tier1_deterministic' WHEN rule LIKE 'pattern:%' THEN 'tier2_pattern'
    WHEN rule LIKE 'llm:%' THEN 'tier3_llm' ELSE 'unknown' END"""


@query(
    "audit_log",
    f"""{with_views('applied_fixes')} SELECT row_no AS row_index, column_name, old_value AS original_value, new_value, issue_type, rule AS fix_method,
    cast(confidence AS double) AS confidence, 'because' AS reasoning, 'cleaner' AS agent_name, {_TIER} AS tier, '' AS trace_id FROM applied_fixes""",
)
def _audit(spark, sf):
    return scoring.audit_log(_fix_log(spark, sf)).drop("timestamp")


@query(
    "tiers",
    f"""{with_views('applied_fixes')} SELECT count(*) AS fixes, round(avg(confidence), 4) AS overall_confidence,
    count(*) FILTER (WHERE rule LIKE 'rule:%') AS tier1_deterministic, count(*) FILTER (WHERE rule LIKE 'pattern:%') AS tier2_pattern,
    count(*) FILTER (WHERE rule LIKE 'llm:%') AS tier3_llm, 0::BIGINT AS unknown FROM applied_fixes""",
)
def _tiers(spark, sf):
    return scoring.confidence_summary(_fix_log(spark, sf))


@query(
    "low_confidence",
    f"""{with_views('applied_fixes')} SELECT row_no AS "row", column_name AS "column", new_value, rule, cast(confidence AS double) AS confidence
    FROM applied_fixes WHERE confidence < 0.7""",
)
def _low(spark, sf):
    return scoring.low_confidence(_fix_log(spark, sf)).select("row", "column", "new_value", "rule", "confidence")


_QUEUE = f"""{with_views('applied_fixes', 'customer_text')},
    queue AS (SELECT 'review-' || (row_number() OVER (ORDER BY row_no, column_name) - 1) AS id, row_no, column_name, old_value,
              new_value, confidence, issue_type, rule FROM applied_fixes WHERE confidence < 0.7)"""


@query(
    "review_queue",
    f"""{_QUEUE} SELECT id, 'pending' AS status, row_no AS "row", column_name AS "column", old_value, new_value AS suggested_value,
    cast(confidence AS double) AS confidence, 'because' AS reasoning, issue_type, rule AS fix_method FROM queue""",
)
def _review_queue(spark, sf):
    return scoring.review_queue(_fix_log(spark, sf))


_ACTION_OF = "CASE row_no % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END"


def _reviewed(spark, sf):
    queue = cut(scoring.review_queue(_fix_log(spark, sf)), "queue")
    action = F.when(F.col("row") % 3 == 0, "accept").when(F.col("row") % 3 == 1, "reject").otherwise("edit")
    decisions = queue.select("id", action.alias("action"), F.when(F.col("row") % 3 == 2, F.concat(F.lit("edited "), F.col("row").cast("string"))).alias("new_value"))
    return scoring.apply_review(view(spark, sf, "customer_text"), queue, decisions, R)


@query(
    "review_apply",
    f"""{_QUEUE}, d AS (SELECT row_no, column_name, {_ACTION_OF} AS action,
        CASE row_no % 3 WHEN 1 THEN old_value ELSE 'edited ' || row_no END AS v FROM queue)
    SELECT c.row_no, id, CASE WHEN action <> 'accept' AND column_name = 'name' THEN v ELSE name END AS name, nation, balance,
           CASE WHEN action <> 'accept' AND column_name = 'segment' THEN v ELSE segment END AS segment
    FROM customer_text c LEFT JOIN d USING (row_no)""",
)
def _review_apply(spark, sf):
    return _reviewed(spark, sf)[0]


@query(
    "review_status",
    f"""{_QUEUE} SELECT id, CASE row_no % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'edited' END AS status,
    CASE row_no % 3 WHEN 0 THEN new_value WHEN 1 THEN old_value ELSE 'edited ' || row_no END AS reviewed_value FROM queue""",
)
def _review_status(spark, sf):
    return _reviewed(spark, sf)[1].select("id", "status", "reviewed_value")


@query(
    "review_audit",
    f"""{_QUEUE} SELECT row_no AS row_index, column_name, 'review:' || {_ACTION_OF} AS fix_method,
    CASE row_no % 3 WHEN 0 THEN new_value WHEN 1 THEN old_value ELSE 'edited ' || row_no END AS new_value, 1.0::DOUBLE AS confidence FROM queue""",
)
def _review_audit(spark, sf):
    return _reviewed(spark, sf)[2].select("row_index", "column_name", "fix_method", "new_value", "confidence")


@query(
    "audit_summary",
    f"""{with_views('applied_fixes')} SELECT count(*) AS total_fixes,
    (SELECT string_agg(issue_type || ':' || n, '|' ORDER BY issue_type) FROM (SELECT issue_type, count(*) AS n FROM applied_fixes GROUP BY 1)) AS by_issue_type,
    round(avg(confidence), 6) AS avg_confidence FROM applied_fixes""",
)
def _audit_summary(spark, sf):
    out = scoring.audit_summary(scoring.audit_log(_fix_log(spark, sf)))
    pairs = F.transform(F.map_entries("by_issue_type"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.select("total_fixes", F.array_join(pairs, "|").alias("by_issue_type"), F.round("avg_confidence", 6).alias("avg_confidence"))


@query(
    "quality_report",
    f"""{with_views('applied_fixes')} SELECT 'customer' AS dataset_id, count(*) AS issues_fixed, count(*) FILTER (WHERE confidence < 0.7) AS issues_skipped,
    round(avg(confidence), 4) AS overall_confidence, count(*) FILTER (WHERE issue_type = 'missing') AS missing_fixed FROM applied_fixes""",
)
def _report(spark, sf):
    out = scoring.quality_report(
        _fix_log(spark, sf), dataset_id="customer", total_rows=0, total_columns=5, issues_detected=0, score_before=0.0,
        iterations=1, validation_passed=True,
    )
    return out.select("dataset_id", "issues_fixed", "issues_skipped", "overall_confidence", F.col("fix_breakdown")["missing"].alias("missing_fixed"))


@query(
    "stage_rollup",
    """WITH r AS (SELECT o_orderpriority AS stage, o_orderkey AS run, CASE WHEN o_orderpriority = '1-URGENT' THEN 'success' ELSE
        CASE o_orderstatus WHEN 'P' THEN 'partial' ELSE 'success' END END AS status,
        cast(cast(o_totalprice AS decimal(18,2)) AS double) AS duration_ms, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.5 END AS confidence_score, o_orderstatus AS summary FROM orders)
    SELECT stage, CASE WHEN bool_and(status = 'success') THEN 'success' ELSE 'partial' END AS status, round(sum(duration_ms), 1) AS duration_ms,
           count(*) AS chunk_runs, round(avg(confidence_score), 4) AS confidence_score, arg_max(summary, run) AS summary FROM r GROUP BY stage""",
)
def _stages(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "success").when(F.col("o_orderstatus") == "P", "partial").otherwise("success")
    runs = o.select(
        F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("run"), status.alias("status"), F.col("o_totalprice").alias("duration_ms"),
        F.when(F.col("o_orderkey") % 3 != 0, 0.5).alias("confidence_score"), F.col("o_orderstatus").alias("summary"),
    )
    return scoring.stage_rollup(runs).withColumn("duration_ms", F.round("duration_ms", 1))


@query(
    "chunk_results",
    f"""{_actions_cte('dirty_customer')}, c AS (
      SELECT row_no // 500 AS chunk_id, 1 AS r, 0 AS f, 0 AS x, 0 AS q FROM dirty_customer
      UNION ALL SELECT row_no // 500, 0, 1, 0, 0 FROM findings
      UNION ALL SELECT row_no // 500, 0, 0, 1, CASE WHEN confidence < 0.8 THEN 1 ELSE 0 END FROM actions)
    SELECT chunk_id, CAST(sum(r) AS BIGINT) AS rows, CAST(sum(f) AS BIGINT) AS findings, CAST(sum(x) AS BIGINT) AS fixes, CAST(sum(q) AS BIGINT) AS reviews
    FROM c GROUP BY chunk_id""",
)
def _chunks(spark, sf):
    v = view(spark, sf, "dirty_customer")
    facts = sc.facts_of(v, COLUMNS["dirty_customer"], row_col=R)
    found, actions = an.detect(v, facts, row_col=R), rp.repair(v, facts, row_col=R).actions
    return scoring.chunk_summary(rows.with_chunk_id(v, 500, R), found, actions, 500, 0.8)


# ---- evaluation -------------------------------------------------------------------------


def _applied_truth(spark, sf, extra=()) -> tuple[DataFrame, DataFrame]:
    a = view(spark, sf, "applied_fixes").select(F.col(R).alias("row"), F.col("column_name").alias("column"), "new_value", *extra)
    t = view(spark, sf, "truth_fixes").select(F.col(R).alias("row"), F.col("column_name").alias("column"), "expected_value", *extra)
    return a, t


def _eval_sql(by: str = "") -> str:
    """Semi and anti joins; ``by`` groups the measures."""
    key = f"{by} AS dataset, " if by else ""
    on = "AND a.dataset = t.dataset" if by else ""
    group, sel = ("GROUP BY dataset", "dataset, ") if by else ("", "")
    join = "USING (dataset)" if by else "ON true"
    return f"""{with_views('applied_fixes', 'truth_fixes')},
    a AS (SELECT {key}row_no, column_name, new_value AS v FROM applied_fixes), t AS (SELECT {key}row_no, column_name, expected_value AS v FROM truth_fixes),
    pa AS (SELECT {sel}count(*) AS n,
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM t WHERE t.row_no = a.row_no AND t.column_name = a.column_name AND t.v = a.v {on})) AS hit,
           count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.row_no = a.row_no AND t.column_name = a.column_name {on})) AS stray FROM a {group}),
    pt AS (SELECT {sel}count(*) AS n,
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM a WHERE t.row_no = a.row_no AND t.column_name = a.column_name AND t.v = a.v {on})) AS hit,
           count(*) FILTER (WHERE EXISTS (SELECT 1 FROM a WHERE t.row_no = a.row_no AND t.column_name = a.column_name {on})) AS touched FROM t {group})
    SELECT {sel}round(pa.hit / pa.n, 4) AS precision, round(pt.hit / pt.n, 4) AS recall,
           round(2 * (pa.hit / pa.n) * (pt.hit / pt.n) / (pa.hit / pa.n + pt.hit / pt.n), 4) AS f1_score, round(pa.stray / pa.n, 4) AS false_positive_rate,
           round(pt.touched / pt.n, 4) AS coverage, pa.n AS total_applied, pt.n AS total_ground_truth FROM pa JOIN pt {join}"""


@query("eval_metrics", _eval_sql())
def _eval(spark, sf):
    return ev.evaluate(*_applied_truth(spark, sf))


@query("eval_by_dataset", _eval_sql("row_no % 3"))
def _eval_by(spark, sf):
    a, t = _applied_truth(spark, sf)
    part = (F.col("row") % 3).alias("dataset")
    return ev.evaluate(a.select("*", part), t.select("*", part), ["dataset"])


@query(
    "false_positives",
    f"""{with_views('applied_fixes', 'truth_fixes')} SELECT row_no AS "row", column_name AS "column", new_value FROM applied_fixes a
    WHERE NOT EXISTS (SELECT 1 FROM truth_fixes t WHERE t.row_no = a.row_no AND t.column_name = a.column_name)""",
)
def _false_positives(spark, sf):
    return ev.wrong_cells(*_applied_truth(spark, sf))


@query(
    "covered_cells",
    f"""{with_views('applied_fixes', 'truth_fixes')} SELECT row_no AS "row", column_name AS "column" FROM applied_fixes
    INTERSECT SELECT row_no, column_name FROM truth_fixes""",
)
def _covered(spark, sf):
    return ev.covered_cells(*_applied_truth(spark, sf))


# ---- reconstruction ---------------------------------------------------------------------

ORDER_SPEC = rc.RecordSpec(
    ("Order_ID", "First_Name", "Last_Name", "Order_Date", "Total"), ("id", "first_name", "last_name", "date", "currency")
)
_LINES = f"""{with_views('squeezed_orders')},
    lines AS (SELECT row_no, trim(blob) AS line, string_split(trim(blob), '|') AS parts FROM squeezed_orders),
    kinds AS (SELECT *, CASE WHEN line = '' THEN 'NOISE' WHEN line LIKE 'Order ID |%' THEN 'HEADER' WHEN len(parts) >= 4 THEN 'FULL_RECORD'
                   WHEN len(parts) = 1 AND len(regexp_split_to_array(line, '\\s+')) <= 2 THEN 'PARTIAL_RECORD' ELSE 'NOISE' END AS kind FROM lines)"""
# In this input a partial line follows the record it completes, and only such a record lacks its last name.
_RECORDS = f"""{_LINES},
    islands AS (SELECT *, max(CASE WHEN kind = 'FULL_RECORD' THEN row_no END) OVER (ORDER BY row_no) AS island FROM kinds),
    fulls AS (SELECT row_no AS seq, trim(parts[1]) AS order_id, trim(parts[2]) AS first_name, trim(parts[3]) AS last_name, trim(parts[4]) AS order_date,
              regexp_replace(regexp_replace(trim(parts[5]), '^[^0-9\\-]+', ''), '[,\\s]', '', 'g') AS total FROM islands WHERE kind = 'FULL_RECORD'),
    tails AS (SELECT island AS seq, min_by(line, row_no) AS token FROM islands WHERE kind = 'PARTIAL_RECORD' GROUP BY island),
    records AS (SELECT seq, order_id, first_name, CASE WHEN last_name = '' THEN coalesce(token, '') ELSE last_name END AS last_name, order_date, total,
                CASE WHEN length(order_id) BETWEEN 2 AND 12 THEN 1.0 ELSE 0.85 END AS confidence FROM fulls LEFT JOIN tails USING (seq)),
    firsts AS (SELECT *, count(*) OVER w AS copies, row_number() OVER (w ORDER BY seq) AS place FROM records
               WINDOW w AS (PARTITION BY md5(lower(concat_ws('|', order_id, first_name, last_name, order_date, total)))))"""


@query("reconstruct_classify", f"""{_LINES} SELECT row_no AS "row", kind, CASE WHEN line = '' THEN 0 ELSE len(parts) END AS parts FROM kinds""")
def _classify(spark, sf):
    return rc.classify(view(spark, sf, "squeezed_orders"), ORDER_SPEC, R).select("row", "kind", F.size("parts").cast("bigint").alias("parts"))


@query(
    "reconstruct_score",
    f"""{_RECORDS} SELECT seq, order_id AS "Order_ID", last_name AS "Last_Name", total AS "Total", round(confidence, 4)::DOUBLE AS confidence FROM records""",
)
def _score(spark, sf):
    records, _ = rc.build_records(view(spark, sf, "squeezed_orders"), ORDER_SPEC, R)
    return records.select("seq", "rec.Order_ID", "rec.Last_Name", "rec.Total", F.round("confidence", 4).alias("confidence"))


@query(
    "reconstruct_dedupe",
    f"""{_RECORDS} SELECT seq, order_id AS "Order_ID", copies FROM firsts WHERE place = 1""",
)
def _dedupe(spark, sf):
    records, _ = rc.build_records(view(spark, sf, "squeezed_orders"), ORDER_SPEC, R)
    return rc.drop_repeats(records, ORDER_SPEC).select("seq", "rec.Order_ID", "copies")


@query(
    "reconstruct_records",
    f"""{_RECORDS} SELECT row_number() OVER (ORDER BY seq) - 1 AS row_no, order_id AS "Order_ID", first_name AS "First_Name", last_name AS "Last_Name",
    order_date AS "Order_Date", total AS "Total", round(confidence, 4)::DOUBLE AS confidence FROM firsts WHERE place = 1""",
)
def _reconstruct(spark, sf):
    out, _ = rc.reconstruct(view(spark, sf, "squeezed_orders"), ORDER_SPEC, R)
    return out.withColumn("confidence", F.round("_confidence", 4)).drop("_confidence")


@query(
    "reconstruct_report",
    f"""{_RECORDS} SELECT (SELECT count(*) FROM records) AS rows_parsed,
    (SELECT count(*) FROM kinds) - (SELECT count(*) FROM records) - (SELECT count(*) FROM kinds WHERE kind = 'PARTIAL_RECORD') AS rows_dropped,
    (SELECT count(*) FROM firsts WHERE place > 1) AS duplicates_removed, (SELECT count(*) FROM firsts WHERE place = 1) AS output_rows, false AS skipped""",
)
def _reconstruct_report(spark, sf):
    return rc.reconstruct(view(spark, sf, "squeezed_orders"), ORDER_SPEC, R)[1].drop("reason")


@query(
    "planner_sample",
    f"""{with_views('customer_text')} SELECT '[' || string_agg(to_json({{'id': id, 'name': name, 'nation': nation, 'balance': balance, 'segment': segment}}), ', ' ORDER BY row_no) || ']' AS sample
    FROM customer_text WHERE row_no < 20""",
)
def _planner_sample(spark, sf):
    return rc.planner_sample(view(spark, sf, "customer_text"), row_col=R)


# ---- browse -----------------------------------------------------------------------------


@query("page", f"{with_views('customer_text')} SELECT * FROM customer_text ORDER BY row_no LIMIT 50 OFFSET 50")
def _page(spark, sf):
    return browse.page(view(spark, sf, "customer_text"), 2, 50, R)


@query(
    "page_info",
    f"{with_views('customer_text')} SELECT 2 AS page, 50 AS page_size, count(*) AS total_rows, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM customer_text",
)
def _page_info(spark, sf):
    return browse.page_info(view(spark, sf, "customer_text"), 2, 50)


@query("preview", f"{with_views('dirty_customer')} SELECT * FROM dirty_customer ORDER BY row_no LIMIT 100")
def _preview(spark, sf):
    return browse.preview(view(spark, sf, "dirty_customer"), 100, R)[0]


@query(
    "preview_info",
    f"{with_views('dirty_customer')} SELECT count(*) AS row_count, 'name,balance,segment,note' AS column_names, count(*) > 100 AS truncated FROM dirty_customer",
)
def _preview_info(spark, sf):
    info = browse.preview(view(spark, sf, "dirty_customer"), 100, R)[1]
    return info.withColumn("column_names", F.array_join("column_names", ","))


@query(
    "search_sort",
    f"""{with_views('dirty_customer')} SELECT * FROM dirty_customer WHERE {' OR '.join(f"contains(lower(coalesce(nullif({c}, ''), '—')), 'build')" for c in COLUMNS['dirty_customer'])}
    ORDER BY lower(coalesce(nullif(name, ''), '—')) DESC, row_no LIMIT 12 OFFSET 12""",
)
def _search_sort(spark, sf):
    return browse.search_sort(view(spark, sf, "dirty_customer"), " BUILD ", "name", True, 2, row_col=R)


@query(
    "table_diff",
    f"""{with_views('customer_text', 'dirty_customer')}, p AS (
      SELECT coalesce(c.row_no, d.row_no) AS row_no, unnest(['id', 'name', 'nation', 'balance', 'segment', 'note']) AS col,
             unnest([c.id, c.name, c.nation, c.balance, c.segment, NULL]) AS a, unnest([NULL, d.name, NULL, d.balance, d.segment, d.note]) AS b
      FROM customer_text c FULL JOIN dirty_customer d USING (row_no)),
    q AS (SELECT row_no, col, a, b FROM p)
    SELECT row_no AS "row", col AS "column", a AS old_value, b AS new_value FROM q WHERE a IS DISTINCT FROM b""",
)
def _table_diff(spark, sf):
    return browse.table_diff(view(spark, sf, "customer_text"), view(spark, sf, "dirty_customer"), R)


@query(
    "row_index",
    """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_no, o_orderkey,
    (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 5000 AS chunk_id FROM orders""",
)
def _row_index(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey")
    return rows.with_chunk_id(rows.with_row_index(o, ["o_orderdate", "o_orderkey"], "row_no"), 5000, "row_no").drop("o_orderdate")


# ---- whole runs -------------------------------------------------------------------------


@query(
    "clean_report",
    f"""{_actions_cte('dirty_customer')} SELECT 'customer' AS dataset_id, (SELECT count(*) FROM dirty_customer) AS total_rows, 4 AS total_columns,
    (SELECT count(*) FROM findings) AS issues_detected, count(*) AS issues_fixed, count(*) FILTER (WHERE confidence < 0.7) AS issues_skipped,
    round(avg(confidence), 4) AS overall_confidence FROM actions""",
)
def _clean_report(spark, sf):
    # one pass: the SQL states a single pass over the table
    result = clean(view(spark, sf, "dirty_customer"), row_col=R, dataset_id="customer", config=CleanConfig(max_passes=1))
    return result.report.select(
        "dataset_id", "total_rows", "total_columns", "issues_detected", "issues_fixed", "issues_skipped", "overall_confidence"
    )


@query("clean_table", f"{_actions_cte('dirty_customer')} SELECT d.row_no AS row_id, {_FIXED} FROM dirty_customer d LEFT JOIN actions a ON a.row_no = d.row_no GROUP BY d.row_no")
def _clean_table(spark, sf):
    result = clean(view(spark, sf, "dirty_customer"), row_col=R, config=CleanConfig(max_passes=1))
    return result.cleaned.withColumnRenamed(rows.ROW, "row_id")


_METER = f"""{_actions_cte('dirty_meter')},
    once AS (SELECT cells.row_no, cells.col, cells.v AS v0, coalesce(a.new_value, cells.v) AS v
             FROM ({cells_sql('dirty_meter')}) cells LEFT JOIN actions a ON a.row_no = cells.row_no AND a.col = cells.col),
    again AS (SELECT row_no, col, v, 'type_mismatch' AS kind, {_NEW} AS new_value, {_NAME} AS rule, {_CONF} AS confidence
              FROM once JOIN schema_of USING (col) WHERE dtype IN ('integer', 'float') AND {PRESENT} AND {NUM} IS NULL AND ({_FIRES})),
    twice AS (SELECT once.row_no, once.col, v0, coalesce(again.new_value, once.v) AS v FROM once LEFT JOIN again ON again.row_no = once.row_no AND again.col = once.col),
    logged AS (SELECT row_no, col, v, new_value, rule, confidence, kind FROM actions UNION ALL SELECT row_no, col, v, new_value, rule, confidence, kind FROM again),
    sides AS (SELECT col, TRY_CAST(v0 AS DOUBLE) AS x, 1 AS a, 0 AS b FROM twice UNION ALL SELECT col, TRY_CAST(v AS DOUBLE), 0, 1 FROM twice), {_KS},
    verdict AS (SELECT coalesce(bool_or(least(n, m) >= 10 AND p < 0.01), false) AS drifted FROM p)"""


def _meter_run(spark, sf):
    """A run whose imputed readings drift, so that the loop goes on until a pass changes nothing."""
    return clean(view(spark, sf, "dirty_meter"), row_col=R, dataset_id="meter")


@query(
    "clean_loop_report",
    f"""{_METER}
    SELECT 'meter' AS dataset_id, (SELECT count(*) FROM dirty_meter) AS total_rows, 2 AS total_columns, (SELECT count(*) FROM findings) AS issues_detected,
           count(*) AS issues_fixed, count(*) FILTER (WHERE confidence < 0.7) AS issues_skipped, round(avg(confidence), 4) AS overall_confidence,
           (SELECT string_agg(kind || ':' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM logged GROUP BY kind)) AS fix_breakdown,
           CASE WHEN (SELECT drifted FROM verdict) THEN 3 ELSE 1 END AS iterations, NOT (SELECT drifted FROM verdict) AS validation_passed,
           count(*) AS total_fixes, (SELECT greatest(1, (count(*) + 49999) // 50000) FROM dirty_meter) AS chunks_processed FROM logged""",
)
def _loop_report(spark, sf):
    report = _meter_run(spark, sf).report.drop("duration_seconds", "data_quality_score_before")
    entries = F.transform(F.array_sort(F.map_entries("fix_breakdown")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return report.withColumn("fix_breakdown", F.array_join(entries, ","))


@query(
    "clean_loop_table",
    f"""{_METER} SELECT row_no AS row_id, max(v) FILTER (WHERE col = 'reading') AS reading, max(v) FILTER (WHERE col = 'kind') AS kind FROM twice GROUP BY row_no""",
)
def _loop_table(spark, sf):
    return _meter_run(spark, sf).cleaned.withColumnRenamed(rows.ROW, "row_id")


@query(
    "clean_loop_actions",
    f"""{_METER} SELECT row_no AS "row", col AS "column", v AS old_value, new_value, rule, cast(confidence AS double) AS confidence, kind AS issue_type FROM logged""",
)
def _loop_actions(spark, sf):
    return _action_cols(_meter_run(spark, sf).actions)


def _meter_stream(spark, sf) -> str:
    """Events as a stream of files, cleaned batch by batch; where the batches were written."""
    out = f"{shared_dir(spark).rstrip('/')}/cellwright/stream-{uuid4().hex}"
    # as a glob, since a plain path of a stream must be a folder
    events = batches.file_stream(spark, f"{sf}/{{events}}.parquet", table(spark, sf, "events").schema)
    meter = spark.sql(VIEWS["dirty_meter"].replace("FROM events", "FROM {events}"), events=events)
    batches.clean_batches(meter, f"{out}/batches", f"{out}/progress", row_col=R).awaitTermination()
    return f"{out}/batches"


@query(
    "stream_clean",
    f"""{_METER} SELECT row_no AS row_id, max(v) FILTER (WHERE col = 'reading') AS reading, max(v) FILTER (WHERE col = 'kind') AS kind FROM twice GROUP BY row_no""",
)
def _stream_clean(spark, sf):
    # all files there are make one batch
    return batches.read_batches(spark, _meter_stream(spark, sf)).select(F.col(rows.ROW).alias("row_id"), "reading", "kind")


@query(
    "stream_counts",
    f"""{with_views('dirty_meter')} SELECT col AS "column", v AS value, count(*) AS n FROM ({cells_sql('dirty_meter')}) cells GROUP BY 1, 2""",
)
def _stream_counts(spark, sf):
    return batches.merged_counts(spark, _meter_stream(spark, sf))


_MANY_RARE = f"""{with_views('event_users')}, cells AS ({cells_sql('event_users')}),
    freq AS (SELECT col, v, count(*) AS n FROM cells WHERE {PRESENT} GROUP BY col, v),
    sizes AS (SELECT col, sum(n) AS present, count(*) AS kinds FROM freq GROUP BY col),
    low AS (SELECT freq.* FROM freq JOIN sizes USING (col) WHERE present >= 20 AND kinds / present <= 0.5 AND n <= greatest(1, floor(present * 0.01)))"""


@query(
    "rare_categories_all",
    f"""{_MANY_RARE} SELECT row_no AS "row", cells.col AS "column", cells.v AS value, 'rare_category' AS anomaly_type, 'info' AS severity,
    concat('Value ''', cells.v, ''' appears only ', n, ' time(s)') AS details FROM cells JOIN low ON low.col = cells.col AND low.v = cells.v""",
)
def _rare_all(spark, sf):
    """Columns with hundreds of rare values, without the limit of fifty."""
    config = CleanConfig(rare_max_values=None)
    marked, facts = sc.facts_with_rare(view(spark, sf, "event_users"), COLUMNS["event_users"], config, R)
    return an.detect(marked, facts, config, R).where("anomaly_type = 'rare_category'")


_OTHERS = {c: ", ".join(f"'{o}', d.{o}" for o in COLUMNS["dirty_customer"] if o != c) for c in COLUMNS["dirty_customer"]}


@query(
    "repair_context_whole",
    f"""{_actions_cte('dirty_customer')},
    picked AS (SELECT col, v FROM (SELECT DISTINCT col, v FROM cells WHERE v IS NOT NULL AND v <> '') QUALIFY row_number() OVER (PARTITION BY col ORDER BY md5(v), v) <= 15),
    samples AS (SELECT col, string_agg(v, '|' ORDER BY v) AS s FROM picked GROUP BY col)
    SELECT f.row_no AS "row", f.col AS "column", f.v AS value, dtype, coalesce(fmt, 'none') AS format_pattern, s AS sample_values,
           CASE f.col {' '.join(f"WHEN '{c}' THEN CAST(json_object({o}) AS VARCHAR)" for c, o in _OTHERS.items())} END AS other_columns
    FROM fixes f JOIN schema_of ON schema_of.col = f.col JOIN dirty_customer d ON d.row_no = f.row_no LEFT JOIN samples ON samples.col = f.col WHERE rule IS NULL""",
)
def _context_whole(spark, sf):
    v = view(spark, sf, "dirty_customer")
    facts = sc.facts_of(v, COLUMNS["dirty_customer"], row_col=R)
    out = rp.repair_context(rp.repair(v, facts, row_col=R).unresolved, v, facts, row_col=R)
    return out.withColumn("sample_values", F.array_join("sample_values", "|"))


_EXTERNAL = """SELECT row_no AS "row", col AS "column", 'ext' AS model, v AS old_value, new_value, cast(confidence AS double) AS confidence,
    'source system' AS reasoning, kind AS issue_type FROM proposed"""


@query("external_log", f"{_PROPOSED} {_EXTERNAL}")
def _external_fixes(spark, sf):
    return rp.external_log(_repaired(spark, sf, proposals=_proposals(spark, sf)).actions).drop("structured_output")


@query(
    "external_log_page",
    f"""{_PROPOSED}, listed AS ({_EXTERNAL}) SELECT listed.*, (SELECT count(*) FROM listed) AS count FROM listed ORDER BY "row", "column" LIMIT 5 OFFSET 5""",
)
def _external_page(spark, sf):
    """The second page of the log of outside fixes, beside the count of all."""
    log = cut(rp.external_log(_repaired(spark, sf, proposals=_proposals(spark, sf)).actions).drop("structured_output"), "log")
    listed, info = browse.listing(log, ["row", "column"], 2, 5)
    return listed.withColumn("count", F.lit(info.first()["total_rows"]))


# ---- sources and sinks: written, read again, compared with the table ----------------------


def _written(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cellwright/{name}-{uuid4().hex}"


@query(
    "read_back",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS text_md5 FROM documents",
)
def _read_back(spark, sf):
    """Documents as CSV and back: their texts hold line feeds, quotes and separators in quoted cells."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    df = readers.load(spark, writers.save_csv(docs, _written(spark, "documents") + ".csv"))
    return df.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("read_back_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def _read_back_tsv(spark, sf):
    path = _written(spark, "customer") + ".tsv"
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("sep", "\t").csv(path)
    return readers.load(spark, path)


@query("read_back_latin", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang FROM documents WHERE lang IN ('fr', 'de', 'es')")
def _read_back_latin(spark, sf):
    """A file that isn't UTF-8: each language's name stands beside a letter of Latin-1, which has to come back."""
    docs = table(spark, sf, "documents").where("lang in ('fr', 'de', 'es')").select("doc_id", F.concat("lang", F.lit("é")).alias("lang"))
    path = _written(spark, "latin") + ".csv"
    docs.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.load(spark, path).where(F.col("lang").endswith("é")).select("doc_id", F.regexp_replace("lang", "é$", "").alias("lang"))


@query("read_back_parquet", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders")
def _read_back_parquet(spark, sf):
    path = _written(spark, "orders") + ".parquet"
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate")).write.parquet(path)
    return readers.load(spark, path)


@query("read_back_query", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _read_back_query(spark, sf):
    """A query over the catalog as a source."""
    table(spark, sf, "nation").createOrReplaceTempView("cellwright_nation")
    return readers.load_sql(spark, "SELECT n_nationkey, n_name FROM cellwright_nation WHERE n_regionkey = 1")


@query(
    "audit_export",
    f"""{_actions_cte('dirty_customer')} SELECT row_no AS "row", col AS "column", v AS old_value, new_value, 2 * count(*) AS n FROM actions GROUP BY ALL""",
)
def _audit_export(spark, sf):
    """The audit log, appended twice as JSON lines, exported and read again."""
    path, out = _written(spark, "audit"), _written(spark, "export")
    log = cut(_action_cols(_repaired(spark, sf).actions), "log")
    for _ in range(2):
        writers.append_audit(log, path)
    writers.export_audit(spark.read.schema(log.schema).json(path), out)
    back = spark.read.schema(log.schema).json(out)
    return back.groupBy("row", "column", "old_value", "new_value").agg(F.count("*").alias("n"))
