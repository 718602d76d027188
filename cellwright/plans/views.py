"""Dirty inputs derived from the clean test tables, by SQL that reads the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONEY = "cast(cast({0} AS decimal(18,2)) AS string)"

VIEWS: dict[str, str] = {
    "customer_text": f"""
        SELECT c_custkey AS row_no, cast(c_custkey AS string) AS id, c_name AS name,
               cast(c_nationkey AS string) AS nation, {MONEY.format('c_acctbal')} AS balance, c_mktsegment AS segment
        FROM customer""",
    "events_text": f"""
        SELECT event_id AS row_no, cast(cast(ts AS date) AS string) AS day, cast(user_id AS string) AS user_id,
               event_type, {MONEY.format('value')} AS value
        FROM events""",
    "lineitem_text": f"""
        SELECT cast(l_orderkey AS string) AS orderkey, cast(l_partkey AS string) AS partkey,
               cast(l_suppkey AS string) AS suppkey, cast(l_linenumber AS string) AS linenumber,
               {MONEY.format('l_quantity')} AS quantity, {MONEY.format('l_extendedprice')} AS extendedprice,
               {MONEY.format('l_discount')} AS discount, {MONEY.format('l_tax')} AS tax,
               l_returnflag AS returnflag, l_linestatus AS linestatus, cast(cast(l_shipdate AS date) AS string) AS shipdate
        FROM lineitem""",
    "dirty_customer": f"""
        SELECT c_custkey AS row_no,
               CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN concat('  ', c_name, '  x ') ELSE c_name END AS name,
               CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 401 = 0 THEN '99999999'
                    WHEN c_custkey % 5 = 0 THEN concat('$', {MONEY.format('c_acctbal')})
                    ELSE {MONEY.format('c_acctbal')} END AS balance,
               CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey = 3 THEN 'HOUSHOLD' WHEN c_custkey = 5 THEN 'None'
                    ELSE c_mktsegment END AS segment,
               CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ' END AS note
        FROM customer""",
    "dirty_contacts": """
        SELECT c_custkey AS row_no,
               CASE WHEN c_custkey % 10 = 0 THEN concat(' User', cast(c_custkey AS string), '@EXAMPLE.COM ')
                    WHEN c_custkey % 10 = 1 THEN concat('User', cast(c_custkey AS string), '@Example.com')
                    WHEN c_custkey % 10 = 2 THEN 'not-an-email'
                    ELSE concat('user', cast(c_custkey AS string), '@example.com') END AS email,
               CASE WHEN c_custkey % 4 = 0 THEN concat('555', lpad(cast(c_custkey AS string), 7, '0'))
                    WHEN c_custkey % 4 = 1 THEN concat('1555', lpad(cast(c_custkey AS string), 7, '0'))
                    WHEN c_custkey % 4 = 2 THEN concat('555-123-', lpad(cast(c_custkey % 10000 AS string), 4, '0'))
                    ELSE '12345' END AS phone,
               CASE WHEN c_custkey % 6 = 0 THEN concat(cast(1 + c_custkey % 12 AS string), '/', cast(1 + c_custkey % 28 AS string), '/', cast(2000 + c_custkey % 25 AS string))
                    WHEN c_custkey % 6 = 1 THEN concat('2', cast(c_custkey % 10 AS string), '/', lpad(cast(1 + c_custkey % 12 AS string), 2, '0'), '/2021')
                    WHEN c_custkey % 6 = 2 THEN concat('07.1', cast(c_custkey % 10 AS string), '.2024')
                    WHEN c_custkey % 6 = 3 THEN concat('2024/02/', lpad(cast(1 + c_custkey % 31 AS string), 2, '0'))
                    WHEN c_custkey % 6 = 4 THEN concat('01/15/', lpad(cast(c_custkey % 100 AS string), 2, '0'))
                    ELSE concat('2024-01-', lpad(cast(1 + c_custkey % 28 AS string), 2, '0')) END AS signup_date,
               CASE WHEN c_custkey % 5 = 0 THEN 'Yes' WHEN c_custkey % 5 = 1 THEN 'n' WHEN c_custkey % 5 = 2 THEN '1'
                    WHEN c_custkey % 5 = 3 THEN 'true' ELSE 'maybe' END AS flag
        FROM customer""",
    "dirty_periods": """
        SELECT o_orderkey AS row_no, cast(cast(o_orderdate AS date) AS string) AS start_date,
               cast(cast(o_orderdate AS date) + cast(o_orderkey % 10 - 2 AS int) AS string) AS end_date
        FROM orders""",
    "dated_orders": """
        SELECT row_no,
               concat(cast(month(a) AS string), '/', cast(day(a) AS string), '/', cast(year(a) AS string)) AS us_start_date,
               concat(lpad(cast(day(a) AS string), 2, '0'), '.', lpad(cast(month(a) AS string), 2, '0'), '.', cast(year(a) AS string)) AS eu_begin_date,
               concat(cast(1 + day(a) % 12 AS string), '-', cast(month(a) AS string), '-', cast(year(a) AS string)) AS unclear_start_time,
               CASE WHEN row_no % 10 = 0 THEN cast(b AS string) WHEN row_no % 10 = 1 THEN ' ' WHEN row_no % 10 = 2 THEN 'soon'
                    ELSE concat(' ', cast(day(b) AS string), '/', cast(month(b) AS string), '/', cast(year(b) AS string)) END AS mixed_end_date,
               CASE WHEN row_no % 4 = 0 THEN concat(cast(b AS string), ' 10:30:00') WHEN row_no % 40 = 1 THEN '31/31/2020' ELSE cast(b AS string) END AS finish_time,
               'n/a' AS no_end_date
        FROM (SELECT o_orderkey AS row_no, cast(o_orderdate AS date) AS a, cast(o_orderdate AS date) + cast(o_orderkey % 10 - 2 AS int) AS b FROM orders) o""",
    "squeezed_orders": f"""
        SELECT o_orderkey * 4 AS row_no,
               concat(cast(o_orderkey AS string), ' | ', CASE WHEN o_orderkey % 3 = 0 THEN 'Mary' ELSE 'John' END, ' | ',
                      CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Smith' END, ' | ', cast(cast(o_orderdate AS date) AS string),
                      ' | $', {MONEY.format('o_totalprice')}) AS blob
        FROM orders
        UNION ALL SELECT o_orderkey * 4 + 1, CASE WHEN o_orderkey % 6 = 0 THEN 'Jones' ELSE ' ' END FROM orders
        UNION ALL SELECT o_orderkey * 4 + 2,
               CASE WHEN o_orderkey % 50 = 0 THEN 'Order ID | First Name | Last Name | Order Date | Total'
                    WHEN o_orderkey % 50 = 1 THEN 'one two three four' ELSE '' END FROM orders
        UNION ALL SELECT o_orderkey * 4 + 3,
               CASE WHEN o_orderkey % 6 = 1 THEN concat(cast(o_orderkey AS string), ' | JOHN | Smith | ',
                    cast(cast(o_orderdate AS date) AS string), ' | $', {MONEY.format('o_totalprice')}) ELSE '' END
        FROM orders""",
    "dirty_meter": f"""
        SELECT event_id AS row_no,
               CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 40 = 1 THEN concat('  $', {MONEY.format('value')})
                    WHEN event_id % 40 = 2 THEN concat({MONEY.format('value')}, '  %') ELSE {MONEY.format('value')} END AS reading,
               CASE WHEN event_id % 50 = 7 THEN ' ' ELSE event_type END AS kind
        FROM events""",
    "event_clock": """
        SELECT event_id AS row_no, cast(unix_micros AS string) AS micros, cast(unix_micros % 1000003 AS string) AS rest,
               CASE WHEN event_id % 2 = 0 THEN 'none' ELSE NULL END AS nothing
        FROM (SELECT event_id, {MICROS} AS unix_micros FROM events) e""",
    "event_users": """
        SELECT event_id AS row_no, concat('user ', cast(user_id AS string)) AS who, concat(event_type, cast(event_id % 97 * (event_id % 89) % 400 AS string)) AS what
        FROM events""",
    "drift_before": f"SELECT event_id AS row_no, {MONEY.format('value')} AS value FROM events",
    "drift_after": f"""
        SELECT event_id AS row_no, CASE WHEN event_id % 10 = 0 THEN {MONEY.format('value * 10')} ELSE {MONEY.format('value')} END AS value
        FROM events""",
    "applied_fixes": """
        SELECT c_custkey AS row_no, CASE WHEN c_custkey % 5 = 0 THEN 'segment' ELSE 'name' END AS column_name, c_name AS new_value,
               lower(c_name) AS old_value,
               CASE WHEN c_custkey % 3 = 0 THEN 'rule:trim_whitespace' WHEN c_custkey % 3 = 1 THEN 'pattern:.*name.*' ELSE 'llm:ext' END AS rule,
               CASE WHEN c_custkey % 3 = 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0.75 END ELSE 0.95 END AS confidence,
               CASE WHEN c_custkey % 2 = 0 THEN 'missing' ELSE 'format_violation' END AS issue_type
        FROM customer""",
    "truth_fixes": """
        SELECT c_custkey AS row_no, CASE WHEN c_custkey % 7 = 0 THEN 'balance' ELSE 'name' END AS column_name,
               CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE c_name END AS expected_value
        FROM customer""",
    "coded_parts": f"""
        SELECT p_partkey AS row_no,
               CASE WHEN p_partkey % 5 = 0 THEN concat('a', lpad(cast(p_partkey % 100 AS string), 2, '0'))
                    WHEN p_partkey % 5 = 1 THEN concat('J', lpad(cast(p_partkey % 100 AS string), 2, '0'), '.')
                    WHEN p_partkey % 5 = 2 THEN concat(' K', lpad(cast(p_partkey % 100 AS string), 2, '0'), '.', cast(p_partkey AS string))
                    WHEN p_partkey % 5 = 3 THEN NULL ELSE concat('M', lpad(cast(p_partkey % 100 AS string), 2, '0'), ' ') END AS icd,
               CASE WHEN p_partkey % 6 = 0 THEN cast(p_partkey AS string) WHEN p_partkey % 6 = 1 THEN '' ELSE lpad(cast(p_partkey AS string), 10, '1') END AS npi,
               CASE WHEN p_partkey % 3 = 0 THEN lower(concat('X', lpad(cast(p_partkey AS string), 8, '0'))) ELSE concat('X', lpad(cast(p_partkey AS string), 8, '0')) END AS cusip,
               CASE WHEN p_partkey % 4 = 0 THEN concat('-$', {MONEY.format('p_retailprice')}) WHEN p_partkey % 4 = 1 THEN '1,234,567.00'
                    WHEN p_partkey % 4 = 2 THEN '$12,34.00' ELSE cast(p_partkey % 1000 AS string) END AS price,
               CASE WHEN p_partkey % 2 = 0 THEN concat('SKU-', cast(p_partkey AS string)) ELSE p_name END AS sku,
               CASE WHEN p_partkey % 7 = 0 THEN lpad(cast(p_partkey AS string), 13, '0') ELSE lpad(cast(p_partkey AS string), 12, '0') END AS upc
        FROM part""",
    "part_typos": """
        SELECT p_partkey AS row_no,
               CASE WHEN p_partkey % 9 = 0 THEN concat(p_name, 's') WHEN p_partkey % 9 = 1 THEN upper(p_name) ELSE p_name END AS name
        FROM part""",
}
BASES = {
    "customer_text": ["customer"], "events_text": ["events"], "lineitem_text": ["lineitem"], "dirty_customer": ["customer"],
    "dirty_contacts": ["customer"], "dirty_periods": ["orders"], "dated_orders": ["orders"], "squeezed_orders": ["orders"], "drift_before": ["events"],
    "drift_after": ["events"], "dirty_meter": ["events"], "event_clock": ["events"], "event_users": ["events"], "applied_fixes": ["customer"], "truth_fixes": ["customer"], "part_typos": ["part"], "coded_parts": ["part"],
}
COLUMNS = {
    "dated_orders": ["us_start_date", "eu_begin_date", "unclear_start_time", "mixed_end_date", "finish_time", "no_end_date"],
    "dirty_meter": ["reading", "kind"],
    "event_users": ["who", "what"],
    "event_clock": ["micros", "rest", "nothing"],
    "customer_text": ["id", "name", "nation", "balance", "segment"],
    "events_text": ["day", "user_id", "event_type", "value"],
    "lineitem_text": [
        "orderkey", "partkey", "suppkey", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag",
        "linestatus", "shipdate",
    ],
    "dirty_customer": ["name", "balance", "segment", "note"],
    "dirty_contacts": ["email", "phone", "signup_date", "flag"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame; nothing is registered in the catalog."""
    sql = VIEWS[name].replace("{MICROS}", "unix_micros(cast(ts AS timestamp))")
    for base in BASES[name]:
        sql = sql.replace(f"FROM {base}", f"FROM {{{base}}}")
    return spark.sql(sql, **{base: table(spark, sf_dir, base) for base in BASES[name]})


def with_views(*names: str) -> str:
    """The same inputs as a WITH clause."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{MICROS}', 'epoch_us(CAST(ts AS TIMESTAMP))')})" for n in names)


def cells_sql(name: str, columns: list[str] | None = None, row: bool = True) -> str:
    """Long form of a derived input."""
    parts = [
        f"SELECT {'row_no, ' if row else ''}'{c}' AS col, {c} AS v FROM {name}" for c in columns or COLUMNS[name]
    ]
    return " UNION ALL ".join(parts)
