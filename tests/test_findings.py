import random
import statistics

import pytest
from pyspark.sql import functions as F

from cellwright.operators.anomalies import date_formats, date_order_violations, detect, domain_violations, iqr_outliers, missing_required, zscore_outliers
from cellwright.operators.counts import cell_counts, exact_quantiles, numbers, order_image
from cellwright.operators.profile import column_info, duplicate_count, duplicate_rows, null_cells, profile, quality_score, value_counts
from cellwright.operators.rows import carry_forward, with_row_index
from cellwright.operators.schema import facts_of, infer_schema


def test_schema(table):
    t = table(
        ["age", "name", "day", "mail", "none", "mixed"],
        [(str(20 + i), f"n{i}", f"2024-01-{i + 1:02d}", f"u{i}@x.com", "", str(i) if i % 2 else "x") for i in range(10)],
    )
    report, issues = infer_schema(t)
    got = {r["column"]: r for r in report.collect()}
    assert got["age"]["dtype"] == "integer" and not got["age"]["nullable"]
    assert got["day"]["dtype"] == "date" and got["day"]["format_pattern"] == "date_iso"
    assert got["mail"]["dtype"] == "string" and got["mail"]["format_pattern"] == "email"
    assert got["name"]["unique_rate"] == 1.0 and got["none"]["dtype"] == "empty"
    found = {(r["column"], r["issue_type"], r["details"]) for r in issues.collect()}
    assert ("mixed", "mixed_types", "mixed_types: 50.0% numeric, 50.0% non-numeric") in found
    assert ("none", "all_empty", "Column contains no non-empty values") in found


def test_profile_of_one_to_hundred(table):
    t = table(["val", "city"], [(str(i), "a" if i % 4 else None) for i in range(1, 101)])
    p = profile(t)
    rows = {r["column"]: r for r in p.collect()}
    v = rows["val"]
    assert (v["mean"], v["median"], v["q1"], v["q3"]) == (50.5, 50.5, 25.75, 75.25)
    assert v["std"] == round(statistics.stdev(range(1, 101)), 6) and v["skew"] == 0.0
    c = rows["city"]
    assert c["null_count"] == 25 and c["null_pct"] == 25.0 and c["top_values"][0]["count"] == 75
    assert quality_score(p).first()[0] == round((1.0 + (0.75 * 0.7 + 0.15)) / 2, 4)


def test_outliers_need_both_tests(table):
    t = table(["val", "flat"], [(str(i), "5") for i in range(100)] + [("10000", "5")])
    facts = facts_of(t)
    found = detect(t, facts).where("anomaly_type = 'numeric_outlier'").collect()
    assert [(r["row"], r["column"], r["value"]) for r in found] == [(100, "val", "10000")]
    assert [r["row"] for r in zscore_outliers(t, facts["val"]).collect()] == [100]
    assert [r["row"] for r in iqr_outliers(t, facts["val"]).collect()] == [100]
    assert zscore_outliers(t, facts["flat"]).count() == 0


def test_rare_categories(table):
    t = table(["c"], [("a",)] * 300 + [("z",)] * 3 + [("None",)])
    facts = facts_of(t)
    assert facts["c"].rare == {"z": 3}
    rows = detect(t, facts).collect()
    assert sorted(r["row"] for r in rows) == [300, 301, 302]
    assert rows[0]["details"] == "Value 'z' appears only 3 time(s)"


def test_date_order_and_domains(table):
    t = table(
        ["start_date", "end_date", "amount"],
        [("2024-01-02", "2024-01-01", "$1,234.00"), ("2024-01-01", "bad", "x"), ("01/05/2024", "2024-01-09", "")],
    )
    rows = detect(t, {}).collect()
    assert [(r["row"], r["column"], r["severity"]) for r in rows] == [(0, "start_date > end_date", "critical")]
    assert [r["row"] for r in domain_violations(t, "amount", "finance", "currency_pattern").collect()] == [1, 2]
    assert domain_violations(t, "amount", "finance", "nothing").count() == 0
    assert {(r["row"], r["column"]) for r in missing_required(t, "finance").collect()} == {(-1, "transaction_id"), (2, "amount")}


def test_one_date_format_a_column(table):
    t = table(
        ["start_date", "end_date", "end_time"],
        [("25/01/2024", "02/01/2024", "1.2.2024"), ("03/02/2024", "3/1/2024", "x"), ("2024-12-30", "01/25/2024", None), (None, "", "31.31.2024")],
    )
    formats = {r["column"]: (r["format"], r["filled"], r["read"]) for r in date_formats(t, ["start_date", "end_date", "end_time"]).where("chosen").collect()}
    # day first because of the 25th, month first because of the 25th, month first since nothing tells
    assert formats == {"start_date": ("d/M/yyyy", 3, 2), "end_date": ("M/d/yyyy", 3, 3), "end_time": ("M.d.yyyy", 3, 1)}
    rows = date_order_violations(t).collect()
    # 25 January > 2 January; the start in another format than its column's is no date
    assert [(r["row"], r["column"]) for r in rows] == [(0, "start_date > end_time")]
    nothing = table(["start_date", "end_date"], [("never", ""), (None, "2024-01-01")])
    assert date_order_violations(nothing).count() == 0
    assert date_order_violations(table(["a"], [("1",)])).count() == 0


def test_column_reports(table):
    t = table(["a", "b"], [("x", "1"), ("x", "1"), ("y", None), ("x", "1"), ("", "2"), (None, "2")])
    assert [(r["value"], r["count"]) for r in value_counts(t, "a").collect()] == [("x", 3), ("", 1), ("y", 1)]
    info = column_info(t, "a").first()
    assert (info["total"], info["null_count"], info["unique_count"], info["sample_values"]) == (6, 2, 3, ["x", "x", "y", "x", ""])
    assert sorted((r["row"], r["first_row"]) for r in duplicate_rows(t).collect()) == [(1, 0), (3, 0)]
    assert duplicate_count(t).first()[0] == 2
    assert sorted((r["row"], r["column"]) for r in null_cells(t).collect()) == [(2, "b"), (4, "a"), (5, "a")]
    with pytest.raises(ValueError):
        value_counts(t, "nope")


def test_quantiles_are_exact_on_odd_values(spark):
    rng = random.Random(3)
    groups = {
        "tiny": [1e-300, -1e-300, 0.0], "one": [5.0], "near": [1e9 + rng.random() for _ in range(501)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200) for _ in range(400)], "hot": [7.0] * 900 + [1.0, 2.0, 9.5],
    }
    df = spark.createDataFrame([(g, x, 1) for g, xs in groups.items() for x in xs], "column string, x double, n bigint")
    nums = df.groupBy("column", "x").agg(F.sum("n").alias("n"))
    got = {r["column"]: r for r in exact_quantiles(nums, {"q1": 0.25, "m": 0.5, "p9": 0.9}).collect()}
    for g, xs in groups.items():
        xs = sorted(xs)
        for name, p in (("q1", 0.25), ("m", 0.5), ("p9", 0.9)):
            pos = (len(xs) - 1) * p
            lo, hi = xs[int(pos)], xs[min(int(pos) + 1, len(xs) - 1)]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (pos - int(pos)), rel=1e-12)


def test_order_image_is_one_to_one(spark):
    """The image of a double is its bits, negated below zero."""
    import struct

    rng = random.Random(8)
    xs = [0.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), 1.0, 0.1, 3.0, 2.0**53 + 2, 1.6e15 + 1]
    xs += [2.0**k for k in range(-1074, 1024, 7)] + [2.0**k * (1 - 2**-53) for k in range(-1000, 1024, 9)] + [10 ** rng.uniform(-310, 308) for _ in range(3000)]
    xs += [-x for x in xs]
    bits = [struct.unpack("<q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1) for x in xs]
    got = spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", order_image(F.col("x"))).collect()
    assert [r[1] for r in sorted(got)] == bits


def test_close_numbers_do_not_gather(spark, monkeypatch):
    """A million times of day in microseconds: quantiles and drift are right, and no group of a digit is larger than a digit."""
    from cellwright.operators import counts, drift

    start = 1_700_000_000_000_000
    nums = spark.range(300_000).select(F.lit("ts").alias("column"), (F.lit(start) + F.col("id") * 7).cast("double").alias("x"), F.lit(1).cast("bigint").alias("n"))
    assert exact_quantiles(nums, {"q": 0.25, "m": 0.5}).first()[1:] == (start + 7 * 74999.75, start + 7 * 149999.5)
    image = counts.order_image(F.col("x"))
    for level in range(1, counts.LEVELS + 1):
        above = counts.digits(image, level - 1) if level > 1 else F.lit(0)
        assert nums.withColumn("above", above).groupBy("above").agg(F.countDistinct(counts.digits(image, level)).alias("n")).agg(F.max("n")).first()[0] <= 1 << counts.DIGIT
    texts = nums.select("column", F.format_string("%.0f", "x").alias("value"), "n")
    later = texts.where("value >= '1700000000600000'")
    d = drift.ks_statistics(texts, later).first()
    assert (d["n_before"], d["n_after"]) == (300_000, 300_000 - 85_715) and d["d"] == pytest.approx(85_715 / 300_000)


def test_exact_p_value_follows_the_band():
    """Against the count of all lattice paths, and in time for sizes whose product is large."""
    from itertools import combinations

    from cellwright.operators.drift import ks_p_value

    for n, m in ((3, 3), (4, 6), (5, 3), (2, 7)):
        gaps = []
        for up in combinations(range(n + m), n):
            i = j = 0
            worst = 0.0
            for step in range(n + m):
                i, j = (i + 1, j) if step in up else (i, j + 1)
                worst = max(worst, abs(i * m - j * n))
            gaps.append(worst)
        for reach in sorted(set(gaps)):
            assert ks_p_value(reach / (n * m), n, m, "exact") == pytest.approx(sum(g >= reach for g in gaps) / len(gaps))
    # wide bands hold counts of very different sizes
    assert max(ks_p_value(0.165, n, 10_000, "exact") for n in (6334, 9999, 10_000)) < 1e-9
    assert ks_p_value(0.05, 6334, 10_000, "exact") == pytest.approx(ks_p_value(0.05, 6334, 10_000, "series"), rel=0.02)
    assert ks_p_value(0.02, 9_000, 10_000, "exact") == pytest.approx(ks_p_value(0.02, 9_000, 10_000, "series"), abs=2e-4)


def test_row_index_is_dense_under_a_hot_key(spark):
    df = spark.range(0, 3000, numPartitions=7).select((F.col("id") % 3 * 0).alias("k"), "id")
    rows = with_row_index(df, ["k"]).select("_row").collect()
    assert sorted(r[0] for r in rows) == list(range(3000))
    assert [r["id"] for r in with_row_index(df, [F.desc("id")]).orderBy("_row").limit(3).collect()] == [2999, 2998, 2997]


@pytest.mark.parametrize("partitions", [1, 16])
def test_carry_forward_over_many_slices(spark, monkeypatch, partitions):
    from cellwright.operators import rows

    monkeypatch.setattr(rows, "SLICE_BITS", 3)
    df = spark.range(0, 1000, numPartitions=partitions).select(
        F.col("id").alias("r"), F.when((F.col("id") % 37 == 5) & (F.col("id") < 600), F.col("id")).alias("v")
    )
    last = None
    for r in carry_forward(df, "r", ["v"]).orderBy("r").collect():
        last = r["v"] if r["v"] is not None else last
        assert r["v_last"] == last


def test_counts_do_not_depend_on_partitions(table):
    t = table(["v"], [(str(i % 17),) for i in range(500)])
    base = sorted(map(tuple, numbers(cell_counts(t)).collect()))
    for n in (1, 4, 64):
        assert sorted(map(tuple, numbers(cell_counts(t.repartition(n))).collect())) == base


def test_dates_are_read_without_a_parser_that_raises(spark, table):
    from cellwright.functions.dates import moment_readers

    texts = ["2/29/2024", "29/2/2023", "31/31/2020", "0000-01-01", "2024-2-3", "2024-02-30", "1.13.1999", "13.1.1999", "1-2-0001", "2024/12/31", "2024-01-01T10:30", "1/2-2024", "", "n/a", None]
    readers = moment_readers(F.col("t"))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[r.cast("string").alias(n) for n, r in readers.items()]).collect()
    got = {r["t"]: {n: r[n][:10] for n in readers if r[n]} for r in rows if any(r[n] for n in readers)}
    assert got == {
        "2/29/2024": {"M/d/yyyy": "2024-02-29"}, "0000-01-01": {"iso": "0000-01-01"}, "2024-2-3": {"iso": "2024-02-03"}, "1.13.1999": {"M.d.yyyy": "1999-01-13"},
        "13.1.1999": {"d.M.yyyy": "1999-01-13"}, "1-2-0001": {"M-d-yyyy": "0001-01-02", "d-M-yyyy": "0001-02-01"}, "2024/12/31": {"yyyy/M/d": "2024-12-31"},
        "2024-01-01T10:30": {"iso": "2024-01-01"},
    }
    plan = df.select(*readers.values())._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "timestamp(" not in plan.replace("cast", "")
    # an empty table has a row for each column and format, and columns may be of other types than text
    empty = date_formats(table(["a_date", "b_date"], [("x", "y")]).where("false"), ["a_date", "b_date"])
    assert (empty.count(), empty.where("filled = 0 and read = 0 and not chosen").count()) == (16, 16)
    typed = spark.sql("SELECT 1L AS _row, date'2024-01-02' AS start_date, '1/1/2024' AS end_date")
    assert [(r["row"], r["value"]) for r in date_order_violations(typed).collect()] == [(1, "2024-01-02 > 1/1/2024")]


def test_images_are_made_once(spark, monkeypatch):
    """Each level of the refinement reads the images of the numbers, none makes them again."""
    from cellwright.operators import counts

    cuts = []
    monkeypatch.setattr(counts, "cut", lambda df, label="table": cuts.append((label, df)) or df.localCheckpoint())
    nums = spark.range(1, 500).selectExpr("'a' AS column", "cast(id AS double) AS x", "1L AS n")
    assert exact_quantiles(nums, {"half": 0.5}).first()["half"] == 250.0
    making = [label for label, df in cuts if "log2" in df._jdf.queryExecution().optimizedPlan().toString().lower()]
    assert making == ["images"] and sum(label == "ranks" for label, _ in cuts) == counts.LEVELS
