import pytest
from pyspark.sql import functions as F

from cellwright.functions.rules import FORMAT_RULES, format_fix, normalize, python_title
from cellwright.functions.text import as_text, float_text, is_blank, looks_numeric, round_share, strip, to_num


def fixes(spark, rule, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r["f"] for r in df.select(rule(F.col("v"), F.lit("c")).alias("f")).collect()]


@pytest.mark.parametrize(
    "rule,value,expected",
    [
        ("trim", "  hello   world  ", "hello world"),
        ("trim", "a \tb", "a b"),
        ("date", "01/15/2024", "2024-01-15"),
        ("date", "13/01/2024", "2024-01-13"),
        ("date", "2/30/2024", None),
        ("date", "2024-01-15", None),
        ("date", "01/15/75", "1975-01-15"),
        ("date", "01/15/68", "2068-01-15"),
        ("date", "1/2/0024", "2024-01-02"),
        ("date", "25-12-2023", "2023-12-25"),
        ("date", "1/2-2024", None),
        ("phone", "5551234567", "(555) 123-4567"),
        ("phone", "15551234567", "(555) 123-4567"),
        ("phone", "(555) 123-4567", None),
        ("phone", "25551234567", None),
        ("email", "  HELLO@WORLD.COM  ", "hello@world.com"),
        ("email", "not an email", None),
        ("boolean", "Yes", "true"),
        ("boolean", "0", "false"),
        ("boolean", "true", None),
        ("numeric", "$1,234.56", "1234.56"),
        ("numeric", "12.5", None),
        ("numeric", "-.", None),
        ("numeric", "1-2", None),
    ],
)
def test_rule(spark, rule, value, expected):
    fix = fixes(spark, FORMAT_RULES[rule], [value])[0]
    assert (fix["new_value"] if fix else None) == expected


def test_first_rule_wins_and_carries_its_name(spark):
    fix = fixes(spark, format_fix, ["  HELLO@WORLD.COM  ", "01/15/2024", "plain", " "])
    assert fix[0]["rule"] == "rule:trim_whitespace" and fix[0]["confidence"] == 0.99
    assert fix[1]["rule"] == "rule:date_normalize_date_us"
    assert fix[1]["reasoning"] == "Converted '01/15/2024' to ISO date '2024-01-15' in 'c'"
    assert fix[2] is None and fix[3] is None


def test_normalize_leaves_what_it_cannot_convert(spark):
    df = spark.createDataFrame([("25-12-2023", "maybe", "123")], "d string, b string, p string")
    r = df.select(normalize(F.col("d"), "date_iso"), normalize(F.col("b"), "boolean"), normalize(F.col("p"), "phone_us")).first()
    assert tuple(r) == ("25-12-2023", "maybe", "123")


def test_text_predicates(spark):
    values = ["1", " 12 ", "1d", "1f", "0x1p3", "inf", "NaN", "", "abc", "1e3", None, "1_000", "\x1c "]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    rows = df.select(to_num(v).alias("n"), looks_numeric(v).alias("l"), is_blank(v).alias("b"), strip(v).alias("s")).collect()
    assert [r["n"] for r in rows] == [1.0, 12.0, None, None, None, float("inf"), None, None, None, 1000.0, None, None, None]
    assert [r["l"] for r in rows][:1] == [True] and rows[6]["l"] and rows[11]["l"] and not rows[8]["l"]
    assert [i for i, r in enumerate(rows) if r["b"]] == [7, 10, 12]
    assert rows[1]["s"] == "12" and rows[12]["s"] == ""


def test_number_text_reads_like_python(spark):
    xs = [30.0, 0.1, 12345678.5, 1e16, 1.5e-5, 0.0005, -123456789.25, 0.0, 1e22, 1.234e-7, 9007199254740991.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(float_text(F.col("x"))).collect()] == [repr(x) for x in xs]
    kept = as_text(spark.createDataFrame([(1, 2.5, True, None)], "i int, d double, b boolean, s string")).first()
    assert tuple(kept) == ("1", "2.5", "True", None)


def test_share_rounding_is_exact(spark):
    xs = [i / 20000 for i in range(0, 20001, 7)] + [0.64935, 0.74815, 0.91875, 0.84625]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(round_share(F.col("x"))).collect()] == [round(x, 4) for x in xs]


def test_title_case(spark):
    assert spark.range(1).select(python_title(F.lit("mc-donald x2y o'neil"))).first()[0] == "mc-donald x2y o'neil".title()
