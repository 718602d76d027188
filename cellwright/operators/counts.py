"""Value counts: the one shuffle that feeds types, profiles, modes, quantiles and drift.

``counts(column, value, n)`` holds each distinct text of each column once. Repeats collapse on
the map side, so a value that fills a third of the table costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import to_num
from ..session import cut
from .rows import ROW, all_cells, data_columns

# Bits of one digit of a number's order image: no group of a refinement has more members than a digit has values.
DIGIT = 16
LEVELS = 64 // DIGIT


def cell_counts(df: DataFrame, columns: list[str] | None = None, row_col: str = ROW) -> DataFrame:
    columns = columns or data_columns(df, row_col)
    return all_cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def counts_after(counts: DataFrame, actions: DataFrame) -> DataFrame:
    """Counts of the repaired table from the counts before and the change log alone."""
    gone = actions.select("column", F.col("old_value").alias("value"), F.lit(-1).cast("bigint").alias("n"))
    come = actions.select("column", F.col("new_value").alias("value"), F.lit(1).cast("bigint").alias("n"))
    return (
        counts.unionByName(gone).unionByName(come)
        .groupBy("column", "value").agg(F.sum("n").alias("n"))
        .where("n > 0")
    )


def numbers(counts: DataFrame) -> DataFrame:
    """Distinct numbers with their counts; ``10`` and ``10.0`` are the same number."""
    return (
        counts.select("column", to_num(F.col("value")).alias("x"), "n")
        .where(F.col("x").isNotNull())
        # adding 0.0 folds -0.0 into 0.0
        .groupBy("column", (F.col("x") + F.lit(0.0)).alias("x")).agg(F.sum("n").alias("n"))
    )


def order_image(x: Column) -> Column:
    """A bigint for each double, in the same order and different for different numbers: exponent and mantissa side by side.

    Powers of two and divisions by them are exact, so the exponent, guessed from the logarithm, is put right by comparison.
    """
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    power = guess + F.when(a >= F.pow(F.lit(2.0), guess + 1), 1).when(a < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    mantissa = ((a / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0**52)).cast("bigint")
    size = (
        F.when(a == float("inf"), F.lit(2047 << 52))
        .when(a < F.lit(2.0**-1022), (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise((power + 1023) * F.lit(1 << 52) + mantissa)
    )
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x < 0, -size).otherwise(size).cast("bigint")


def digits(image: Column, level: int) -> Column:
    """The first ``level`` digits of an order image."""
    return F.shiftright(image, 64 - DIGIT * level)


def exact_quantiles(nums: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per column, one output column per name in ``probs``.

    Radix refinement: a histogram over the first digit of the numbers' order images finds the groups that hold the wanted
    ranks; only their members go on to the next digit, until all digits are known. A group is ordered by a digit of
    ``DIGIT`` bits, so none has more than 2 ** ``DIGIT`` members, however close the numbers lie. No column is sorted as a
    whole, and no sketch is merged in a single task.
    """
    # an image costs far more than reading one, and each level reads them
    imaged = cut(nums.select("column", order_image(F.col("x")).alias("image"), "x", "n"), "images")
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(part).alias("part"), rounder(pos).cast("bigint").alias("rank"), pos.alias("pos"))
            for name, p in probs.items()
            for pos in [(F.col("total") - 1) * F.lit(float(p))]
            for part, rounder in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    totals = nums.groupBy("column").agg(F.sum("n").alias("total"))
    targets = totals.select("column", F.lit(0).cast("bigint").alias("prefix"), F.explode(wanted).alias("w")).select("column", "prefix", "w.*")
    for level in range(1, LEVELS + 1):
        # two ranks per name and column: a table bounded by the number of columns
        targets = cut(targets.select("column", "prefix", "name", "part", "rank", "pos"), "ranks")
        above = digits(F.col("image"), level - 1) if level > 1 else F.lit(0).cast("bigint")
        held = imaged.withColumn("prefix", above).join(F.broadcast(targets.select("column", "prefix").distinct()), ["column", "prefix"])
        hist = held.groupBy("column", "prefix", digits(F.col("image"), level).alias("digit")).agg(F.sum("n").alias("n"), F.max("x").alias("x"))
        upto = F.sum("n").over(Window.partitionBy("column", "prefix").orderBy("digit"))
        found = hist.withColumn("below", upto - F.col("n")).join(F.broadcast(targets), ["column", "prefix"])
        found = found.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        targets = found.select("column", F.col("digit").alias("prefix"), "name", "part", (F.col("rank") - F.col("below")).alias("rank"), "pos", "x")
    out = []
    for name in probs:
        lo = F.max(F.when((F.col("name") == name) & (F.col("part") == "lo"), F.col("x")))
        hi = F.max(F.when((F.col("name") == name) & (F.col("part") == "hi"), F.col("x")))
        pos = F.max(F.when(F.col("name") == name, F.col("pos")))
        # lo == hi covers infinities, where the difference is not a number
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return targets.groupBy("column").agg(*out)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def moments(nums: DataFrame) -> DataFrame:
    """Count, mean, deviations, sample skewness and kurtosis per column, in two exact passes.

    Every step is a partial aggregate; one row per column is broadcast in between.
    """
    base = nums.groupBy("column").agg(
        F.sum("n").alias("numeric_count"),
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    d = F.col("x") - F.col("mean")
    central = (
        nums.join(F.broadcast(base.select("column", "mean")), "column")
        .groupBy("column")
        .agg(
            F.sum(F.col("n") * d * d).alias("m2"),
            F.sum(F.col("n") * d * d * d).alias("m3"),
            F.sum(F.col("n") * d * d * d * d).alias("m4"),
        )
    )
    n, m2, m3, m4 = (F.col(c) for c in ("numeric_count", "m2", "m3", "m4"))
    flat = m2 <= F.lit(1e-14)
    skew = F.when(n <= 2, 0.0).when(flat, 0.0).otherwise(
        (m3 / n) / F.pow(m2 / n, 1.5) * F.sqrt(n * (n - 1.0)) / (n - 2.0)
    )
    excess = n * m4 / (m2 * m2) - 3.0
    kurt = F.when(n <= 3, 0.0).when(flat, 0.0).otherwise(
        (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * excess + 6.0)
    )
    return base.join(F.broadcast(central), "column").select(
        "column", "numeric_count", "mean", "min", "max",
        F.when(n > 1, F.sqrt(m2 / (n - 1.0))).otherwise(0.0).alias("std"),
        F.sqrt(m2 / n).alias("std_pop"),
        skew.alias("skew"),
        kurt.alias("kurtosis"),
    )


def numeric_summary(counts: DataFrame) -> DataFrame:
    """Moments and quartiles, one row per column that holds any number."""
    # read four times below, so the text is parsed and collapsed to distinct numbers once
    nums = cut(numbers(counts), "numbers")
    return moments(nums).join(F.broadcast(exact_quantiles(nums, QUARTILES)), "column", "left")


def top_values(counts: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """The ``k`` most frequent values per column; ties go to the smaller value."""
    kept = counts if keep is None else counts.where(keep)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value")))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)
