"""Learned fix patterns kept as a small table, and their use on values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import python_title
from ..functions.text import strip
from ..session import cut
from .rows import spread

PATTERN_SCHEMA = (
    "id bigint, column_pattern string, value_pattern string, fix_template string, "
    "domain string, success_count bigint, fail_count bigint"
)
DEFAULT_CONFIDENCE = 0.85  # fixed value: a pattern without history
GENERIC = "generic"
PART = 50_000  # lookups of one key that meet its patterns in one place
GRAM = 4  # characters from which on a literal that matches begin with is taken before longer ones inside
LONGEST_PREFIX = 64
# Characters of the piece that a value is looked up by, where the literal is not its beginning: the largest that fits.
PIECES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def pattern_confidence(success: Column, fail: Column) -> Column:
    return F.coalesce(F.try_divide(success.cast("double"), (success + fail).cast("double")), F.lit(DEFAULT_CONFIDENCE))


def add_patterns(patterns: DataFrame, new: DataFrame) -> DataFrame:
    """Append patterns under fresh ids. Ids follow a dense order, so no single-task window is used."""
    from .rows import with_row_index

    keys = ["column_pattern", "value_pattern", "fix_template", "domain"]
    numbered = with_row_index(new.select(*keys, "success_count", "fail_count"), keys)
    last = patterns.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    return patterns.unionByName(
        numbered.withColumn("id", (F.col("_row") + 1 + last).cast("bigint")).select(*patterns.columns)
    )


def record_outcomes(patterns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add ``(id, success BOOLEAN)`` outcomes to the counters; a new snapshot of the table."""
    tally = outcomes.groupBy("id").agg(
        F.count_if(F.col("success")).alias("_won"), F.count_if(~F.col("success")).alias("_lost")
    )
    return patterns.join(tally, "id", "left").select(
        "id", "column_pattern", "value_pattern", "fix_template", "domain",
        (F.col("success_count") + F.coalesce("_won", F.lit(0))).alias("success_count"),
        (F.col("fail_count") + F.coalesce("_lost", F.lit(0))).alias("fail_count"),
    )


def list_patterns(patterns: DataFrame, domain: str | None = None) -> DataFrame:
    out = patterns if domain is None else patterns.where(F.col("domain") == domain)
    return out.withColumn("confidence", pattern_confidence(F.col("success_count"), F.col("fail_count"))).orderBy(
        F.desc("success_count"), "id"
    )


def apply_template(template: Column, value: Column) -> Column:
    """Put the value into the template, then run the string steps the template names, in fixed order."""
    out = F.replace(template, F.lit("{value}"), value)
    for marker, step in ((".strip()", strip), (".lower()", F.lower), (".upper()", F.upper), (".title()", python_title)):
        out = F.when(template.contains(marker), step(F.replace(out, F.lit(marker), F.lit("")))).otherwise(out)
    return out


def escape_regex(c: Column) -> Column:
    """Escape a text so that it matches itself."""
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-\s#&~])", r"\\$1")


def _expression(pattern: str) -> Column:
    """A pattern anchored at the start, case and character classes by Unicode, in the spelling of Spark's dialect.

    Group names may hold underscores where patterns come from, not in the dialect that runs them; ``\\Z`` is the very end.
    """
    out = F.col(pattern)
    for opening, closing in (("<", ">"), ("=", r"\)")):
        out = F.regexp_replace(out, rf"(?<=\(\?P{opening}\w{{0,64}})_(?=\w*{closing})", "U95U")
    out = F.regexp_replace(F.regexp_replace(out, r"\(\?P<", "(?<"), r"\(\?P=(\w+)\)", r"\\k<$1>")
    out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\Z", r"$1\\z")
    return F.concat(F.lit("(?iU)^(?:"), out, F.lit(")"))


def _valid(pattern: str) -> Column:
    """Whether the dialect that runs an expression compiles it; a broken one would fail the whole job."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), _expression(pattern)).isNotNull()


def required_literal(pattern: str) -> tuple[bool, str]:
    """``(at the start, text)``: a lower-case ASCII text that each match of an expression anchored at the start holds; empty if none is sure.

    Only what stands outside of groups, classes and alternatives is looked at. Where a pattern says more than this scan reads, nothing is sure.
    """
    runs: list[tuple[bool, str]] = []
    run, begins = "", True  # begins: nothing that consumes text lies before the run

    def end() -> None:
        nonlocal run, begins
        if run:
            runs.append((begins, run))
        run, begins = "", False

    i, size = 0, len(pattern)
    while i < size:
        ch, literal = pattern[i], None
        if ch == "|" or ch in ")*+?{":
            return False, ""
        if ch == "\\":
            nxt = pattern[i + 1 : i + 2]
            if not nxt or nxt.isalnum() and nxt not in "dDwWsSbBntrfAZz":
                return False, ""
            literal = nxt if not nxt.isalnum() else None
            i += 2
        elif ch == "[":
            closing = re.compile(r"\[(?!\^?\])(?:[^\]\[\\]|\\.)+\]").match(pattern, i)
            if not closing:
                return False, ""
            i = closing.end()
        elif ch == "(":
            if pattern[i + 1 : i + 2] == "?" and not re.compile(r"\(\?(?::|=|!|<|P<)").match(pattern, i):
                return False, ""
            depth, inside = 0, re.compile(r"\\.|\[(?!\^?\])(?:[^\]\[\\]|\\.)+\]|[()]|[^\\\[()]+", re.S)
            while i < size:
                part = inside.match(pattern, i)
                if not part or re.match(r"\\[QE]|\(\?[a-zA-OQ-Z-]", pattern[i : i + 3]):
                    return False, ""
                i = part.end()
                depth += {"(": 1, ")": -1}.get(part[0], 0)
                if depth == 0:
                    break
        else:
            literal = ch if ch not in ".^$" else None
            i += 1
            if ch == "^" and begins and not run:
                continue
        repeat = re.compile(r"(?:[*+?]|\{(\d+)(?:,\d*)?\})[+?]?").match(pattern, i)
        i = repeat.end() if repeat else i
        none = repeat and (repeat[0][0] in "*?" or repeat[1] is not None and int(repeat[1]) == 0)
        if literal is None or not literal.isascii() or none:
            end()
        else:
            run += literal.lower()
            if repeat:
                end()
    end()
    return max(runs, key=lambda r: (r[0], len(r[1])) if len(r[1]) >= GRAM else (False, len(r[1])), default=(False, ""))


def _literals(pattern: Column) -> Column:
    """The literals of the pattern table, in batches."""

    @F.pandas_udf("at_start boolean, literal string")
    def literals(patterns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([required_literal(p) for p in patterns], columns=["at_start", "literal"])

    return literals(pattern)


def _fold(c: Column) -> Column:
    """Lower case, as an expression without case sees it: besides capitals, four letters count as an ASCII letter."""
    # dotted and dotless i, long s, Kelvin sign
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))


def _key(kind: str, text: Column | None = None) -> Column:
    """A key as a number: a chance meeting of two keys adds a pair that the expression itself then turns down."""
    return F.xxhash64(F.lit(kind), *([] if text is None else [text]))


def _grams(text: Column, size: Column) -> Column:
    """The keys of all pieces of a text that have ``size`` characters."""
    count = F.length(text) - size + 1
    keys = F.transform(F.sequence(F.lit(1), count), lambda i: _key("~", F.substring(text, i, size)))
    return F.when(count > 0, F.array_distinct(keys)).otherwise(F.array().cast("array<bigint>"))


def pattern_candidates(values: DataFrame, per_column: DataFrame) -> DataFrame:
    """Values beside the patterns of their column whose literal they hold.

    A pattern has one key: the text its matches begin with, else the piece of its literal that the fewest patterns of the column
    hold, else none, and then every value of the column meets it. A piece is as long as ``PIECES`` allow, so that keys don't get
    crowded as patterns grow in number. A value looks up the keys it can hold, in the sizes that occur. A key that many values
    look up is spread over parts, and only such a key's patterns are repeated, once for each part.
    """
    described = per_column.withColumn("l", _literals(F.col("value_pattern")))
    text = F.col("l.literal")
    kind = F.when(text == "", "*").when(F.col("l.at_start"), "^").otherwise("~")
    fitting = F.array_max(F.filter(F.array(*map(F.lit, PIECES)), lambda n: n <= F.length(text)))
    size = F.when(kind == "^", F.least(F.lit(LONGEST_PREFIX), F.length(text))).when(kind == "~", fitting).otherwise(0)
    # read four times below, and a literal is a scan by Python
    described = cut(described.select(*per_column.columns, text.alias("_literal"), kind.alias("_kind"), size.alias("_size")), "patterns")
    whole = [c for c in per_column.columns if c not in ("column", "id")]
    own = ["column", "id", *whole, "_kind", "_size"]
    start = F.when(F.col("_kind") == "*", _key("*")).otherwise(_key("^", F.substring(F.col("_literal"), F.lit(1), F.col("_size"))))
    sure = described.where("_kind != '~'").select(*own, start.alias("key"))
    # only a literal inside has a choice of keys
    options = described.where("_kind = '~'").select(*own, F.explode(_grams(F.col("_literal"), F.col("_size"))).alias("key"))
    held = options.groupBy("column", "key").agg(F.count("*").alias("_held"))
    keyed = sure.unionByName(
        options.join(held, ["column", "key"]).groupBy(*own).agg(F.min_by("key", F.struct("_held", "key")).alias("key"))
    )
    # a few dozen sizes for each column of the table
    sizes = described.groupBy("column").agg(
        F.collect_set(F.when(F.col("_kind") == "^", F.col("_size"))).alias("_starts"),
        F.collect_set(F.when(F.col("_kind") == "~", F.col("_size"))).alias("_sizes"), F.bool_or(F.col("_kind") == "*").alias("_open"),
    )
    distinct = cut(values.select("column", "value").distinct(), "values")
    folded = spread(distinct).join(F.broadcast(sizes), "column").withColumn("_text", _fold(F.col("value")))
    starts = F.transform(F.filter("_starts", lambda n: n <= F.length("_text")), lambda n: _key("^", F.substring(F.col("_text"), F.lit(1), n)))
    inside = F.flatten(F.transform("_sizes", lambda n: _grams(F.col("_text"), n)))
    none = F.when(F.col("_open"), F.array(_key("*"))).otherwise(F.array().cast("array<bigint>"))
    looked = folded.select("column", "value", F.explode(F.concat(starts, inside, none)).alias("key"))
    # one row for each ``PART`` lookups at most
    hot = looked.groupBy("column", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > PART)
    hot = cut(hot.select("column", "key", F.ceil(F.col("_n") / PART).alias("_parts")), "hot-keys")
    part = F.coalesce(F.pmod(F.xxhash64("value"), F.col("_parts")), F.lit(0).cast("bigint"))
    last = F.coalesce(F.col("_parts"), F.lit(1).cast("bigint")) - 1
    dealt = looked.join(F.broadcast(hot), ["column", "key"], "left").select("column", "value", "key", part.alias("_part"))
    repeated = keyed.join(F.broadcast(hot), ["column", "key"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return dealt.join(repeated.drop("_parts", "_kind", "_size"), ["column", "key", "_part"]).drop("key", "_part")


def match_patterns(values: DataFrame, patterns: DataFrame, columns: list[str], domain: str = GENERIC) -> DataFrame:
    """Best pattern for each distinct ``(column, value)``, by a join that grows with neither side's cap.

    ``columns`` are the table's columns. Column names are matched first on the distinct names; then a value meets only the
    patterns whose literals it holds, and the value expression decides. Patterns that the dialect can't compile are skipped.
    """
    spark = values.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    live = spread(patterns).where(F.col("domain").isin(domain, GENERIC))
    live = live.where(_valid("column_pattern") & _valid("value_pattern"))
    # the names of one table's columns: a driver-held list
    per_column = live.join(F.broadcast(names), F.rlike(F.col("column"), _expression("column_pattern"))).select(
        "column", "id", "column_pattern", "value_pattern", "fix_template", "success_count", "fail_count"
    )
    hits = pattern_candidates(values, per_column).where(F.rlike(F.col("value"), _expression("value_pattern")))
    best = hits.groupBy("column", "value").agg(
        F.min_by(
            F.struct("id", "column_pattern", "fix_template", "success_count", "fail_count"),
            F.struct(-F.col("success_count"), F.col("id")),
        ).alias("p")
    )
    return best.select(
        "column", "value", F.col("p.id").alias("pattern_id"), F.col("p.column_pattern").alias("column_pattern"),
        apply_template(F.col("p.fix_template"), F.col("value")).alias("new_value"),
        pattern_confidence(F.col("p.success_count"), F.col("p.fail_count")).alias("confidence"),
    )


def learn_patterns(actions: DataFrame, floor: float = 0.7) -> DataFrame:
    """Patterns from accepted external fixes, one per distinct lesson."""
    old, ext = F.col("old_value"), F.col("rule").startswith("llm:") & (F.col("confidence") >= floor)
    return actions.where(ext).select(
        F.concat(F.lit(".*"), escape_regex(F.col("column")), F.lit(".*")).alias("column_pattern"),
        F.when(old.isNull() | (old == ""), "^$").otherwise(escape_regex(old)).alias("value_pattern"),
        F.coalesce("new_value", F.lit("None")).alias("fix_template"),
        F.lit(GENERIC).alias("domain"),
        F.lit(1).cast("bigint").alias("success_count"),
        F.lit(0).cast("bigint").alias("fail_count"),
    )
