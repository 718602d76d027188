"""Repair rules for one value: each is a struct column, NULL where the rule does not fire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .dates import CONVERTER_FORMATS, DATE_FORMATS, ISO_SHAPE, date_with_format, let
from .text import FORMAT_PATTERNS, is_blank, squash, strip

FIX = "struct<new_value:string,rule:string,confidence:double,reasoning:string>"

# ---- fixed values: rule names, confidences, messages and word lists -------------------
RULES = {
    "median": ("rule:median_impute", 0.90, "Missing numeric value in '%s' replaced with column median (%s)"),
    "mode": ("rule:mode_impute", 0.85, "Missing categorical value in '%s' replaced with mode ('%s')"),
    "unknown": ("rule:unknown_fill", 0.70, "Missing value in '%s' filled with 'Unknown' (no better imputation available)"),
    "trim": ("rule:trim_whitespace", 0.99, "Trimmed whitespace in '%s'"),
    "date": ("rule:date_normalize_", 0.95, "Converted '%s' to ISO date '%s' in '%s'"),
    "phone": ("rule:phone_normalize", 0.95, "Normalized phone '%s' → '%s' in '%s'"),
    "email": ("rule:email_normalize", 0.98, "Normalized email '%s' → '%s' in '%s'"),
    "boolean": ("rule:boolean_coerce", 0.95, "Coerced '%s' → '%s' in '%s'"),
    "numeric": ("rule:numeric_coerce", 0.90, "Stripped non-numeric characters: '%s' → '%s' in '%s'"),
}
UNKNOWN = "Unknown"
TRUE_WORDS = ["yes", "y", "1", "t"]
FALSE_WORDS = ["no", "n", "0", "f"]
# ---------------------------------------------------------------------------------------


def _fix(key: str, new: Column, fires: Callable[[Column], Column], words: Callable[[Column], list[Column]]) -> Column:
    """The fix struct for a new value that is worked out once; NULL unless ``fires`` holds for it."""
    name, confidence, message = RULES[key]

    def build(n: Column) -> Column:
        return F.when(
            fires(n),
            F.struct(
                n.alias("new_value"), F.lit(name).alias("rule"), F.lit(confidence).alias("confidence"),
                F.format_string(message, *words(n)).alias("reasoning"),
            ),
        )

    return let(new, build)


def fill_median(column: Column, median_text: Column) -> Column:
    return _fix("median", median_text, lambda n: n.isNotNull(), lambda n: [column, n])


def fill_mode(column: Column, mode: Column) -> Column:
    return _fix("mode", mode, lambda n: n.isNotNull(), lambda n: [column, n])


def fill_unknown(column: Column) -> Column:
    return _fix("unknown", F.lit(UNKNOWN), lambda n: n.isNotNull(), lambda n: [column])


def trim_whitespace(v: Column, column: Column) -> Column:
    return _fix("trim", squash(v), lambda n: n != v, lambda n: [column])


def date_to_iso(v: Column, column: Column) -> Column:
    """The rule's name carries the format that parsed."""
    name, confidence, message = RULES["date"]

    def build(got: Column) -> Column:
        day = F.substring(got, 1, 10)
        return F.when(
            got.isNotNull(),
            F.struct(
                day.alias("new_value"), F.concat(F.lit(name), F.substring(got, 12, 40)).alias("rule"),
                F.lit(confidence).alias("confidence"), F.format_string(message, strip(v), day, column).alias("reasoning"),
            ),
        )

    return let(strip(v), lambda text: F.when(~text.rlike(ISO_SHAPE), let(date_with_format(text, DATE_FORMATS), build)))


def phone_digits(v: Column) -> Column:
    """Ten digits of a US number, a leading country 1 dropped; else NULL."""
    digits = F.regexp_replace(F.regexp_replace(v, r"(?U)\D", ""), r"^1(.{10})$", "$1")
    return let(digits, lambda d: F.when(F.length(d) == 10, d))


def phone_text(digits: Column) -> Column:
    return F.concat(
        F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4)
    )


def phone_us(v: Column, column: Column) -> Column:
    new = let(phone_digits(v), phone_text)
    return _fix("phone", new, lambda n: n.isNotNull() & (n != strip(v)), lambda n: [v, n, column])


def email_lower(v: Column, column: Column) -> Column:
    return _fix(
        "email", F.lower(strip(v)), lambda n: (n != v) & n.rlike(FORMAT_PATTERNS["email"]), lambda n: [v, n, column]
    )


def boolean_word(v: Column, column: Column) -> Column:
    new = let(F.lower(strip(v)), lambda low: F.when(low.isin(TRUE_WORDS), "true").when(low.isin(FALSE_WORDS), "false"))
    return _fix("boolean", new, lambda n: n.isNotNull(), lambda n: [v, n, column])


def numeric_text(v: Column, column: Column) -> Column:
    def fires(n: Column) -> Column:
        return n.rlike(r"(?U)^-?(\d+\.?\d*|\.\d+)$") & ~strip(v).rlike(r"(?U)^-?\d+\.?\d*$") & (n != strip(v))

    return _fix("numeric", F.regexp_replace(strip(v), r"(?U)[^\d.\-]", ""), fires, lambda n: [v, n, column])


FORMAT_RULES: dict[str, Callable[[Column, Column], Column]] = {
    "trim": trim_whitespace,
    "date": date_to_iso,
    "phone": phone_us,
    "email": email_lower,
    "boolean": boolean_word,
    "numeric": numeric_text,
}
# Column types each rule fits when rules are gated by type.
RULE_TYPES = {"boolean": ["boolean"], "phone": ["string"], "numeric": ["integer", "float"]}
MAX_CHAIN = 4


def format_fix(
    v: Column,
    column: Column,
    dtype: Column | None = None,
    extra: dict[str, Callable[[Column, Column], Column]] | None = None,
) -> Column:
    """First rule that fires on a non-blank value. ``dtype`` gates rules by column type.

    ``extra`` rules of the caller, ``(value, column) -> fix struct``, are tried after the built-in ones.
    """

    def first(text: Column) -> Column:
        tries = []
        for name, rule in {**FORMAT_RULES, **(extra or {})}.items():
            fix = rule(text, column)
            if dtype is not None and name in RULE_TYPES:
                fix = F.when(dtype.isin(RULE_TYPES[name]), fix)
            tries.append(fix)
        return F.coalesce(*tries)

    return F.when(~is_blank(v), let(v, first))


def chained_format_fix(v: Column, column: Column, dtype: Column | None = None) -> Column:
    """Apply rules until none fires; the last rule names the fix, the lowest confidence counts."""
    seed = F.lit(None).cast(FIX)

    def step(acc: Column, _: Column) -> Column:
        now = F.coalesce(acc["new_value"], v)

        def joined(nxt: Column) -> Column:
            merged = F.struct(
                nxt["new_value"].alias("new_value"), nxt["rule"].alias("rule"),
                F.least(nxt["confidence"], acc["confidence"]).alias("confidence"), nxt["reasoning"].alias("reasoning"),
            )
            return F.when(nxt.isNull(), acc).otherwise(merged)

        return let(now, lambda text: let(format_fix(text, column, dtype), joined))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_CHAIN)), seed, step)


def normalize(c: Column, target: str) -> Column:
    """Convert a value to ``email``, ``phone_us``, ``boolean`` or ``date_iso``; unchanged if it cannot be."""
    text = strip(c)
    if target == "email":
        return F.lower(text)
    if target == "phone_us":
        return F.coalesce(let(phone_digits(text), phone_text), text)
    if target == "boolean":
        low = F.lower(text)
        yes, no = TRUE_WORDS + ["true"], FALSE_WORDS + ["false"]
        return F.when(low.isin(yes), "true").when(low.isin(no), "false").otherwise(text)
    if target == "date_iso":
        return F.coalesce(F.substring(date_with_format(text, CONVERTER_FORMATS), 1, 10), text)
    return text


def python_title(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest of it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")
