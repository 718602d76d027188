"""Quality rules: a threshold table compiled into one projection of counts and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, documents

#: Common short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at by from this have not "
    "le la les de des du et en un une que qui dans pour est sur par au avec pas "
    "der die das und ist von mit zu den ein eine auf für nicht sich im dem "
    "el los las y por con para una del se lo no su al es"
).split()

#: (rule, measure, least, most); a missing bound is open. A text passes when every measure lies within its bounds.
THRESHOLDS = (
    ("length", "n_words", 50, None),
    ("repetition", "repeat_share", None, 0.5),
    ("word_length", "mean_word_chars", 2.0, 15.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "n_stop_words", 2, None),
    ("duplicate_lines", "dup_line_share", None, 0.3),
    ("ellipsis_lines", "ellipsis_line_share", None, 0.3),
    ("bullet_lines", "bullet_line_share", None, 0.9),
)
WINDOW = 3


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``doc_id`` with the given columns, each computed once: filters above it aren't pushed into their expressions."""
    held = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select("doc_id", held)


def _counts(docs: DataFrame) -> DataFrame:
    """Words and lines of each text, and what is counted in them, all as expressions on the row."""
    has_word = lambda line: line.rlike(SPACE.replace("[", "[^"))
    split = _held(
        documents(docs),
        n_symbols=F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint"),
        words=F.array_remove(F.split("text", f"{SPACE}+"), ""),
        lines=F.filter(F.split("text", "\n"), has_word),
    )
    at = lambda i: F.get("words", i)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.concat_ws(" ", *[at(i + k) for k in range(WINDOW)])
    )
    shaped = split.select("*", F.when(F.size("words") >= WINDOW, windows).otherwise(F.array().cast("array<string>")).alias("windows"))
    # equal windows are neighbours once sorted; only texts that repeat one are sorted
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
    )
    shaped = _held(shaped, **{c: F.col(c) for c in ("n_symbols", "words", "lines")}, ordered=ordered)
    window = lambda j: F.get("ordered", j)["w"]
    repeated = F.filter(
        F.transform(
            "ordered",
            lambda s, j: F.when((s["w"] == window(j - 1)) | (s["w"] == window(j + 1)), s["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(*[i + k for k in range(WINDOW)])))))
    share = lambda test: F.size(F.filter("lines", test)).cast("bigint")
    return _held(
        shaped,
        n_words=F.size("words").cast("bigint"),
        word_chars=F.length(F.array_join("words", "")).cast("bigint"),
        n_symbols=F.col("n_symbols"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        n_repeat_words=F.when(F.col("ordered").isNotNull(), covered).otherwise(0).cast("bigint"),
        n_stop_words=F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        n_lines=F.size("lines").cast("bigint"),
        n_ellipsis_lines=share(lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…")),
        n_bullet_lines=share(lambda line: F.ltrim(line).rlike("^[-*•]")),
    )


def measures(docs: DataFrame) -> DataFrame:
    """Counts and ratios of each text. Ratios of texts without words or lines are 0."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return _counts(docs).select(
        "*",
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_ellipsis_lines", "n_lines").alias("ellipsis_line_share"),
        per("n_bullet_lines", "n_lines").alias("bullet_line_share"),
    )


def compiled(thresholds: tuple = THRESHOLDS) -> dict[str, Column]:
    """One boolean expression for each rule: true when the text passes."""
    rules = {}
    for rule, measure, least, most in thresholds:
        passes = F.lit(True)
        if least is not None:
            passes = passes & (F.col(measure) >= least)
        if most is not None:
            passes = passes & (F.col(measure) <= most)
        rules[rule] = passes
    return rules


def quality_rules(docs: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """Measures of every row, ``failed_rules`` (names in table order) and ``kept``.

    Words are runs without white space, lines are split at line feeds and count when they hold a word. A null text has no
    words. Nothing is shuffled: every row of ``docs`` gives one row, repeated rows too.
    """
    rules = compiled(thresholds)
    failed = F.array_compact(F.array(*[F.when(~passes, F.lit(rule)) for rule, passes in rules.items()]))
    return measures(docs).withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)
