"""Fuzzy matching of values to canonical spellings.

Candidates come from an exact filter: if two texts are at most k edits apart and one of them has
k + 1 disjoint pieces, some piece of rank r stands unchanged in the other with exactly r edits left of it,
which bounds its shift from both ends. Pieces are join keys, so no value is compared with every
canonical, and no pair within reach is lost.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SALTS = 8  # a piece that very many values hold is spread over tasks


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits per character class."""
    if a == b:
        return len(a)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Vectorised check of the few pairs that pass the filter."""

    @F.pandas_udf("int")
    def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_lcs(x, y) for x, y in zip(left, right)], dtype="int32")

    return lcs(a, b)


def _edits(total_or_longest: Column, metric: str, threshold: float) -> Column:
    """Most edits that still reach the threshold, from both lengths together (``ratio``) or the longer one (``levenshtein``)."""
    # ratio scores are rounded to whole percent, so half a percent below still counts
    share = 1 - threshold + (0.005 if metric == "ratio" else 0)
    return F.floor(share * total_or_longest + 1e-9).cast("int")


def _allowed(length_a: Column, length_b: Column, metric: str, threshold: float) -> Column:
    return _edits(length_a + length_b if metric == "ratio" else F.greatest(length_a, length_b), metric, threshold)


def _score(a: Column, b: Column, metric: str) -> Column:
    if metric == "ratio":
        total = F.length(a) + F.length(b)
        return F.bround(200.0 * lcs_length(a, b) / total, 0) / 100
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _stretch(metric: str, threshold: float) -> float:
    """How many times as long as a text its longest partner within reach can be."""
    return (2 - threshold + 0.005) / (threshold - 0.005) if metric == "ratio" else 1 / threshold


def _grid(length: Column, metric: str, threshold: float) -> tuple[Column, Column]:
    """Edits that any partner of a canonical of this length can need, and the size of its pieces: more pieces than edits, none empty."""
    longest = F.floor(length * _stretch(metric, threshold) + 1e-9)
    edits = _allowed(longest, length, metric, threshold)
    return edits, F.floor(length / (edits + 1)).cast("int")


def _zone(place: Column) -> Column:
    """Places fall into zones that double in length, as the shift that edits can cause grows with the place."""
    return F.floor(F.log2(place + 1)).cast("int")


def _salts() -> Column:
    return F.array(*[F.lit(i) for i in range(SALTS)])


def _salt(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")


def canonical_keys(canonicals: DataFrame, metric: str, threshold: float) -> DataFrame:
    """``(c, lc, size, zone, piece, begin, rank)``: for each canonical as many pieces as its partners' edits can't all hit.

    A text is cut into a grid of pieces of one size. Where the grid has pieces to spare, those that the fewest canonicals
    hold at that place are taken. ``rank`` is a piece's number among those taken, from the left.
    """
    edits, size = _grid(F.col("lc"), metric, threshold)
    cut_up = canonicals.select("c", F.length("c").alias("lc")).where("lc > 0").withColumn("edits", edits).withColumn("size", size)
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.col("lc") / F.col("size")).cast("int") - 1),
        lambda i: F.struct((i * F.col("size")).alias("begin"), F.substring(F.col("c"), i * F.col("size") + 1, F.col("size")).alias("piece")),
    )
    grid = cut_up.withColumn("p", F.explode(pieces)).select("c", "lc", "edits", "size", _zone(F.col("p.begin")).alias("zone"), "p.*")
    # a piece that most canonicals hold is spread over salts
    held = grid.groupBy("size", "zone", "piece").agg(F.count("*").alias("held")).withColumn("salt", F.explode(_salts()))
    grid = grid.withColumn("salt", _salt("c"))
    # the pieces of one text: as many as it is long at most
    each = grid.join(held, ["size", "zone", "piece", "salt"]).groupBy("c", "lc", "edits", "size").agg(
        F.sort_array(F.collect_list(F.struct("held", "begin", "zone", "piece"))).alias("p")
    )
    rarest = F.slice("p", 1, F.col("edits") + 1)
    in_place = F.sort_array(F.transform(rarest, lambda x: F.struct(x["begin"].alias("begin"), x["zone"].alias("zone"), x["piece"].alias("piece"))))
    return each.select("c", "lc", "size", F.posexplode(in_place).alias("rank", "p")).select("c", "lc", "size", "p.*", "rank")


def value_keys(values: DataFrame, metric: str, threshold: float) -> DataFrame:
    """``(v, lv, size, zone, piece, start)``: the substrings that can be a piece of some canonical, with the zones it can come from.

    Left of the piece of rank r lie at most r edits, and r pieces, so a piece of size s from ``begin`` stands at ``start`` between
    ``begin * (s - 1) / s`` and ``begin * (s + 1) / s``. Keys grow with the length of a value: sizes x places x a few zones.
    """
    v = values.select("v", F.length("v").alias("lv")).where("lv > 0")
    lengths = F.sequence(
        F.greatest(F.lit(1), F.ceil(F.col("lv") / _stretch(metric, threshold) - 1e-9).cast("int")),
        F.floor(F.col("lv") * _stretch(metric, threshold) + 1e-9).cast("int"),
    )
    sized = v.withColumn("size", F.explode(F.array_distinct(F.transform(lengths, lambda n: _grid(n, metric, threshold)[1])))).where("lv >= size")
    placed = sized.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("lv") - F.col("size"))))
    s, at = F.col("size"), F.col("start")
    first = s * F.ceil(at / (s + 1)).cast("int")
    last = F.least(
        F.when(s > 1, s * F.floor(at / (s - 1)).cast("int")).otherwise(F.lit(2**30)),
        F.floor(F.col("lv") * _stretch(metric, threshold) + 1e-9).cast("int"),
    )
    return placed.where(first <= last).select(
        "v", "lv", "size", F.explode(F.sequence(_zone(first), _zone(last))).alias("zone"),
        F.substring("v", at + 1, s).alias("piece"), "start",
    )


def _letters(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.length(text) > 0).select(text, F.explode(F.array_distinct(F.split(text, ""))).alias("piece")).where("piece <> ''")


def fuzzy_pairs(values: DataFrame, canonicals: DataFrame, metric: str, threshold: float) -> DataFrame:
    """``(v, c, score)`` of all lower-cased distinct texts within reach of each other.

    Thresholds up to 2/3 (``ratio``) or 1/2 (``levenshtein``) allow more edits than a text has characters; there the one thing
    that partners share is a character.
    """
    if not 0.005 < threshold <= 1:
        raise ValueError("threshold must lie above 0.005 and be 1 at most")
    salt = _salt("v").alias("salt")
    k = _allowed(F.col("lv"), F.col("lc"), metric, threshold)
    if (1 - threshold + 0.005) * (1 + _stretch("ratio", threshold)) >= 1 if metric == "ratio" else threshold <= 0.5:
        left = _letters(values, "v").select("*", F.length("v").alias("lv"), salt)
        right = _letters(canonicals, "c").select("*", F.length("c").alias("lc"), F.explode(_salts()).alias("salt"))
        met = left.join(right, ["piece", "salt"]).where(F.abs(F.col("lv") - F.col("lc")) <= k)
    else:
        left = value_keys(values, metric, threshold).select("*", salt)
        right = canonical_keys(canonicals, metric, threshold).select("*", F.explode(_salts()).alias("salt"))
        shift = F.col("start") - F.col("begin")
        met = left.join(right, ["size", "zone", "piece", "salt"]).where(
            (F.abs(shift) <= F.col("rank")) & (F.abs(shift - F.col("lv") + F.col("lc")) <= k - F.col("rank"))
        )
    near = met.select("v", "c").distinct()
    return near.withColumn("score", _score(F.col("v"), F.col("c"), metric)).where(F.col("score") >= threshold - 1e-12)


def fuzzy_canonical(
    df: DataFrame,
    column: str,
    canonicals: DataFrame,
    threshold: float = 0.9,
    metric: str = "ratio",
) -> DataFrame:
    """Best canonical spelling per distinct value: ``(value, canonical, score)``.

    ``canonicals(canonical, place)``: the lower ``place`` wins ties. A value that is itself the best
    match is left out. ``metric`` is ``ratio`` (common subsequence) or ``levenshtein`` (all JVM).
    """
    if metric not in ("ratio", "levenshtein"):
        raise ValueError("metric must be 'ratio' or 'levenshtein'")
    texts = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("value")).distinct()
    values = texts.withColumn("v", F.lower("value"))
    spelled = (
        canonicals.withColumn("c", F.lower("canonical"))
        .groupBy("c").agg(F.min("place").alias("place"), F.min_by("canonical", "place").alias("canonical"))
    )
    # equal texts score 1 and need no search
    same = values.join(spelled, F.col("v") == F.col("c")).select("value", "canonical", F.lit(1.0).alias("score"))
    rest = values.join(spelled.select(F.col("c").alias("v")), "v", "left_anti")
    pairs = fuzzy_pairs(rest.select("v").distinct(), spelled.select("c"), metric, threshold)
    best = (
        pairs.join(spelled, "c").groupBy("v")
        .agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), F.col("place"))).alias("b"))
    )
    found = rest.join(best, "v").select("value", "b.canonical", "b.score")
    return same.unionByName(found).where(F.col("value") != F.col("canonical"))


def apply_canonical(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace values by their canonical spelling; the optimizer broadcasts a short mapping by its size."""
    m = mapping.select(F.col("value").alias(column), F.col("canonical").alias("_canonical"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("_canonical", column)).select(*df.columns)
