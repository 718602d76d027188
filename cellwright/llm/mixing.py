"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, cut, free_name

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
ROWS_PER_SLICE = 5_000
SLICES_PER_BLOCK = 5_000


def size_in_words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(f"{SPACE.replace('[', '[^')}+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, rank, source_size, weight, target)`` for a table ``(source, source_size)``, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. No target is above
    ``max_repeats`` times its source's size; what a source cannot take is shared by weight among the rest. The level of
    the sharing is found from aggregates, one round per set of sources that fill up.
    """
    ranked = (
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("place", F.monotonically_increasing_id())
    )
    ranked = cut(ranked, "sources")
    block = F.shiftright("place", 33)
    blocks = ranked.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    starts = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n") - F.col("first")).alias("shift"))
    ranked = ranked.withColumn("block", block).join(starts, "block").withColumn("rank", F.col("place") + F.col("shift"))
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = cut(
        ranked.select("source", "rank", "source_size", F.get(turn, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight")), "weights"
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * max_repeats
    level = -1.0
    while True:
        full, weight = ranked.agg(
            F.sum(F.when(cap <= F.col("weight") * F.lit(level), cap)), F.sum(F.when(cap > F.col("weight") * F.lit(level), F.col("weight")))
        ).first()
        if not weight:
            break
        raised = (total - (full or 0)) / weight
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mix as a sequence: ``(row, doc_id, text_key, source, size, pass, source_size, target, finish, words, before, taken)``.

    Every source repeats its documents in one order shuffled by a hash, at most ``max_repeats`` times. A document's virtual
    finish time is the words of its source up to and with it, over the source's target: all sources are served at the
    speed of their targets. The entries of all sources are range-sorted by that time, and the queue is cut where its running
    words reach the total budget, the sum of the targets in whole words. The one document of each source that is being
    served at time 1 stands in the queue as two entries: the words that finish by then, and the rest. ``words``: size of the
    entry; ``before``: words of the queue ahead of it; ``taken``: words of it ahead of the cut.

    ``row`` numbers the rows of ``docs``, so repeated rows and null ids are documents of their own; the order of rows that agree in
    id, size and text is open. Running sums go by (source, slice of the hash), the slices' sums by (source, block of slices), so one source with
    most of the rows is spread over many tasks; null ids are shuffled by their texts. Null texts and texts without words have
    size 0 and are listed with 0 words; a null source is a source; very long texts count whole. An empty table gives an empty mix.
    """
    base = docs.select(
        F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.col("source").alias("source"), size_in_words().alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))))).alias("order"),
    )
    base = cut(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("source", "of_source")
    targets = cut(targets.withColumn("whole", F.floor("target")), "targets")
    budget = targets.agg(F.sum("whole")).first()[0] or 0

    n_slices = max(1, base.count() // ROWS_PER_SLICE)
    drawn = base.withColumn(
        "slice", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32 * n_slices).cast("int")
    )
    drawn = drawn.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    slices = drawn.groupBy("rank", "slice").agg(F.sum("size").alias("words")).withColumn("block", F.floor(F.col("slice") / SLICES_PER_BLOCK))
    slices = cut(slices, "slices")
    blocks = slices.groupBy("rank", "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select("rank", "block", (F.sum("words").over(Window.partitionBy("rank").orderBy("block")) - F.col("words")).alias("earlier"))
    ahead = F.sum("words").over(Window.partitionBy("rank", "block").orderBy("slice")) - F.col("words")
    slices = slices.withColumn("ahead", ahead).join(blocks, ["rank", "block"]).select("rank", "slice", (F.col("ahead") + F.col("earlier")).alias("ahead"))
    within = Window.partitionBy("rank", "slice").orderBy("order", "doc_id", "size", "row")
    placed = drawn.withColumn("upto", F.sum("size").over(within)).join(slices, ["rank", "slice"])

    passes = F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") - 1
    queued = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(0)))))
    queued = queued.withColumn("upto", F.col("ahead") + F.col("upto") + F.col("pass") * F.col("source_size"))
    on_time = F.greatest(F.lit(0), F.least(F.col("size"), F.col("whole") - F.col("upto") + F.col("size"))).cast("bigint")
    served = (on_time > 0) & (on_time < F.col("size"))
    entry = lambda words, upto: F.struct(words.alias("words"), upto.alias("upto"))
    split = F.array(entry(on_time, F.col("target")), entry(F.col("size") - on_time, F.col("upto").cast("double")))
    entries = F.when(served, split).otherwise(F.array(entry(F.col("size"), F.col("upto").cast("double"))))
    queued = queued.withColumn("entry", F.explode(entries)).select(
        "row", "doc_id", "text_key", "source", "size", "pass", "rank", "source_size", "target", "entry.words",
        F.when(F.col("target") > 0, F.col("entry.upto") / F.col("target")).otherwise(0.0).alias("finish"),
    )
    keys = ["finish", "rank", "pass", "doc_id", "row"]
    line = cut(queued.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "queue")
    part = F.shiftright("at", 33)
    parts = line.groupBy(part.alias("part")).agg(F.sum("words").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("earlier"))
    before = F.col("earlier") + F.sum("words").over(Window.partitionBy("part").orderBy("at")) - F.col("words")
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("before"))).cast("bigint")
    return (
        line.withColumn("part", part)
        .join(parts, "part")
        .withColumn("before", before)
        .withColumn("taken", taken)
        .select("row", "doc_id", "text_key", "source", "size", "pass", "source_size", "target", "finish", "words", "before", "taken")
    )


def words_taken(mixed: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: a row for every document of a mix, with all words taken of it."""
    by_row = mixed.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"))
    return by_row.drop("row")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; a part counts from half of the document on.

    Rows that repeat id, source and text share their turns evenly, rounded up.
    """
    turns = mix(docs).groupBy("row", "pass").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "text_key", "size")], F.sum("taken").alias("taken"))
    times = turns.groupBy("doc_id", "source", "text_key").agg(
        F.sum((F.col("taken") * 2 >= F.col("size")).cast("int")).alias("turns"), F.sum((F.col("pass") == 0).cast("int")).alias("rows")
    )
    times = times.select(
        F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), F.col("text_key").alias("mixed_key"),
        F.ceil(F.col("turns") / F.col("rows")).cast("int").alias("turns"),
    )
    # the turns grow with the documents: one plan at every size
    times = cut(times.where("turns > 0"), "turns").hint("merge")
    same = (
        docs["doc_id"].eqNullSafe(times["mixed_id"])
        & docs["source"].eqNullSafe(times["mixed_source"])
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == times["mixed_key"])
    )
    own = free_name(docs, "turn")
    turns = docs.join(times, same).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times["turns"])).alias(own))
    return turns.drop(own)
