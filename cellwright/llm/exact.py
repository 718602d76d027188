"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, documents, normalised, without

PREFIX_CHARS = 64


def measured(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``(doc_id, text_key, chars, prefix, text_sha256)`` of the normalised texts: one scan, written as narrow columns."""
    first, second = normalised(F.col("text"))
    return cut(
        documents(docs)
        .select("doc_id", F.xxhash64("text").alias("text_key"), first.alias("flat"))
        .select("doc_id", "text_key", second.alias("norm"))
        .select(
            "doc_id",
            "text_key",
            F.length("norm").alias("chars"),
            F.xxhash64(F.left("norm", F.lit(prefix_chars))).alias("prefix"),
            F.sha2("norm", 256).alias("text_sha256"),
        ),
        "measured",
    )


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``(doc_id, text_key, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when they agree after each run of white space is one blank; null counts as empty. Of equal texts
    the row with the smallest ``doc_id`` stays (null ids last); if rows repeat that id too, one of them stays.

    Texts are read once. A second reading of the texts whose length and prefix are shared would have to send every text to a join,
    so the scan hashes whole texts as they pass; each level of the refinement then reads its own narrow column, and the
    full hashes only of rows whose length and prefix are shared. Lengths and prefixes are counted before the shuffle, and
    copies per document before their groups meet, so a group that holds a third of the rows costs one row per task;
    attaching its result is a join that Spark can split. Empty tables give empty results.
    """
    rows = measured(docs, prefix_chars)
    lengths = rows.groupBy("chars").count().where("count > 1").select("chars")
    prefixes = rows.groupBy("chars", "prefix").count().where("count > 1").select("chars", "prefix")
    prefixes = cut(prefixes.join(lengths, "chars", "left_semi"), "prefixes")
    open_rows = rows.join(prefixes, ["chars", "prefix"], "left_semi")
    by_doc = cut(
        open_rows.groupBy("doc_id", "text_key", "text_sha256").agg(F.count("*").alias("n")), "hashes"
    )
    groups = cut(by_doc.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")
    # one row of the id that stays: of its raw texts, the one with the smallest key
    stays = by_doc.join(groups, "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = stays.groupBy("text_sha256").agg(F.min("text_key").alias("keep_key"))
    settled = (
        by_doc.join(cut(groups.join(stays, "text_sha256"), "settled"), "text_sha256")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
        .select(
            "doc_id",
            "text_key",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
    alone = rows.join(prefixes, ["chars", "prefix"], "left_anti").select(
        "doc_id",
        "text_key",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return settled.unionByName(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text one stays."""
    return without(docs, exact_duplicates(docs).select("doc_id", "text_key", "kept"))
