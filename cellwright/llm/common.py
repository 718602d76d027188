"""What several operators of this package share: the two document columns, row keys, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut

#: White space of every contract of this package: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"

__all__ = ["SPACE", "bytes_of", "cut", "documents", "free_name", "normalised", "pieces", "table", "texts_of", "with_key", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` alone, a null text read as empty; other columns never reach an operator."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def with_key(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, text)``. Rows that share both keys are copies of one row and get one result."""
    return documents(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``(doc_id, text_key, kept)`` in ``verdicts`` is kept, with all columns.

    ``verdicts`` has a row for each row of ``docs``. Rows that agree in id and text are one document: one of them stays, if any.
    """
    marks = verdicts.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    marks = marks.where("not kept or n > 1").select(F.col("doc_id").alias("marked_id"), F.col("text_key").alias("marked_key"), "kept")
    # the marks grow with the documents: one plan at every size
    marks = cut(marks.withColumnRenamed("kept", "marked_kept"), "marks").hint("merge")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(marks["marked_id"]) & (key == marks["marked_key"])
    single = docs.join(marks, same, "left_anti")
    repeated = marks.where("marked_kept")
    if repeated.isEmpty():
        return single
    own = free_name(docs, "key")
    one = docs.join(repeated, same, "left_semi").withColumn(own, key).dropDuplicates(["doc_id", own]).drop(own)
    return single.unionByName(one)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def normalised(text: Column) -> tuple[Column, Column]:
    """Two steps to every run of white space as one blank: single blanks first, then runs of blanks.

    The second step takes the column that holds the first one's result, so that texts without runs skip the pattern.
    """
    for mark in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(mark), F.lit(" "))
    flat = F.col("flat")
    return text, F.when(F.instr(flat, "  ") > 0, F.regexp_replace(flat, " +", " ")).otherwise(flat)


def pieces(batches: Iterator[pa.RecordBatch], size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose buffers average ``size`` bytes, one row at least."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, batch.num_rows * size // max(size, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(name).to_pylist()


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()
