"""Delimited text in many tasks: records whose quoted cells hold line feeds are put together across lines and file ranges."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut
from ..operators.rows import ROW, with_row_index

FILE, RANGE, PLACE = "_source_file", "_range", "_place"
LENGTH, SLOT = "_length", "_slot"
#: Ranges that start within this many bytes of all files share a task; a longer range has one of its own.
SLOT_BYTES = 4 << 20


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(_source_file, _range, _length, _place, value)``: the lines of text files as bytes, with file, range, its bytes, and place in it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    block = [F.col("_metadata.file_block_start").alias(RANGE), F.col("_metadata.file_block_length").alias(LENGTH)]
    return lines.select(F.col("_metadata.file_path").alias(FILE), *block, F.monotonically_increasing_id().alias(PLACE), "value")


class Quotes:
    """Whether a quoted cell is open behind a line, for both states in front of it."""

    def __init__(self, sep: str) -> None:
        s = re.escape(sep)
        inner, rest = '[^"]*+(?:""[^"]*+)*+', rf"(?:(?!{s}).)*+" if len(sep) > 1 else f"[^{s}]*+"
        cell = rf'(?:"{inner}"{rest}|(?!"){rest})'
        self.opens = rf'(?s)^(?:{cell}{s})*+"{inner}$'
        self.closes = rf'(?s)^{inner}"{rest}'
        self.sep = sep

    def after_closed(self, line: Column) -> Column:
        """1 if a cell that the line opens is still open behind it, else 0."""
        return F.when(F.contains(line, F.lit('"')) & F.rlike(line, F.lit(self.opens)), 1).otherwise(0)

    def after_open(self, line: Column) -> Column:
        """The same for a line that starts inside a quoted cell."""
        rest = F.regexp_replace(line, F.lit(self.closes), F.lit(""))
        more = self.after_closed(F.substring(rest, len(self.sep) + 1, 1 << 30))
        return F.when(~F.contains(line, F.lit('"')) | ~F.rlike(line, F.lit(self.closes)), 1).when(rest == "", 0).otherwise(more)


def file_facts(lines: DataFrame, sep: str) -> DataFrame:
    """``(_source_file, utf8, spans)``: whether all bytes of a file are UTF-8, and whether a line ends inside a quoted cell."""
    return lines.groupBy(FILE).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), (F.max(Quotes(sep).after_closed(F.col("value"))) == 1).alias("spans")
    )


def _states(rows: DataFrame, by: list[str], order: str, fixed: Column, swaps: Column, start: Column | None = None) -> DataFrame:
    """Prefix composition of two-state steps: ``known``, ``parity`` of the state in front of each row, and ``before`` if a start is given.

    A step either fixes the state behind it (``fixed``, else NULL), or turns it round (``swaps`` 1), or leaves it.
    """
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_fixed", fixed).withColumn("_swaps", swaps).withColumn("_turns", F.coalesce(F.sum("_swaps").over(ahead), F.lit(0)))
    last = F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_turns")), ignorenulls=True).over(ahead)
    placed = counted.withColumn("_last", last)
    known = F.col("_last").isNotNull()
    parity = F.when(known, (F.col("_last._fixed") + F.col("_turns") - F.col("_last._turns")) % 2).otherwise(F.col("_turns") % 2)
    out = placed.withColumn("known", known).withColumn("parity", parity)
    if start is not None:
        out = out.withColumn("before", F.when(F.col("known"), F.col("parity")).otherwise((F.col("parity") + start) % 2))
    return out.drop("_last", "_turns")


def marked_lines(lines: DataFrame, sep: str) -> DataFrame:
    """The lines, written once so that their places hold, with the state behind them for both states in front, and whether they are blank."""
    q, value = Quotes(sep), F.col("value")
    blank = F.trim(F.regexp_replace(value, "\r$", "")) == ""
    return cut(lines.select("*", q.after_closed(value).alias("_c"), q.after_open(value).alias("_o"), blank.alias("_blank")), "lines", "gzip")


def range_slots(marked: DataFrame) -> DataFrame:
    """``(_source_file, _range, _slot)``, a row a range: the task that gets its lines, counted from 0.

    Ranges are dealt out in file order by their bytes, so a task gets ``SLOT_BYTES`` and one range at most, however large the files
    are and whatever the number of shuffle partitions is. Splits are a list that the driver already keeps.
    """
    sizes = marked.groupBy(FILE, RANGE).agg(F.max(LENGTH).alias(LENGTH))
    before = sizes.withColumn("_before", F.sum(LENGTH).over(Window.orderBy(FILE, RANGE)) - F.col(LENGTH))
    slot = F.dense_rank().over(Window.orderBy(F.floor(F.col("_before") / SLOT_BYTES))) - 1
    return cut(before.select(FILE, RANGE, slot.alias(SLOT)), "slots")


def _dealt(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The lines with what ``ranges`` tells of their range, each slot in a task of its own."""
    slots = (ranges.agg(F.max(SLOT)).first()[0] or 0) + 1
    # one row per file split
    return lines.drop(LENGTH).join(F.broadcast(ranges), [FILE, RANGE]).repartitionById(slots, SLOT)


def _placed(dealt: DataFrame) -> DataFrame:
    """The steps of the lines within their ranges: see ``_states``."""
    fixed, swaps = F.when(F.col("_c") == F.col("_o"), F.col("_c")), F.when(F.col("_c") > F.col("_o"), 1).otherwise(0)
    return _states(dealt, [SLOT, FILE, RANGE], PLACE, fixed, swaps)


def _state() -> Column:
    return F.when(F.col("known"), F.col("parity")).otherwise((F.col("parity") + F.col("entry")) % 2)


def range_states(marked: DataFrame) -> DataFrame:
    """``(_source_file, _range, _slot, entry, goes_on, last, held, first)``, a row a range: its task, the states in front of it and behind
    it, its last record's place, the record that it starts in (NULL: none), and the place of the file's header.

    What a line does to the state "inside a quoted cell" is one of four functions. Their composition is a prefix scan: within the
    ranges, then over one row a range, so a range learns from those before it whether it starts inside a cell. Texts don't
    take part.
    """
    slots = range_slots(marked)
    steps = cut(_placed(_dealt(marked.drop("value"), slots)), "steps")
    fixed_end = F.struct(F.lit(True).alias("known"), F.col("_fixed").cast("bigint").alias("parity"))
    behind = F.when(F.col("_fixed").isNotNull(), fixed_end).otherwise(F.struct("known", ((F.col("parity") + F.col("_swaps")) % 2).alias("parity")))
    ends = steps.groupBy(FILE, RANGE).agg(F.max_by(behind, PLACE).alias("end"))
    fixed, swaps = F.when(F.col("end.known"), F.col("end.parity")), F.when(F.col("end.known"), 0).otherwise(F.col("end.parity"))
    ranges = _states(ends, [FILE], RANGE, fixed, swaps, F.lit(0))
    behind_all = F.when(F.col("end.known"), F.col("end.parity")).otherwise((F.col("before") + F.col("end.parity")) % 2)
    ranges = cut(ranges.select(FILE, RANGE, F.col("before").alias("entry"), (behind_all == 1).alias("goes_on")), "ranges")
    opening = F.when(_state() == 0, F.col(PLACE))
    found = steps.join(ranges.select(FILE, RANGE, "entry"), [FILE, RANGE]).groupBy(FILE, RANGE).agg(
        F.max(opening).alias("last"), F.min(F.when(~F.col("_blank"), opening)).alias("_first")
    )
    earlier = Window.partitionBy(FILE).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("last").isNotNull(), F.struct(RANGE, F.col("last").alias(PLACE))), ignorenulls=True).over(earlier)
    first = F.min(F.when(F.col("_first").isNotNull(), F.struct(RANGE, F.col("_first").alias(PLACE)))).over(Window.partitionBy(FILE))
    found = ranges.join(found, [FILE, RANGE]).withColumn("held", held).withColumn("first", first).drop("_first")
    return cut(found.join(slots, [FILE, RANGE]), "range-states")


def records(marked: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(_source_file, _range, _place, record, header)``: lines put together where a quoted cell goes on in the next one.

    One shuffle brings the lines of a range together, a slot a task; only records that cross a range's end meet in a second one. A cell
    that is never closed goes on to the end of its file, in one row.
    """
    placed = _placed(_dealt(marked, ranges))
    opener = F.last(F.when(_state() == 0, F.col(PLACE)), ignorenulls=True).over(Window.partitionBy(SLOT, FILE, RANGE).orderBy(PLACE))
    owned = placed.withColumn("_own", opener)
    kept = [F.first(c).alias(c) for c in ("held", "first", "last", "goes_on")]
    pieces = owned.groupBy(SLOT, FILE, RANGE, "_own").agg(F.sort_array(F.collect_list(F.struct(PLACE, "value"))).alias("_lines"), *kept)
    pieces = pieces.withColumn("record", F.array_join("_lines.value", "\n")).drop("_lines")
    key = F.when(F.col("_own").isNotNull(), F.struct(F.col(RANGE), F.col("_own").alias(PLACE))).otherwise(F.col("held"))
    pieces = pieces.withColumn("_key", key).withColumn("_cross", F.col("_own").isNull() | (F.col("goes_on") & (F.col("_own") == F.col("last"))))
    whole = pieces.where("not _cross").select(FILE, "_key", "record", "first")
    crossing = pieces.where("_cross").groupBy(FILE, "_key").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct(RANGE, "record")))["record"], "\n").alias("record"), F.first("first").alias("first")
    )
    both = whole.unionByName(crossing)
    return both.select(FILE, f"_key.{RANGE}", f"_key.{PLACE}", "record", (F.col("_key") == F.col("first")).alias("header"))


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header: an empty one by its place, repeated ones with their place added."""
    low = [c.lower() for c in cells]
    return [f"_c{i}" if c == "" else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_records(lines: DataFrame, facts: DataFrame, sep: str, row_index: bool = False, options: dict | None = None) -> DataFrame:
    """The table of the files' records, as text; blank cells are ``""``. Each file's first record is its header, the first file's names count.

    Files are UTF-8 or, where ``facts`` says they aren't, Latin-1.
    """
    spark = lines.sparkSession
    marked = marked_lines(lines, sep)
    ranges = range_states(marked)
    # patterns would replace bytes that aren't UTF-8, so they come after the decoding
    text = F.when(F.col("utf8"), F.col("record")).otherwise(F.decode(F.col("record").cast("binary"), "ISO-8859-1"))
    text = F.regexp_replace(text, "\r$", "").alias("record")
    # one row per file
    texts = lambda found: found.join(F.broadcast(facts.select(FILE, "utf8")), FILE).select(FILE, RANGE, PLACE, text, "header")
    start = ranges.where("first is not null").agg(F.min(F.struct(FILE, F.col(f"first.{RANGE}").alias(RANGE), F.col(f"first.{PLACE}").alias(PLACE))).alias("s")).first()["s"]
    if start is None:
        return spark.createDataFrame([], f"{ROW} bigint" if row_index else "_c0 string")
    # the first file's header, out of the range it starts in, or of all if it goes on in the next one
    here = (F.col(FILE) == start[FILE]) & (F.col(RANGE) == start[RANGE])
    inside = ranges.where(here & (~F.col("goes_on") | (F.col("last") > start[PLACE])))
    near = (marked, ranges) if inside.isEmpty() else (marked.where(here), ranges.where(here).withColumn(SLOT, F.lit(0)))
    top = texts(records(*near)).where(F.col("header") & (F.col(FILE) == start[FILE])).first()["record"]
    names = header_names(next(csv.reader(top.splitlines(keepends=True), delimiter=sep)))
    body = texts(records(marked, ranges)).where(~F.col("header") & (F.trim("record") != ""))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", **(options or {})})
    rows = body.select(FILE, RANGE, PLACE, parsed.alias("cells"))
    cells = [F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)]
    if not row_index:
        return rows.select(*cells)
    return with_row_index(rows, [FILE, RANGE, PLACE]).select(ROW, *cells)
