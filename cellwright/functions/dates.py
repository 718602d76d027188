"""Date parsing as column expressions. A shape test decides which formats can apply at all."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F


# ---- fixed values: accepted date formats in order of precedence -----------------------
# rule suffix, shape, format
DATE_FORMATS = [
    ("date_us", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    ("date_eu_slash", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    ("date_us_dash", r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    ("date_eu_dot", r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    ("date_iso_slash", r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    ("date_us_short", r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    ("date_eu_dash", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
]
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
# Formats of the single-value converter, which does not know day-month-year with dashes.
CONVERTER_FORMATS = [f for f in DATE_FORMATS if f[0] != "date_eu_dash"]
# Formats that a date column of an order check can have; where two read as many cells, the earlier one counts (month before day).
ISO_MOMENT = "iso"
MOMENT_FORMATS = [
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("M.d.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
]
# ---------------------------------------------------------------------------------------


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """Name an expression so that it is evaluated once, however often ``use`` refers to it."""
    return F.transform(F.array(x), use)[0]


def _try_date(parts: Column, fmt: str) -> Column:
    """The day whose parts stand in the order of ``fmt``; NULL when there is no such day. No parser raises an error on the way."""
    order = [p[0] for p in re.split(r"[/.-]", fmt)]
    year, month, day = (parts[order.index(k)] for k in "yMd")
    if not fmt.count("y") == 4:
        # two-digit years from 69 on belong to the last century
        year = F.concat(F.when(year >= "69", "19").otherwise("20"), year)
    return F.concat_ws("-", year, month, day).try_cast("date")


def date_with_format(text: Column, formats: list[tuple[str, str, str]] = DATE_FORMATS) -> Column:
    """``<ISO day>|<format name>`` of the first format that parses, else NULL."""
    by_shape: dict[str, list[tuple[str, str]]] = {}
    for name, shape, fmt in formats:
        by_shape.setdefault(shape, []).append((name, fmt))

    def tried(parts: Column) -> Column:
        out = F.lit(None).cast("string")
        for shape, group in by_shape.items():
            hits = F.coalesce(*[F.concat(_try_date(parts, fmt).cast("string"), F.lit(f"|{name}")) for name, fmt in group])
            out = F.when(parts[3].rlike(shape), hits).otherwise(out)
        return out

    # a written year below 100 counts from 2000
    whole = F.regexp_replace(text, r"(?<!\d)00(?!00)(\d\d)(?!\d)", "20$1")
    some = text.rlike(r"^\d{1,4}[/.-]\d{1,2}[/.-]\d{2,4}$")
    return F.when(some, let(F.concat(F.split(whole, r"[/.\-]"), F.array(whole)), tried))


def moment_readers(text: Column) -> dict[str, Column]:
    """Per format, in order of precedence, the timestamp that it reads in a stripped text; NULL where it reads none. ISO texts may have a time."""
    iso = F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date")).cast("timestamp"),
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d"), text.try_cast("timestamp")),
    )
    others = {
        fmt: F.when(text.rlike(shape), _try_date(F.split(text, rf"\{re.search('[/.-]', fmt)[0]}"), fmt)).cast("timestamp")
        for fmt, shape in MOMENT_FORMATS
    }
    return {ISO_MOMENT: iso} | others
