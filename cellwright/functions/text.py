"""Text predicates, number parsing and the format catalogue, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# ---- fixed values ---------------------------------------------------------------------
# Format patterns in order of precedence; compared ignoring case on stripped text.
FORMAT_PATTERNS: dict[str, str] = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "phone_us": r"^\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$",
    "zip_us": r"^\d{5}(-\d{4})?$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_us": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "date_eu": r"^\d{1,2}\.\d{1,2}\.\d{2,4}$",
    "integer": r"^-?\d+$",
    "decimal": r"^-?\d+\.\d+$",
    "boolean": r"^(true|false|yes|no|1|0|t|f|y|n)$",
    "url": r"^https?://[^\s]+$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
# Domain checks, case-sensitive on stripped text, and the columns each domain requires.
DOMAIN_PATTERNS: dict[str, dict[str, str]] = {
    "healthcare": {
        "icd_code_pattern": r"^[A-Z]\d{2}(\.\d{1,4})?$",
        "npi_pattern": r"^\d{10}$",
    },
    "finance": {
        "cusip_pattern": r"^[A-Z0-9]{9}$",
        "currency_pattern": r"^-?\$?\d{1,3}(,\d{3})*(\.\d{2})?$",
    },
    "retail": {
        "sku_pattern": r"^[A-Z0-9\-]{4,20}$",
        "upc_pattern": r"^\d{12}$",
    },
    "generic": {},
}
DOMAIN_REQUIRED: dict[str, list[str]] = {
    "healthcare": ["patient_id", "date_of_service"],
    "finance": ["transaction_id", "amount"],
    "retail": ["product_id", "price"],
    "generic": [],
}
# ---------------------------------------------------------------------------------------

# Every character Python treats as white space: Unicode White_Space plus the separators 1c-1f.
WS = r"[\s\x1c-\x1f]"


def _visible(c: Column) -> Column:
    """First and last characters are visible ASCII: nothing to strip, and no regex needed to tell."""
    return F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)


def strip(c: Column) -> Column:
    """Strip all Unicode white space (Spark's ``trim`` strips only blanks)."""
    return F.when(_visible(c), c).otherwise(F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", ""))


def plain_text(c: Column) -> Column:
    """Stripped text whose non-ASCII digits read ``7`` and blanks read as space.

    Plain regexes then see the right character classes (no catalogue pattern has a literal 7).
    Clean ASCII, told by its end characters and byte length, passes untouched.
    """
    slow = F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")
    slow = F.regexp_replace(F.regexp_replace(slow, r"(?U)[\d&&[^0-9]]", "7"), r"(?U)[\s&&[^\x00-\x7f]]", " ")
    return F.when(_visible(c) & (F.octet_length(c) == F.length(c)), c).otherwise(slow)


def squash(c: Column) -> Column:
    """Strip, and collapse inner runs of white space to one blank."""
    return F.regexp_replace(strip(c), rf"(?U){WS}+", " ")


def is_blank(c: Column) -> Column:
    """NULL or white space only. Empty text is decided without a regex."""
    return c.isNull() | (c == "") | (~F.ascii(c).between(33, 126) & ~c.rlike(r"(?U)[^\s\x1c-\x1f]"))


def is_profile_null(c: Column) -> Column:
    """What profiling counts as null: NULL, empty, or the text ``None``; no stripping."""
    return c.isNull() | c.isin("", "None")


def is_info_null(c: Column) -> Column:
    return c.isNull() | (c == "")


def to_num(c: Column) -> Column:
    """Text to double; NULL for anything that is not a plain number, NaN included.

    Java also reads ``1d``, ``1f`` and hexadecimal floats, which are not numbers here.
    """
    x = c.cast("string").try_cast("double")
    java_only = c.rlike(r"[xX]|[dDfF]\s*$") & ~c.rlike(r"(?i)^\s*[+-]?inf\s*$")
    return F.when(x.isNotNull() & ~F.isnan(x) & ~java_only, x)


def looks_numeric(c: Column) -> Column:
    """Type inference's looser test: thousands separators, ``$``, ``%`` and blanks are ignored."""
    bare = F.when(_visible(c) & ~c.rlike(r"[,$%\s]"), c).otherwise(F.regexp_replace(c, r"(?U)[,$%\s\x1c-\x1f]", ""))
    return F.coalesce(
        to_num(bare).isNotNull() | bare.rlike(r"(?i)^[+-]?nan$|^[+-]?\d+(_\d+)+(\.\d+(_\d+)*)?$"),
        F.lit(False),
    )


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Match from the start of the stripped text."""
    return plain_text(c).rlike(("(?i)" if ignore_case else "") + f"^(?:{pattern})")


def is_digits(c: Column) -> Column:
    return plain_text(c).rlike(r"^\d+$")


def float_text(x: Column) -> Column:
    """A double as its shortest decimal text: ``30.0``, ``12345678.5``, ``1e+16``, ``1e-05``.

    Spark prints the common range the same way; the rest takes the longer branches.
    """
    raw, size = x.cast("string"), F.abs(x)
    plain = F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d*?[1-9]|\.0)0*$", "$1")
    power = F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E(\d)", "E+$1")
    short = F.regexp_replace(F.regexp_replace(power, r"E([+-])(\d)$", "E$10$2"), "Infinity", "inf")
    return (
        F.when((size < 1e7) & ((size >= 1e-3) | (size == 0)), raw)
        .when((size < 1e16) & (size >= 1e-4), plain)
        .otherwise(F.lower(short))
    )


def round_share(x: Column, scale: int = 10_000) -> Column:
    """Round a share in [0, 1] to 1/``scale``, ties decided on the exact binary value, then to even.

    ``x`` is split so that both products below are exact doubles.
    """
    high = F.floor(x * F.lit(2.0**26)) / F.lit(2.0**26)
    low = x - high
    k = F.floor(x * scale)
    over = (high * (2.0 * scale) - (2 * k + 1)) + low * (2.0 * scale)
    return F.when((over > 0) | ((over == 0) & (k % 2 == 1)), k + 1).otherwise(k) / F.lit(float(scale))


def as_text(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The string view of a typed table. SQL NULL stays NULL; ``keep`` columns stay typed."""
    kept = set(keep or [])
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in kept or isinstance(f.dataType, T.StringType):
            out.append(c)
        elif isinstance(f.dataType, T.DoubleType):
            out.append(float_text(c).alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            out.append(float_text(c.cast("string").cast("double")).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.initcap(c.cast("string")).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)
