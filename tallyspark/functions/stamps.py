"""Numbers and times in statements, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Local times in statements are in this zone.
ZONE = "America/New_York"


def number(text: Column) -> Column:
    """A number, or null for absent, blank or unreadable text; never 0 instead."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def digits(text: Column) -> Column:
    """A whole number written in digits alone, else null."""
    return F.when(F.trim(text).rlike(r"^\d+$"), F.trim(text).try_cast("bigint"))


def moment(text: Column) -> Column:
    """The instant of a statement's date or time, null if it can't be read.

    ISO-8601 with T and an offset is taken as it is. Without an offset, as YYYY-MM-DD HH:MM:SS, YYYY-MM-DD, YYYYMMDD;HHMMSS, YYYYMMDD HHMMSS or YYYYMMDD it is
    New York time.
    """
    bare = F.trim(text)
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?"
    absolute = F.when(bare.rlike(iso + r"([+-]\d{2}:?\d{2}|Z)$"), F.regexp_replace(bare, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    spaced = F.when(bare.rlike(iso + "$") | bare.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"), bare)
    compact = F.when(bare.rlike(r"^\d{8}([; ]\d{6})?$"), F.regexp_replace(F.regexp_replace(bare, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"), r"[; ](\d{2})(\d{2})(\d{2})$", " $1:$2:$3"))
    return F.coalesce(absolute, F.to_utc_timestamp(F.coalesce(spaced, compact).try_cast("timestamp"), ZONE))


def decimal_text(x: Column) -> Column:
    """The shortest decimal text of a double in Python's notation, which identities in older stores were built from: plain from 1e-4 to 1e16, else as 1e+16. Java before 19 gives a longer text for some doubles from 1e16 up."""
    raw = F.regexp_replace(F.abs(x).cast("string"), r"\.0E", "E")
    mantissa, power = F.regexp_extract(raw, r"^([\d.]+)E", 1), F.regexp_extract(raw, r"E(-?\d+)$", 1).try_cast("int")
    figures = F.replace(mantissa, F.lit("."), F.lit(""))
    large = F.when(F.length(figures) <= power + 1, F.concat(F.rpad(figures, F.greatest(power + 1, F.lit(1)), F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(figures, F.lit(1), power + 1), F.lit("."), F.substring(figures, power + 2, F.length(figures))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), figures)
    science = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    body = F.when(~raw.contains("E"), raw).when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(science)
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.concat(F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise(""), body))


def fingerprint(prefix: str, *parts: Column) -> Column:
    """A stable identity from the parts, null as empty: the first 16 hexadecimal places of their SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, 16))
