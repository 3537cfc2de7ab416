"""Periods: one domain type that comes as 202501, 202501.0, "2025M01", "01/2025", 20250131 or a date.

A period column is decoded to a month index, year * 12 + month, by one format for the whole
column: all filled values must agree on it, else the column is no period. The decision is one
aggregation; the decoding is an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.sources.store import materialise, release

#: Spellings that mean an empty period, fixed values.
EMPTY = ("", "nan", "none", "null", "na", "n/a", "nat", "-", "?")
MAX_SCALE_MONTHS = 120
#: Distinct texts of a period that are broadcast with their months.
FEW = 100_000

_YEAR_MONTH = "^([0-9]{4})\\s*[-/._mM]?\\s*([0-9]{1,2})$"
_MONTH_YEAR = "^([0-9]{1,2})\\s*[-/._]\\s*([0-9]{4})$"
_ISO = "^((?:19|2[0-9])[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})"
_DOTTED = "^([0-9]{1,2})\\.([0-9]{1,2})\\.((?:19|2[0-9])[0-9]{2})"


def clean(x: Column, kind: T.DataType) -> Column:
    """The period as text: trimmed, without a fraction of zeros, null for empty spellings."""
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.date_format(x, "yyyy-MM-dd")
    if isinstance(kind, T.FloatType | T.DoubleType):
        x = F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(F.when(~F.isnan(x), x.cast("string")))
    text = F.trim(x.cast("string"))
    text = F.when(~F.lower(text).isin(*EMPTY), text)
    return F.regexp_replace(text, "^(-?[0-9]+)\\.0+$", "$1")


def _month(year: Column, month: Column) -> Column:
    y, m = year.try_cast("int"), month.try_cast("int")
    return F.when(m.between(1, 12), y * 12 + m)


def _formats(text: Column) -> dict[str, Column]:
    n = F.when(text.rlike("^[0-9]{6,8}$"), text).try_cast("long")
    six = F.when(n.between(190001, 299912), _month(F.floor(n / 100), n % 100))
    day = F.when((n % 100).between(1, 31) & n.between(19000101, 29991231), _month(F.floor(n / 10000), F.floor(n / 100) % 100))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    spelled = F.coalesce(
        F.when(text.rlike(_YEAR_MONTH), _month(part(_YEAR_MONTH, 1), part(_YEAR_MONTH, 2))),
        F.when(text.rlike(_MONTH_YEAR), _month(part(_MONTH_YEAR, 2), part(_MONTH_YEAR, 1))),
    )
    dated = F.coalesce(
        F.when(text.rlike(_ISO), _month(part(_ISO, 1), part(_ISO, 2))),
        F.when(text.rlike(_DOTTED), _month(part(_DOTTED, 3), part(_DOTTED, 2))),
    )
    return {"YYYYMM": six, "YYYYMMDD": day, "year-month": spelled, "date": dated}


def month_index(df: DataFrame, name: str, format: str) -> Column:
    """The month index of a column, by a format that ``decide`` gave."""
    return _formats(clean(F.col(f"`{name}`"), df.schema[name].dataType))[format].cast("int")


def texts_of(df: DataFrame, name: str) -> DataFrame:
    """The distinct texts of a column, few for a period, written once."""
    return materialise(df.select(clean(F.col(f"`{name}`"), df.schema[name].dataType).alias("text")).distinct(), "periods")


def span(texts: DataFrame) -> tuple[str | None, tuple[int | None, int | None], int]:
    """Of ``texts_of``: the first format in which every filled value decodes, or None, the first and last month by it, and how many values there are.

    One aggregation; no rows come back.
    """
    formats = _formats(F.col("text"))
    row = texts.select("text", *[c.alias(k) for k, c in formats.items()]).agg(F.count("text").alias("filled"), *[F.struct(F.count(f"`{k}`").alias("n"), F.min(f"`{k}`").alias("a"), F.max(f"`{k}`").alias("b")).alias(k) for k in formats]).first()
    found = next((k for k in formats if row.filled and row[k].n == row.filled), None)
    return found, (row[found].a, row[found].b) if found else (None, None), row.filled


def with_index(df: DataFrame, name: str, format: str, out: str, texts: DataFrame, distinct: int) -> DataFrame:
    """df with the month index as ``out``: each distinct text is decoded once and rows look it up; above FEW texts, row by row."""
    text = out + "_text"
    rows = df.withColumn(text, clean(F.col(f"`{name}`"), df.schema[name].dataType))
    if distinct > FEW:
        return rows.withColumn(out, _formats(F.col(text))[format].cast("int")).drop(text)
    known = texts.where("text IS NOT NULL").select(F.col("text").alias(text), _formats(F.col("text"))[format].cast("int").alias(out))
    return rows.join(F.broadcast(known), text, "left").drop(text)


def decide(df: DataFrame, name: str) -> str | None:
    """The first format in which every filled value decodes, or None."""
    texts = texts_of(df, name)
    found = span(texts)[0]
    release(texts)
    return found


def month_text(month: Column) -> Column:
    """24289 -> '202401'."""
    year = F.floor((month - 1) / 12).cast("int")
    return F.format_string("%04d%02d", year, (month - 12 * year).cast("int"))


def period_end(x: Column) -> Column:
    """The last day of a period: of the month for six digits, of the year for four, the day itself for eight."""
    digits = F.regexp_replace(x.cast("string"), "[^0-9]", "")
    return (
        F.when(F.length(digits) == 6, F.last_day(F.try_to_date(F.concat(digits, F.lit("01")), "yyyyMMdd")))
        .when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))
        .when(F.length(digits) == 4, F.try_to_date(F.concat(digits, F.lit("1231")), "yyyyMMdd"))
    )


def same_scale(a: tuple[int | None, int | None], b: tuple[int | None, int | None], months: int = MAX_SCALE_MONTHS) -> bool:
    """Whether two ranges (min, max) of month indexes can belong together: no gap above ``months`` between them."""
    if None in a or None in b:
        return False
    return max(a[0], b[0]) - min(a[1], b[1]) <= months
