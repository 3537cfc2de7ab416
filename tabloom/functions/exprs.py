"""Column expressions that every operator shares: null rules, safe arithmetic, text folding, bins, ranks.

Spark's ANSI mode throws where tabular work wants a null, so text becomes a number by
``num`` and division goes through ``div``; nothing here switches ANSI off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def null(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def finite(x: Column) -> Column:
    """x, with NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == INFINITY), null()).otherwise(x)


def num(x: Column) -> Column:
    """x as a double; what is no number, and NaN, is null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0; never infinite."""
    return finite(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))))


def normalise(df: DataFrame) -> DataFrame:
    """NaN in floats and empty text become null, once, at the scan."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x between low and high; null stays null (least and greatest would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def turkish_lower(x: Column) -> Column:
    """Lower case with dotless and dotted i kept apart: the two capitals are mapped before ``lower``."""
    return F.lower(F.translate(x, "Iİ", "ıi"))


#: Folded letters, fixed values: c g i o s u a i u for ç ğ ı ö ş ü â î û.
_FOLD = ("çğıöşüâîû", "cgiosuaiu")


def turkish_fold(x: Column) -> Column:
    return F.translate(turkish_lower(x), *_FOLD)


def spelling_key(x: Column) -> Column:
    """One key for all spellings of a value: trimmed, single spaces, folded."""
    return turkish_fold(F.trim(F.regexp_replace(x, "\\s+", " ")))


def below(cuts: Sequence[float], x: Column, inclusive: bool) -> Column:
    """How many cuts lie below x, or (inclusive) at or below it; null for null x.

    inclusive False is a search from the left: a cut is the inclusive upper bound of its bin.
    """
    if not len(cuts):
        return F.when(x.isNotNull(), F.lit(0))
    array = F.array(*[F.lit(float(c)) for c in cuts])
    return F.when(x.isNotNull(), F.size(F.filter(array, lambda c: (c <= x) if inclusive else (c < x))))


def average_rank(x: Column, by: Sequence[Column] = ()) -> Column:
    """Rank from 1 with ties sharing their mean; null for null x.

    A rank over a whole table sorts it in one task: give ``by``, or rank the distinct values
    (``tabloom.operators.measures.value_ranks``), wherever the table is large.
    """
    own = Window.partitionBy(*by, x.isNull()).orderBy(x)
    peers = Window.partitionBy(*by, x)
    return F.when(x.isNotNull(), F.rank().over(own) + (F.count(F.lit(1)).over(peers) - 1) / 2.0)


def choose(mapping: dict, x: Column, otherwise: Column) -> Column:
    """Look x up in a small mapping that was learnt on the driver (at most about a thousand entries)."""
    if not mapping:
        return otherwise
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), otherwise)
