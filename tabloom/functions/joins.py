"""Joins of rows with learnt tables, in which no key gathers in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A learnt table of up to so many rows is broadcast whole; of a larger one only keys that many rows ask for, of which there are fewer.
BROADCAST = 20_000


def attach(rows: DataFrame, found: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join: every row, with the columns of found (one row a key; ``weight``: about how many rows have the key, adding up to total).

    Keys that ask more often than total / BROADCAST are answered by a broadcast, all others by a
    shuffle in which none is large. Rows with a null or an unknown key get nulls and aren't
    shuffled to one place: nulls stay where they are.
    """
    new = [c for c in found.columns if c not in (key, weight)]
    if found.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(found.drop(weight)), key, "left")
    heavy = F.col(weight) > total // BROADCAST
    filled = rows.where(F.col(key).isNotNull())
    often = F.broadcast(found.where(heavy).drop(weight))
    light = filled.join(F.broadcast(found.where(heavy).select(key)), key, "left_anti").join(found.where(~heavy).drop(weight), key, "left")
    none = rows.where(F.col(key).isNull()).select(key, *[c for c in rows.columns if c != key], *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in new])
    return filled.join(often, key).unionByName(light).unionByName(none)
