"""Measures on distinct-value tables: cumulative counts, exact quantiles, ranks, AUC, KS, information value, PSI.

A value table has one row for each distinct value, so it is the map-side combined form of a
column: one shuffle serves every statistic. Its cumulative counts are found in ranges: the
rows are range-partitioned by (group, value), so a column with very many distinct values is
spread over tasks, and offsets between ranges come from one small sum for each range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.sources.store import materialise

_ALL = "__all"


def grouped(measure: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let a measure take no group columns: the whole table is then one group."""

    @wraps(measure)
    def run(table: DataFrame, group: Sequence[str], *rest: object, **named: object) -> DataFrame:
        if group:
            return measure(table, list(group), *rest, **named)
        return measure(table.withColumn(_ALL, F.lit(0)), [_ALL], *rest, **named).drop(_ALL)

    return run


#: Up to so many bytes, by the optimizer's own bound, one sorted window per group is the cheaper plan. The bound counts
#: compressed files and does not see that rows are exploded, so what a task sorts may be a few dozen times as large.
SMALL = 16 << 20


def _small(values: DataFrame) -> bool:
    """Whether a table is surely small: a look at its plan, not a job."""
    return int(str(values._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def _held(values: DataFrame) -> DataFrame:
    """A large table that is read several times, written first if it has to be aggregated or joined anew each time."""
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    if _small(values) or "InMemoryRelation" in plan or not any(step in plan for step in ("Aggregate", "Join", "Window", "Generate")):
        return values
    return materialise(values, "values")


@grouped
def cumulate(values: DataFrame, group: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """Add ``W_before`` for each weight W: its sum over smaller values of the group."""
    if _small(values):
        run = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return values.withColumns({f"{w}_before": F.coalesce(F.sum(w).over(run), F.lit(0)) for w in weights})
    spark, values = values.sparkSession, _held(values)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(values.repartitionByRange(parts, *group, value).withColumn("__part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__part", *group).agg(*[F.sum(w).alias(f"__{w}") for w in weights])
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *group, *[F.coalesce(F.sum(f"__{w}").over(earlier), F.lit(0)).alias(f"__{w}_off") for w in weights])
    inside = Window.partitionBy("__part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"{w}_before": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    joined = local.join(offsets, ["__part", *group])
    return joined.select(*values.columns, *[(F.col(f"{w}_before") + F.col(f"__{w}_off")).alias(f"{w}_before") for w in weights])


@grouped
def quantiles(values: DataFrame, group: Sequence[str], value: str, weight: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row a group, columns q0, q1, ... in the given order."""
    values = _held(values)
    total = values.groupBy(*group).agg(F.sum(weight).alias("__n"))
    run = cumulate(values, group, value, [weight]).join(total, group)
    out = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col(f"{weight}_before") <= k) & (k < F.col(f"{weight}_before") + F.col(weight))
        a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
        out.append((a + (b - a) * F.max(at - low)).alias(f"q{i}"))
    return run.groupBy(*group).agg(*out)


@grouped
def value_ranks(values: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """Add ``rank``: the average rank (from 1) of each distinct value."""
    return cumulate(values, group, value, [weight]).withColumn("rank", F.col(f"{weight}_before") + (F.col(weight) + 1) / 2.0).drop(f"{weight}_before")


@grouped
def separation(values: DataFrame, group: Sequence[str], value: str, bad: str, good: str) -> DataFrame:
    """auc (Mann-Whitney, ties half), gini, ks and the class sizes, one row a group; null where a class is missing.

    values: distinct values with counts of both classes.
    """
    values = _held(values)
    run = cumulate(values, group, value, [bad, good])
    totals = values.groupBy(*group).agg(F.sum(bad).cast("double").alias("__b"), F.sum(good).cast("double").alias("__g"))
    run = run.join(totals, group)
    both = (F.col("__b") > 0) & (F.col("__g") > 0)
    won = F.sum(F.col(bad) * (F.col(f"{good}_before") + F.col(good) / 2.0))
    gap = F.abs((F.col(f"{bad}_before") + F.col(bad)) / F.col("__b") - (F.col(f"{good}_before") + F.col(good)) / F.col("__g"))
    out = run.groupBy(*group, "__b", "__g").agg(won.alias("__won"), F.max(F.when(both, gap)).alias("ks"))
    auc = F.when(both, F.col("__won") / (F.col("__b") * F.col("__g")))
    return out.select(*group, F.col("__b").cast("long").alias("n_bad"), F.col("__g").cast("long").alias("n_good"), auc.alias("auc"), (2 * auc - 1).alias("gini"), "ks")


def folded(auc: Column) -> Column:
    """Strength without direction."""
    return F.greatest(auc, 1 - auc)


def class_counts(df: DataFrame, group: Sequence[str], value: str, target: str) -> DataFrame:
    """Distinct values with ``bad`` (target > 0) and ``good`` counts; rows with a null value or target are left out."""
    return df.where(F.col(value).isNotNull() & F.col(target).isNotNull()).groupBy(*group, value).agg(F.count_if(F.col(target) > 0).alias("bad"), F.count_if(F.col(target) <= 0).alias("good"))


@grouped
def information_value(bins: DataFrame, group: Sequence[str], bad: str = "bad", good: str = "good", laplace: float = 0.5) -> DataFrame:
    """iv of binned counts, one row a group: half a row added to every cell, and to the totals for every bin.

    This is the single-factor variant; ``uplift_iv`` differs in what counts as a bin.
    """
    totals = bins.groupBy(*group).agg(F.sum(bad).alias("__b"), F.sum(good).alias("__g"), F.count(F.lit(1)).alias("__k"))
    joined = bins.join(totals, group)
    pb = (F.col(bad) + laplace) / (F.col("__b") + laplace * F.col("__k"))
    pg = (F.col(good) + laplace) / (F.col("__g") + laplace * F.col("__k"))
    both = (F.col("__b") > 0) & (F.col("__g") > 0)
    return joined.groupBy(*group).agg(F.sum(F.when(both, (pb - pg) * F.log(pb / pg))).alias("iv"), F.max("__k").alias("bins"))


@grouped
def uplift_iv(bins: DataFrame, group: Sequence[str], bad: str = "bad", good: str = "good") -> DataFrame:
    """iv for candidate features: as above, where empty bins count for nothing and nulls are a bin of their own."""
    return information_value(bins.where(F.col(bad) + F.col(good) > 0), group, bad, good)


@grouped
def bin_woe(bins: DataFrame, group: Sequence[str], bad: str = "bad", good: str = "good", laplace: float = 0.5) -> DataFrame:
    """Add ``woe`` = ln(bad share / good share): the binning sign, opposite to that of the feature encodings."""
    totals = bins.groupBy(*group).agg(F.sum(bad).alias("__b"), F.sum(good).alias("__g"), F.count(F.lit(1)).alias("__k"))
    joined = bins.join(totals, group)
    pb = (F.col(bad) + laplace) / (F.col("__b") + laplace * F.col("__k"))
    pg = (F.col(good) + laplace) / (F.col("__g") + laplace * F.col("__k"))
    return joined.withColumn("woe", F.log(pb / pg)).drop("__b", "__g", "__k")


@grouped
def shares_psi(counts: DataFrame, group: Sequence[str], expected: str, actual: str, floor: float = 1e-4) -> DataFrame:
    """psi of two count columns over bins, one row a group; empty shares count as ``floor``."""
    totals = counts.groupBy(*group).agg(F.sum(expected).alias("__e"), F.sum(actual).alias("__a"))
    joined = counts.join(totals, group)
    e = F.greatest(F.try_divide(F.col(expected), F.col("__e")), F.lit(floor))
    a = F.greatest(F.try_divide(F.col(actual), F.col("__a")), F.lit(floor))
    return joined.groupBy(*group).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
