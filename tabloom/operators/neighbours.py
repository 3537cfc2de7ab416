"""Mutual information of numbers and a class by nearest neighbours, for all columns together.

For a value of a class, the radius is the distance to its k-th nearest neighbour of the class; what counts is how many
rows of any class lie within it. Both come from the table of distinct values (column, class, value, n):
the values are numbered in order, dealt into blocks of neighbours that overlap by k values, and the
rows within a radius are the difference of two cumulative counts. No column is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.exprs import finite, num
from tabloom.operators import measures
from tabloom.sources.store import materialise, release

#: Neighbours of a value, and the values that one window of the search holds.
K, BLOCK = 3, 16_384


def digamma(n: Column) -> Column:
    """The digamma function of positive numbers, to about 3e-13: ten steps of its recurrence, then the asymptotic series."""
    x = n.cast("double")
    far = x + 10
    series = F.log(far) - 1 / (2 * far) - 1 / (12 * far * far) + 1 / (120 * F.pow(far, F.lit(4))) - 1 / (252 * F.pow(far, F.lit(6))) + 1 / (240 * F.pow(far, F.lit(8)))
    for i in range(10):
        series = series - 1 / (x + i)
    return series


def _radii(cells: DataFrame, k: int, block: int) -> DataFrame:
    """Add r and near: the distance to the k-th other row of the class (of all others, if fewer), and the rows it stands for.

    Where at least so many rows share the value, r is 0 and near is their number.
    """
    numbered = measures.cumulate(cells.withColumn("one", F.lit(1)), ["k", "y"], "v", ["one"]).drop("one").withColumnRenamed("one_before", "i")
    home, inside = F.floor(F.col("i") / block), F.col("i") % block
    blocks = F.array_compact(F.array(home, F.when((inside < k) & (home > 0), home - 1), F.when(inside >= block - k, home + 1)))
    dealt = numbered.withColumn("block", F.explode(blocks))
    order = Window.partitionBy("k", "y", "block").orderBy("i")
    sides = [F.struct(F.abs(F.col("v") - step("v", j).over(order)).alias("d"), step("n", j).over(order).alias("n")) for j in range(1, k + 1) for step in (F.lag, F.lead)]
    around = F.array_sort(F.filter(F.array(*sides), lambda s: s["d"].isNotNull()))
    wanted = F.least(F.lit(k), F.col("rows") - 1)
    found = F.aggregate("around", F.struct((F.col("n") - 1).cast("long").alias("seen"), F.lit(0.0).alias("r")), lambda a, s: F.when(a["seen"] < F.col("wanted"), F.struct((a["seen"] + s["n"]).cast("long").alias("seen"), s["d"].alias("r"))).otherwise(a))
    own = dealt.withColumns({"around": around, "wanted": wanted, "home": home}).where("block = home")
    out = own.withColumn("r", found["r"])
    return out.select("k", "y", "v", "n", "r", F.when(F.col("r") > 0, F.col("wanted")).otherwise(F.col("n")).alias("near"))


def information(df: DataFrame, names: Sequence[str], target: str, k: int = K, block: int = BLOCK) -> DataFrame:
    """(variable, rows, mi): the nearest-neighbour estimate of the mutual information, in nats, with target > 0; never below 0.

    Missing values, and what is no finite number, count as 0, as does a missing target. A class of one row is left out; with fewer than two
    classes left, or no rows, a variable has mi 0. Rows that share a value are no noise to be broken up: a value held by more than k rows of its class
    has radius 0, and is counted by the rows that share it (the plug-in estimate). Names may repeat and clash with any column.
    Distances are plain double differences, so a row exactly at a radius counts as outside.
    """
    if not names or k < 1 or block < 2 * k:
        raise ValueError("at least one column, one neighbour and blocks of 2 * k values")
    names = list(dict.fromkeys(names))
    y = F.coalesce(num(F.col(f"`{target}`")) > 0, F.lit(False))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), (F.coalesce(finite(num(F.col(f"`{c}`"))), F.lit(0.0)) + F.lit(0.0)).alias("v")) for c in names])
    counted = df.select(F.explode(pairs).alias("c"), y.alias("y")).groupBy("c.k", "y", "c.v").agg(F.count(F.lit(1)).alias("n"))
    all_cells = materialise(counted, "cells")
    classes = all_cells.groupBy("k", "y").agg(F.sum("n").alias("rows")).where("rows > 1")  # two rows a column
    cells = materialise(all_cells.join(F.broadcast(classes), ["k", "y"]), "known")
    radii = materialise(_radii(cells, k, block), "radii")

    ends = F.array(F.struct(F.lit(True).alias("upper"), F.when(F.col("r") > 0, F.col("v") + F.col("r")).otherwise(F.col("v")).alias("at")), F.struct(F.lit(False).alias("upper"), F.when(F.col("r") > 0, F.col("v") - F.col("r")).otherwise(F.col("v")).alias("at")))
    asked = radii.select("*", F.explode(ends).alias("e")).select("k", "y", "v", "r", "e.upper", "e.at")
    points = cells.select("k", F.col("v").alias("at"), "n").unionByName(asked.select("k", "at", F.lit(0).cast("long").alias("n"))).groupBy("k", "at").agg(F.sum("n").alias("n"))
    upto = measures.cumulate(points, ["k"], "at", ["n"])
    # Open at both ends, so the lower end's own rows are taken off, too; a radius of 0 keeps the rows of its value.
    through = F.col("n_before") + F.when(F.col("upper") == (F.col("r") > 0), F.lit(0)).otherwise(F.col("n"))
    within = asked.join(upto, ["k", "at"]).groupBy("k", "y", "v").agg(F.sum(F.when(F.col("upper"), through).otherwise(-through)).alias("within"))

    sizes = classes.groupBy("k").agg(F.sum("rows").alias("total"), F.sum(F.col("rows") * digamma(F.col("rows"))).alias("by_class"), F.count(F.lit(1)).alias("classes"))
    terms = radii.join(within, ["k", "y", "v"]).groupBy("k").agg(F.sum(F.col("n") * (digamma(F.col("near")) - digamma(F.col("within")))).alias("terms"))
    mi = F.when(F.col("classes") > 1, F.greatest(digamma(F.col("total")) + (F.col("terms") - F.col("by_class")) / F.col("total"), F.lit(0.0)))
    wanted = df.sparkSession.createDataFrame([(c,) for c in names], "k string")
    found = wanted.join(F.broadcast(sizes.join(terms, "k")), "k", "left")
    out = materialise(found.select(F.col("k").alias("variable"), F.coalesce("total", F.lit(0)).alias("rows"), F.coalesce(mi, F.lit(0.0)).alias("mi")), "information")
    for table in (all_cells, cells, radii):
        release(table)
    return out
