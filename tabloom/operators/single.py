"""Single-factor analysis of all variables at once, and columns that order the rows alike.

One value table, (variable, value, fold, counts), serves fills, quantiles, information values and the
C-values of every variable. The C-values are folded AUCs of five scores (raw, clipped, log,
exp, rank), found in one cumulation that carries the score's name as part of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import num
from tabloom.operators import measures, variables
from tabloom.operators.binning import MIN_ROWS, iv_band
from tabloom.operators.features import fold_of
from tabloom.operators.measures import folded
from tabloom.sources.store import materialise, release

#: Share cut off at both ends, levels of a category above which it is left out, and the C-value that means leakage. Fixed values.
CLIP, MAX_LEVELS, LEAK = 0.05, 50, 0.95
MISSING = "MISSING"
SCORES = ("c_raw", "c_clipped", "c_log", "c_exp", "c_rank")


def _cells(df: DataFrame, names: Sequence[str], value: type, target: str, train: Column, keys: Sequence[str]) -> DataFrame:
    """(k, v, f, m, n, bad): train rows m of each value and fold, those with a target, and their bad ones; v is null for missing values.

    Values that occur outside train only are kept with m = 0, as they count as levels.
    """
    one = (lambda c: num(F.col(f"`{c}`"))) if value is float else (lambda c: F.col(f"`{c}`").cast("string"))
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), one(c).alias("v")) for c in names])
    y = F.col(f"`{target}`")
    rows = df.select(F.explode(pairs).alias("c"), (fold_of(keys) if value is str else F.lit(0)).alias("f"), F.coalesce(train, F.lit(False)).alias("t"), y.isNotNull().alias("known"), F.coalesce(y > 0, F.lit(False)).alias("y"))
    return rows.groupBy("c.k", "c.v", "f").agg(F.count_if("t").alias("m"), F.count_if(F.col("t") & F.col("known")).alias("n"), F.count_if(F.col("t") & F.col("y")).alias("bad"))


def _scores(filled: DataFrame) -> DataFrame:
    """(k, what, score, n, bad): five scores of every filled value, by parameters of the train rows.

    exp is of the value's place between the least and the greatest one; rank is the share of train rows at or below it.
    """
    bounds = measures.quantiles(filled.where("m > 0"), ["k"], "v", "m", (CLIP, 1 - CLIP))
    ends = filled.where("m > 0").groupBy("k").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("m").alias("total"))
    x, width = F.col("v"), F.coalesce(F.nullif(F.col("most") - F.col("least"), F.lit(0.0)), F.lit(1.0))
    place = F.least(F.greatest((x - F.col("least")) / width, F.lit(-5.0)), F.lit(5.0))
    made = (x, F.least(F.greatest(x, F.col("q0")), F.col("q1")), F.signum(x) * F.log1p(F.abs(x)), F.exp(place), (F.col("m_before") + F.col("m")) / F.col("total"))
    run = measures.cumulate(filled.where("m > 0"), ["k"], "v", ["m"])
    cells = run.join(F.broadcast(bounds.join(ends, "k")), "k").select("k", F.explode(F.array(*[F.struct(F.lit(w).alias("what"), s.alias("score")) for w, s in zip(SCORES, made, strict=True)])).alias("s"), "n", "bad")
    return cells.groupBy("k", "s.what", "s.score").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _numbers(df: DataFrame, names: Sequence[str], target: str, train: Column, keys: Sequence[str], bins: int) -> DataFrame:
    """(variable, fill, missing, bins, iv, and a C-value each) of numeric variables, missing values filled with the train median."""
    cells = materialise(_cells(df, names, float, target, train, keys), "cells")
    medians = materialise(measures.quantiles(cells.where("v IS NOT NULL AND m > 0"), ["k"], "v", "m", (0.5,)).select("k", F.col("q0").alias("median")), "medians")
    joined = cells.join(F.broadcast(medians), "k", "left").withColumn("v", F.coalesce("v", "median"))
    filled = materialise(joined.where("v IS NOT NULL").groupBy("k", "v").agg(*[F.sum(c).alias(c) for c in ("m", "n", "bad")]), "filled")
    run = materialise(measures.cumulate(filled.where("m > 0").select("k", "v", F.col("m").alias("n")), ["k"], "v", ["n"]).withColumn("upto", F.col("n_before") + F.col("n")), "running")
    cuts = variables.equal_cuts(run, bins)
    table = df.sparkSession.createDataFrame([(c, [float(x) for x in cuts.get(c, [])]) for c in names], "k string, cuts array<double>")
    place = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    binned = filled.where("m > 0").join(F.broadcast(table), "k").groupBy("k", place.alias("b")).agg(F.sum("bad").alias("bad"), F.sum(F.col("n") - F.col("bad")).alias("good"))
    ivs = measures.information_value(binned, ["k"])
    missing = cells.groupBy("k").agg(F.sum(F.when(F.col("v").isNull(), F.col("m")).otherwise(0)).alias("missing"))
    out = materialise(_c_values(_scores(filled)).join(ivs, "k", "full").join(missing, "k", "full").join(medians, "k", "left"), "single")
    for t in (cells, medians, filled, run):
        release(t)
    return out.select(F.col("k").alias("variable"), F.lit("numeric").alias("type"), F.col("median").alias("fill"), "missing", "bins", F.when(F.col("bins") > 1, F.col("iv")).alias("iv"), *SCORES, F.when(F.coalesce("bins", F.lit(0)) > 1, "measured").otherwise("not measurable").alias("result"))


def _c_values(scores: DataFrame) -> DataFrame:
    """One row a variable with a column for each score; fewer than 100 rows with a target give null."""
    counts = scores.where("n > 0").select("k", "what", "score", "bad", (F.col("n") - F.col("bad")).alias("good"))
    auc = measures.separation(counts, ["k", "what"], "score", "bad", "good")
    c = F.when(F.col("n_bad") + F.col("n_good") >= MIN_ROWS, folded(F.col("auc")))
    return auc.groupBy("k").agg(*[F.max(F.when(F.col("what") == w, c)).alias(w) for w in SCORES])


def _categories(df: DataFrame, names: Sequence[str], target: str, train: Column, keys: Sequence[str]) -> DataFrame:
    """The same for categories: a level of their own for missing values, the target rate of the other folds as the score.

    A level that the other folds don't have takes their overall rate. More than 50 levels: left out, but listed.
    """
    cells = materialise(_cells(df, names, str, target, train, keys), "cells")
    facts = materialise(cells.groupBy("k").agg(F.count_distinct("v").alias("levels"), F.sum(F.when(F.col("v").isNull(), F.col("m")).otherwise(0)).alias("missing")), "levels")
    short = cells.join(F.broadcast(facts.where(F.col("levels") <= MAX_LEVELS).select("k")), "k").withColumn("v", F.coalesce("v", F.lit(MISSING)))
    short = materialise(short.groupBy("k", "v", "f").agg(*[F.sum(c).alias(c) for c in ("m", "n", "bad")]).where("m > 0"), "short")
    level, fold = ((short.groupBy("k", c).agg(F.sum("n").alias(f"n_{c}"), F.sum("bad").alias(f"b_{c}"))) for c in ("v", "f"))
    whole = short.groupBy("k").agg(F.sum("n").alias("n_k"), F.sum("bad").alias("b_k"))
    rate = F.coalesce(F.try_divide(F.col("b_v") - F.col("bad"), F.col("n_v") - F.col("n")), F.try_divide(F.col("b_k") - F.col("b_f"), F.col("n_k") - F.col("n_f")))
    scored = short.join(level, ["k", "v"]).join(fold, ["k", "f"]).join(whole, "k").select("k", rate.alias("score"), "n", "bad").where("score IS NOT NULL")
    scores = scored.groupBy("k", F.lit(SCORES[0]).alias("what"), "score").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ivs = measures.information_value(level.select("k", F.col("b_v").alias("bad"), (F.col("n_v") - F.col("b_v")).alias("good")), ["k"])
    same = [F.col("c_raw").alias(w) for w in SCORES]
    out = materialise(facts.join(_c_values(scores).select("k", "c_raw"), "k", "left").join(ivs, "k", "left"), "single")
    for t in (cells, facts, short):
        release(t)
    return out.select(F.col("k").alias("variable"), F.lit("categorical").alias("type"), F.lit(None).cast("double").alias("fill"), "missing", "bins", "iv", *same, F.when(F.col("levels") > MAX_LEVELS, "left out").otherwise("measured").alias("result"))


def single_factors(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, train: Column, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """One row a variable: type, fill, missing (train rows), bins, iv, band, five C-values, leak, result.

    Everything is learnt and measured on train rows; rows without a target only fill and cut. Nothing
    is dropped: a variable in one bin is "not measurable", a category of more than 50 levels
    "left out", and both have their row. keys give the folds of categories. Jobs don't follow
    the number of variables.
    """
    parts = ([_numbers(df, numbers, target, train, keys, bins)] if numbers else []) + ([_categories(df, categories, target, train, keys)] if categories else [])
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return out.withColumn("band", iv_band(F.col("iv"))).withColumn("leak", F.coalesce(F.col("c_raw") > LEAK, F.lit(False)))


# ---- columns of equal order -----------------------------------------------------------------


def same_order(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(column, first, direction): columns that put all rows in one order, or in the opposite one, with the least name of their class.

    Such columns say the same to a tree. Only classes of two and more have rows; ``first`` has one, too.
    A column is its dense ranks with the set of rows at each: the rows' keys are hashed and
    summed by value (three sums of 21 bits, so 10^12 rows don't overflow), and the sums hashed
    with the rank from below and from above. That is one shuffle of values for all columns,
    and no pair of columns is compared. Nulls must lie in the same rows. Rows that share a key
    can't be told apart: columns that part only there count as equal.
    """
    h = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    pieces = [F.shiftrightunsigned(h, 21 * i).bitwiseAND(F.lit(0x1FFFFF)).alias(f"h{i}") for i in range(3)]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), num(F.col(f"`{c}`")).alias("v")) for c in names])
    values = df.select(*pieces, F.explode(pairs).alias("c")).where("c.v IS NOT NULL").groupBy("c.k", "c.v").agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(3)], F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    values = materialise(values, "orders")
    run = measures.cumulate(values, ["k"], "v", ["one"]).join(F.broadcast(values.groupBy("k").agg(F.count(F.lit(1)).alias("d"))), "k")
    rows = ["h0", "h1", "h2", "n"]
    up, down = (F.xxhash64(*rows, r.cast("long")) for r in (F.col("one_before"), F.col("d") - 1 - F.col("one_before")))
    part = lambda x, i: F.sum(F.shiftrightunsigned(x, 21 * i).bitwiseAND(F.lit(0x1FFFFF)))
    mark = lambda x: F.concat_ws("-", *[part(x, i).cast("string") for i in range(3)], F.count(F.lit(1)).cast("string"), F.sum("n").cast("string"))
    prints = run.groupBy("k").agg(mark(up).alias("up"), mark(down).alias("down"))
    classed = prints.withColumn("mark", F.least("up", "down"))
    heads = classed.groupBy("mark").agg(F.min("k").alias("first"), F.min_by("up", "k").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    out = materialise(classed.join(heads, "mark").select(F.col("k").alias("column"), "first", F.when(F.col("up") == F.col("head"), "same").otherwise("opposite").alias("direction")), "same-order")
    release(values)
    return out
