"""Advice to keep, drop or mend columns, from one count cube.

The cube has one row for each (column, period, value) with its rows, and the train rows and
events among them: one melt and one shuffle for all columns, combined before it. Every
finding and every figure behind its advice is an aggregation of the cube; the data isn't read again.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.exprs import num, spelling_key, turkish_lower
from tabloom.operators import measures
from tabloom.operators.checks import EMPTY_TEXTS, HIDDEN_CODES, never_negative
from tabloom.operators.profile import kind_of, numeric
from tabloom.sources.store import materialise

#: Limits of findings, fixed values: share of the top value, rows of a period that can be constant or drift, null shares of a jump, factor of a drift, of an extreme.
DOMINANT, CONSTANT_ROWS, DRIFT_ROWS, JUMP, DRIFT, EXTREME, PLACES = 0.99, 100, 30, 0.20, 10.0, 100.0, 4
#: Limits of advice, fixed values: rows beside the top value, ratio of target rates, share of first periods, null share after a jump, distance from a power of ten, share of negatives, of spelled nulls.
BESIDE, RATIO, FIRST, GONE, POWER, NEGATIVES, SPELLED = 30, 1.5, 0.35, 0.5, 0.05, 0.05, 0.05
#: Words in names of codes and ids, fixed values.
CODE_WORDS = ("KOD", "CODE", "CD", "NO", "ID", "KIMLIK", "NUMARA", "NUM")
_OUT = ("column", "finding", "advice", "reason", "figure", "against")


def count_cube(df: DataFrame, columns: Sequence[str], period: str, target: str | None = None, train: Column | None = None) -> DataFrame:
    """(k, p, v, n, nt, bt): rows of each value, as text, null included, by column and period; nt and bt are train rows with a target and events among them."""
    # numbers are grouped as numbers; only what is left of them becomes text
    number = {c: numeric(kind_of(df.schema[c].dataType)) for c in columns}
    x = lambda c: num(F.col(f"`{c}`")) if number[c] else F.lit(None).cast("double")
    text = lambda c: F.lit(None).cast("string") if number[c] else F.col(f"`{c}`").cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), x(c).alias("x"), text(c).alias("s")) for i, c in enumerate(columns)])
    y = F.col(f"`{target}`") if target else F.lit(None).cast("int")
    own = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    rows = df.select(F.col(f"`{period}`").cast("string").alias("p"), (own & y.isNotNull()).alias("t"), (own & (y > 0)).alias("b"), F.explode(cells).alias("c"))
    sums = rows.groupBy("c.i", "p", "c.x", "c.s").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("nt"), F.count_if("b").alias("bt"))
    return sums.select(F.get(F.array(*map(F.lit, columns)), F.col("i")).alias("k"), "p", F.coalesce("s", F.col("x").cast("string")).alias("v"), "n", "nt", "bt")


def _row(finding: str, advice: Column, reason: Column, figure: Column, against: Column) -> list[Column]:
    return [F.col("k").alias("column"), F.lit(finding).alias("finding"), advice.alias("advice"), reason.alias("reason"), figure.cast("double").alias("figure"), against.cast("double").alias("against")]


def dominant(cube: DataFrame, binary: bool) -> DataFrame:
    """Near-constant columns: do the rows beside the top train value have another target rate?"""
    values = cube.groupBy("k", "v").agg(*[F.sum(c).alias(c) for c in ("n", "nt", "bt")])
    top = values.groupBy("k").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count(F.lit(1)).alias("d"), F.sum("nt").alias("t"), F.sum("bt").alias("b"), F.max_by(F.struct("nt", "bt"), F.struct("nt", F.col("v").isNull(), "v")).alias("top"))
    near = top.where((F.col("d") > 1) & (F.col("most") >= DOMINANT * F.col("rows")))
    beside = F.col("t") - F.col("top.nt")
    rate, main = (F.col("b") - F.col("top.bt")) / F.nullif(beside, F.lit(0)), F.col("top.bt") / F.nullif(F.col("top.nt"), F.lit(0))
    low, high = F.least(rate, main), F.greatest(rate, main)
    unknown = F.lit(not binary) | (F.col("t") == 0)
    reason = F.when(unknown, "hedef_yok").when(beside < BESIDE, "az_satir").when(high == 0, "olay_yok").when((low == 0) | (high / F.nullif(low, F.lit(0.0)) >= RATIO), "ayirir").otherwise("ayirmaz")
    return near.select(*_row("baskin", F.when(reason.isin("hedef_yok", "ayirir"), "tut").otherwise("cikar"), reason, F.when(~unknown, rate), F.when(~unknown, main)))


def _periods(cube: DataFrame) -> DataFrame:
    """(k, p, rows, filled, d, place, periods) of known periods, in their order."""
    by = cube.where("p IS NOT NULL").groupBy("k", "p").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("v").alias("d"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("p"))).withColumn("periods", F.count(F.lit(1)).over(Window.partitionBy("k")))


def gaps(periods: DataFrame) -> DataFrame:
    """Columns that are empty, or hold one value, in some periods: the last ones, only the first ones, or others."""
    constant = (F.col("filled") == F.col("rows")) & (F.col("d") == 1) & (F.col("rows") >= CONSTANT_ROWS)
    marked = periods.withColumn("c", constant).withColumn("always", F.bool_and("c").over(Window.partitionBy("k")))
    bad = marked.where((F.col("filled") == 0) | (F.col("c") & ~F.col("always")))
    got = bad.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.max("place").alias("last"), F.max("periods").alias("periods"))
    reason = F.when(F.col("last") == F.col("periods"), "son_donem").when((F.col("last") == F.col("m")) & (F.col("m") <= FIRST * F.col("periods")), "ilk_donemler").otherwise("tutarsiz")
    return got.select(*_row("donem", F.when(reason == "ilk_donemler", "tut").otherwise("cikar"), reason, F.col("m"), F.col("periods")))


def jumps(periods: DataFrame) -> DataFrame:
    """The largest change of the null share between neighbouring periods."""
    order = Window.partitionBy("k").orderBy("place")
    share = 1 - F.col("filled") / F.col("rows")
    steps = periods.withColumn("after", share).withColumn("before", F.lag("after").over(order)).withColumn("jump", F.abs(F.col("after") - F.col("before")))
    best = steps.where(F.col("jump") > JUMP).groupBy("k").agg(F.max_by(F.struct("before", "after"), F.struct("jump", -F.col("place"))).alias("s")).select("k", "s.*")
    more = F.col("after") > F.col("before")
    reason = F.when(~more, "azaldi").when(F.col("after") >= GONE, "asti").otherwise("artti")
    return best.select(*_row("sicrama", F.when(reason == "asti", "cikar").otherwise("tut"), reason, F.col("before"), F.col("after")))


def drifts(cube: DataFrame, periods: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All quartiles of non-zero sizes move one way by a factor: a power of ten is a change of unit."""
    sizes = cube.where(F.col("k").isin(*columns) & F.col("p").isNotNull()).select("k", "p", F.abs(num(F.col("v"))).alias("x"), "n").where("x > 0").groupBy("k", "p", "x").agg(F.sum("n").alias("n"))
    q = measures.quantiles(sizes, ["k", "p"], "x", "n", (0.25, 0.5, 0.75)).join(sizes.groupBy("k", "p").agg(F.sum("n").alias("m")), ["k", "p"])
    order = Window.partitionBy("k").orderBy("place")
    steps = periods.select("k", "p", "place").join(q, ["k", "p"], "left").withColumns({f"{c}_b": F.lag(c).over(order) for c in ("q0", "q1", "q2", "m")})
    ratios = [F.col(f"q{i}") / F.col(f"q{i}_b") for i in range(3)]
    up, down = F.least(*ratios), 1 / F.greatest(*ratios)
    steps = steps.where((F.col("m") >= DRIFT_ROWS) & (F.col("m_b") >= DRIFT_ROWS)).withColumn("f", F.when(up > 1, up).when(down > 1, down)).where(F.col("f") >= DRIFT)
    best = steps.groupBy("k").agg(F.max_by(F.struct("f", "q1_b", "q1"), F.struct("f", -F.col("place"))).alias("s")).select("k", "s.*")
    power = F.log10("f")
    unit = (F.round(power) >= 1) & (F.abs(power - F.round(power)) <= POWER)
    return best.select(*_row("kayma", F.when(unit, "cikar").otherwise("tut"), F.when(unit, "birim").otherwise("degisim"), F.col("f"), F.col("q1") / F.col("q1_b")))


def numbers(cube: DataFrame, columns: Sequence[str], fractional: Sequence[str], described: Mapping[str, str]) -> DataFrame:
    """Extremes, unexpected negatives and needless decimals of numeric columns."""
    values = cube.where(F.col("k").isin(*columns)).select("k", num(F.col("v")).alias("x"), "n").where("x IS NOT NULL").groupBy("k", "x").agg(F.sum("n").alias("n"))
    x, n = F.col("x"), F.col("n")
    facts = values.groupBy("k").agg(
        F.sum("n").alias("filled"), F.max("x").alias("most"), F.sum(F.when(x < 0, n).otherwise(0)).alias("negative"), F.min("x").alias("least"),
        F.bool_and(x == F.floor("x")).alias("whole"), F.bool_or(F.bround("x", PLACES) != x).alias("long"),
    ).join(measures.quantiles(values, ["k"], "x", "n", (0.99,)), "k")
    far = facts.where((F.col("q0") > 0) & (F.col("most") > EXTREME * F.col("q0")) & ~F.col("most").isin(*[float(c) for c in HIDDEN_CODES]))
    out = [far.select(*_row("uc", F.lit("kirp"), F.lit("kat"), F.col("most"), F.col("q0")))]
    never = [c for c in columns if never_negative(described.get(c, ""))]
    share = F.col("negative") / F.col("filled")
    below = facts.where(F.col("k").isin(*never) & (F.col("negative") > 0))
    out.append(below.select(*_row("negatif", F.when(share < NEGATIVES, "negatif_bos").otherwise("birak"), F.when(share < NEGATIVES, "az").otherwise("sistematik"), F.col("negative"), F.col("least"))))
    coded = [c for c in columns if set(re.split("[^A-Za-z0-9]+", c.upper())) & set(CODE_WORDS)]
    fine = facts.where(F.col("k").isin(*fractional) & (F.col("whole") | F.col("long")))
    code = F.col("k").isin(*coded)
    out.append(fine.select(*_row("ondalik", F.when(code, "birak").when(F.col("whole"), "tam_sayi").otherwise("yuvarla"), F.when(code, "kod_adi").when(F.col("whole"), "tam").otherwise("fazla"), F.lit(PLACES), F.col("filled"))))
    return reduce(DataFrame.unionAll, out)


def texts(cube: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls spelled as text, and values in several spellings."""
    values = cube.where(F.col("k").isin(*columns) & F.col("v").isNotNull()).groupBy("k", "v").agg(F.sum("n").alias("n")).withColumn("e", turkish_lower(F.trim("v")).isin(*EMPTY_TEXTS))
    spelled = values.groupBy("k").agg(F.sum(F.when(F.col("e"), F.col("n")).otherwise(0)).alias("m"), F.sum("n").alias("filled")).where("m > 0")
    share = F.col("m") / F.col("filled")
    out = spelled.select(*_row("metin_bos", F.when(share >= SPELLED, "metin_bos_bayrak").otherwise("metin_bos"), F.when(share >= SPELLED, "cok").otherwise("az"), F.col("m"), share))
    keys = values.where("NOT e AND v <> ''").groupBy("k", spelling_key(F.col("v")).alias("s")).agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"), F.max("n").alias("top")).where("d > 1")
    several = keys.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n") - F.col("top")).alias("rows"))
    return out.unionAll(several.select(*_row("yazim", F.lit("tek_yazim"), F.lit("yazimlar"), F.col("m"), F.col("rows"))))


def keep_or_drop(df: DataFrame, columns: Sequence[str], period: str, target: str | None = None, train: Column | None = None, described: Mapping[str, str] | None = None) -> DataFrame:
    """(column, finding, advice, reason, figure, against): one row for each finding on a column.

    Findings, with what they advise: baskin (near constant: tut or cikar by the target rates beside and at the top value),
    donem (empty or constant in periods: cikar, but tut if only the first third or so is), sicrama (null share), kayma (a
    factor near a power of ten is a change of unit: cikar), uc (kirp), negatif (negatif_bos or birak), metin_bos, yazim, ondalik.
    figure and against are the numbers that decided. Rows of a null period count in what isn't by period. Target rates
    come from train rows with a target of two classes. No row for a column without findings; none for an empty table.
    """
    columns = list(dict.fromkeys(columns))
    cube = materialise(count_cube(df, columns, period, target, train), "cube")
    kinds = {c: kind_of(df.schema[c].dataType) for c in columns}
    number = [c for c in columns if numeric(kinds[c])]
    classes = df.select(F.col(f"`{target}`").cast("double").alias("y")).where("y IS NOT NULL").agg(F.bool_and(F.col("y").isin(0.0, 1.0)).alias("b")).first().b if target else False
    periods = materialise(_periods(cube), "periods")
    out = [dominant(cube, bool(classes)), gaps(periods), jumps(periods)]
    if number:
        out += [drifts(cube, periods, number), numbers(cube, number, [c for c in number if kinds[c] == "ondalik"], described or {})]
    words = [c for c in columns if kinds[c] == "metin"]
    if words:
        out.append(texts(cube, words))
    return reduce(DataFrame.unionAll, out).select(*_OUT)
