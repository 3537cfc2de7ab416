"""Supervised binning and single-factor analysis on train rows.

Here are the rules on the bins of one variable, at most a few dozen: merging, shapes, information
value, labels. Fine bins, cuts and proposals of all variables together are in ``variables``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import below, num
from tabloom.operators import measures

FINE, MOST, MIN_SHARE, P_LIMIT, U_GAIN, LAPLACE, MIN_ROWS, MIN_IV = 20, 8, 0.05, 0.05, 0.10, 0.5, 100, 0.02


@dataclass
class Bin:
    n: int
    bad: int
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()

    @property
    def rate(self) -> float:
        return self.bad / self.n if self.n else 0.0

    def __add__(self, other: Bin) -> Bin:
        return Bin(self.n + other.n, self.bad + other.bad, self.low, other.high, self.values + other.values)


def equal_cuts(counts: Sequence[tuple[float, int]], k: int) -> list[float]:
    """Cuts nearest to equal frequency that never split a value; a cut is its bin's inclusive upper bound.

    counts: (value, rows) in order. The aim is set anew after each cut from what is left; up to
    k distinct values get a bin each.
    """
    if len(counts) <= k:
        return [v for v, _ in counts[:-1]]
    cuts, held, left, bins = [], 0, float(sum(n for _, n in counts)), k
    for v, n in counts[:-1]:
        held += n
        if bins > 1 and held >= left / bins:
            cuts.append(v)
            left, bins, held = left - held, bins - 1, 0
    return cuts


def fine_cuts(train: DataFrame, column: str, k: int = FINE, grid: int = 2_000) -> list[float]:
    """``equal_cuts`` of a column. Beyond ``grid`` distinct values the value table stays distributed:

    each cut is one look-up of the value at which the running count reaches its aim.
    """
    x = num(F.col(f"`{column}`"))
    tt = train.select(x.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        if tt.limit(grid + 1).count() <= grid:
            return equal_cuts([(r.v, r.n) for r in tt.orderBy("v").collect()], k)
        run = measures.cumulate(tt, [], "v", ["n"]).withColumn("upto", F.col("n_before") + F.col("n")).persist()
        total = run.agg(F.max("upto")).first()[0]
        last = tt.agg(F.max("v")).first()[0]
        cuts, done, bins = [], 0, k
        while bins > 1:
            aim = done + (total - done) / bins
            row = run.where(F.col("upto") >= aim).agg(F.min(F.struct("v", "upto")).alias("s")).first()
            if row.s is None or row.s.v >= last:
                break
            cuts.append(row.s.v)
            done, bins = row.s.upto, bins - 1
        run.unpersist()
        return cuts
    finally:
        tt.unpersist()


def iv(bins: Sequence[Bin]) -> float | None:
    bad, good, k = sum(b.bad for b in bins), sum(b.n - b.bad for b in bins), len(bins)
    if not bad or not good:
        return None
    out = 0.0
    for b in bins:
        x, y = (b.bad + LAPLACE) / (bad + LAPLACE * k), (b.n - b.bad + LAPLACE) / (good + LAPLACE * k)
        out += (x - y) * math.log(x / y)
    return out


def _pooled(bins: Sequence[Bin], rising: bool) -> list[Bin]:
    """Adjacent violators of one direction are pooled until the rates are monotone."""
    stack: list[Bin] = []
    for b in bins:
        stack.append(b)
        while len(stack) > 1 and ((stack[-2].rate > stack[-1].rate) if rising else (stack[-2].rate < stack[-1].rate)):
            last = stack.pop()
            stack[-1] = stack[-1] + last
    return stack


def _merge_at(bins: list[Bin], i: int) -> list[Bin]:
    return [*bins[:i], bins[i] + bins[i + 1], *bins[i + 2 :]]


def _shares(bins: list[Bin], total: int) -> list[Bin]:
    """Bins below the least share join the neighbour with the nearest rate, the smallest first."""
    while len(bins) > 1 and min(b.n for b in bins) < MIN_SHARE * total:
        i = min((j for j, b in enumerate(bins) if b.n < MIN_SHARE * total), key=lambda j: bins[j].n)
        near = min((j for j in (i - 1, i + 1) if 0 <= j < len(bins)), key=lambda j: abs(bins[j].rate - bins[i].rate))
        bins = _merge_at(bins, min(i, near))
    return bins


def p_value(a: Bin, b: Bin) -> float:
    """Two-sided z test of two proportions."""
    p = (a.bad + b.bad) / (a.n + b.n)
    if not 0 < p < 1:
        return 1.0
    return math.erfc(abs(a.rate - b.rate) / math.sqrt(p * (1 - p) * (1 / a.n + 1 / b.n)) / math.sqrt(2))


def _distinct(bins: list[Bin]) -> list[Bin]:
    """Neighbours that don't differ significantly are merged, the most alike first, and any until there are at most MOST."""
    while len(bins) > 1:
        p = [p_value(a, b) for a, b in zip(bins, bins[1:], strict=False)]
        i = p.index(max(p))
        if p[i] <= P_LIMIT and len(bins) <= MOST:
            break
        bins = _merge_at(bins, i)
    return bins


def shape(bins: Sequence[Bin]) -> str:
    steps = [(b.rate > a.rate) - (b.rate < a.rate) for a, b in zip(bins, bins[1:], strict=False)]
    steps = [s for s in steps if s]
    if not steps:
        return "düz"
    turns = sum(a != b for a, b in zip(steps, steps[1:], strict=False))
    return ("artan" if steps[0] > 0 else "azalan") if not turns else ("U" if steps[0] < 0 else "ters U") if turns == 1 else "düzensiz"


def best_bins(fine: Sequence[Bin], total: int | None = None) -> tuple[list[Bin], str]:
    """The better of rising and falling by IV; a U or inverted U only with a tenth more IV and three bins.

    total: the rows that shares are of, those of the bins unless given.
    """
    total = sum(b.n for b in fine) if total is None else total
    settle = lambda bins: _distinct(_shares(list(bins), total))
    value = lambda bins: iv(bins) or 0.0
    best = max((settle(_pooled(fine, way)) for way in (True, False)), key=value)
    curved = []
    for k in range(1, len(fine)):
        for way in (False, True):
            bins = settle(_pooled(fine[:k], way) + _pooled(fine[k:], not way))
            if len(bins) >= 3 and shape(bins) in ("U", "ters U"):
                curved.append(bins)
    if curved:
        other = max(curved, key=value)
        if value(other) >= value(best) * (1 + U_GAIN):
            best = other
    return best, shape(best)


@dataclass
class Proposal:
    column: str
    bins: list[Bin]
    shape: str
    iv: float | None
    kind: str
    note: str | None = None


def number_text(v: float, decimals: int = 2) -> str:
    """Turkish number format: dots between thousands, a decimal comma, no trailing zeros."""
    text = f"{v:,.0f}" if float(v).is_integer() else f"{v:,.{decimals}f}".rstrip("0").rstrip(".")
    return text.translate(str.maketrans(",.", ".,"))


def labels(cuts: Sequence[float]) -> list[str]:
    """``≤ a``, ``a - b``, ``> b``."""
    if not cuts:
        return ["tümü"]
    text = [number_text(c) for c in cuts]
    return [f"≤ {text[0]}", *(f"{a} - {b}" for a, b in zip(text, text[1:], strict=False)), f"> {text[-1]}"]


def apply_cuts(column: str, cuts: Sequence[float]) -> Column:
    """The bin's label; null is "Eksik"."""
    names = F.array(*[F.lit(x) for x in labels(cuts)])
    return F.coalesce(F.get(names, below(cuts, num(F.col(f"`{column}`")), False)), F.lit("Eksik"))


def apply_groups(column: str, groups: dict[str, str]) -> Column:
    """The group of a category; null is "Eksik", an unseen one "Diğer"."""
    c = F.col(f"`{column}`").cast("string")
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]), c) if groups else F.lit(None).cast("string")
    return F.when(c.isNull(), "Eksik").otherwise(F.coalesce(known, F.lit("Diğer")))


def ordinal(column: str, order: Sequence[str]) -> Column:
    """A bin label as its place, for models."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, float(i))]), F.col(f"`{column}`"))


def iv_band(value: Column) -> Column:
    return F.when(value.isNull(), None).when(value < 0.02, "önemsiz").when(value < 0.10, "zayıf").when(value < 0.30, "orta").otherwise("güçlü")


def check(p: Proposal, total: int) -> list[str]:
    """What a reviewer should look at in a proposal."""
    notes = [f"bin {i}: below {MIN_SHARE:.0%} of the rows" for i, b in enumerate(p.bins) if b.n < MIN_SHARE * total]
    notes += [f"bin {i}: one class" for i, b in enumerate(p.bins) if b.bad in (0, b.n)]
    if p.shape == "düzensiz":
        notes.append("the rates have no order")
    return notes


# ---- single-factor analysis ------------------------------------------------------------------


def single_factor(train: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(column, iv, c_value, leak) of numeric columns on train rows: IV in equal-frequency bins and folded AUC, from filled rows.

    Fewer than 100 filled rows give null. leak: a C-value above 0.95.
    """
    out = None
    for c in columns:
        cuts = fine_cuts(train, c, bins)
        x = num(F.col(f"`{c}`"))
        rows = train.select(x.alias("x"), F.col(target).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        counts = measures.class_counts(rows, [], "x", "y")
        binned = counts.groupBy(below(cuts, F.col("x"), False).alias("b")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        value = measures.information_value(binned, []).select(F.lit(c).alias("column"), "iv")
        auc = measures.separation(counts, [], "x", "bad", "good").select(F.lit(c).alias("column"), "auc", (F.col("n_bad") + F.col("n_good")).alias("n"))
        enough = F.col("n") >= MIN_ROWS
        c_value = F.when(enough, measures.folded(F.col("auc")))
        part = value.join(F.broadcast(auc), "column").select("column", F.when(enough, F.col("iv")).alias("iv"), c_value.alias("c_value"), F.coalesce(c_value > 0.95, F.lit(False)).alias("leak"))
        out = part if out is None else out.unionAll(part)
    return out


def variable_detail(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, p1, p5, p25, p50, p75, p95, p99, outlier_share, skew): outliers lie beyond three quartile distances."""
    from tabloom.operators.features import column_summary
    from tabloom.operators.profile import value_table

    tt = value_table(df, columns, False)
    names = ["p1", "p5", "p25", "p50", "p75", "p95", "p99"]
    q = measures.quantiles(tt, ["k"], "v", "n", (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)).withColumnsRenamed({f"q{i}": n for i, n in enumerate(names)})
    reach = 3 * (F.col("p75") - F.col("p25"))
    far = (F.col("v") < F.col("p25") - reach) | (F.col("v") > F.col("p75") + reach)
    share = tt.join(q, "k").groupBy("k", *names).agg((F.sum(F.when(far, F.col("n")).otherwise(0)) / F.sum("n")).alias("outlier_share"))
    skew = column_summary(df, columns).select(F.col("column").alias("k"), "skew")
    return share.join(skew, "k").withColumnRenamed("k", "column")


def psi_numeric(dev: DataFrame, other: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: psi by the development set's deciles, bins closed on the right, nulls a bin, shares of all rows."""
    from tabloom.operators.features import learn_grid

    grid = learn_grid(dev, [column], [i / bins for i in range(bins + 1)]).get(column)
    inner = sorted(set(grid))[1:-1] if grid else []
    x = num(F.col(f"`{column}`"))
    place = F.coalesce(below(inner, x, False), F.lit(-1)).alias("b")
    both = dev.select(place, F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(other.select(place, F.lit(0), F.lit(1)))
    counts = both.groupBy("b").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    every = dev.sparkSession.range(-1, len(inner) + 1).select(F.col("id").cast("int").alias("b"))
    full = F.broadcast(every).join(counts, "b", "left").fillna(0, ["e", "a"])
    return measures.shares_psi(full, [], "e", "a").select(F.lit(column).alias("column"), "psi")


def psi_categorical(dev: DataFrame, other: DataFrame, column: str) -> DataFrame:
    level = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("__EKSIK__")).alias("b")
    both = dev.select(level, F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(other.select(level, F.lit(0), F.lit(1)))
    return measures.shares_psi(both.groupBy("b").agg(F.sum("e").alias("e"), F.sum("a").alias("a")), [], "e", "a").select(F.lit(column).alias("column"), "psi")


def apply_decisions(df: DataFrame, decisions: dict[str, dict]) -> DataFrame:
    """Carry out decisions by column: drop, bins (``_ARALIK``), flag (``_EKSIK``), fill, winsor (``_KIRP``), log, exp, rank (``_SIRA``).

    A column that was turned into something else leaves the table.
    """
    made: dict[str, Column] = {}
    gone = []
    for c, d in decisions.items():
        x = num(F.col(f"`{c}`"))
        if "fill" in d:
            x = F.coalesce(x, F.lit(float(d["fill"])))
        if d.get("flag"):
            made[f"{c}_EKSIK"] = F.col(f"`{c}`").isNull().cast("int")
        if "cuts" in d:
            made[f"{c}_ARALIK"] = apply_cuts(c, d["cuts"])
        if "groups" in d:
            made[f"{c}_ARALIK"] = apply_groups(c, d["groups"])
        if "winsor" in d:
            low, high = d["winsor"]
            made[f"{c}_KIRP"] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
        if d.get("log"):
            made[f"{c}_LOG"] = F.when(x.isNotNull(), F.signum(x) * F.log1p(F.abs(x)))
        if "exp" in d:
            made[f"{c}_USTEL"] = F.exp(-F.abs(x) / F.lit(float(d["exp"])))
        if "grid" in d:
            made[f"{c}_SIRA"] = below(d["grid"], x, True) / float(len(d["grid"]))
        if d.get("drop") or set(d) - {"drop", "flag", "fill"}:
            gone.append(c)
        elif "fill" in d:
            made[c] = x
    return df.withColumns(made).drop(*gone)
