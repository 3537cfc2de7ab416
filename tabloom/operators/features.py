"""The rule-based feature catalogue: names compile to Columns, what is learnt comes from train rows only.

Every output is a double without infinities. Window families, pairs and groups are found from
column names alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import below, choose, div, finite, num
from tabloom.functions.joins import attach
from tabloom.operators import measures
from tabloom.sources.store import materialise

#: Days of a window unit, fixed values: D and G day, W week, M and A month, Q quarter, Y year.
UNIT_DAYS = {"D": 1, "G": 1, "W": 7, "M": 30, "A": 30, "Q": 91, "Y": 365}
_WINDOW = re.compile(r"^(?:L|SON|LAST)_?([0-9]{1,3})([DGWMAQY])$")
MAX_PAIRS = 400
FOLDS = 5


def window_days(token: str) -> int | None:
    """Days of a window token such as L30D or SON3A."""
    m = _WINDOW.match(token.upper())
    return int(m[1]) * UNIT_DAYS[m[2]] if m else None


def families(columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """stem -> [(column, days)] from the shortest window on: the same tokens but for one window, at least two lengths."""
    found: dict[str, dict[int, str]] = {}
    for c in columns:
        tokens = c.split("_")
        at = [i for i, t in enumerate(tokens) if window_days(t)]
        if len(at) == 1:
            stem = "_".join(t for i, t in enumerate(tokens) if i != at[0])
            found.setdefault(stem, {}).setdefault(window_days(tokens[at[0]]), c)
    return {stem: [(c, d) for d, c in sorted(by.items())] for stem, by in found.items() if len(by) > 1}


#: Words that make pairs of columns, fixed values.
OPPOSITES = (("IN", "OUT"), ("GIRIS", "CIKIS"), ("ALACAK", "BORC"), ("CREDIT", "DEBIT"))
AMOUNT, COUNT, TOTAL = ("AMT", "TUTAR", "AMOUNT"), ("CNT", "ADET", "COUNT"), ("TOT", "TOPLAM", "TOTAL")


def pairs(columns: Sequence[str], most: int = MAX_PAIRS) -> list[tuple[str, str, str]]:
    """(kind, a, b): opposite directions ("net"), amount and count ("ort"), part and total ("pay"), by exchanging one token."""
    known, out = set(columns), []
    for c in columns:
        tokens = c.split("_")
        for i, t in enumerate(tokens):
            other = lambda word, i=i, tokens=tokens: "_".join([*tokens[:i], word, *tokens[i + 1 :]])
            out += [("net", c, other(b)) for a, b in OPPOSITES if t == a and other(b) in known]
            out += [("ort", c, other(w)) for w in COUNT if t in AMOUNT and other(w) in known]
            out += [("pay", c, other(w)) for w in TOTAL if t not in TOTAL and other(w) in known]
    return list(dict.fromkeys(out))[:most]


def concentration_groups(columns: Sequence[str]) -> dict[str, list[str]]:
    """total -> its parts, at least two."""
    groups: dict[str, list[str]] = {}
    for kind, part, total in pairs(columns, 10**9):
        if kind == "pay":
            groups.setdefault(total, []).append(part)
    return {t: p for t, p in groups.items() if len(p) > 1}


def _x(c: str) -> Column:
    return num(F.col(f"`{c}`"))


# ---- without learning -------------------------------------------------------------------


def single(c: str, codes: Sequence[str], threshold: float | None = None, cuts: Sequence[float] = ()) -> dict[str, Column]:
    """kare, isaret, sifir, esik (with threshold) and kova (with cuts) of one column."""
    x, out = _x(c), {}
    if "kare" in codes:
        out[f"{c}__KARE"] = x * x
    if "isaret" in codes:
        out[f"{c}__ISR"] = F.signum(x)
    if "sifir" in codes:
        out[f"{c}__SIFIR"] = (x == 0).cast("double")
    if threshold is not None and "esik" in codes:
        t = f"{threshold:g}".replace(".", "_").replace("-", "N")
        out[f"{c}__GE_{t}"] = (x >= threshold).cast("double")
        out[f"{c}__LE_{t}"] = (x <= threshold).cast("double")
    if len(cuts) and "kova" in codes:
        out[f"{c}__KOVA"] = below(cuts, x, True) + 1
    return out


def family(stem: str, members: Sequence[tuple[str, int]], codes: Sequence[str]) -> dict[str, Column]:
    """Features of one window family, members from the shortest window on."""
    out: dict[str, Column] = {}
    xs = [(c, _x(c), float(d)) for c, d in members]
    for (a, x, dx), (c, y, dy) in pairwise(xs):
        if "oran" in codes:
            out[f"{a}__DIV__{c}"] = div(x, y)
        if "fark" in codes:
            out[f"{a}__MINUS__{c}"] = x - y
        if "norm" in codes:
            out[f"{a}__NDIV__{c}"] = div(x / dx, y / dy)
        if "buyume" in codes:
            previous = (y - x) * (dx / (dy - dx))
            out[f"{a}__GRW__{c}"] = div(x - previous, F.abs(previous))
    if "oran_tum" in codes or "fark_tum" in codes:
        for i, (a, x, _) in enumerate(xs):
            for c, y, _ in xs[i + 1 :]:
                if "oran_tum" in codes:
                    out[f"{a}__DIV__{c}"] = div(x, y)
                if "fark_tum" in codes:
                    out[f"{a}__MINUS__{c}"] = x - y
    longest = xs[-1][1]
    # slices between consecutive windows, the newest first: (from, to, amount, days)
    slices = [(0.0, xs[0][2], xs[0][1], xs[0][2])] + [(dx, dy, y - x, dy - dx) for (_, x, dx), (_, y, dy) in pairwise(xs)]
    rates = [amount / days for _, _, amount, days in slices]
    mark = lambda s: f"{s[0]:g}_{s[1]:g}"
    filled = reduce(lambda a, b: a & b, [x.isNotNull() for _, x, _ in xs])
    for s in slices[1:]:
        if "donem" in codes:
            out[f"{stem}__DNM_{mark(s)}"] = s[2]
        if "donem_pay" in codes:
            out[f"{stem}__DPAY_{mark(s)}"] = div(s[2], longest)
    if "donem_oran" in codes:
        for (s, r), (_, q) in pairwise(list(zip(slices, rates, strict=True))):
            out[f"{stem}__DORAN_{mark(s)}"] = div(r, q)
    if "ardisik" in codes:
        rises = reduce(lambda a, b: a + b, [(new > old).cast("double") for new, old in pairwise(rates)])
        out[f"{stem}__ARDISIK"] = F.when(filled, rises)
    if "en_yogun" in codes:
        out[f"{stem}__ENYOGUN"] = div(F.greatest(*[s[2] for s in slices]), longest)
    daily = [x / d for _, x, d in xs]
    if "egim" in codes:
        logs = [math.log(d) for _, _, d in xs]
        mean = sum(logs) / len(logs)
        spread = sum((v - mean) ** 2 for v in logs)
        out[f"{stem}__EGIM"] = F.when(filled, reduce(lambda a, b: a + b, [r * ((v - mean) / spread) for r, v in zip(daily, logs, strict=True)]))
    if "dk" in codes:
        n = len(daily)
        mean_rate = reduce(lambda a, b: a + b, daily) / n
        variance = reduce(lambda a, b: a + b, [(r - mean_rate) * (r - mean_rate) for r in daily]) / n
        out[f"{stem}__DK"] = F.when(filled, div(F.sqrt(variance), F.abs(mean_rate)))
    return out


def pair(kind: str, a: str, c: str) -> dict[str, Column]:
    """net a - c; cift_oran, ort, pay a / c; carpim a * c."""
    x, y = _x(a), _x(c)
    match kind:
        case "net":
            return {f"{a}__MINUS__{c}": x - y}
        case "carpim":
            return {f"{a}__X__{c}": x * y}
    return {f"{a}__DIV__{c}": div(x, y)}


def concentration(total: str, parts: Sequence[str]) -> dict[str, Column]:
    """Sum of squared shares and the largest share of the non-negative parts; null if they sum to 0."""
    xs = [F.greatest(_x(p), F.lit(0.0)) for p in parts]
    whole = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
    shares = [div(x, whole) for x in xs]
    squares = reduce(lambda a, b: a + b, [F.coalesce(s * s, F.lit(0.0)) for s in shares])
    return {f"{total}__HHI": F.when(whole > 0, squares), f"{total}__MAXPAY": F.greatest(*shares)}


def row_missing(columns: Sequence[str]) -> dict[str, Column]:
    n = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("double") for c in columns])
    return {"SATIR_EKSIK_SAYISI": n, "SATIR_EKSIK_ORANI": n / len(columns)}


def add(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """All features in one projection."""
    return df.withColumns({n: finite(c.cast("double")) for n, c in made.items()})


# ---- learnt on train rows -----------------------------------------------------------------


@dataclass
class Learnt:
    """Parameters by (code, column, segment): cuts, grids, medians, moments, categories."""

    values: dict[tuple[str, ...], object] = field(default_factory=dict)


def learn_grid(train: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Exact train quantiles of several columns, from one distinct-value table."""
    from tabloom.operators.profile import value_table

    q = measures.quantiles(value_table(train, columns, False), ["k"], "v", "n", probabilities)
    return {r.k: [r[f"q{i}"] for i in range(len(probabilities))] for r in q.collect()}


def decile_cuts(train: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Inner deciles, rounded to six places and without repeats."""
    return {c: sorted({round(v, 6) for v in q}) for c, q in learn_grid(train, columns, [i / 10 for i in range(1, 10)]).items()}


def decile(c: str, cuts: Sequence[float]) -> dict[str, Column]:
    return {f"{c}__DLM": below(cuts, _x(c), True) + 1}


def learn_segments(train: DataFrame, column: str, segment: str) -> dict[str, dict[str, object]]:
    """segment -> median, mean, std (population) and the 21-point grid. Segments are few (2 to 20 values)."""
    tt = train.where(_x(column).isNotNull() & F.col(segment).isNotNull()).groupBy(F.col(segment).cast("string").alias("s"), _x(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    grid = measures.quantiles(tt, ["s"], "v", "n", [i / 20 for i in range(21)])
    moments = train.groupBy(F.col(segment).cast("string").alias("s")).agg(F.avg(_x(column)).alias("mean"), F.stddev_pop(_x(column)).alias("std"))
    return {r.s: {"median": r.q10, "mean": r["mean"], "std": r["std"], "grid": [r[f"q{i}"] for i in range(21)]} for r in grid.join(moments, "s").collect()}


def by_segment(column: str, segment: str, learnt: dict[str, dict[str, object]]) -> dict[str, Column]:
    """Ratio to the segment's median (zero medians don't count), standard score, position in its grid (0 to 1)."""
    x, s, none = _x(column), F.col(segment).cast("string"), F.lit(None).cast("double")
    of = lambda what: choose({k: float(v[what]) for k, v in learnt.items() if v[what] is not None}, s, none)
    position = none
    for k, v in learnt.items():
        position = F.when(s == k, below(v["grid"], x, True) / 21.0).otherwise(position)
    return {f"{column}__GRO_{segment}": div(x, of("median")), f"{column}__ZS_{segment}": div(x - of("mean"), of("std")), f"{column}__PCT_{segment}": position}


def fold_of(keys: Sequence[str], k: int = FOLDS) -> Column:
    """A row's fold, from its key alone."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys])), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def category_counts(df: DataFrame, train: Column, column: str, target: str | None, keys: Sequence[str]) -> DataFrame:
    """What ``encode`` learns: train rows n and bad rows b by category __c and fold __f; a category that is hot is summed before the shuffle."""
    y = F.col(f"`{target}`") if target else F.lit(0)
    rows = df.where(train & y.isNotNull()).select(_category(column).alias("__c"), fold_of(keys).alias("__f"), (y > 0).cast("double").alias("__y"))
    return rows.groupBy("__c", "__f").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("__y").alias("b"))


def _category(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("__BOS__"))


def encode(df: DataFrame, train: Column, column: str, target: str | None, keys: Sequence[str], kinds: Sequence[str] = ("woe", "te", "frk"), weight: float = 20.0, counts: DataFrame | None = None) -> DataFrame:
    """Add K__WOE, K__TE and K__FRK, learnt on train rows with a target.

    Train rows get out-of-fold values, also on a replay: a category's counts less those of the
    row's own fold. Other rows get those of all train rows. Unseen categories: 0 for WoE and
    frequency, the prior for the target mean. counts: those of an earlier ``category_counts``,
    for a replay; else they are taken from df.
    """
    y = F.col(target) if target else F.lit(0)
    valid = train & y.isNotNull()
    work = df.withColumns({"__c": _category(column), "__t": valid, "__f": fold_of(keys)})
    counts = category_counts(df, train, column, target, keys) if counts is None else counts
    cats = counts.groupBy("__c").agg(F.sum("n").alias("__n"), F.sum("b").alias("__b"), F.map_from_entries(F.collect_list(F.struct("__f", F.struct("n", "b")))).alias("__by"))
    total = {r["__f"]: (r.n, r.b) for r in counts.groupBy("__f").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}
    n_all, b_all = sum(v[0] for v in total.values()), sum(v[1] for v in total.values())
    # what a row gets depends on its category and, on train rows, its fold: it is worked out once for each of these
    folds = [-1, *sorted(total)]
    kinds = [k for k in ("woe", "te", "frk") if k in kinds and (target or k == "frk")]

    def values(f: Column) -> Column:
        part = lambda what: F.coalesce(F.try_element_at(F.col("__by"), f)[what], F.lit(0.0))
        all_n, all_b = (F.lit(v) - choose({k: float(t[i]) for k, t in total.items()}, f, F.lit(0.0)) for i, v in enumerate((n_all, b_all)))
        n, b = F.col("__n") - part("n"), F.col("__b") - part("b")
        seen, prior = F.coalesce(n, F.lit(0.0)) > 0, div(all_b, all_n)
        woe = F.log(div(n - b + 0.5, all_n - all_b + 0.5)) - F.log(div(b + 0.5, all_b + 0.5))
        made = {"woe": F.when(seen, woe).otherwise(F.lit(0.0)), "te": F.when(seen, (b + weight * prior) / (n + weight)).otherwise(prior), "frk": F.coalesce(F.col("__n") / F.lit(n_all if n_all else 1.0), F.lit(0.0))}
        return F.struct(f.alias("f"), F.struct(*[made[k].alias(k) for k in kinds]).alias("v"))

    learnt = cats.select("__c", F.map_from_entries(F.transform(F.array(*map(F.lit, folds)), values)).alias("__v"), F.col("__n").cast("long").alias("__w"))
    rest = {-1: (0.0, 0.0), **total}
    priors = {f: (b_all - b) / (n_all - n) for f, (n, b) in rest.items() if n_all - n}
    unseen = {"woe": F.lit(0.0), "te": choose(priors, F.col("__f"), F.lit(None).cast("double")), "frk": F.lit(0.0)}
    work = work.withColumn("__f", F.when(F.col("__t") & F.col("__f").isin(folds), F.col("__f")).otherwise(F.lit(-1)))
    joined = attach(work, materialise(learnt, "encoding"), "__c", "__w", int(n_all)).withColumn("__v", F.try_element_at("__v", F.col("__f")))
    out = {f"{column}__{k.upper()}": F.when(F.col("__v").isNull(), unseen[k]).otherwise(F.col("__v")[k]) for k in kinds}
    return joined.select(*[F.col(f"`{x}`") for x in df.columns], *[v.alias(k) for k, v in out.items()])


def frequent(train: DataFrame, column: str, top: int = 10) -> list[str]:
    """The most frequent train values, null as __BOS__; ties by value."""
    c = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("__BOS__"))
    return [r.c for r in train.groupBy(c.alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(top).collect()]


def one_hot(column: str, values: Sequence[str]) -> dict[str, Column]:
    c = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("__BOS__"))
    return {f"{column}__OH_{re.sub(r'[^0-9A-Za-z]+', '_', v)}": (c == v).cast("double") for v in values}


def crossed(a: str, b: str) -> Column:
    """The category of two columns together."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__BOS__")) for c in (a, b)])


def scaled(c: str, grid: Sequence[float]) -> dict[str, Column]:
    """log, rank on a 101-point train grid, and winsor between its 2nd and its last but one point."""
    x = _x(c)
    return {f"{c}__LOG": F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0)))), f"{c}__RANK": below(grid, x, True) / 101.0, f"{c}__WNS": F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(grid[1]))), F.lit(float(grid[-2]))))}


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, least, most, distinct, zero_share, has_negative, skew, reach): skew is bias-corrected, reach is max / p99."""
    from tabloom.operators.profile import value_table

    tt = value_table(df, columns, False)
    q = measures.quantiles(tt, ["k"], "v", "n", (0.99,))
    w, v = F.col("n").cast("double"), F.col("v")
    mean = tt.groupBy("k").agg(F.sum("n").cast("double").alias("m"), (F.sum(w * v) / F.sum(w)).alias("mu"), F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("distinct"), (F.sum(F.when(v == 0, w).otherwise(0.0)) / F.sum(w)).alias("zero_share"), F.bool_or(v < 0).alias("has_negative"))
    d = v - F.col("mu")
    central = tt.join(mean, "k").groupBy("k", *[c for c in mean.columns if c != "k"]).agg((F.sum(w * d * d) / F.max("m")).alias("m2"), (F.sum(w * d * d * d) / F.max("m")).alias("m3"))
    m = F.col("m")
    skew = F.when((m > 2) & (F.col("m2") > 0), F.sqrt(m * (m - 1)) / (m - 2) * F.col("m3") / F.pow("m2", F.lit(1.5)))
    return central.join(q, "k").select(F.col("k").alias("column"), "least", "most", "distinct", "zero_share", "has_negative", skew.alias("skew"), div(F.col("most"), F.col("q0")).alias("reach"))


# ---- measuring candidates -------------------------------------------------------------------


def candidate_iv(train: DataFrame, column: str, target: str, cuts: Sequence[float] | None = None) -> DataFrame:
    """iv of one candidate on train rows: its own values as bins up to ten of them, else bins by cuts; nulls are a bin."""
    x = _x(column)
    b = F.coalesce((below(cuts, x, False) if cuts is not None else x).cast("string"), F.lit("__EKSIK__"))
    bins = train.where(F.col(target).isNotNull()).groupBy(b.alias("b")).agg(F.count_if(F.col(target) > 0).alias("bad"), F.count_if(F.col(target) <= 0).alias("good"))
    return measures.uplift_iv(bins, []).select(F.lit(column).alias("column"), "iv", "bins")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the rank correlation of two columns over rows where both are filled, from value tables, not from a sorted table."""
    rows = df.select(_x(a).alias("a"), _x(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    cells = rows.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    ranks = [measures.value_ranks(cells.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("n")), [], "v", "n").select(F.col("v").alias(c), F.col("rank").alias(f"r{c}")) for c in ("a", "b")]
    both = cells.join(ranks[0], "a").join(ranks[1], "b")
    n, s = F.sum("n"), lambda c: F.sum(F.col("n") * c)
    ra, rb = F.col("ra"), F.col("rb")
    cov = s(ra * rb) - s(ra) * s(rb) / n
    return both.agg(div(cov, F.sqrt((s(ra * ra) - s(ra) * s(ra) / n) * (s(rb * rb) - s(rb) * s(rb) / n))).alias("rho"), n.cast("long").alias("n"))


def worth(iv_gain: float, rho: float, auc_gain: float | None = None) -> bool:
    """A candidate is kept for an IV gain of 0.02 with |rho| below 0.95, or a linear gain of 0.01."""
    return (iv_gain >= 0.02 and abs(rho) < 0.95) or (auc_gain is not None and auc_gain >= 0.01)


def linear_gain(df: DataFrame, source: str, candidate: str, target: str, keys: Sequence[str]) -> float:
    """AUC of a logistic on (source, candidate) less that on the source alone; 0 below two standard errors or where it can't be measured (``uplift.linear_gains``)."""
    from tabloom.operators import uplift

    return uplift.linear_gains(df, [(candidate, source)], target, keys)[candidate, source] or 0.0


def prune(names: Sequence[str]) -> list[str]:
    """Without ``NDIV`` where the same pair has a ``DIV``: they order rows alike."""
    known = set(names)
    return [n for n in names if not ("__NDIV__" in n and n.replace("__NDIV__", "__DIV__") in known)]


def estimate(members: int, codes: Sequence[str]) -> int:
    """How many columns a family of so many windows gives."""
    per = {"oran": members - 1, "fark": members - 1, "norm": members - 1, "buyume": members - 1, "oran_tum": members * (members - 1) // 2, "fark_tum": members * (members - 1) // 2, "donem": members - 1, "donem_pay": members - 1, "donem_oran": members - 1, "ardisik": 1, "en_yogun": 1, "egim": 1, "dk": 1}
    return sum(per.get(c, 0) for c in codes)
