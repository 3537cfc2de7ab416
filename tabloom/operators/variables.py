"""Bins of many variables at once: cuts, fine bins, proposals, groups of categories.

All variables share one value table, (variable, value, set, rows, bad rows), so one shuffle of
distinct values serves a thousand columns. Running counts are found in ranges of (variable,
value). Equal-frequency cuts depend on each other, as an aim is set anew after every cut; a
job looks all open aims of all variables up together, with the values that follow each, and
the next aims are met among those wherever that decides them. The merging of fine bins works
on at most ``FINE`` bins, or ``LEVELS`` categories, a variable, in grouped functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import num
from tabloom.functions.joins import attach
from tabloom.operators import measures
from tabloom.operators.binning import FINE, MIN_IV, MIN_ROWS, MIN_SHARE, Bin, _distinct, _shares, best_bins, iv, labels
from tabloom.sources.store import materialise, release

#: A category of more levels gets no proposal; sets count towards consistency from so many rows a bin; so far may the rate of missing rows lie from the median bin's. Fixed values.
LEVELS, SET_ROWS, MISSING_GAP = 200, 30, 0.30
#: Values after an aim that a job brings along, in rows.
AFTER = 8
#: A variable of so many distinct values or fewer brings them all in its first job.
EVERY = 256
#: Categories by rate are merged one by one up to so many; more are first put into so many fine bins by running count.
SLOTS = 1_000
#: Name roots of sensitive variables, fixed values.
SENSITIVE = {
    "yaş": ("YAS", "AGE", "DOGUM", "BIRTH", "YAŞ", "DOĞUM"),
    "cinsiyet": ("CINSIYET", "CİNSİYET", "GENDER", "SEX"),
    "uyruk": ("UYRUK", "NATIONALITY", "VATANDAS", "VATANDAŞ", "ULKE_DOGUM"),
    "medeni hâl": ("MEDENI", "MEDENİ", "MARITAL"),
    "din": ("DIN", "DİN", "RELIGION", "MEZHEP"),
    "etnik köken": ("ETNIK", "ETNİK", "IRK", "RACE", "ETHNIC"),
    "engellilik": ("ENGELLI", "ENGELLİ", "DISABILITY"),
    "sağlık": ("SAGLIK", "SAĞLIK", "HEALTH"),
}
TRAIN = "train"
#: What a missing category and the rare ones together are called, fixed values.
NO_VALUE, RARE_NAME = "Boş", "Seyrek"


def sensitive(name: str, description: str = "") -> str | None:
    """The kind of sensitive attribute that a name, or its description, speaks of: a word is a root, or starts with one of four letters or more."""
    words = [w for w in re.split(r"[^0-9A-Za-zÇĞİÖŞÜçğıöşü]+", name.upper()) if w]
    text = description.upper()
    for kind, roots in SENSITIVE.items():
        if any(w == r or (len(r) > 3 and w.startswith(r)) for r in roots for w in words):
            return kind
        if any(len(r) > 3 and re.search(rf"\b{r}", text) for r in roots):
            return kind
    return None


def value_counts(df: DataFrame, columns: Sequence[str], target: str, sets: Column, categorical: bool) -> DataFrame:
    """(k, v, s, n, bad) of rows with a target and a set: one shuffle for all columns. v is null for missing values."""
    value = lambda c: F.col(f"`{c}`").cast("string") if categorical else num(F.col(f"`{c}`"))
    cells = F.array(*[F.struct(F.lit(c).alias("k"), value(c).alias("v")) for c in columns])
    y = F.col(f"`{target}`")
    rows = df.where(y.isNotNull() & sets.isNotNull()).select(F.explode(cells).alias("c"), (y > 0).alias("y"), sets.cast("string").alias("s"))
    return rows.groupBy("c.k", "c.v", "s").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("bad"))


def running(values: DataFrame) -> DataFrame:
    """(k, v, n, n_before, upto) of the filled train values."""
    train = values.where((F.col("s") == TRAIN) & F.col("v").isNotNull()).select("k", "v", "n")
    return measures.cumulate(train, ["k"], "v", ["n"]).withColumn("upto", F.col("n_before") + F.col("n"))


def equal_cuts(run: DataFrame, bins: int = FINE) -> dict[str, list[float]]:
    """``binning.equal_cuts`` of every variable of ``running`` counts, materialised.

    A job asks for all aims that each open variable would have if every cut met its aim, and
    for the values within AFTER rows behind. The true aims follow from the first cut; as long as
    the crossing value of the next one is among the rows at hand, it is taken, else another
    job asks. So a job brings one cut a variable at least, and mostly all; of up to EVERY values, which are far
    apart in rows, the first job brings all. What reaches the driver are these, or at most AFTER + 1 values an aim.
    """
    totals = run.groupBy("k").agg(F.max("upto").alias("total"), F.count(F.lit(1)).alias("d"), F.max("v").alias("last")).collect()
    cuts: dict[str, list[float]] = {r.k: [] for r in totals}
    state = {r.k: (0, bins) for r in totals}
    open_ = {r.k: r for r in totals if r.d > 1}
    while open_:
        asked = [(k, r.d <= max(bins, EVERY), [done + j * (r.total - done) / left - 0.25 for j in range(1, left)]) for k, r in open_.items() for done, left in [state[k]]]
        aims = run.sparkSession.createDataFrame(asked, "k string, every boolean, aims array<double>")
        near = F.exists("aims", lambda a: (F.col("upto") >= a) & (F.col("n_before") < a + AFTER))
        got: dict[str, list] = {}
        for row in run.join(F.broadcast(aims), "k").where(F.col("every") | near).select("k", "v", "n_before", "upto").collect():
            got.setdefault(row.k, []).append((row.n_before, row.upto, row.v))
        for k, r in list(open_.items()):
            rows = sorted(got.get(k, []))
            if r.d <= bins:
                cuts[k] = [v for _, _, v in rows[:-1]]
                del open_[k]
                continue
            done, left = state[k]
            for before, upto, v in rows:
                if left < 2 or v >= r.last:
                    break
                if upto - done < (r.total - done) / left:
                    continue
                if before - done >= (r.total - done) / left:  # the crossing value isn't at hand
                    break
                cuts[k].append(v)
                done, left = upto, left - 1
            if left < 2 or (rows and rows[-1][2] >= r.last and rows[-1][0] - done < (r.total - done) / left):
                del open_[k]
            state[k] = done, left
    return cuts


def fine_bins(values: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(k, s, b, n, bad, low, high, whole) by cuts; b is -1 for missing values, whole says that all values are whole numbers."""
    table = values.sparkSession.createDataFrame(sorted(cuts.items()), "k string, cuts array<double>")
    b = F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("v"))))
    return values.join(F.broadcast(table), "k").groupBy("k", "s", b.alias("b")).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("v").alias("low"), F.max("v").alias("high"), F.coalesce(F.bool_and(F.col("v") == F.floor("v")), F.lit(True)).alias("whole"),
    )


def number_medians(run: DataFrame) -> DataFrame:
    """(k, median) of the filled train values."""
    total = run.groupBy("k").agg(F.max("upto").alias("t"))
    holds = lambda at: F.max(F.when((F.col("n_before") <= at) & (at < F.col("upto")), F.col("v")))
    return run.join(F.broadcast(total), "k").groupBy("k").agg(((holds(F.floor((F.col("t") - 1) / 2)) + holds(F.floor(F.col("t") / 2))) / 2).alias("median"))


def _auc(bins: Iterable[Bin]) -> float | None:
    """How well bins in order of their rates separate, ties half."""
    found = sorted(bins, key=lambda b: b.rate)
    bad, good = sum(b.bad for b in found), sum(b.n - b.bad for b in found)
    if not bad or not good:
        return None
    won = below = 0.0
    for b in found:
        won += b.bad * (below + (b.n - b.bad) / 2)
        below += b.n - b.bad
    return won / (bad * good)


def _consistency(rates: list[float], other: list[tuple[int, int]]) -> float | None:
    """Rank correlation of the bins' rates with another set's; null if a bin has too few rows there, or all rates are one."""
    if len(rates) < 2 or any(n < SET_ROWS for n, _ in other):
        return None
    r = pd.Series(rates).rank().corr(pd.Series([b / n for n, b in other]).rank())
    return None if pd.isna(r) else round(float(r), 3)


_PROPOSAL = (
    "variable string, kind string, shape string, bins int, cuts array<double>, levels array<array<string>>, labels array<string>, n array<long>, bad array<long>, iv double, c double, iv_bins double, "
    "n_missing long, bad_missing long, median double, median_bin int, iv_median double, missing_differs boolean, nearest_bin int, consistency map<string, double>, sensitive string, note string"
)


def _proposal(name: str, rows: pd.DataFrame, categorical: bool, median: float | None, description: str) -> dict:
    """One variable: rows s, b, n, bad, cut (or level), whole."""
    out = {c.split(" ")[0]: None for c in _PROPOSAL.replace("map<string, double>", "map").split(", ")}
    out |= {"variable": name, "kind": "kategorik" if categorical else "sayisal", "shape": "düz", "bins": 0, "consistency": {}, "sensitive": sensitive(name, description)}
    train = rows[rows["s"] == TRAIN]
    none, filled = train[train["b"] < 0], train[train["b"] >= 0]
    missing = Bin(int(none["n"].sum()), int(none["bad"].sum()))
    n, bad = int(filled["n"].sum()), int(filled["bad"].sum())
    total = n + missing.n
    out |= {"n_missing": missing.n, "bad_missing": missing.bad}
    if n < MIN_ROWS or bad + missing.bad in (0, total):
        return out | {"note": "too few rows or one class"}
    if categorical:
        if len(filled) > LEVELS:
            return out | {"note": f"over {LEVELS} levels"}
        fine = sorted((Bin(int(r.n), int(r.bad), values=(r.level,)) for r in filled.itertuples()), key=lambda b: (b.rate, -b.n, b.values))
        bins = _distinct(_shares(fine, total))
        shape = "gruplama" if len(bins) > 1 else "düz"
    else:
        fine = [Bin(int(r.n), int(r.bad), r.low, None if pd.isna(r.cut) else r.cut, (int(r.b),)) for r in filled.sort_values("b").itertuples()]
        bins, shape = best_bins(fine, total)
    note = None
    if len(bins) > 1 and (iv(bins) or 0.0) < MIN_IV:
        whole = bins[0]
        for b in bins[1:]:
            whole = whole + b
        bins, shape, note = [whole], "düz", "IV below 0.02"
    cuts = [] if categorical else [b.high for b in bins[:-1]]
    shown = [*bins, missing] if missing.n else bins
    out |= {"shape": shape, "bins": len(bins), "n": [b.n for b in bins], "bad": [b.bad for b in bins], "iv": iv(shown), "c": _auc(shown), "iv_bins": iv(bins), "note": note}
    out |= {"levels": [list(b.values) for b in bins], "labels": [", ".join(b.values) for b in bins]} if categorical else {"cuts": cuts, "labels": labels(cuts)}
    if not categorical and missing.n:
        place = sum(c < median for c in cuts)
        put = [b + missing if i == place else b for i, b in enumerate(bins)]
        far = bins[place].rate > 0 and abs(missing.rate - bins[place].rate) / bins[place].rate > MISSING_GAP and missing.n >= MIN_SHARE * total / 2
        out |= {"median": median, "median_bin": place, "iv_median": iv(put), "missing_differs": bool(far), "nearest_bin": min(range(len(bins)), key=lambda i: abs(bins[i].rate - missing.rate))}
    key = "level" if categorical else "b"
    place = {v: i for i, b in enumerate(bins) for v in b.values}
    for s, own in rows[(rows["s"] != TRAIN) & (rows["b"] >= 0)].groupby("s"):
        at = own[key].map(place)
        counts = own.assign(at=at).dropna(subset=["at"]).groupby("at")[["n", "bad"]].sum().reindex(range(len(bins)), fill_value=0)
        r = _consistency([b.rate for b in bins], [(int(a), int(b)) for a, b in counts.itertuples(index=False)])
        if r is not None:
            out["consistency"][str(s)] = r
    return out


def proposals(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], target: str, sets: Column, descriptions: dict[str, str] | None = None) -> DataFrame:
    """One row a variable: bins learnt on train rows (set "train"), judged on the other sets; see ``_PROPOSAL`` for the columns.

    Missing values are a bin of their own in iv and c; for numbers, iv_median shows what it would be with
    them in the median's bin, missing_differs that this hides a rate over 30 % off. No bins (with a note) below 100 filled
    rows, with one class or over 200 levels; a single one below an IV of 0.02. consistency has the rank correlation of
    rates on every other set with 30 rows in each bin. Rows without a target or a set take no part; an empty table gives no rows.

    Jobs do not grow with the number of variables.
    """
    told = descriptions or {}
    out = []
    if numbers:
        values = materialise(value_counts(df, numbers, target, sets, False), "values")
        run = materialise(running(values), "running")
        cuts = equal_cuts(run)
        whole = {k: cuts.get(k, []) for k in numbers}
        fine = fine_bins(values, whole).join(F.broadcast(values.sparkSession.createDataFrame(sorted(whole.items()), "k string, cuts array<double>")), "k")
        fine = fine.select("k", "s", "b", "n", "bad", "low", F.get("cuts", F.col("b")).alias("cut"), F.lit(None).cast("string").alias("level")).join(F.broadcast(number_medians(run)), "k", "left")
        out.append(fine.groupBy("k").applyInPandas(lambda rows: pd.DataFrame([_proposal(rows["k"].iloc[0], rows, False, rows["median"].iloc[0], told.get(rows["k"].iloc[0], ""))]), _PROPOSAL))
    if categories:
        values = materialise(value_counts(df, categories, target, sets, True), "levels")
        # of a variable of too many levels only the counts go on, so a group is small
        sizes = values.where((F.col("s") == TRAIN) & F.col("v").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("d"))
        counted = values.join(F.broadcast(sizes), "k", "left").withColumn("wide", F.coalesce(F.col("d") > LEVELS, F.lit(False)))
        level = F.when(F.col("wide"), F.pmod(F.xxhash64("v"), F.lit(LEVELS + 1)).cast("string")).otherwise(F.col("v"))
        fine = counted.groupBy("k", "s", F.when(F.col("v").isNull(), -1).otherwise(0).alias("b"), level.alias("level"), "wide").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

        def work(rows: pd.DataFrame) -> pd.DataFrame:
            found = _proposal(rows["k"].iloc[0], rows, True, None, told.get(rows["k"].iloc[0], ""))
            if rows["wide"].iloc[0] and found["note"] != "too few rows or one class":
                found |= {c: None for c in ("levels", "labels", "n", "bad", "iv", "c", "iv_bins")} | {"shape": "düz", "bins": 0, "consistency": {}, "note": f"over {LEVELS} levels"}
            return pd.DataFrame([found])

        out.append(fine.groupBy("k").applyInPandas(work, _PROPOSAL))
    return materialise(out[0].unionByName(out[1]) if len(out) > 1 else out[0], "proposals")


def category_key(column: str) -> Column:
    """A category as text without spaces around it; null is a category of its own."""
    return F.coalesce(F.trim(F.col(f"`{column}`").cast("string")), F.lit(NO_VALUE))


def target_groups(train: DataFrame, column: str, target: str, rare: int) -> DataFrame:
    """(category, grp, n, spare): G1 .. Gn by rising target rate, n train rows; categories below ``rare`` rows are one.

    Categories stay where they are. In order of rate (the larger first, then the name) they
    are numbered by ranged running counts, merged to at most SLOTS fine bins where there are more
    categories, and only these, with the rare ones as another, are merged further on the driver: neighbours by share, then by z test.
    spare, the same in all rows, is the group of categories that train never saw: that of the
    rare ones, else the one of most rows. Rows without a target take no part; without any row
    the table is empty.
    """
    rows = train.where(F.col(f"`{target}`").isNotNull()).select(category_key(column).alias("category"), (F.col(f"`{target}`") > 0).alias("y"))
    seen = materialise(rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("bad")), "categories")
    often = seen.where(F.col("n") >= rare).withColumn("o", F.struct((F.col("bad") / F.col("n")).alias("rate"), (-F.col("n")).alias("m"), F.col("category").alias("c"))).withColumn("one", F.lit(1).cast("long"))
    run = materialise(measures.cumulate(often, [], "o", ["n", "one"]), "rates")
    size = run.agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("t")).first()
    slot = F.col("one_before") if size.d <= SLOTS else F.floor(F.col("n_before") * SLOTS / F.lit(size.t)).cast("long")
    placed = run.withColumn("slot", slot)
    found = [Bin(r.n, r.bad, values=((r.c, r.slot),)) for r in placed.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("category").alias("c")).collect()]
    few = seen.where(F.col("n") < rare)
    rest = few.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if rest.n:
        found.append(Bin(rest.n, rest.bad, values=((RARE_NAME, -1),)))
    order = sorted(found, key=lambda b: (b.rate, -b.n, b.values))
    merged = _distinct(_shares(order, sum(b.n for b in order))) if order else []
    named = {s: f"G{i + 1}" for i, b in enumerate(merged) for _, s in b.values}
    spare = named.get(-1) or (named[max(merged, key=lambda b: b.n).values[0][1]] if merged else None)
    names = train.sparkSession.createDataFrame(list(named.items()), "slot long, grp string")
    both = placed.select("category", "slot", "n").unionByName(few.select("category", F.lit(-1).cast("long").alias("slot"), "n"))
    out = materialise(both.join(F.broadcast(names), "slot").select("category", "grp", "n", F.lit(spare).alias("spare")), "groups")
    release(seen)
    return out


def with_group(df: DataFrame, groups: DataFrame, column: str, name: str) -> DataFrame:
    """Add the learnt group of a category; one that train never saw gets the spare group. Null where nothing was learnt."""
    first = groups.select("spare").first()
    total = groups.agg(F.sum("n")).first()[0] or 0
    key = "__category"
    rows = df.withColumn(key, category_key(column))
    out = attach(rows, groups.select(F.col("category").alias(key), F.col("grp").alias("__grp"), "n"), key, "n", total)
    return out.select(*[f"`{c}`" for c in df.columns], F.coalesce("__grp", F.lit(first.spare if first else None).cast("string")).alias(name))
