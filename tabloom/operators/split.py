"""Train / validation / test / out-of-time sets and cross-validation folds.

Random choices are orders by ``md5(seed | key)``, so they depend on a row's key and on nothing
else, agree between engines, and survive any repartitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import periods
from tabloom.functions.joins import attach
from tabloom.sources.store import materialise

SPLIT = "_SPLIT"
TRAIN, VAL, TEST, OOT, OUTSIDE = "train", "val", "test", "oot", "disarida"
_PRIORITY = (TEST, OOT, VAL, TRAIN)


@dataclass(frozen=True)
class Settings:
    """Defaults of a split; ``defaults`` derives them from a table."""

    test: float = 0.20
    val: float = 0.20
    folds: int = 5
    seed: int = 42
    temporal: bool = False
    by_id: bool = False


def defaults(df: DataFrame, ident: str | None, period: str | None) -> Settings:
    """Temporal if there is a period, by id if rows repeat for an id."""
    repeats = bool(ident) and not df.where(F.col(ident).isNotNull()).groupBy(ident).count().where("count > 1").isEmpty()
    return Settings(temporal=bool(period), by_id=repeats)


def order_key(seed: int, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def by_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Ready-made 0/1 flag columns (set -> column); priority test, oot, val, train; none set: outside."""
    c = F.lit(OUTSIDE)
    for name in reversed(_PRIORITY):
        if name in flags:
            c = F.when(F.coalesce(F.col(flags[name]).try_cast("double"), F.lit(0.0)) != 0, F.lit(name)).otherwise(c)
    return df.withColumn(SPLIT, c)


def by_label(df: DataFrame, column: str, labels: dict[str, Sequence[str]]) -> DataFrame:
    """A ready-made label column; labels: set -> spellings, compared trimmed and in lower case."""
    text, c = F.lower(F.trim(F.col(column).cast("string"))), F.lit(OUTSIDE)
    for name in reversed(_PRIORITY):
        if labels.get(name):
            c = F.when(text.isin(*[x.strip().lower() for x in labels[name]]), F.lit(name)).otherwise(c)
    return df.withColumn(SPLIT, c)


#: Spellings of sets in ready-made label columns, fixed values.
KNOWN = {TRAIN: ("train", "ms", "egitim", "eğitim"), VAL: ("val", "valid", "validation", "dogrulama", "doğrulama"), TEST: ("test",), OOT: ("oot",)}


def find_ready(values: dict[str, Sequence[str]]) -> tuple[str, dict[str, list[str]]] | None:
    """A label column among columns' distinct values: at most 8 values, all known, train and test among them."""
    for column, found in values.items():
        kinds = {v: next((k for k, names in KNOWN.items() if str(v).strip().lower() in names), None) for v in found}
        if 0 < len(kinds) <= 8 and None not in kinds.values() and {TRAIN, TEST} <= set(kinds.values()):
            return column, {k: [v for v, kind in kinds.items() if kind == k] for k in set(kinds.values())}
    return None


def temporal_plan(counts: list[tuple[str, int]], test: Sequence[str], gap: int, val_ratio: float) -> dict[str, str]:
    """period -> set, from (period, rows) in time order.

    The gap is the latest remaining periods before the test, of which one at least stays; the
    validation set takes latest periods until val_ratio of the rows is reached, never the first.
    """
    chosen = set(test)
    first = min(i for i, (p, _) in enumerate(counts) if p in chosen)
    plan = {p: TEST for p in chosen}
    pool = [(p, n) for i, (p, n) in enumerate(counts) if p not in chosen and i < first]
    later = [p for i, (p, _) in enumerate(counts) if p not in chosen and i > first]
    take = max(0, min(gap, len(pool) - 1))
    plan |= {p: OUTSIDE for p, _ in pool[len(pool) - take :]}
    pool = pool[: len(pool) - take]
    total, held = sum(n for _, n in pool), 0
    for p, n in reversed(pool[1:]):
        if val_ratio <= 0 or held >= val_ratio * total:
            break
        plan[p] = VAL
        held += n
    for p, _ in pool:
        plan.setdefault(p, TRAIN)
    for p in later:
        plan.setdefault(p, TRAIN)
    return plan


def temporal(df: DataFrame, period: str, test: Sequence[str], gap: int = 0, val_ratio: float = 0.2) -> DataFrame:
    """Split by period; a null period trains. Only one row a period comes to the driver."""
    return by_period(df, period, learn_periods(df, period, test, gap, val_ratio))


def learn_periods(df: DataFrame, period: str, test: Sequence[str], gap: int = 0, val_ratio: float = 0.2) -> dict[str, str]:
    """period -> set, by ``temporal_plan``."""
    form = periods.decide(df, period)
    text = periods.clean(F.col(period), df.schema[period].dataType)
    month = periods.month_index(df, period, form) if form else F.lit(0)
    counts = [(r.p, r.n) for r in df.groupBy(text.alias("p"), month.alias("m")).agg(F.count(F.lit(1)).alias("n")).where("p IS NOT NULL").orderBy("m", "p").collect()]
    return temporal_plan(counts, test, gap, val_ratio)


def by_period(df: DataFrame, period: str, plan: dict[str, str]) -> DataFrame:
    """Label rows by a plan; a period that it doesn't know, and a null one, train."""
    table = F.create_map(*[F.lit(x) for pair in plan.items() for x in pair])
    text = periods.clean(F.col(period), df.schema[period].dataType)
    return df.withColumn(SPLIT, F.coalesce(F.try_element_at(table, text), F.lit(TRAIN)))


def _sizes(n: Column, ratios: list[tuple[str, float]]) -> list[tuple[str, Column]]:
    """Rows of each set in a stratum of n: half-even rounding, at least one where n allows, one left to train."""
    out, used = [], F.lit(0).cast("bigint")
    for name, ratio in ratios:
        want = F.bround(n * F.lit(float(ratio)), 0).cast("bigint")
        want = F.when((n >= len(ratios) + 1) & (want < 1) & F.lit(ratio > 0), F.lit(1)).otherwise(want)
        size = F.greatest(F.least(want, n - 1 - used), F.lit(0)).cast("bigint")
        out.append((name, size))
        used = used + size
    return out


def _ranks(df: DataFrame, strata: Sequence[str], key: Column) -> DataFrame:
    """Add ``__rank`` (from 0, by key within the stratum) and ``__n`` (the stratum's rows).

    The key is a digest in hex, so its first four digits deal a stratum into 65,536 ranges of
    equal size: no stratum is sorted in one task, and the ranges' offsets are one small table.
    """
    marked = df.withColumn("__key", key).withColumn("__range", F.conv(F.substring("__key", 1, 4), 16, 10).cast("int"))
    names = [f"__s{i}" for i in range(len(strata))]
    marked = marked.withColumns({n: F.col(s) for n, s in zip(names, strata, strict=True)})
    sums = marked.groupBy(*names, "__range").agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(n).alias(f"{n}o") for n in names], F.col("__range").alias("__ro"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"), F.sum("__c").over(whole).alias("__n"))
    on = F.col("__range") == F.col("__ro")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}o"))
    local = marked.withColumn("__local", F.row_number().over(Window.partitionBy(*names, "__range").orderBy("__key")) - 1)
    joined = local.join(offsets, on).withColumn("__rank", F.col("__local") + F.col("__off"))
    return joined.select(*df.columns, "__rank", "__n")


def stratified(df: DataFrame, keys: Sequence[str], strata: Sequence[str], ratios: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Row-level random split: in every stratum contiguous ranges of the md5 order. ratios in order, like test then val."""
    ranked = _ranks(df, strata, order_key(seed, keys))
    c, start = F.lit(TRAIN), F.lit(0).cast("bigint")
    cuts = []
    for name, size in _sizes(F.col("__n"), ratios):
        cuts.append((name, start, start + size))
        start = start + size
    for name, a, b in reversed(cuts):
        c = F.when((F.col("__rank") >= a) & (F.col("__rank") < b), F.lit(name)).otherwise(c)
    return ranked.withColumn(SPLIT, c).select(*df.columns, SPLIT)


def learn_ranges(df: DataFrame, keys: Sequence[str], strata: Sequence[str], ratios: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """(__k, __w, ranges): for every stratum its rows and, for each set, the least digest that belongs to it.

    What ``stratified`` decides, in a form that later rows can be dealt by. Rows are counted by stratum and range of
    the digest; only those in the ranges where a set begins, a few of 65,536, are ranked.
    """
    digest = order_key(seed, keys)
    rows = df.select(stratum(strata, df).alias("__k"), digest.alias("__key"), F.substring(digest, 1, 4).alias("__range"))
    counts = materialise(rows.groupBy("__k", "__range").agg(F.count(F.lit(1)).alias("__c")), "ranges")
    whole = Window.partitionBy("__k")
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__k", "__range", "__c", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"), F.sum("__c").over(whole).alias("__n"))
    start, firsts = F.lit(0).cast("bigint"), []
    for name, size in [*_sizes(F.col("__n"), ratios), (TRAIN, None)]:
        end = F.col("__n") if size is None else start + size
        firsts.append(F.when(start < end, F.struct(start.alias("at"), F.lit(name).alias("label"))))
        start = end
    inside = F.filter(F.array_compact(F.array(*firsts)), lambda f: (f["at"] >= F.col("__off")) & (f["at"] < F.col("__off") + F.col("__c")))
    wanted = materialise(offsets.select("__k", "__range", "__off", "__n", inside.alias("__firsts")).where(F.size("__firsts") > 0), "firsts")
    near = rows.join(wanted, ["__k", "__range"])
    ranked = near.withColumn("__rank", F.row_number().over(Window.partitionBy("__k", "__range").orderBy("__key")) - 1 + F.col("__off"))
    lows = ranked.select("__k", "__n", "__key", "__rank", F.explode("__firsts").alias("f")).where(F.col("f.at") == F.col("__rank"))
    return lows.groupBy("__k").agg(F.max("__n").alias("__w"), F.array_sort(F.collect_list(F.struct(F.col("__key").alias("low"), F.col("f.label").alias("label")))).alias("ranges"))


def stratum(strata: Sequence[str], df: DataFrame | None = None) -> Column:
    """A stratum as one text; nulls are a value. Of a known table, texts that need no escapes are joined, which gives the same and is cheaper."""
    plain = T.IntegralType | T.BooleanType | T.DateType
    if df is not None and strata and all(isinstance(df.schema[s].dataType, plain) for s in strata):
        cells = [F.coalesce(F.concat(F.lit('"'), F.col(f"`{s}`").cast("string"), F.lit('"')), F.lit("null")) for s in strata]
        return F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
    return F.to_json(F.array(*[F.col(f"`{s}`").cast("string") for s in strata])) if strata else F.lit("[]")


def by_ranges(df: DataFrame, keys: Sequence[str], strata: Sequence[str], ranges: DataFrame, seed: int = 42) -> DataFrame:
    """Label rows by ``learn_ranges``, without ranking them: equal to ``stratified`` on the rows it learnt from.

    Rows of one key never part; a stratum that wasn't there trains.
    """
    rows = df.select(F.struct("*").alias("row"), stratum(strata, df).alias("__k"), order_key(seed, keys).alias("digest"))
    total = ranges.agg(F.sum("__w")).first()[0] or 0
    joined = attach(rows, ranges, "__k", "__w", int(total))
    met = F.filter("ranges", lambda r: r["low"] <= F.col("digest"))
    label = F.when(F.size(met) > 0, F.element_at(met, -1)["label"]).otherwise(F.get("ranges", F.lit(0))["label"])
    return joined.select("row.*", F.coalesce(label, F.lit(TRAIN)).alias(SPLIT))


def stratified_by_id(df: DataFrame, ident: str, target: str, ratios: list[tuple[str, float]], segment: str | None = None, seed: int = 42) -> DataFrame:
    """Every row of an id gets one label; an id's stratum is its largest target and smallest segment. Rows without an id train."""
    aggs = [F.max(target).alias("__y")] + ([F.min(segment).alias("__seg")] if segment else [])
    ids = df.where(F.col(ident).isNotNull()).groupBy(ident).agg(*aggs)
    labels = stratified(ids, [ident], ["__y", "__seg"] if segment else ["__y"], ratios, seed).select(F.col(ident).alias("__id"), F.col(SPLIT))
    joined = df.join(labels, df[ident] == labels["__id"], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(labels[SPLIT], F.lit(TRAIN)).alias(SPLIT))


def summary(df: DataFrame, target: str, segment: str | None = None) -> DataFrame:
    return df.groupBy(*([segment] if segment else []), SPLIT).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(target) > 0).alias("positives"))


def small_segments(df: DataFrame, target: str, segment: str, rows: int = 50, positives: int = 20) -> DataFrame:
    """Segments with too few rows or positives in some set (a set they miss altogether included)."""
    found = summary(df.where(F.col(SPLIT) != OUTSIDE), target, segment)
    sets = df.where(F.col(SPLIT) != OUTSIDE).select(SPLIT).distinct()
    all_cells = df.select(segment).distinct().join(F.broadcast(sets), F.lit(True), "inner")
    cells = all_cells.join(found, [segment, SPLIT], "left").fillna(0, ["n_rows", "positives"])
    return cells.where((F.col("n_rows") < rows) | (F.col("positives") < positives))


def folds(df: DataFrame, keys: Sequence[str], strata: Sequence[str] = (), k: int = 5, seed: int = 42, group: str | None = None, repeats: int = 1) -> DataFrame:
    """Add ``fold`` (0 to k - 1), or ``fold_0`` ... for repeats, each with a seed of its own.

    group: all rows of a group share a fold (rows without a group: their own by their keys). A
    target to stratify grouped folds by is taken as the group's maximum.
    """
    out = df
    for r in range(repeats):
        name = "fold" if repeats == 1 else f"fold_{r}"
        if group:
            ids = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.max(s).alias(f"__g{i}") for i, s in enumerate(strata)] or [F.lit(0).alias("__g0")])
            label = _ranks(ids, [f"__g{i}" for i in range(len(strata))], order_key(seed + r, [group])).select(F.col(group).alias("__id"), F.pmod("__rank", F.lit(k)).cast("int").alias(name))
            joined = out.join(label, out[group] == label["__id"], "left")
            alone = F.pmod(F.conv(F.substring(order_key(seed + r, keys), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
            out = joined.select(*[out[c] for c in out.columns], F.coalesce(label[name], alone).alias(name))
        else:
            ranked = _ranks(out, strata, order_key(seed + r, keys))
            out = ranked.withColumn(name, F.pmod("__rank", F.lit(k)).cast("int")).drop("__rank", "__n")
    return out


def walk_forward(df: DataFrame, period: str, k: int = 3) -> DataFrame:
    """(fold, part, rows): fold i validates on the i-th of the last k periods and trains on all before it."""
    order = df.where(F.col(period).isNotNull()).groupBy(period).agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.row_number().over(Window.orderBy(period)))
    n = order.agg(F.max("i")).first()[0] or 0
    picks = [i for i in range(max(2, n - k + 1), n + 1)]
    out = None
    for f, i in enumerate(picks):
        part = order.where(F.col("i") <= i).groupBy(F.lit(f).alias("fold"), F.when(F.col("i") == i, "valid").otherwise(TRAIN).alias("part")).agg(F.sum("n").alias("n_rows"))
        out = part if out is None else out.unionAll(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "fold int, part string, n_rows long")


def overlap(df: DataFrame, ident: str, period: str | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """set, kind ("kimlik", "anahtar", "tam"), ids and n_rows of validation, test and oot rows that train has too; only kinds that occur."""
    train, out = df.where(F.col(SPLIT) == TRAIN), None
    columns = [c for c in df.columns if c not in (*ignore, SPLIT)]
    kinds = [("kimlik", [ident], False)] + ([("anahtar", [ident, period], False)] if period else []) + [("tam", columns, True)]
    for kind, keys, nulls in kinds:
        known = train.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)])
        if not nulls:
            known = known.dropna()
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}")) if nulls else F.col(f"`{k}`") == F.col(f"__{i}") for i, k in enumerate(keys)]
        met = df.where(F.col(SPLIT).isin(VAL, TEST, OOT)).join(known.distinct(), on, "left_semi")
        part = met.groupBy(F.col(SPLIT).alias("set"), F.lit(kind).alias("kind")).agg(F.count_distinct(F.lit(None) if nulls else F.col(ident)).alias("ids"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionAll(part)
    return out
