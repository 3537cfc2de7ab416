"""Plan-driven merging: as-of and plain dimension joins, point-in-time aggregation, stacking, lineage.

Point in time: a window of N months before observation month m covers [m - N, m); the month
itself never counts. Transactions are first summed to one row for each key and month, so a
key with very many transactions costs months, not rows, in everything that follows; windows
are range frames over those months, not joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import periods
from tabloom.functions.exprs import num
from tabloom.sources.store import materialise

FUNCTIONS = ("sum", "mean", "max", "min", "std", "count", "nunique", "last")
#: Window codes and their months; None is all history.
WINDOWS = {"son_1a": 1, "son_3a": 3, "son_6a": 6, "son_12a": 12, "tum": None}
_CODE = {"son_1a": "1A", "son_3a": "3A", "son_6a": "6A", "son_12a": "12A", "tum": "TUM"}
MAX_COLUMNS = 4_000


class PlanError(ValueError):
    """A source can't be merged as planned."""


@dataclass(frozen=True)
class Aggregate:
    function: str
    window: str
    column: str | None = None
    name: str | None = None


@dataclass
class Source:
    """kind: "boyut" (dimension) or "islem" (transactions)."""

    table: str
    kind: str
    keys: list[str]
    period: str | None = None
    columns: list[str] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)


@dataclass
class Plan:
    main: str
    sources: list[Source]
    period: str | None = None


def output_name(table: str, agg: Aggregate, used: set[str]) -> str:
    """TABLE__COL_SUM_3A, with a short digest where two aggregates would share a name."""
    base = table.replace("_ISLEM", "").replace("_TRX", "")[:14]
    name = agg.name or f"{base}__{(agg.column or 'KAYIT')[:16]}_{agg.function.upper()}_{_CODE[agg.window]}"[:120]
    if name in used:
        digest = hashlib.md5(f"{table}|{agg.column}|{agg.function}|{agg.window}".encode()).hexdigest()[:4].upper()
        tries = (f"{name[:112]}_{digest}{n}" if n > 1 else f"{name[:115]}_{digest}" for n in range(1, 10_000))
        name = next(t for t in tries if t not in used)
    used.add(name)
    return name


def validate(plan: Plan, schemas: dict[str, Sequence[str]]) -> tuple[Plan, list[str]]:
    """The part of the plan that can run, and a note for everything dropped. Nothing is widened silently."""
    notes: list[str] = []
    if plan.main not in schemas:
        raise PlanError(f"no table {plan.main}")
    period = plan.period if plan.period in schemas[plan.main] else None
    kept, total = [], len(schemas[plan.main])
    for s in plan.sources:
        known = set(schemas.get(s.table, ()))
        if not known or not s.keys or not set(s.keys) <= known & set(schemas[plan.main]):
            notes.append(f"{s.table}: table or key missing")
            continue
        own = s.period if s.period in known else None
        columns = [c for c in s.columns if c in known and c not in s.keys]
        notes += [f"{s.table}.{c}: no such column" for c in s.columns if c not in known]
        aggregates = []
        for a in s.aggregates:
            if a.function not in FUNCTIONS or a.window not in WINDOWS:
                notes.append(f"{s.table}: no function {a.function} over {a.window}")
            elif a.function != "count" and a.column not in known:
                notes.append(f"{s.table}.{a.column}: no such column")
            elif WINDOWS[a.window] is not None and not (own and period):
                notes.append(f"{s.table}: window {a.window} needs a period on both sides")
            elif a.function == "last" and not own:
                notes.append(f"{s.table}: last needs a period")
            elif total + len(aggregates) + len(columns) >= MAX_COLUMNS:
                notes.append(f"{s.table}: more than {MAX_COLUMNS} columns")
            else:
                aggregates.append(a)
        if columns or aggregates:
            kept.append(Source(s.table, s.kind, list(s.keys), own, columns, aggregates))
            total += len(columns) + len(aggregates)
        else:
            notes.append(f"{s.table}: nothing left to take")
    return Plan(plan.main, kept, period), notes


def _on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def asof_join(main: DataFrame, dim: DataFrame, keys: list[str], main_month: str, dim_month: str, columns: list[str], tie: Sequence[str] = ()) -> DataFrame:
    """For each row of main the latest row of dim with dim_month <= main_month, by key; null if there is none.

    main_month, dim_month: columns of month indexes. Of several rows of one month the last by
    ``tie`` is taken. Versions and observed months are put in one order for each key, so
    nothing is multiplied by months.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    last = F.max_by(F.struct(*columns), F.struct(*[F.col(t) for t in (tie or columns)]))
    versions = dim.where(known & F.col(dim_month).isNotNull()).groupBy(*keys, F.col(dim_month).alias("__m")).agg(last.alias("__v"))
    seen = main.select(*keys, F.col(main_month).alias("__m")).distinct()
    both = versions.withColumn("__want", F.lit(False)).unionByName(seen.withColumn("__want", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__m", "__want").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__want AND __m IS NOT NULL").select(*keys, "__m", *[F.col("__v")[c].alias(c) for c in columns])
    joined = main.join(found, (_on(main, found, keys)) & (main[main_month] == found["__m"]), "left")
    return joined.select(*[main[c] for c in main.columns], *[found[c] for c in columns])


def first_join(main: DataFrame, dim: DataFrame, keys: list[str], columns: list[str], order: Sequence[str] = ()) -> DataFrame:
    """Left join on the first row (by ``order``) of each key; a null key meets a null key. Not point in time."""
    one = dim.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*[F.col(o) for o in (order or columns)])).alias("__v"))
    one = one.select(*keys, *[F.col("__v")[c].alias(c) for c in columns])
    return main.join(one, _on(main, one, keys), "left").select(*[main[c] for c in main.columns], *[one[c] for c in columns])


def _spread(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def _merged_std(parts: Column) -> Column:
    """Sample deviation from (n, mean, m2) parts: the mean first, then squares about it."""
    n = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"] * p["mean"]) / n
    squares = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def monthly(trx: DataFrame, keys: list[str], month: str, columns: dict[str, set[str]], tie: Sequence[str]) -> DataFrame:
    """One row for each key and month: what the functions asked for (by column) need. Null keys and months are left out."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for c, functions in columns.items():
        x = num(F.col(f"`{c}`"))
        if functions & {"sum", "mean"}:
            aggs += [F.sum(x).alias(f"{c}__s"), F.count(x).alias(f"{c}__n")]
        if "max" in functions:
            aggs.append(F.max(x).alias(f"{c}__hi"))
        if "min" in functions:
            aggs.append(F.min(x).alias(f"{c}__lo"))
        if "std" in functions:
            n = F.count(x)
            aggs.append(F.when(n > 0, _spread(n.cast("double"), F.avg(x), F.var_pop(x) * n)).alias(f"{c}__sp"))
        if "last" in functions:
            aggs.append(F.max_by(F.struct(F.col(f"`{c}`").alias("v")), F.struct(*[F.col(t) for t in tie])).alias(f"{c}__last"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, month]])
    return trx.where(known).groupBy(*keys, F.col(month).alias("__m")).agg(*aggs)


def _windowed(agg: Aggregate, rows: Column, over: Callable[[Column], Column]) -> Column:
    """One aggregate over the months of a frame."""
    c = agg.column
    col = lambda suffix: F.col(f"`{c}__{suffix}`")
    match agg.function:
        case "count":
            return F.nullif(rows, F.lit(0))
        case "sum":
            return F.when(rows > 0, F.coalesce(over(F.sum(col("s"))), F.lit(0.0)))
        case "mean":
            return F.try_divide(over(F.sum(col("s"))), F.nullif(over(F.sum(col("n"))), F.lit(0)))
        case "max":
            return over(F.max(col("hi")))
        case "min":
            return over(F.min(col("lo")))
        case "std":
            return _merged_std(over(F.collect_list(col("sp"))))
        case "last":
            return over(F.max_by(col("last"), F.when(~F.col("__want"), F.col("__m"))))["v"]
    raise PlanError(agg.function)


def pit_aggregate(main: DataFrame, trx: DataFrame, keys: list[str], main_month: str, trx_month: str, aggregates: list[tuple[str, Aggregate]], tie: Sequence[str] = ()) -> DataFrame:
    """Left-join windowed aggregates of trx to main, by key and month.

    aggregates: (output name, what). Sums over rows that are all null are 0; a window without
    rows gives null, for counts too; ``last`` is the last value by ``tie`` of the last month,
    which may be null.
    """
    columns: dict[str, set[str]] = {}
    for _, a in aggregates:
        if a.column and a.function not in ("count", "nunique"):
            columns.setdefault(a.column, set()).add(a.function)
    months = monthly(trx, keys, trx_month, columns, tie or [trx_month])
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, main_month]])
    seen = main.where(known).select(*keys, F.col(main_month).alias("__m")).distinct()
    both = months.withColumn("__want", F.lit(False)).unionByName(seen.withColumn("__want", F.lit(True)), allowMissingColumns=True)
    out: list[Column] = []
    for name, a in aggregates:
        if a.function == "nunique":
            continue
        n = WINDOWS[a.window]
        frame = Window.partitionBy(*keys).orderBy("__m").rangeBetween(Window.unboundedPreceding if n is None else -n, -1)
        over = lambda c, frame=frame: c.over(frame)
        rows = F.coalesce(over(F.sum("__rows")), F.lit(0))
        out.append(_windowed(a, rows, over).alias(name))
    found = both.select(*keys, "__m", "__want", *out).where("__want").drop("__want")
    for name, a in aggregates:
        if a.function == "nunique":
            part = _distinct_counts(trx, seen, keys, trx_month, a).withColumnRenamed("__d", name)
            found = found.join(part, [*keys, "__m"], "left")
    joined = main.join(found, reduce(lambda a, b: a & b, [main[k] == found[k] for k in keys]) & (main[main_month] == found["__m"]), "left")
    return joined.select(*[main[c] for c in main.columns], *[found[n] for n, _ in aggregates])


def _distinct_counts(trx: DataFrame, seen: DataFrame, keys: list[str], month: str, agg: Aggregate) -> DataFrame:
    """Distinct filled values by key and observed month: 0 where rows exist but none is filled, no row without rows.

    All history: a value counts from its first month on, a running sum of first months. N
    months: each (key, value, month) is dealt to the N months that see it.
    """
    n = WINDOWS[agg.window]
    x = F.col(f"`{agg.column}`")
    rows = trx.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, month]])).select(*keys, F.col(month).alias("__m"), x.alias("__x"))
    if n is not None:
        dealt = rows.distinct().withColumn("__m", F.explode(F.sequence(F.col("__m") + 1, F.col("__m") + n)))
        return dealt.join(seen, [*keys, "__m"], "left_semi").groupBy(*keys, "__m").agg(F.count_distinct("__x").alias("__d"))
    first = rows.groupBy(*keys, "__x").agg(F.min("__m").alias("__m"))
    fresh = first.groupBy(*keys, "__m").agg(F.count("__x").alias("__new"))
    both = fresh.withColumn("__want", F.lit(False)).unionByName(seen.withColumn("__want", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("__m").rangeBetween(Window.unboundedPreceding, -1)
    return both.select(*keys, "__m", "__want", F.sum("__new").over(before).alias("__d")).where("__want").drop("__want")


def total_aggregate(main: DataFrame, trx: DataFrame, keys: list[str], aggregates: list[tuple[str, Aggregate]]) -> DataFrame:
    """Left-join aggregates over all rows of each key; there is no period, so only the window ``tum`` makes sense."""
    out = []
    for name, a in aggregates:
        x = num(F.col(f"`{a.column}`")) if a.column else None
        match a.function:
            case "count":
                value = F.count(F.lit(1))
            case "sum":
                value = F.coalesce(F.sum(x), F.lit(0.0))
            case "nunique":
                value = F.count_distinct(F.col(f"`{a.column}`"))
            case "std":
                value = F.stddev_samp(x)
            case "mean":
                value = F.avg(x)
            case "max" | "min":
                value = getattr(F, a.function)(x)
            case _:
                raise PlanError(f"{a.function} needs a period")
        out.append(value.alias(name))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    found = trx.where(known).groupBy(*keys).agg(*out)
    joined = main.join(found, reduce(lambda a, b: a & b, [main[k] == found[k] for k in keys]), "left")
    return joined.select(*[main[c] for c in main.columns], *[found[n] for n, _ in aggregates])


def _dated(df: DataFrame, period: str | None, out: str, taken: Sequence[str]) -> tuple[DataFrame | None, tuple[int | None, int | None]]:
    """The columns ``taken`` of df with their month index, and its first and last; None if there is no period.

    It is written once: filters and joins on the index would else decode a row's text many times over. A table with a
    column of no type can't be written and stays a plan.
    """
    if not period:
        return None, (None, None)
    texts = periods.texts_of(df, period)
    form, months, distinct = periods.span(texts)
    if not form:
        return None, months
    dated = periods.with_index(df.select(*[f"`{c}`" for c in dict.fromkeys(taken)]), period, form, out, texts, distinct)
    return dated if "void" in dict(dated.dtypes).values() else materialise(dated, "dated"), months


def execute(plan: Plan, read: Callable[[str], DataFrame]) -> tuple[DataFrame, list[tuple], list[tuple[str, str]]]:
    """The merged table, its lineage rows (column, source, key, function, window, point in time, note) and (source, outcome).

    A source that fails is reported and left out; the others go on.
    """
    main = read(plan.main)
    lineage = [(c, plan.main, None, None, None, True, None) for c in main.columns]
    outcome: list[tuple[str, str]] = []
    used, out = set(main.columns), main
    dated, seen = _dated(main, plan.period, "__obs", main.columns)
    form = dated is not None
    if form:
        out = dated
    for s in plan.sources:
        try:
            df = read(s.table)
            dated, months = _dated(df, s.period, "__per", [*s.keys, s.period, *s.columns, *(a.column for a in s.aggregates if a.column)])
            own = dated is not None
            if own:
                df = dated
                if form and not periods.same_scale(seen, months):
                    raise PlanError("the periods are on different scales")
            clash = set(s.columns) & used
            if clash:
                raise PlanError(f"columns there already: {', '.join(sorted(clash))}")
            if s.kind == "boyut":
                timed = bool(own and form)
                out = asof_join(out, df, s.keys, "__obs", "__per", s.columns) if timed else first_join(out, df, s.keys, s.columns)
                lineage += [(c, s.table, ",".join(s.keys), "as-of" if timed else "first", None, timed, None if timed else "not point in time") for c in s.columns]
                used |= set(s.columns)
            else:
                named = [(output_name(s.table, a, used), a) for a in s.aggregates]
                timed = bool(own and form)
                if not timed and any(a.window != "tum" for _, a in named):
                    raise PlanError("windows need a period on both sides")
                out = pit_aggregate(out, df, s.keys, "__obs", "__per", named, [s.period]) if timed else total_aggregate(out, df, s.keys, named)
                lineage += [(n, s.table, ",".join(s.keys), a.function, a.window, timed, None if timed else "not point in time") for n, a in named]
            outcome.append((s.table, "ok"))
        except PlanError as e:
            outcome.append((s.table, str(e)))
    return out.drop("__obs"), lineage, outcome


LINEAGE = "KOLON string, KAYNAK_TABLO string, ANAHTAR string, FONKSIYON string, PENCERE string, POINT_IN_TIME boolean, NOTU string"


def describe(plan: Plan) -> list[str]:
    """The plan in words, one line a source."""
    lines = [f"{plan.main}: main table" + (f", period {plan.period}" if plan.period else "")]
    for s in plan.sources:
        what = ", ".join([*s.columns, *(f"{a.function}({a.column or 'rows'}) over {a.window}" for a in s.aggregates)])
        lines.append(f"{s.table}: {s.kind} by {', '.join(s.keys)}" + (f", period {s.period}" if s.period else "") + f": {what}")
    return lines


def stackable(schemas: Sequence[Sequence[str]]) -> bool:
    """Whether tables have equal column sets, in whatever order."""
    return len({frozenset(s) for s in schemas}) == 1


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; column sets must be equal, types widen."""
    if not stackable([t.columns for t in tables]):
        raise PlanError("the tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), tables)


def duplicates(df: DataFrame, ident: str | None = None, period: str | None = None) -> DataFrame:
    """One row: surplus rows that are equal in full, equal by (ident, period), and either.

    Rows are first counted by their full value, which leaves one row for each distinct one: a
    row value that repeats very often is summed before the shuffle.
    """
    names = [f"`{c}`" for c in df.columns]
    distinct = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    full = F.sum(F.col("__n") - 1)
    if ident is None:
        return distinct.agg(full.alias("full_rows"), F.lit(None).cast("long").alias("key_rows"), full.alias("any_rows"))
    keys = [f"`{c}`" for c in (ident, period) if c]
    by_key = distinct.groupBy(*keys).agg(F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("__n") - 1).alias("full"))
    # all but one row of a key repeat the key; they include every full repeat but those of the row that stays
    return by_key.agg(F.sum("full").alias("full_rows"), F.sum(F.col("rows") - 1).alias("key_rows"), F.sum(F.col("rows") - 1).alias("any_rows"))
