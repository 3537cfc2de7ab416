"""Column surgery on a modelling table: drops, renames, set filters, the analytic base set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import num, turkish_fold
from tabloom.operators.profile import kind_of, numeric
from tabloom.operators.split import SPLIT

#: Words in column names that point at a person, fixed values: strong ones alone, weak ones beside a person word.
STRONG = ("tckn", "tcno", "kimlikno", "iban", "eposta", "email", "telefon", "gsm", "ceptel", "adres", "soyad", "dogumtarihi")
WEAK, PERSON = ("ad", "isim", "unvan", "no", "dogum"), ("musteri", "kisi", "anne", "baba", "es", "calisan")


@dataclass(frozen=True)
class Roles:
    """Which columns are what; they are protected from drops."""

    target: str | None = None
    ident: str | None = None
    period: str | None = None
    segment: str | None = None

    @property
    def protected(self) -> set[str]:
        return {c for c in (self.target, self.ident, self.period) if c}


def drop(df: DataFrame, columns: Sequence[str], roles: Roles) -> DataFrame:
    """Without columns, but never without a target, id or period."""
    return df.drop(*[c for c in columns if c not in roles.protected])


def rename(df: DataFrame, approved: dict[str, str]) -> DataFrame:
    """By an approved map; a new name that is taken, or given twice, is refused."""
    new = [approved.get(c, c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError("two columns would have one name")
    return df.withColumnsRenamed({k: v for k, v in approved.items() if k in df.columns})


def of_sets(df: DataFrame, *sets: str) -> DataFrame:
    return df.where(F.col(SPLIT).isin(*sets))


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known: only they enter models and folds."""
    return df.where(F.col(target).isNotNull())


def drop_defective(df: DataFrame, findings: Sequence[tuple[str, str]], roles: Roles, kinds: Sequence[str] = ("too_null", "constant", "id_like", "high_cardinality", "date", "copy")) -> DataFrame:
    """Without the columns that (column, finding) rows condemn."""
    return drop(df, [c for c, finding in findings if finding in kinds], roles)


def analytic_base(df: DataFrame, train: Column, roles: Roles, decide: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """The base set: decisions applied, then every numeric column filled with its exact train median."""
    from tabloom.operators.features import learn_grid

    out = decide(df)
    skip = roles.protected | {SPLIT, roles.segment}
    own = [f.name for f in out.schema.fields if numeric(kind_of(f.dataType)) and f.name not in skip]
    medians = {c: q[0] for c, q in learn_grid(out.where(train), own, (0.5,)).items() if q[0] is not None} if own else {}
    return out.withColumns({c: F.coalesce(num(F.col(f"`{c}`")), F.lit(float(m))) for c, m in medians.items()})


def personal_names(names: DataFrame) -> DataFrame:
    """(column, personal): whether a column's name points at a person. names: column."""
    folded = turkish_fold(F.col("column"))
    joined, parts = F.regexp_replace(folded, "[^a-z0-9]", ""), F.split(folded, "[^a-z0-9]+")
    any_of = lambda words: F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words]))
    strong = F.lit(False)
    for w in STRONG:
        strong = strong | joined.contains(w)
    return names.select("column", (strong | (any_of(WEAK) & any_of(PERSON))).alias("personal"))


def target_kind(df: DataFrame, target: str) -> DataFrame:
    """One row: binary (at most two values) or continuous, distinct values, and the event rate over all rows, null targets included."""
    y = num(F.col(target))
    row = df.agg(F.count_distinct(y).alias("distinct"), F.avg(F.coalesce((y > 0).cast("double"), F.lit(0.0))).alias("event_rate"), F.count_if(y.isNull()).alias("nulls"))
    return row.select(F.when(F.col("distinct") <= 2, "binary").otherwise("continuous").alias("kind"), "distinct", "event_rate", "nulls")


def period_summary(df: DataFrame, period: str) -> DataFrame:
    """One row: first and last period in time order, how many, and whether the column serves as one (a single value doesn't)."""
    from tabloom.functions import periods

    form = periods.decide(df, period)
    month = periods.month_index(df, period, form) if form else F.lit(None).cast("int")
    text = periods.clean(F.col(period), df.schema[period].dataType)
    order = F.struct(F.coalesce(month, F.lit(0)), text)
    seen = df.where(text.isNotNull())
    return seen.agg(F.min_by(text, order).alias("first"), F.max_by(text, order).alias("last"), F.count_distinct(text).alias("n_periods")).withColumn("serves", (F.col("n_periods") > 1) & F.lit(form is not None))


def advice(findings: DataFrame) -> DataFrame:
    """(column, advice) from (column, finding) rows: drop beats fix beats keep."""
    strength = F.when(F.col("finding").isin("too_null", "constant", "id_like", "near_constant", "copy"), 2).when(F.col("finding").isin("hidden_code", "empty_text", "spelling", "negative", "extreme", "sentinel_date", "drift"), 1).otherwise(0)
    names = F.element_at(F.array(F.lit("keep"), F.lit("fix"), F.lit("drop")), F.max(strength) + 1)
    return findings.groupBy("column").agg(names.alias("advice"))
