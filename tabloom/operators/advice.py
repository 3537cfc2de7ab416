"""Proposals from what was found: how a variable enters a model, which columns take part in generation, which remedies are worth offering.

Rules are expressions over tables of facts, one row for each column, so they are the same for
thirty columns and thirty thousand. Unknown facts (null) never trigger a rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators import profile, remedies

#: Limits, fixed values: share of outliers and skew from which on a variable is treated, levels of a text, rows of a group, standard errors.
OUTLIERS, SKEW, LEVELS, ROWS, ERRORS = 0.005, 2.0, 200, 30, 2.58
#: What a decision may say, fixed values; the first is taken for anything else.
USE = ("evet", "hayir")
MISSING = ("yok", "medyan", "sabit", "isaret", "missing")
EXTREME = ("yok", "winsor")
TRANSFORM = ("yok", "log", "ustel", "sira")
BINNING = ("yok", "onerilen")
#: Codes that order a single column as it was ordered or that a tree splits on by itself, fixed values.
FOR_LINEAR = ("kare", "dilim", "isaret", "sifir", "esik", "kova", "carpim")


def _is(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def variable_decisions(facts: DataFrame) -> DataFrame:
    """(column, use, missing, extreme, transform, binning) for each row of facts.

    facts: column, categorical, n_missing, missing_differs, shape, bins, outlier_share, skew,
    least, leak, sensitive. A leak leaves, and so does a sensitive variable that has no bins.
    Bins stand in for categories, sensitive variables and U shapes; only numbers without bins
    are clipped or transformed.
    """
    several = F.coalesce(F.col("bins") > 1, F.lit(False))
    curved = F.coalesce(F.col("shape").isin("U", "ters U"), F.lit(False))
    binned = several & (_is("categorical") | _is("sensitive") | curved)
    number = ~_is("categorical") & ~binned
    gaps = F.coalesce(F.col("n_missing") > 0, F.lit(False))
    return facts.select(
        "column",
        F.when(_is("leak") | (_is("sensitive") & ~several), "hayir").otherwise("evet").alias("use"),
        F.when(~gaps, "yok").when(_is("categorical"), "missing").when(_is("missing_differs"), "isaret").otherwise("medyan").alias("missing"),
        F.when(number & (F.col("outlier_share") > OUTLIERS), "winsor").otherwise("yok").alias("extreme"),
        F.when(number & (F.col("skew") > SKEW) & (F.coalesce("least", F.lit(0.0)) >= 0), "log").otherwise("yok").alias("transform"),
        F.when(binned, "onerilen").otherwise("yok").alias("binning"),
    )


def valid_decisions(given: DataFrame) -> DataFrame:
    """Decisions from outside, reduced to what can be carried out. given: column, categorical, use, missing, missing_value (text), extreme, transform, binning.

    Categories take missing values as a level of their own and are neither clipped nor
    transformed; a constant without a number is the median.
    """
    def one_of(c: str, allowed: Sequence[str]) -> Column:
        return F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(F.lit(allowed[0]))

    value = F.expr("try_cast(replace(missing_value, ',', '.') AS double)")
    chosen, text = one_of("missing", MISSING), _is("categorical")
    missing = F.when(text & chosen.isin("medyan", "sabit", "isaret"), "missing").when(~text & (chosen == "missing"), "isaret").when((chosen == "sabit") & value.isNull(), "medyan").otherwise(chosen)
    return given.select(
        "column", one_of("use", USE).alias("use"), missing.alias("missing"), value.alias("missing_value"),
        F.when(text, "yok").otherwise(one_of("extreme", EXTREME)).alias("extreme"),
        F.when(text, "yok").otherwise(one_of("transform", TRANSFORM)).alias("transform"),
        one_of("binning", BINNING).alias("binning"),
    )


def generation_columns(df: DataFrame, roles: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """(column, kind, reason): why a column takes no part in generation; reason is null for those that do.

    In order: rol (target, id, period, split), haric (ruled out before), tarih, sabit (empty or
    one value), bayrak (0 and 1 only), cok_degerli (text of more than LEVELS values).
    """
    c = F.col("column")
    number = F.col("kind").isin("tam", "ondalik", "mantiksal")
    reason = (
        F.when(c.isin(*roles), "rol").when(c.isin(*excluded), "haric").when(F.col("kind") == "tarih", "tarih").when(F.coalesce("distinct", F.lit(0)) <= 1, "sabit")
        .when(number & (F.col("distinct") == 2) & (F.col("min") == 0) & (F.col("max") == 1), "bayrak").when(~number & (F.col("distinct") > LEVELS), "cok_degerli")
    )
    return profile.profile(df).select("column", "kind", reason.alias("reason"))


def feasible(codes: Sequence[str], model: str) -> list[str]:
    """The codes worth generating for a kind of model: trees ("agac") need none of FOR_LINEAR."""
    return [c for c in codes if model != "agac" or c not in FOR_LINEAR]


def filled_flags(train: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(column, filled, missing, filled_rate, missing_rate, remedy): whether being filled says something about the target.

    dolu_bayrak if there are ROWS rows of either kind and the rates differ by ERRORS standard
    errors, else cikar. One pass over the columns together.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").isNotNull().alias("f")) for c in columns])
    y = F.col(f"`{target}`")
    each = train.select(F.explode(cells).alias("x"), y.alias("y")).select("x.column", "x.f", "y")
    got = each.groupBy("column").agg(
        F.count_if("f").alias("filled"), F.count_if(~F.col("f")).alias("missing"),
        F.count_if(F.col("f") & F.col("y").isNotNull()).alias("n1"), F.count_if(~F.col("f") & F.col("y").isNotNull()).alias("n0"),
        F.count_if(F.col("f") & (F.col("y") > 0)).alias("b1"), F.count_if(~F.col("f") & (F.col("y") > 0)).alias("b0"),
    )
    p1, p0, p = F.try_divide("b1", "n1"), F.try_divide("b0", "n0"), F.try_divide(F.col("b1") + F.col("b0"), F.col("n1") + F.col("n0"))
    error = F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n0")))
    worth = (F.least("filled", "missing") >= ROWS) & (F.least("n1", "n0") > 0) & (p > 0) & (p < 1)
    flag = F.when(worth, F.abs(p1 - p0) >= ERRORS * error)
    return got.select("column", "filled", "missing", p1.alias("filled_rate"), p0.alias("missing_rate"), F.when(flag, "dolu_bayrak").otherwise("cikar").alias("remedy"))


def offers(train: DataFrame, column: str, target: str, parity: Column) -> list[str]:
    """Remedies worth offering for a column of too many levels, the advised one first, "cikar" last.

    Free text gives text features. Target groups, and groups of a prefix, are offered if they
    hold on the other half of the train rows; keeping frequent values if target groups are and
    two values have ROWS rows.
    """
    if remedies.free_text(train, [column]).where("free").count():
        return ["metin", "cikar"]
    text, found = not profile.numeric(profile.kind_of(train.schema[column].dataType)), []
    if text and remedies.groups_hold(train, column, target, parity):
        found.append("hedef_grupla")
    k = remedies.prefix_length(train, column)
    if k:
        start = train.withColumn(column, F.substring(F.col(f"`{column}`").cast("string"), 1, k))
        if remedies.groups_hold(start, column, target, parity):
            found.append("onek_grupla")
    if "hedef_grupla" in found:
        often = train.where(F.col(f"`{column}`").isNotNull()).groupBy(f"`{column}`").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ROWS)
        if often.limit(2).count() == 2:
            found.append("seyrek_grupla")
    return [*found, "cikar"]
