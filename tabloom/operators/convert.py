"""Typed conversions, each verified on the whole column: what can't be converted is counted, and a write aborts on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODES = ("sayisal_nokta", "sayisal_virgul", "tarih_ymd", "tarih_dmy", "tarih_ymd8", "tarih_ym6", "donem_ym6", "donem_ymd8", "kategorik_metin", "kategorik_ay", "kategorik_yil", "sayisal_ymd8")
MAX_LEVELS = 50
#: What every text that a date form takes looks like.
_LOOKS = {"yyyy-M-d": "[0-9]-[-+]?[0-9]+-[-+]?[0-9]+$", "d.M.yyyy": "^[-+]?[0-9]+[.][-+]?[0-9]+[.][-+]?[0-9]+$", "yyyyMMdd": "[0-9]{4}$"}


class ConversionError(ValueError):
    """Filled values would be lost."""


def rendered(c: Column, kind: T.DataType, whole: bool = False) -> Column:
    """The value as trimmed text; a float column that is integral throughout (whole) prints without a fraction."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(~F.isnan(c), c.cast("long").cast("string") if whole else c.cast("string"))
    return F.trim(c.cast("string"))


def convert(c: Column, code: str, kind: T.DataType, whole: bool = False) -> Column:
    """One of CODES as an expression; null where the value can't be converted."""
    text = rendered(c, kind, whole)
    filled = F.when(text != "", text)
    stamp = isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)
    # a text that can't have the form is not parsed, as a failure costs far more than a look
    date = lambda form, t=filled: F.when(t.rlike(_LOOKS[form]), F.try_to_timestamp(t, F.lit(form)))
    match code:
        case "sayisal_nokta" | "sayisal_virgul":
            group, point = (",", "\\.") if code == "sayisal_nokta" else ("\\.", ",")
            grouped = f"^[+-]?[0-9]{{1,3}}({group}[0-9]{{3}})+({point}[0-9]*)?$"
            plain = F.regexp_replace(F.regexp_replace(filled, group, ""), point, ".")
            return F.when(~filled.rlike(group) | filled.rlike(grouped), plain.try_cast("double"))
        case "tarih_ymd":
            return date("yyyy-M-d")
        case "tarih_dmy":
            return date("d.M.yyyy")
        case "tarih_ymd8":
            return F.when(F.length(filled) == 8, date("yyyyMMdd"))
        case "tarih_ym6":
            return F.when(F.length(filled) == 6, date("yyyyMMdd", F.concat(filled, F.lit("01"))))
        case "donem_ym6":
            return F.when((F.length(filled) == 6) & date("yyyyMMdd", F.concat(filled, F.lit("01"))).isNotNull(), c)
        case "donem_ymd8":
            return F.when((F.length(filled) == 8) & date("yyyyMMdd").isNotNull(), c)
        case "kategorik_metin":
            return F.regexp_replace(filled, "^(-?[0-9]+)\\.0+$", "$1")
    when = c.cast("timestamp") if stamp else F.coalesce(date("yyyy-M-d"), date("d.M.yyyy"))
    match code:
        case "kategorik_ay":
            return F.date_format(when, "yyyy-MM")
        case "kategorik_yil":
            return F.date_format(when, "yyyy")
        case "sayisal_ymd8":
            return F.date_format(when, "yyyyMMdd").try_cast("double")
    raise ConversionError(f"no conversion {code}")


def whole_floats(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Which float columns are integral throughout: decided over the whole column, in one aggregation."""
    floats = [n for n in names if isinstance(df.schema[n].dataType, T.FloatType | T.DoubleType)]
    if not floats:
        return {}
    row = df.agg(*[F.bool_and(F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`") == F.floor(f"`{n}`"))).alias(n) for n in floats]).first()
    return {n: bool(row[n]) for n in floats}


def audit(df: DataFrame, changes: list[tuple[str, str]]) -> DataFrame:
    """Per change: column, code, filled, failed and up to three values that fail (the least ones)."""
    whole = whole_floats(df, [n for n, _ in changes])
    rows = []
    for n, code in changes:
        c = F.col(f"`{n}`")
        text = rendered(c, df.schema[n].dataType, whole.get(n, False))
        filled = text.isNotNull() & (text != "")
        bad = filled & convert(c, code, df.schema[n].dataType, whole.get(n, False)).isNull()
        rows.append(df.agg(F.lit(n).alias("column"), F.lit(code).alias("code"), F.count_if(filled).alias("filled"), F.count_if(bad).alias("failed"), F.slice(F.array_sort(F.collect_set(F.when(bad, text))), 1, 3).alias("examples")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def apply(df: DataFrame, changes: list[tuple[str, str]], strict: bool = True) -> tuple[DataFrame, list[str]]:
    """Apply conversions. strict: any filled value that would become null aborts all; else such columns stay as they are.

    Gives the table and the columns skipped. All failure counters come from one aggregation.
    """
    whole = whole_floats(df, [n for n, _ in changes])
    made = {n: convert(F.col(f"`{n}`"), code, df.schema[n].dataType, whole.get(n, False)) for n, code in changes}
    counters = []
    for n, c in made.items():
        text = rendered(F.col(f"`{n}`"), df.schema[n].dataType, whole.get(n, False))
        counters.append(F.count_if(text.isNotNull() & (text != "") & c.isNull()).alias(n))
    row = df.agg(*counters).first()
    failed = [n for n in made if row[n]]
    if failed and strict:
        raise ConversionError("; ".join(f"{n}: {row[n]} values can't be converted" for n in failed))
    return df.withColumns({n: c for n, c in made.items() if n not in failed}), failed


def suggest(profile: dict) -> str | None:
    """The first rule that matches a column's profile (keys kind, filled, bad_ym6, bad_ymd8, bad_number, leading_zero, bad_date, distinct).

    Period of six digits, date of eight, numeric text without leading zeros, date text, code-like integer.
    """
    p = {"kind": "", "filled": 0, "bad_ym6": 1, "bad_ymd8": 1, "bad_number": 1, "leading_zero": 1, "bad_date": 1, "distinct": 0, **profile}
    if not p["filled"]:
        return None
    if p["bad_ym6"] == 0:
        return "donem_ym6"
    if p["bad_ymd8"] == 0:
        return "tarih_ymd8"
    if p["kind"] == "metin" and p["bad_number"] == 0 and p["leading_zero"] == 0:
        return "sayisal_nokta"
    if p["kind"] == "metin" and p["bad_date"] == 0:
        return "tarih_ymd"
    if p["kind"] == "tam" and 1 < p["distinct"] <= MAX_LEVELS and p.get("named_code"):
        return "kategorik_metin"
    return None


def text_facts(df: DataFrame, columns: list[str], coded: list[str]) -> DataFrame:
    """Per column (its place ``i``) what its filled texts are, in one aggregation; distinct is counted of coded columns only.

    Cells go through one set of expressions, so what a column is made by is evaluated once a row.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), rendered(F.col(f"`{n}`"), df.schema[n].dataType, True).alias("t")) for i, n in enumerate(columns)])
    each = df.select(F.explode(cells).alias("x")).select("x.i", "x.t").where("t IS NOT NULL AND t <> ''")
    bad = lambda code: F.count_if(convert(F.col("t"), code, T.StringType()).isNull())
    own = [i for i, n in enumerate(columns) if n in coded]
    return each.groupBy("i").agg(
        F.count("t").alias("filled"), bad("donem_ym6").alias("bad_ym6"), bad("donem_ymd8").alias("bad_ymd8"), bad("sayisal_nokta").alias("bad_number"), bad("tarih_ymd").alias("bad_date"),
        F.count_if(F.col("t").rlike("^0[0-9]")).alias("leading_zero"), (F.count_distinct(F.when(F.col("i").isin(own), F.col("t"))) if own else F.lit(0)).alias("distinct"),
    )


def facts(df: DataFrame, columns: list[str]) -> list[tuple[str, dict]]:
    """For each column what ``suggest`` asks about, from one aggregation over the table; distinct values are counted of whole numbers named as codes (else 0)."""
    kind = lambda k: "metin" if isinstance(k, T.StringType) else "tam" if isinstance(k, T.IntegralType) else "ondalik" if isinstance(k, T.NumericType) else "tarih"
    kinds = {n: kind(df.schema[n].dataType) for n in columns}
    named = {n: n.upper().endswith(("KOD", "CODE", "CD")) for n in columns}
    got = {r.i: r for r in text_facts(df, columns, [n for n in columns if named[n] and kinds[n] == "tam"]).collect()}
    keys = ("filled", "bad_ym6", "bad_ymd8", "bad_number", "bad_date", "leading_zero", "distinct")
    return [(n, {"kind": kinds[n], "named_code": named[n], **{k: got[i][k] if i in got else 0 for k in keys}}) for i, n in enumerate(columns)]


def suggestions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, code) of the columns whose values all fit a conversion, by the first rule they meet; others have no row."""
    found = [(n, code) for n, f in facts(df, columns) if (code := suggest(f))]
    return df.sparkSession.createDataFrame(found, "column string, code string")
