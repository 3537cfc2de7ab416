"""A battery of data-quality checks. Each gives rows only for what it finds, as (column, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import periods
from tabloom.functions.exprs import num, spelling_key, turkish_lower
from tabloom.operators import gram, measures
from tabloom.operators.profile import numeric, kind_of, value_table

#: Codes that hide a missing value, fixed values.
HIDDEN_CODES = (-1, -9, -99, -999, -9999, -99999, -999999, -9999999, -99999999, 9999, 99999, 999999, 9999999, 99999999, 999999999)
#: Spellings of an empty text, fixed values.
EMPTY_TEXTS = ("", "null", "none", "nan", "nat", "n/a", "na", "#n/a", "nil", "undefined", "-", "--", "---", "?", "??", ".", "boş", "bos", "bilinmiyor", "bilinmeyen", "belirtilmemiş", "belirtilmemis", "tanımsız", "tanimsiz")
#: Starts and words of measures that are never negative, fixed values.
NEVER_NEGATIVE = ("adet", "sayı", "sayi", "gün", "gun", "süre", "sure", "yaş", "yas", "kez", "frekans")
NEVER_NEGATIVE_WORDS = ("ay", "ayı", "aylar", "yıl", "yılı", "yil", "yili")
FIRST_YEAR, LAST_YEAR = 1901, 2200
#: Pairs of near copies whose ratios one aggregation measures.
RATIOS = 200


def column_rules(profiled: DataFrame, null_share: float = 0.5, id_share: float = 0.95, id_min: int = 100, cardinality: int = 50, dominant: float = 0.99) -> DataFrame:
    """(column, finding) from a profile: too_null, constant, id_like, high_cardinality, near_constant.

    Nulls count as a value for constant and near-constant columns.
    """
    nulls = F.col("n_rows") - F.col("filled")
    top = F.greatest(F.col("top_count"), nulls)
    whole = (F.col("kind") != "ondalik") & (F.col("kind") != "tarih")
    tests = {
        "too_null": nulls > null_share * F.col("n_rows"),
        "constant": F.col("distinct_with_null") <= 1,
        "id_like": (F.col("distinct") > id_share * F.col("n_rows")) & (F.col("distinct") > id_min) & whole,
        "high_cardinality": (F.col("kind") == "metin") & (F.col("distinct") > cardinality),
        "near_constant": top >= dominant * F.col("n_rows"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return profiled.select("column", F.explode(found).alias("finding"))


def _numeric_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return value_table(df, [c for c in columns if numeric(kind_of(df.schema[c].dataType))], False)


def hidden_missing(df: DataFrame, columns: Sequence[str], share: float = 0.01, gap: float = 10) -> DataFrame:
    """(column, code, n, share, nulls, mixed): a code cut off from all other values, in over ``share`` of the filled rows.

    A negative code must be the only negative value; a positive one the largest by a factor of
    ``gap``. mixed: the column has nulls, too, and the code's share doesn't matter.
    """
    tt = _numeric_table(df, columns)
    n_rows = df.count()
    sides = tt.groupBy("k").agg(F.sum("n").alias("filled"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v") < 0).alias("negatives"))
    second = tt.join(F.broadcast(sides.select("k", "most")), "k").where(F.col("v") < F.col("most")).groupBy("k").agg(F.max("v").alias("second"))
    codes = tt.where(F.col("v").isin(*[float(c) for c in HIDDEN_CODES])).join(sides, "k").join(second, "k", "left")
    cut_off = F.when(F.col("v") < 0, (F.col("negatives") == 1) & (F.col("least") == F.col("v"))).otherwise((F.col("most") == F.col("v")) & (F.col("second").isNull() | (F.col("second") * gap < F.col("v"))))
    found = codes.where(cut_off).withColumn("nulls", F.lit(n_rows) - F.col("filled")).withColumn("share", F.col("n") / F.col("filled"))
    ranked = found.where((F.col("share") > share) | (F.col("nulls") > 0)).withColumn("mixed", F.col("share") <= share)
    best = Window.partitionBy("k").orderBy("mixed", F.desc("n"), "v")
    return ranked.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("k").alias("column"), F.col("v").alias("code"), "n", "share", "nulls", "mixed")


def zero_heavy(df: DataFrame, columns: Sequence[str], share: float = 0.95, dominant: float = 0.99) -> DataFrame:
    """(column, n, share): zeros in at least ``share`` of the filled rows, unless the column is near constant."""
    n_rows = df.count()
    stats = _numeric_table(df, columns).groupBy("k").agg(F.sum("n").alias("filled"), F.max("n").alias("top"), F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("n"))), F.lit(0)).alias("z"))
    quiet = F.greatest(F.col("top"), F.lit(n_rows) - F.col("filled")) < dominant * n_rows
    return stats.where((F.col("z") >= share * F.col("filled")) & quiet).select(F.col("k").alias("column"), F.col("z").alias("n"), (F.col("z") / F.col("filled")).alias("share"))


def extremes(df: DataFrame, columns: Sequence[str], factor: float = 100) -> DataFrame:
    """(column, most, p99): a maximum above ``factor`` times the 99th percentile (if that is positive)."""
    q = measures.quantiles(_numeric_table(df, columns), ["k"], "v", "n", (0.99, 1.0))
    return q.where((F.col("q0") > 0) & (F.col("q1") > factor * F.col("q0"))).select(F.col("k").alias("column"), F.col("q1").alias("most"), F.col("q0").alias("p99"))


def never_negative(measure: str) -> bool:
    """Whether a measure's description names a count, a day, a duration, an age, a month or a year."""
    words = "".join(c if c.isalpha() else " " for c in measure.replace("I", "ı").replace("İ", "i").lower()).split()
    return any(w.startswith(NEVER_NEGATIVE) or w in NEVER_NEGATIVE_WORDS for w in words)


def unexpected_negatives(df: DataFrame, described: dict[str, str]) -> DataFrame:
    """(column, n, least): negative values of columns whose description rules them out."""
    return _numeric_table(df, [c for c, d in described.items() if never_negative(d)]).where("v < 0").groupBy("k").agg(F.sum("n").alias("n"), F.min("v").alias("least")).withColumnRenamed("k", "column")


def _by_period(df: DataFrame, columns: Sequence[str], period: str) -> DataFrame:
    """(k, period, rows, filled, distinct): one melt and one shuffle for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    cells = df.where(F.col(period).isNotNull()).select(F.col(period).alias("p"), F.explode(pairs).alias("c")).groupBy("p", "c.k", "c.v").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("k", F.col("p").alias("period")).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"), F.count("v").alias("distinct"))


def period_gaps(df: DataFrame, columns: Sequence[str], period: str, least_rows: int = 100) -> DataFrame:
    """(column, period, finding): empty in a period, or constant in one of at least ``least_rows`` rows (unless in all)."""
    cells = _by_period(df, columns, period)
    constant = (F.col("filled") == F.col("n_rows")) & (F.col("distinct") == 1) & (F.col("n_rows") >= least_rows)
    whole = Window.partitionBy("k")
    marked = cells.withColumn("constant", constant).withColumn("always", F.bool_and("constant").over(whole))
    finding = F.when(F.col("filled") == 0, "empty").when(F.col("constant") & ~F.col("always"), "constant")
    return marked.select(F.col("k").alias("column"), "period", finding.alias("finding")).where("finding IS NOT NULL")


def missing_jumps(df: DataFrame, columns: Sequence[str], period: str, jump: float = 0.20) -> DataFrame:
    """(column, before, after, share_before, share_after): the largest jump of the null share between consecutive periods, above ``jump``."""
    cells = _by_period(df, columns, period).withColumn("share", 1 - F.col("filled") / F.col("n_rows"))
    order = Window.partitionBy("k").orderBy("period")
    steps = cells.withColumn("before", F.lag("period").over(order)).withColumn("share_before", F.lag("share").over(order)).withColumn("jump", F.abs(F.col("share") - F.col("share_before")))
    best = Window.partitionBy("k").orderBy(F.desc("jump"), "period")
    return steps.where(F.col("jump") > jump).withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("k").alias("column"), "before", F.col("period").alias("after"), "share_before", F.col("share").alias("share_after"))


def target_summary(df: DataFrame, target: str, period: str | None = None) -> DataFrame:
    """(period, value, n, share): classes of the target (null included), overall or by period; shares are of filled rows."""
    keys = [F.col(period).alias("period")] if period else []
    counts = df.groupBy(*keys, F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*(["period"] if period else []))
    filled = F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).over(whole)
    return counts.withColumn("share", F.when(F.col("value").isNotNull(), F.col("n") / filled))


def empty_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): texts that spell an empty value, compared trimmed and in Turkish lower case."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    tt = df.select(F.explode(pairs).alias("p")).select("p.k", "p.v").where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    return tt.where(turkish_lower(F.trim("v")).isin(*EMPTY_TEXTS)).select(F.col("k").alias("column"), F.col("v").alias("value"), "n")


def spelling_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, target): values that share a spelling key with a more frequent one, which is the target (ties: the least)."""
    tt = value_table(df, columns, True).where(~turkish_lower(F.trim("v")).isin(*EMPTY_TEXTS)).withColumn("key", spelling_key(F.col("v")))
    best = tt.groupBy("k", "key").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("target"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return tt.join(best, ["k", "key"]).where(F.col("v") != F.col("target")).select(F.col("k").alias("column"), F.col("v").alias("value"), "n", "target")


def as_date(c: Column, kind: str) -> Column:
    """A date from a date column, ISO or dotted text, or an eight-digit number; null if it is none."""
    if kind == "tarih":
        return c.cast("date")
    if kind in ("tam", "ondalik"):
        return F.when(c.between(10000101, 99991231), F.try_to_date(c.cast("long").cast("string"), "yyyyMMdd"))
    text = F.substring(F.trim(c), 1, 10)
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd.MM.yyyy"))


def date_columns(df: DataFrame, columns: Sequence[str], text_share: float = 0.8, number_share: float = 0.99) -> DataFrame:
    """(column, how): columns that are dates by type, by 80 % of their distinct texts, or by 99 % of their eight-digit numbers."""
    rows = [(c, "type") for c in columns if kind_of(df.schema[c].dataType) == "tarih"]
    out = df.sparkSession.createDataFrame(rows, "column string, how string")
    texts = [c for c in columns if kind_of(df.schema[c].dataType) == "metin"]
    numbers = [c for c in columns if kind_of(df.schema[c].dataType) in ("tam", "ondalik")]
    if texts:
        tt = value_table(df, texts, True)
        good = tt.groupBy("k").agg(F.count(as_date(F.col("v"), "metin")).alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("d") >= text_share * F.col("n"))
        out = out.unionAll(good.select("k", F.lit("text")))
    if numbers:
        tt = value_table(df, numbers, False).where(F.abs("v") < 1e17)
        good = tt.groupBy("k").agg(F.sum(F.when(as_date(F.when(F.col("v") == F.floor("v"), F.col("v")), "ondalik").isNotNull(), F.col("n")).otherwise(0)).alias("d"), F.sum("n").alias("n")).where(F.col("d") >= number_share * F.col("n"))
        out = out.unionAll(good.select("k", F.lit("number")))
    return out


def sentinel_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): dates before 1901 or after 2200."""
    out = None
    for c in columns:
        d = as_date(F.col(f"`{c}`"), kind_of(df.schema[c].dataType))
        part = df.select(d.alias("d")).where((F.year("d") < FIRST_YEAR) | (F.year("d") > LAST_YEAR)).groupBy("d").agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), F.date_format("d", "yyyy-MM-dd").alias("value"), "n")
        out = part if out is None else out.unionAll(part)
    return out


def late_dates(df: DataFrame, columns: Sequence[str], period: str) -> DataFrame:
    """(column, n, share, latest): dates after the end of the row's own period; sentinel dates don't count."""
    end, out = periods.period_end(F.col(period)), None
    for c in columns:
        d = as_date(F.col(f"`{c}`"), kind_of(df.schema[c].dataType))
        d = F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d)
        both = df.select(d.alias("d"), end.alias("e")).where("d IS NOT NULL AND e IS NOT NULL")
        part = both.agg(F.lit(c).alias("column"), F.count_if(F.col("d") > F.col("e")).alias("n"), F.avg((F.col("d") > F.col("e")).cast("double")).alias("share"), F.date_format(F.max(F.when(F.col("d") > F.col("e"), F.col("d"))), "yyyy-MM-dd").alias("latest")).where("n > 0")
        out = part if out is None else out.unionAll(part)
    return out


def value_drift(df: DataFrame, columns: Sequence[str], period: str, factor: float = 10, least_rows: int = 30) -> DataFrame:
    """(column, before, after, median_before, median_after, factor): all quartiles of non-zero absolute values move one way by at least ``factor``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.abs(num(F.col(f"`{c}`"))).alias("v")) for c in columns])
    tt = df.where(F.col(period).isNotNull()).select(F.col(period).alias("p"), F.explode(pairs).alias("c")).select("p", "c.k", "c.v").where("v > 0").groupBy("k", "p", "v").agg(F.count(F.lit(1)).alias("n"))
    q = measures.quantiles(tt, ["k", "p"], "v", "n", (0.25, 0.5, 0.75)).join(tt.groupBy("k", "p").agg(F.sum("n").alias("m")), ["k", "p"])
    seen = df.where(F.col(period).isNotNull()).select(F.col(period).alias("p")).distinct()
    grid = q.select("k").distinct().join(F.broadcast(seen), F.lit(True)).join(q, ["k", "p"], "left")
    order = Window.partitionBy("k").orderBy("p")
    steps = grid.withColumns({f"{c}_b": F.lag(c).over(order) for c in ("q0", "q1", "q2", "m", "p")})
    ratios = [F.col(f"q{i}") / F.col(f"q{i}_b") for i in range(3)]
    up, down = F.least(*ratios), 1 / F.greatest(*ratios)
    steps = steps.where((F.col("m") >= least_rows) & (F.col("m_b") >= least_rows)).withColumn("factor", F.when(up > 1, up).when(down > 1, down))
    best = Window.partitionBy("k").orderBy(F.desc("factor"), "p")
    return steps.where(F.col("factor") >= factor).withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("k").alias("column"), F.col("p_b").alias("before"), F.col("p").alias("after"), F.col("q1_b").alias("median_before"), F.col("q1").alias("median_after"), "factor")


def target_separators(df: DataFrame, columns: Sequence[str], target: str, least: float = 0.95, levels: int = 50) -> DataFrame:
    """(column, auc): columns that separate a 0/1 target almost perfectly by themselves. Give training rows.

    Nulls come below the least number; a category is scored by its own target rate, up to ``levels`` levels.
    """
    rows, out = df.where(F.col(target).isNotNull()), None
    for c in columns:
        kind = kind_of(df.schema[c].dataType)
        if kind in ("tam", "ondalik"):
            x = num(F.col(f"`{c}`"))
            tt = rows.select(x.alias("x"), F.col(target).alias("y")).groupBy("x").agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") <= 0).alias("good"))
            tt = tt.withColumn("x", F.coalesce("x", F.lit(float("-inf"))))
        else:
            cats = rows.groupBy(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__BOS__")).alias("c")).agg(F.count_if(F.col(target) > 0).alias("bad"), F.count_if(F.col(target) <= 0).alias("good"))
            if not 2 <= cats.limit(levels + 1).count() <= levels:
                continue
            tt = cats.withColumn("x", F.col("bad") / (F.col("bad") + F.col("good"))).groupBy("x").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        part = measures.separation(tt, [], "x", "bad", "good").select(F.lit(c).alias("column"), measures.folded(F.col("auc")).alias("auc"))
        out = part if out is None else out.unionAll(part)
    return out.where(F.col("auc") >= least) if out is not None else df.sparkSession.createDataFrame([], "column string, auc double")


def _fingerprint(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> dict[str, tuple]:
    """One aggregation: for each column an order-free sum of hashes of (row key, value); 1 and 1.0 agree."""
    row = df.agg(*[F.sum(F.xxhash64(*key, F.coalesce(num(F.col(f"`{c}`").cast("string")).cast("string"), F.col(f"`{c}`").cast("string"), F.lit("\0"))).cast("decimal(38,0)")).alias(f"f{i}") for i, c in enumerate(columns)], *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"f{i}"], row[f"n{i}"]) for i, c in enumerate(columns)}


def identical_columns(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(column, copy): columns with the same values in every row. Candidates by fingerprint, then compared exactly."""
    prints = _fingerprint(df, columns, key)
    pairs = [(a, b) for a, b in combinations(columns, 2) if prints[a] == prints[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, copy string")

    def same(a: str, b: str) -> Column:
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        numbers = numeric(kind_of(df.schema[a].dataType)) and numeric(kind_of(df.schema[b].dataType))
        return F.bool_and(x.cast("double").eqNullSafe(y.cast("double")) if numbers else x.cast("string").eqNullSafe(y.cast("string")))

    row = df.agg(*[same(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return df.sparkSession.createDataFrame([p for i, p in enumerate(pairs) if row[f"p{i}"]], "column string, copy string")


def near_copies(df: DataFrame, columns: Sequence[str], least: float = 0.99) -> DataFrame:
    """(column, copy, r, relation): numeric columns that correlate at ``least`` or are a constant multiple.

    Candidates share null count, zero count and the rounded quantiles of their standard form,
    up to sign; one pass over the candidates' columns (``gram``) correlates them, however many
    share a signature, and the ratios of those that do correlate are measured RATIOS pairs at a time.
    """
    x = {c: num(F.col(f"`{c}`")) for c in columns}
    tt = _numeric_table(df, columns)
    q = measures.quantiles(tt, ["k"], "v", "n", (0.1, 0.25, 0.5, 0.75, 0.9))
    moments = df.agg(*[f(x[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))], *[F.count_if(x[c] == 0).alias(f"z{i}") for i, c in enumerate(columns)]).first()
    quantile = {r.k: [r[f"q{j}"] for j in range(5)] for r in q.collect()}
    buckets: dict[tuple, list[str]] = {}
    for i, c in enumerate(columns):
        if c in quantile and moments[f"s{i}"]:
            z = [round((v - moments[f"m{i}"]) / moments[f"s{i}"], 1) + 0.0 for v in quantile[c]]
            mark = min(tuple(z), tuple(-v + 0.0 for v in reversed(z)))
            buckets.setdefault((moments[f"n{i}"], moments[f"z{i}"], mark), []).append(c)
    together = {c: i for i, group in enumerate(buckets.values()) for c in group if len(group) > 1}
    strong = [(r.a, r.b, r.r) for r in gram.correlations(df, [c for c in columns if c in together], least).collect() if together[r.a] == together[r.b]]
    kinds: dict[tuple[str, str], str] = {}
    for at in range(0, len(strong), RATIOS):
        part = strong[at : at + RATIOS]
        ratio = [F.try_divide(F.when(x[a] != 0, x[b]), F.when(x[a] != 0, x[a])) for a, b, _ in part]
        row = df.agg(*[f(q).alias(f"{n}{i}") for i, q in enumerate(ratio) for n, f in (("s", F.stddev_samp), ("m", F.avg))]).first()
        kinds |= {(a, b): "kat" if row[f"s{i}"] is not None and row[f"s{i}"] <= 1e-9 * max(abs(row[f"m{i}"]), 1) else "kor" for i, (a, b, _) in enumerate(part)}
    return df.sparkSession.createDataFrame([(a, b, r, kinds[a, b]) for a, b, r in strong], "column string, copy string, r double, relation string")


def _violations(df: DataFrame, tests: list[tuple[str, str, str, Column, Column]]) -> DataFrame:
    """(column, other, kind, n, share) of row predicates, all in one aggregation."""
    row = df.agg(*[F.count_if(bad).alias(f"b{i}") for i, (_, _, _, bad, _) in enumerate(tests)], *[F.count_if(of).alias(f"o{i}") for i, (_, _, _, _, of) in enumerate(tests)]).first()
    found = [(a, b, kind, row[f"b{i}"], row[f"b{i}"] / max(row[f"o{i}"], 1)) for i, (a, b, kind, _, _) in enumerate(tests) if row[f"b{i}"]]
    return df.sparkSession.createDataFrame(found, "column string, other string, kind string, n long, share double")


def window_consistency(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """pairs: (short, long, "artan" or "azalan"): the short window must not exceed (artan) or undercut (azalan) the long one."""
    tests = []
    for a, b, way in pairs:
        x, y = num(F.col(a)), num(F.col(b))
        slack, both = 1e-9 * (F.abs(y) + 1), x.isNotNull() & y.isNotNull()
        tests.append((a, b, way, both & (x > y + slack if way == "artan" else x < y - slack), both))
    return _violations(df, tests)


def amount_count(df: DataFrame, amounts: Sequence[tuple[str, str]], maxima: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """amounts: (count, amount): an amount although the count is 0 or null. maxima: (max, mean): a maximum below the mean."""
    tests = []
    for c, a in amounts:
        n, t = num(F.col(c)), num(F.col(a))
        tests.append((a, c, "adet_tutar", F.coalesce(n, F.lit(0.0)).eqNullSafe(0.0) & t.isNotNull() & (t != 0), t.isNotNull()))
    for m, a in maxima:
        x, y = num(F.col(m)), num(F.col(a))
        tests.append((m, a, "maks_ort", x.isNotNull() & y.isNotNull() & (x < y - 1e-9 * (F.abs(y) + 1)), x.isNotNull() & y.isNotNull()))
    return _violations(df, tests)


def decimal_precision(df: DataFrame, columns: Sequence[str], places: int = 4) -> DataFrame:
    """(column, finding): float columns that are integral throughout, or carry more decimals than ``places`` (half-even)."""
    x = {c: num(F.col(f"`{c}`")) for c in columns}
    row = df.agg(*[F.bool_and(x[c] == F.floor(x[c])).alias(f"w{i}") for i, c in enumerate(columns)], *[F.bool_or(F.bround(x[c], places) != x[c]).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    found = [(c, "integral" if row[f"w{i}"] else "decimals") for i, c in enumerate(columns) if row[f"w{i}"] or row[f"d{i}"]]
    return df.sparkSession.createDataFrame(found, "column string, finding string")


def keep_of_copies(copies: list[tuple[str, str]], strength: dict[str, float], findings: dict[str, int], order: Sequence[str]) -> dict[str, str]:
    """column -> the survivor of its group: the strongest, then the one with fewest findings, then the first in the table."""
    root = {c: c for c in order}

    def top(c: str) -> str:
        while root[c] != c:
            c = root[c]
        return c

    for a, b in copies:
        root[top(b)] = top(a)
    groups: dict[str, list[str]] = {}
    for c in order:
        groups.setdefault(top(c), []).append(c)
    return {c: min(g, key=lambda m: (-strength.get(m, 0.5), findings.get(m, 0), list(order).index(m))) for g in groups.values() if len(g) > 1 for c in g}
