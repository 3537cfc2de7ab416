"""Column remedies and text features: learnt on train rows, applied to all."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import periods
from tabloom.functions.exprs import num, spelling_key, turkish_lower
from tabloom.operators import measures, variables
from tabloom.operators.checks import EMPTY_TEXTS, FIRST_YEAR, LAST_YEAR
from tabloom.sources.store import materialise

RARE, OTHER, TOP = 30, "Diğer", 20
#: A mapping on the driver has at most so many entries.
MAPPED = 1_000
Z = 2.58


def learn_target_groups(train: DataFrame, column: str, target: str) -> dict[str, str]:
    """``variables.target_groups`` of a column of few categories, as a mapping; columns of more than a thousand stay a table."""
    rows = variables.target_groups(train, column, target, RARE).limit(MAPPED + 1).collect()
    if len(rows) > MAPPED:
        raise ValueError(f"{column} has over {MAPPED} categories: use variables.target_groups and with_group")
    return {r.category: r.grp for r in rows}


def target_group(column: str, groups: dict[str, str], default: str | None = None) -> Column:
    """The learnt group; a category that train never saw gets the default, the largest group unless given."""
    c = variables.category_key(column)
    if not groups:
        return F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(groups.items()) for x in pair]), c), F.lit(default or max(sorted(set(groups.values())), key=list(groups.values()).count)))


def groups_hold(train: DataFrame, column: str, target: str, parity: Column) -> bool:
    """Groups learnt on one half separate the other: AUC 2.58 standard errors above a half."""
    groups = variables.target_groups(train.where(parity == 1), column, target, RARE)
    marked = variables.with_group(train.where(parity == 0).select(F.col(f"`{column}`"), F.col(f"`{target}`").alias("__y")), groups, column, "__g")
    rows = marked.select(F.substring("__g", 2, 9).cast("double").alias("s"), F.col("__y").alias("y"))
    row = measures.separation(measures.class_counts(rows, [], "s", "y"), [], "s", "bad", "good").first()
    if row is None or row.auc is None:
        return False
    error = math.sqrt((row.n_bad + row.n_good + 1) / (12.0 * row.n_bad * row.n_good))
    return (row.auc - 0.5) / error >= Z


def learn_frequent(train: DataFrame, column: str, top: int = TOP) -> list[str]:
    """The most frequent train values; ties by value."""
    return [r.c for r in train.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(top).collect()]


def rare_group(column: str, frequent: Sequence[str]) -> Column:
    c = F.col(f"`{column}`").cast("string")
    return F.when(c.isNull(), None).when(c.isin(*frequent), c).otherwise(F.lit(OTHER))


def prefix_length(train: DataFrame, column: str, most: int = 8, share: float = 0.8, levels: tuple[int, int] = (2, 200)) -> int | None:
    """The longest proper prefix that makes 2 to 200 groups, if at least 80 % of the values have one length."""
    c = F.col(f"`{column}`").cast("string")
    lengths = train.where(c.isNotNull()).groupBy(F.length(c).alias("l")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m"), F.sum("n").alias("t"), F.max_by("l", "n").alias("l")).first()
    if not lengths.t or lengths.m < share * lengths.t or lengths.l < 2:
        return None
    most = min(most, lengths.l - 1)
    row = train.agg(*[F.count_distinct(F.substring(c, 1, k)).alias(f"k{k}") for k in range(1, most + 1)]).first()
    fit = [k for k in range(1, most + 1) if levels[0] <= row[f"k{k}"] <= levels[1]]
    return max(fit) if fit else None


def filled_flag(column: str) -> Column:
    return F.col(f"`{column}`").isNotNull().cast("int")


def days_before_period_end(date: Column, period: Column) -> Column:
    return F.datediff(periods.period_end(period), date)


def code_to_null(column: str, code: float) -> Column:
    x = num(F.col(f"`{column}`"))
    return F.when(x != code, x)


def null_to_code(column: str, code: float) -> Column:
    return F.coalesce(num(F.col(f"`{column}`")), F.lit(float(code)))


def sentinel_date_to_null(date: Column) -> Column:
    return F.when(F.year(date).between(FIRST_YEAR, LAST_YEAR), date)


def empty_text_to_null(column: str) -> Column:
    c = F.col(f"`{column}`")
    return F.when(~turkish_lower(F.trim(c)).isin(*EMPTY_TEXTS), c)


def canonical_spelling(column: str, targets: dict[str, str]) -> Column:
    """The target spelling of the value's key, else the value as it is."""
    c = F.col(f"`{column}`")
    if not targets:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(targets.items()) for x in pair]), spelling_key(c)), c)


def negative_to_null(column: str) -> Column:
    x = num(F.col(f"`{column}`"))
    return F.when(x >= 0, x)


def learn_upper_clip(train: DataFrame, column: str, share: float = 0.99) -> float | None:
    """The train percentile of the non-zero values."""
    x = num(F.col(f"`{column}`"))
    tt = train.select(x.alias("v")).where("v <> 0").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    row = measures.quantiles(tt, [], "v", "n", (share,)).first()
    return row.q0 if row else None


def upper_clip(column: str, cut: float) -> Column:
    x = num(F.col(f"`{column}`"))
    return F.when(x.isNotNull(), F.least(x, F.lit(float(cut))))


def rounded(column: str, places: int) -> Column:
    """Half-even; 0 places give a whole number."""
    x = F.bround(num(F.col(f"`{column}`")), places)
    return x.cast("long") if places == 0 else x


#: The order in which corrections are applied, whatever order they were chosen in.
ORDER = ("hidden_code", "sentinel_date", "empty_text", "spelling", "negative", "clip", "round")


def in_order(steps: Sequence[tuple[str, str, Column]]) -> list[tuple[str, str, Column]]:
    """(kind, column, expression) in the fixed order."""
    return sorted(steps, key=lambda s: (ORDER.index(s[0]), s[1]))


# ---- text ---------------------------------------------------------------------------------

#: Words that carry no meaning, fixed values.
STOP = ("ve", "veya", "ile", "bir", "bu", "şu", "için", "de", "da", "ki", "mi", "the", "of", "and", "to", "in", "is", "it", "for", "on")


def words(c: Column) -> Column:
    """Distinct words of two letters or more, Turkish lower case, without stop words, in order."""
    found = F.regexp_extract_all(turkish_lower(c), F.lit("([a-zçğıöşüâîû]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP]))


def free_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean_words, mean_length, free): free text has 3 words or 25 characters on average over its distinct values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    tt = df.select(F.explode(pairs).alias("p")).select("p.k", "p.v").where("v IS NOT NULL").distinct()
    n_words, size = F.avg(F.size(F.split(F.trim("v"), "\\s+"))), F.avg(F.length("v"))
    return tt.groupBy("k").agg(n_words.alias("mean_words"), size.alias("mean_length")).select(F.col("k").alias("column"), "mean_words", "mean_length", ((F.col("mean_words") >= 3) | (F.col("mean_length") >= 25)).alias("free"))


def word_table(train: DataFrame, column: str, target: str) -> DataFrame:
    """(word, n, bad, woe, z) of words in at least max(30, 0.5 %) of the train texts with a target."""
    rows = train.where(F.col(target).isNotNull() & F.col(column).isNotNull()).select(words(F.col(f"`{column}`")).alias("w"), (F.col(target) > 0).cast("int").alias("y"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).first()
    n, bad = totals.n, totals.b or 0
    least, rate = max(30, math.ceil(0.005 * n)), (bad / n if n else 0.0)
    tt = rows.select(F.explode("w").alias("word"), "y").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).where(F.col("n") >= least)
    good = n - bad
    woe = F.log((F.col("n") - F.col("bad") + 0.5) / (good + 0.5)) - F.log((F.col("bad") + 0.5) / (bad + 0.5))
    z = (F.col("bad") / F.col("n") - rate) / F.sqrt(F.lit(max(rate * (1 - rate), 1e-12)) / F.col("n"))
    return tt.select("word", "n", "bad", woe.alias("woe"), z.alias("z"))


def _fold_words(train: DataFrame, column: str, target: str, fold: Column, folds: int = 5) -> DataFrame:
    """(word, woe, __f): the word table without each fold's rows, and of all rows (-1), from one pass that counts words by fold.

    Rows without a fold count for all rows only.
    """
    rows = train.where(F.col(target).isNotNull() & F.col(column).isNotNull()).select(F.col(f"`{column}`").alias("t"), (F.col(target) > 0).cast("int").alias("y"), F.coalesce(fold, F.lit(-1)).cast("int").alias("f"))
    sums = {r.f: (r.n, r.b or 0) for r in rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("b")).collect()}
    found = rows.select(F.explode(words(F.col("t"))).alias("word"), "y", "f").groupBy("word")
    n, bad = ([F.count_if(F.col("f") == f) for f in range(-1, folds)], [F.coalesce(F.sum(F.when(F.col("f") == f, F.col("y"))), F.lit(0)) for f in range(-1, folds)])
    wide = found.agg(F.array(*n).alias("n"), F.array(*bad).alias("bad"))
    parts = []
    for f in range(-1, folds):
        used = [g for g in range(-1, folds) if f == -1 or g not in (-1, f)]
        own = lambda c, used=used: sum((F.col(c)[g + 1] for g in used), F.lit(0))
        total, events = (sum(sums.get(g, (0, 0))[i] for g in used) for i in (0, 1))
        woe = F.log((own("n") - own("bad") + 0.5) / (total - events + 0.5)) - F.log((own("bad") + 0.5) / (events + 0.5))
        parts.append(F.when(own("n") >= max(30, math.ceil(0.005 * total)), F.struct(woe.alias("woe"), F.lit(f).alias("__f"))))
    return wide.select("word", F.explode(F.array(*parts)).alias("x")).where("x IS NOT NULL").select("word", "x.woe", "x.__f")


def flag_words(table: DataFrame, top: int = 10) -> list[str]:
    return [r.word for r in table.where(F.abs("z") >= Z).orderBy(F.desc(F.abs("z")), "word").limit(top).collect()]


def text_features(df: DataFrame, column: str, flags: Sequence[str]) -> DataFrame:
    """Add K__KELIME (distinct words) and a 0/1 column for each flag word; null text has no words."""
    w = F.coalesce(words(F.col(f"`{column}`")), F.array().cast("array<string>"))
    return df.withColumns({f"{column}__KELIME": F.size(w), **{f"{column}__K_{x}": F.array_contains(w, x).cast("int") for x in flags}})


def text_score(df: DataFrame, train: Column, column: str, target: str, keys: Sequence[str]) -> DataFrame:
    """Add K__SKOR, the mean WoE of a text's known words; on train rows out of fold (5 folds by the row's key).

    A score depends on the text and on the fold left out alone, so exploded words meet the word
    tables and are averaged by these two; neither null nor repeated keys matter. Support bounds
    the broadcast: a fold's table has at most 200 times the mean distinct words of a text.
    """
    from tabloom.operators.features import fold_of

    fold = fold_of(keys)
    tables = materialise(_fold_words(df.where(train), column, target, fold), "words")
    text = F.col(f"`{column}`")
    rows = df.drop(f"{column}__SKOR").withColumns({"__f": F.when(train, F.coalesce(fold, F.lit(-1))).otherwise(-1).cast("int"), "__k": F.sha2(text.cast("string"), 256)})
    hits = rows.select("__k", "__f", F.explode(words(text)).alias("word")).join(F.broadcast(tables), ["word", "__f"])
    means = hits.groupBy("__k", "__f").agg(F.avg("woe").alias(f"{column}__SKOR"))
    return rows.join(means, ["__k", "__f"], "left").select(*[f"`{c}`" for c in df.columns if c != f"{column}__SKOR"], f"`{column}__SKOR`")


def topics(df: DataFrame, column: str, key: str, k: int = 8, vocabulary: int = 2_000, seed: int = 42) -> DataFrame:
    """(key, topic): the strongest of k topics by LDA on TF-IDF counts. The matrix factorisation of other tools has no counterpart here."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import IDF, CountVectorizer
    from pyspark.ml.functions import vector_to_array

    rows = df.select(key, F.coalesce(words(F.col(f"`{column}`")), F.array().cast("array<string>")).alias("w"))
    counted = CountVectorizer(inputCol="w", outputCol="c", vocabSize=vocabulary, minDF=2).fit(rows).transform(rows)
    weighted = IDF(inputCol="c", outputCol="features").fit(counted).transform(counted)
    mixed = LDA(k=k, maxIter=5, seed=seed).fit(weighted).transform(weighted)
    share = vector_to_array("topicDistribution")
    return mixed.select(key, (F.array_position(share, F.array_max(share)) - 1).cast("int").alias("topic"))
