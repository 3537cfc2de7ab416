"""Feature selection, model comparison and the validation gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.exprs import below, num
from tabloom.operators import gram, measures
from tabloom.sources.store import materialise, release


def leaks(train: DataFrame, columns: Sequence[str], target: str, most: float = 0.95) -> DataFrame:
    """(column, r): columns whose absolute correlation with the target is above ``most``, all in one aggregation."""
    row = train.agg(*[F.corr(num(F.col(f"`{c}`")), F.col(target).cast("double")).alias(f"r{i}") for i, c in enumerate(columns)]).first()
    return train.sparkSession.createDataFrame([(c, row[f"r{i}"]) for i, c in enumerate(columns) if row[f"r{i}"] is not None and abs(row[f"r{i}"]) > most], "column string, r double")


def correlations(train: DataFrame, columns: Sequence[str], least: float = 0.0) -> dict[tuple[str, str], float]:
    """Pairwise correlations of at least ``least`` over rows where both are filled; one pass for all pairs (``gram``)."""
    return {(r.a, r.b): r.r for r in gram.correlations(train, columns, least).collect()}


def prune_correlated(r: dict[tuple[str, str], float], priority: dict[str, float], most: float = 0.95) -> dict[str, str]:
    """dropped -> the column it gave way to: the strongest surviving pair first, the one of lower priority goes (ties: the later name)."""
    alive = {c for p in r for c in p}
    gone: dict[str, str] = {}
    for (a, b), _ in sorted(r.items(), key=lambda x: (-abs(x[1]), x[0])):
        if abs(r[a, b]) > most and a in alive and b in alive:
            loser, keeper = (a, b) if (priority.get(a, 0), [-ord(x) for x in a]) < (priority.get(b, 0), [-ord(x) for x in b]) else (b, a)
            alive.discard(loser)
            gone[loser] = keeper
    return gone


def quasi_constant(train: DataFrame, columns: Sequence[str], most: float = 0.99) -> DataFrame:
    """(column, share): columns whose most frequent value (null included) has more than ``most`` of the rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    tt = train.select(F.explode(cells).alias("p")).groupBy("p.k", "p.v").agg(F.count(F.lit(1)).alias("n"))
    return tt.groupBy("k").agg((F.max("n") / F.sum("n")).alias("share")).where(F.col("share") > most).withColumnRenamed("k", "column")


def mutual_information(train: DataFrame, column: str, target: str, cuts: Sequence[float]) -> DataFrame:
    """One row: mutual information (nats) of a binned column and the target, from contingency counts. Binned instead of nearest neighbours."""
    cells = train.where(F.col(target).isNotNull()).groupBy(F.coalesce(below(cuts, num(F.col(f"`{column}`")), False), F.lit(-1)).alias("b"), (F.col(target) > 0).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    both = cells.join(cells.groupBy("b").agg(F.sum("n").alias("nb")), "b").join(cells.groupBy("y").agg(F.sum("n").alias("ny")), "y")
    total = cells.agg(F.sum("n")).first()[0] or 1.0
    return both.agg(F.lit(column).alias("column"), F.sum(F.col("n") / total * F.log(F.col("n") * total / (F.col("nb") * F.col("ny")))).alias("mi"))


def _assembled(df: DataFrame, columns: Sequence[str], target: str, fill: dict[str, float]) -> DataFrame:
    """features: nulls filled with train medians, and an indicator beside each column, since trees here take no nulls."""
    from pyspark.ml.feature import VectorAssembler

    x = {c: num(F.col(f"`{c}`")) for c in columns}
    made = df.where(F.col(target).isNotNull()).select("*", F.col(target).cast("double").alias("__y"), *[F.coalesce(x[c], F.lit(float(fill.get(c, 0.0)))).alias(f"__x{i}") for i, c in enumerate(columns)], *[x[c].isNull().cast("double").alias(f"__m{i}") for i, c in enumerate(columns)])
    return VectorAssembler(inputCols=[f"__{k}{i}" for k in "xm" for i in range(len(columns))], outputCol="__features").transform(made)


def medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    from tabloom.operators.features import learn_grid

    return {c: q[0] for c, q in learn_grid(train, columns, (0.5,)).items() if q[0] is not None}


#: Trees tell at most so many values of a column apart (what MLlib's do), and models are fitted from cells if there are at most so many.
BINS, CELLS = 32, 200_000
#: Fits that run at a time.
FITS = 10


def learn_cuts(train: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Cuts between values for columns of up to 32 values, else exact 32-quantiles of the train rows."""
    from tabloom.operators.profile import value_table

    table = materialise(value_table(train.select(*[num(F.col(f"`{c}`")).alias(c) for c in columns]), columns, False), "model-values")
    short = table.groupBy("k").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= BINS).select("k")
    cuts = {r.k: sorted(r.v)[:-1] for r in table.join(F.broadcast(short), "k").groupBy("k").agg(F.collect_list("v").alias("v")).collect()}
    long = table.join(F.broadcast(short), "k", "left_anti")
    for r in measures.quantiles(long, ["k"], "v", "n", [i / BINS for i in range(1, BINS)]).collect():
        cuts[r.k] = sorted({r[f"q{i}"] for i in range(BINS - 1)})
    release(table)
    return cuts


def model_cells(df: DataFrame, columns: Sequence[str], target: str, cuts: dict[str, list[float]], fill: dict[str, float]) -> DataFrame:
    """(x0, m0, x1, m1, ..., bad, n): rows of equal bins, null indicators and class are one row of weight n. Rows that a tree can't tell apart aren't kept apart."""
    made = []
    for i, c in enumerate(columns):
        x = num(F.col(f"`{c}`"))
        made += [below(cuts.get(c, []), F.coalesce(x, F.lit(float(fill.get(c, 0.0)))), False).cast("double").alias(f"x{i}"), x.isNull().cast("double").alias(f"m{i}")]
    rows = df.where(F.col(target).isNotNull()).select(*made, (F.col(target) > 0).cast("double").alias("bad"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _drawn(cells: DataFrame, kind: str, seed: int, number: int, rate: float) -> DataFrame:
    """The cells with a weight w: how often their n rows come when each is drawn on its own, kept at a rate (binomial) or as often as a bootstrap takes it (poisson).

    Draws depend on the cell, the seed and the number of the draw, not on partitions.
    """
    @F.pandas_udf("double")
    def draw(key: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for k, size in zip(key.to_numpy(), n.to_numpy(), strict=True):
            rng = np.random.default_rng(int(k) & (2**63 - 1))
            out.append(float(rng.binomial(size, rate) if kind == "binomial" else rng.poisson(size * rate)))
        return pd.Series(out)

    names = [c for c in cells.columns if c[0] in "xm" or c == "bad"]
    return cells.withColumn("w", draw(F.xxhash64(F.lit(seed), F.lit(number), *names), F.col("n"))).where("w > 0")


def _vectors(df: DataFrame, k: int) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[f"{a}{i}" for a in "xm" for i in range(k)], outputCol="features").transform(df)


def _side_by_side(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """Fits in threads, as MLlib's own validators run theirs: each is a few short jobs."""
    with ThreadPool(min(FITS, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


def importance(train: DataFrame, columns: Sequence[str], target: str, trees: int = 150, depth: int = 8, seed: int = 42) -> dict[str, float]:
    """Impurity importance of a random forest, a column and its null indicator together.

    Where rows make at most ``CELLS`` cells, each tree is learnt from cells weighted by its own bootstrap of
    the rows: Poisson counts of rows of a cell add up to one Poisson number. Else MLlib's forest reads the rows.
    """
    from pyspark.ml.classification import RandomForestClassifier

    columns, fill = list(columns), medians(train, columns)
    cells = materialise(model_cells(train, columns, target, learn_cuts(train, columns), fill), "cells")
    if cells.count() > CELLS:
        model = RandomForestClassifier(featuresCol="__features", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(train, columns, target, fill))
        v = model.featureImportances.toArray()
        return {c: float(v[i] + v[len(columns) + i]) for i, c in enumerate(columns)}

    few = materialise(cells.coalesce(2), "few-cells")

    def one(tree: int) -> np.ndarray:
        rows = _vectors(_drawn(few, "poisson", seed, tree, 1.0), len(columns))
        forest = RandomForestClassifier(labelCol="bad", weightCol="w", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt" if trees > 1 else "all", maxDepth=depth, seed=seed + tree)
        return forest.fit(rows).featureImportances.toArray()

    v = np.sum(_side_by_side(train.sparkSession, one, range(trees)), axis=0)
    v = v / (v.sum() or 1.0)
    return {c: float(v[i] + v[len(columns) + i]) for i, c in enumerate(columns)}


def unimportant(values: dict[str, float], share: float = 0.0005) -> list[str]:
    total = sum(values.values())
    return sorted(c for c, v in values.items() if v < share * total)


def select(train: DataFrame, columns: Sequence[str], target: str, priority: dict[str, float]) -> DataFrame:
    """(column, kept, reason): leakage, quasi-constant and correlation filters, in that order."""
    reason: dict[str, str] = {r["column"]: f"leak r={r['r']:.4f}" for r in leaks(train, columns, target).collect()}
    rest = [c for c in columns if c not in reason]
    reason |= {r["column"]: "quasi constant" for r in quasi_constant(train, rest).collect()} if rest else {}
    rest = [c for c in rest if c not in reason]
    reason |= {c: f"correlates with {k}" for c, k in prune_correlated(correlations(train, rest, 0.95), priority).items()}
    return train.sparkSession.createDataFrame([(c, c not in reason, reason.get(c)) for c in columns], "column string, kept boolean, reason string")


def _boosted(train: DataFrame, test: DataFrame, k: int, seed: int, iterations: int, depth: int = 4, rate: float = 0.8, step: float = 0.1) -> float | None:
    """AUC on test cells of gradient boosting on train cells: logistic loss, classes -1 and 1, every tree on its own draw of 80 % of the rows, as MLlib boosts."""
    from pyspark.ml.regression import DecisionTreeRegressor

    sides = _vectors(train.withColumn("tr", F.lit(True)).unionByName(test.withColumn("tr", F.lit(False))), k)
    now = sides.withColumn("f", F.lit(0.0))
    y = 2 * F.col("bad") - 1
    for i in range(iterations):
        label = y if i == 0 else 4 * y / (1 + F.exp(2 * y * F.col("f")))
        rows = _drawn(now.where("tr").withColumn("label", label), "binomial", seed, i, rate)
        tree = DecisionTreeRegressor(weightCol="w", maxDepth=depth, seed=seed).fit(rows)
        made = tree.transform(now).withColumn("f", F.col("f") + F.lit(1.0 if i == 0 else step) * F.col("prediction")).drop("prediction")
        now = materialise(made, "boosted") if i % 5 == 4 else made
    scores = now.where("NOT tr").groupBy("f").agg(F.sum(F.when(F.col("bad") > 0, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad") > 0, 0).otherwise(F.col("n"))).alias("good"))
    return measures.separation(scores, [], "f", "bad", "good").first().auc


def compare(train: DataFrame, test: DataFrame, base: Sequence[str], more: Sequence[str], target: str, seeds: Sequence[int] = (1, 2, 3, 4, 5), iterations: int = 20) -> DataFrame:
    """(seed, auc_base, auc_more, delta) of boosted trees on either column set.

    Where rows make at most ``CELLS`` cells, trees are learnt from cells, each weighted by a draw of its rows
    (kept rows of a cell are a binomial number), and the AUC is exact. Else MLlib's boosted trees read the rows.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    sets = (list(base), list(dict.fromkeys([*base, *more])))
    fill, cuts = medians(train, sets[1]), learn_cuts(train, sets[1])
    cells = [tuple(materialise(model_cells(df, columns, target, cuts, fill), "cells") for df in (train, test)) for columns in sets]

    def one(what: tuple[int, int]) -> float | None:
        seed, at = what
        columns = sets[at]
        if max(c.count() for c in cells[at]) <= CELLS:
            return _boosted(*few[at], len(columns), seed, iterations)
        model = GBTClassifier(featuresCol="__features", labelCol="__y", maxIter=iterations, maxDepth=4, subsamplingRate=0.8, seed=seed).fit(_assembled(train, columns, target, fill))
        return float(BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="__y").evaluate(model.transform(_assembled(test, columns, target, fill))))

    few = [tuple(materialise(c.coalesce(1 if c.count() <= CELLS else 64), "few-cells") for c in pair) for pair in cells]
    auc = _side_by_side(train.sparkSession, one, [(seed, at) for seed in seeds for at in (0, 1)])
    rows = [(seed, a, b, None if a is None or b is None else b - a) for seed, a, b in zip(seeds, auc[::2], auc[1::2], strict=True)]
    return train.sparkSession.createDataFrame(rows, "seed int, auc_base double, auc_more double, delta double")


def interval(deltas: Sequence[float]) -> tuple[float, float, float]:
    """Mean and 95 % interval of the differences (normal approximation)."""
    n = len(deltas)
    mean = sum(deltas) / n
    spread = (sum((d - mean) ** 2 for d in deltas) / (n - 1)) ** 0.5 if n > 1 else 0.0
    return mean, mean - 1.96 * spread / n**0.5, mean + 1.96 * spread / n**0.5


def score_metrics(df: DataFrame, score: str, target: str, group: Sequence[str] = ()) -> DataFrame:
    """auc, gini, ks and class sizes of a score, by group; NaN scores and null targets are left out."""
    rows = df.withColumn("__s", num(F.col(score)))
    return measures.separation(measures.class_counts(rows, list(group), "__s", target), list(group), "__s", "bad", "good")


def score_psi(dev: DataFrame, other: DataFrame, score: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """One row: psi of a score by development deciles, bins closed on the left; null with fewer than three inner cuts."""
    from tabloom.operators.features import learn_grid

    grid = learn_grid(dev, [score], [i / bins for i in range(1, bins)]).get(score, [])
    cuts = sorted(set(grid))
    if len(cuts) < 3:
        return dev.sparkSession.createDataFrame([(None,)], "psi double")
    place = below(cuts, num(F.col(score)), True).alias("b")
    both = dev.select(place, F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(other.select(place, F.lit(0), F.lit(1))).where("b IS NOT NULL")
    counts = both.groupBy("b").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    every = dev.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("b"))
    return measures.shares_psi(F.broadcast(every).join(counts, "b", "left").fillna(0, ["e", "a"]), [], "e", "a", floor)


#: Criteria of the gate, fixed values: (measure, pass, conditional, whether more is better).
GATE = (("gini_test", 0.40, 0.30, True), ("ks_test", 0.30, 0.20, True), ("gini_drop", 0.10, 0.15, False), ("psi", 0.10, 0.25, False), ("gini_oot", 0.35, 0.25, True), ("ks_oot", 0.25, 0.15, True))


def gate(values: dict[str, float | None]) -> tuple[str, list[tuple[str, str]]]:
    """The verdict (gecti, kosullu, kaldi) and one for each criterion; what can't be computed is neither passed nor failed."""
    out = []
    for name, good, fair, more in GATE:
        v = values.get(name)
        better = (lambda a, b: a >= b) if more else (lambda a, b: a <= b)
        out.append((name, "hesaplanamadi" if v is None else "gecti" if better(v, good) else "kosullu" if better(v, fair) else "kaldi"))
    marks = {m for _, m in out}
    return ("kaldi" if "kaldi" in marks else "kosullu" if "kosullu" in marks or "hesaplanamadi" in marks else "gecti"), out


def best_model(train: DataFrame, columns: Sequence[str], target: str, folds: int = 3, seed: int = 42):
    """The best of logistic regression, forest and boosted trees by cross-validated AUC: (name, auc) pairs, best first."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    ready = _assembled(train, columns, target, medians(train, columns)).cache()
    kinds = {"lojistik": LogisticRegression, "orman": RandomForestClassifier, "gbt": GBTClassifier}
    found = []
    for name, kind in kinds.items():
        model = kind(featuresCol="__features", labelCol="__y", **({} if name == "lojistik" else {"seed": seed, "maxDepth": 4}))
        cv = CrossValidator(estimator=Pipeline(stages=[model]), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="__y"), numFolds=folds, seed=seed)
        found.append((name, cv.fit(ready).avgMetrics[0]))
    ready.unpersist()
    return sorted(found, key=lambda x: -x[1])
