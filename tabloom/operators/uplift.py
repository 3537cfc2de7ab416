"""What candidate features add to their sources, measured for all candidates together on train rows.

Information values come from one value table of all columns. Rank correlations are measured
for candidates that gain, from cells of equal (source, candidate) values. The linear gain
compares crossed logistic models: all candidates' Newton steps advance together, as one pass
over the rows sums every model's gradient and Hessian, so the number of passes is that of
Newton steps, whatever the number of candidates. What reaches the driver are a few numbers for each candidate and pass.

A finished measurement is kept under a signature of its inputs (``Measured``) and not repeated.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.exprs import div, finite, num
from tabloom.functions.joins import attach
from tabloom.operators import measures
from tabloom.operators.features import fold_of
from tabloom.sources.store import materialise, release

#: Limits, fixed values: bins of an information value, gains and rank correlation that count, rows that a linear gain needs, Newton steps, when they end.
BINS, IV_GAIN, SAME_ORDER, LINEAR_GAIN, LINEAR_ROWS, STEPS, ENOUGH = 10, 0.02, 0.95, 0.01, 50, 25, 1e-4
_ROWS = 2_048


def information_values(train: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(k, iv) of every column: up to ten values are bins of their own, else bins by deciles (a value on a cut lies below it); nulls are a bin."""
    values = materialise(_values(train, columns, target), "uplift-values")
    filled = values.where("v IS NOT NULL")
    deciles = measures.quantiles(filled.withColumn("n", F.col("bad") + F.col("good")), ["k"], "v", "n", [i / BINS for i in range(1, BINS)])
    cuts = deciles.select("k", F.array_distinct(F.array(*[f"q{i}" for i in range(BINS - 1)])).alias("cuts"))
    known = filled.groupBy("k").agg(F.count(F.lit(1)).alias("d")).join(cuts, "k")
    own = F.col("v").cast("string")
    b = F.when(F.col("v").isNull(), "-").when(F.col("d") <= BINS, own).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("v"))).cast("string"))
    bins = values.join(F.broadcast(known), "k").groupBy("k", b.alias("b")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return measures.uplift_iv(bins, ["k"]).select("k", "iv")


def _values(train: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    y = F.col(f"`{target}`")
    cells = F.array(*[F.struct(F.lit(c).alias("k"), finite(num(F.col(f"`{c}`"))).alias("v")) for c in columns])
    rows = train.where(y.isNotNull()).select(F.explode(cells).alias("c"), (y > 0).alias("y"))
    return rows.groupBy("c.k", "c.v").agg(F.count_if("y").alias("bad"), F.count_if(~F.col("y")).alias("good"))


def rank_relations(train: DataFrame, pairs: Sequence[tuple[str, str]], target: str) -> DataFrame:
    """(column, source, rho): absolute correlation of ranks over rows where both are filled; each column is ranked over all its filled rows."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    values = _values(train, columns, target).where("v IS NOT NULL").withColumn("n", F.col("bad") + F.col("good"))
    ranks = materialise(measures.value_ranks(values, ["k"], "v", "n").select(F.struct("k", "v").alias("at"), "rank", "n"), "ranks")
    total = ranks.agg(F.sum("n")).first()[0] or 0
    x = lambda c: finite(num(F.col(f"`{c}`")))
    cell = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("source"), x(c).alias("x"), x(s).alias("z")) for c, s in pairs])
    cells = train.where(F.col(f"`{target}`").isNotNull()).select(F.explode(cell).alias("c")).select("c.*").where("x IS NOT NULL AND z IS NOT NULL")
    cells = cells.groupBy("column", "source", "x", "z").agg(F.count(F.lit(1)).cast("double").alias("w"))
    for side, name, rank in (("x", "column", "rx"), ("z", "source", "rz")):
        cells = attach(cells.withColumn("at", F.struct(F.col(name).alias("k"), F.col(side).alias("v"))), ranks.withColumnRenamed("rank", rank), "at", "n", total).drop("at")
    w, a, b = F.sum("w"), F.col("rx"), F.col("rz")
    s = lambda e: F.sum(F.col("w") * e)
    rho = div(s(a * b) - s(a) * s(b) / w, F.sqrt((s(a * a) - s(a) * s(a) / w) * (s(b * b) - s(b) * s(b) / w)))
    return cells.groupBy("column", "source").agg(F.when(w > 2, F.abs(rho)).alias("rho"))


def _sums(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], models: int, width: int) -> np.ndarray:
    """work gives (models, width) for some rows, as a matrix of columns; the sum of all, in one pass."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, width))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                total += work(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.slice(at, _ROWS).columns]))
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))], ["i", "s"])

    got = rows.mapInArrow(part, "i int, s array<double>").groupBy("i").agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)]).collect()
    out = np.zeros((models, width))
    for r in got:
        out[r.i] = r[1:]
    return out


class _Pairs:
    """The standard form of every (source, candidate) pair in a matrix whose last two columns are target and half."""

    def __init__(self, source: list[int], candidate: list[int]) -> None:
        self.source, self.candidate = source, candidate

    def filled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, c = x[:, self.source], x[:, self.candidate]
        m = ~(np.isnan(s) | np.isnan(c))
        return np.where(m, s, 0.0), np.where(m, c, 0.0), m

    def moments(self, x: np.ndarray) -> np.ndarray:
        """By pair: n, sums of both, rows with the event."""
        s, c, m = self.filled(x)
        return np.stack([m.sum(0), s.sum(0), c.sum(0), (m * x[:, [-2]]).sum(0)], 1).astype(np.float64)

    def spread(self, x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """By pair: sums of squares around the means; for either half, rows, events, and the source's distance times the event."""
        s, c, m = self.filled(x)
        s, c = np.where(m, s - mean[:, 0], 0.0), np.where(m, c - mean[:, 1], 0.0)
        out = [(s * s).sum(0), (c * c).sum(0)]
        for half in (0, 1):
            own = m * (x[:, [-1]] == half)
            out += [own.sum(0), (own * x[:, [-2]]).sum(0), (own * s).sum(0), (own * s * x[:, [-2]]).sum(0)]
        return np.stack(out, 1).astype(np.float64)

    def standard(self, x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, c, m = self.filled(x)
        return np.where(m, (s - mean[:, 0]) / std[:, 0], 0.0), np.where(m, (c - mean[:, 1]) / std[:, 1], 0.0), m

    def step(self, x: np.ndarray, mean: np.ndarray, std: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By pair, for the models learnt on half 0 and on half 1: gradient (3) and Hessian (6 of 9)."""
        s, c, m = self.standard(x, mean, std)
        out = []
        for half in (0, 1):
            own = m & (x[:, [-1]] == half)
            p = 1 / (1 + np.exp(-np.clip(b[:, half, 0] + b[:, half, 1] * s + b[:, half, 2] * c, -30, 30)))
            e, w = np.where(own, x[:, [-2]] - p, 0.0), np.where(own, p * (1 - p), 0.0)
            out += [e.sum(0), (e * s).sum(0), (e * c).sum(0), w.sum(0), (w * s).sum(0), (w * c).sum(0), (w * s * s).sum(0), (w * s * c).sum(0), (w * c * c).sum(0)]
        return np.stack(out, 1)


def linear_gains(train: DataFrame, pairs: Sequence[tuple[str, str]], target: str, keys: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """(candidate, source) -> AUC of a logistic on both less that on the source alone, or than a half, both crossed over two halves by the rows' keys.

    Gains below two standard errors are 0. None where it can't be measured: under 50 rows with both, a
    column or a half of one value, no finite fit. At most 25 steps and three passes more.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    place = {c: i for i, c in enumerate(columns)}
    at = _Pairs([place[s] for _, s in pairs], [place[c] for c, _ in pairs])
    y = F.col(f"`{target}`")
    rows = train.where(y.isNotNull()).select(*[finite(num(F.col(f"`{c}`"))).alias(f"x{i}") for i, c in enumerate(columns)], (y > 0).cast("double").alias("y"), fold_of(keys, 2).cast("double").alias("h"))
    rows = materialise(rows, "uplift")
    v = len(pairs)
    first = _sums(rows, at.moments, v, 4)
    n, events = first[:, 0], first[:, 3]
    with np.errstate(all="ignore"):
        mean = np.nan_to_num(first[:, 1:3] / n[:, None])
        second = _sums(rows, lambda x: at.spread(x, mean), v, 10)
        std = np.sqrt(np.nan_to_num(second[:, :2] / n[:, None]))
    flat = (std <= 1e-12 * np.maximum(np.abs(mean), 1e-300)).any(1)
    std[std == 0] = 1.0
    halves = second[:, 2:].reshape(v, 2, 4)  # rows, events, sum of the source's distances, and of those with the event
    one_class = ((halves[:, :, 1] == 0) | (halves[:, :, 1] == halves[:, :, 0])).any(1)
    fit = (n >= LINEAR_ROWS) & ~flat & ~one_class
    b = np.zeros((v, 2, 3))
    with np.errstate(all="ignore"):
        rate = np.clip(np.nan_to_num(halves[:, :, 1] / halves[:, :, 0]), 1e-9, 1 - 1e-9)
    b[:, :, 0] = np.log(rate / (1 - rate))
    open_ = np.repeat(fit[:, None], 2, 1)
    for _ in range(STEPS):
        if not open_.any():
            break
        now = b.copy()
        got = _sums(rows, lambda x: at.step(x, mean, std, now), v, 18).reshape(v, 2, 9)  # noqa: B023  used before the next round
        for i, half in zip(*np.nonzero(open_), strict=True):
            g = got[i, half]
            hessian = np.array([[g[3], g[4], g[5]], [g[4], g[6], g[7]], [g[5], g[7], g[8]]]) + 1e-8 * np.eye(3)
            try:
                step = np.linalg.solve(hessian, g[:3])
            except np.linalg.LinAlgError:
                step = np.full(3, np.nan)
            b[i, half] += step
            if not np.isfinite(b[i, half]).all():
                fit[i] = False
                open_[i] = False
            elif np.abs(step).max() < ENOUGH:
                open_[i, half] = False
    # on the source alone, a fit's slope has the sign of the source's covariance with the target, so its scores order rows as the source or against it
    slope = np.sign(halves[:, :, 3] - halves[:, :, 2] * halves[:, :, 1] / np.maximum(halves[:, :, 0], 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.slice(start, _ROWS).columns])
                s, c, m = at.standard(x, mean, std)
                half = x[:, -1].astype(int)
                for i in np.flatnonzero(fit):
                    own = np.flatnonzero(m[:, i])
                    if not len(own):
                        continue
                    other = 1 - half[own]  # rows are scored by the model of the other half
                    both = b[i, other, 0] + b[i, other, 1] * s[own, i] + b[i, other, 2] * c[own, i]
                    for model, score in ((0, slope[i, other] * s[own, i]), (1, both)):
                        columns = [pa.array(np.full(len(own), i, np.int32)), pa.array(half[own].astype(np.int32)), pa.array(np.full(len(own), model, np.int32)), pa.array(score), pa.array(x[own, -2])]
                        yield pa.RecordBatch.from_arrays(columns, ["i", "half", "model", "score", "y"])

    counts = measures.class_counts(rows.mapInArrow(scored, "i int, half int, model int, score double, y double"), ["i", "half", "model"], "score", "y")
    auc: dict[tuple[int, int], list[float]] = {}
    for r in measures.separation(counts, ["i", "half", "model"], "score", "bad", "good").collect():
        if r.auc is not None:
            auc.setdefault((r.i, r.model), []).append(r.auc)
    out: dict[tuple[str, str], float | None] = {}
    for i, pair in enumerate(pairs):
        one, two = auc.get((i, 0), []), auc.get((i, 1), [])
        if not fit[i] or len(one) < 2 or len(two) < 2:
            out[pair] = None
            continue
        gain = sum(two) / 2 - max(sum(one) / 2, 0.5)
        error = np.sqrt((n[i] + 1) / (12 * events[i] * (n[i] - events[i])))
        out[pair] = 0.0 if 0 < gain < 2 * error else float(gain)
    release(rows)
    return out


class Measured:
    """Results by the signature of what they were measured on: a dictionary of the session, or one that was read from a file."""

    def __init__(self, known: dict[str, dict] | None = None) -> None:
        self.known = known if known is not None else {}

    @staticmethod
    def signature(train: DataFrame, column: str, sources: Sequence[str], target: str, keys: Sequence[str], linear: bool) -> str:
        """Of the plan, not of the data: the same expressions over the same files."""
        plan = train.select(*[f"`{c}`" for c in dict.fromkeys([column, *sources, target, *keys])])
        mark = [plan._jdf.queryExecution().analyzed().canonicalized().hashCode(), column, list(sources), target, list(keys), linear]
        return hashlib.md5(json.dumps(mark).encode()).hexdigest()


def measure(train: DataFrame, candidates: dict[str, Sequence[str]], target: str, keys: Sequence[str], linear: Sequence[str] = (), measured: Measured | None = None) -> DataFrame:
    """(column, sources, iv, source_iv, gain, rho, linear_gain, worth) of each candidate, a column of train, with the columns it was made from.

    gain: the candidate's IV less the best of its sources' (its own where it has none). rho: the
    highest absolute rank correlation with a source, for candidates that gain IV_GAIN. linear_gain: for
    the candidates named in ``linear``, with their first source. worth: a gain of IV_GAIN in another
    order than the source's, or a linear gain of LINEAR_GAIN. Rows without a target take no
    part; a column that is a source of several candidates is measured once.
    """
    memo = measured or Measured()
    mark = {c: memo.signature(train, c, s, target, keys, c in linear) for c, s in candidates.items()}
    todo = {c: s for c, s in candidates.items() if mark[c] not in memo.known}
    if todo:
        columns = list(dict.fromkeys([*todo, *[s for sources in todo.values() for s in sources]]))
        iv = {r.k: r.iv for r in information_values(train, columns, target).collect()}
        best = {c: max((iv[s] for s in sources if iv.get(s) is not None), default=None) for c, sources in todo.items()}
        gain = {c: None if iv.get(c) is None else iv[c] - (best[c] or 0.0) for c in todo}
        near = [(c, s) for c, sources in todo.items() if (gain[c] or 0.0) >= IV_GAIN for s in sources]
        rho: dict[str, float] = {}
        for r in rank_relations(train, near, target).collect() if near else []:
            if r.rho is not None:
                rho[r.column] = max(rho.get(r.column, 0.0), r.rho)
        fits = [(c, s[0]) for c, s in todo.items() if c in linear and s]
        lines = linear_gains(train, fits, target, keys) if fits else {}
        for c, sources in todo.items():
            line = lines.get((c, sources[0])) if sources else None
            worth = (line or 0.0) >= LINEAR_GAIN or ((gain[c] or 0.0) >= IV_GAIN and rho.get(c, 0.0) < SAME_ORDER)
            memo.known[mark[c]] = {"column": c, "sources": list(sources), "iv": iv.get(c), "source_iv": best[c], "gain": gain[c], "rho": rho.get(c), "linear_gain": line, "worth": worth}
    schema = "column string, sources array<string>, iv double, source_iv double, gain double, rho double, linear_gain double, worth boolean"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return train.sparkSession.createDataFrame([tuple(memo.known[mark[c]][n] for n in names) for c in candidates], schema)
