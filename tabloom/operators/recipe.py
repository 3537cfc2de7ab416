"""Recipes: the steps from a base table to a modelling table, with what they learnt, as versioned data.

``fit`` learns each step on the table that the steps before it give, and applies it; ``rebuild``
applies the stored steps to a base again. Both go through the same expressions, so a table
rebuilt from its base is the table that was fitted, bit for bit, and train rows get
out-of-fold encodings on a replay, too. Steps are data, never code to be executed: they are
compiled to Columns anew, and whatever doesn't fit (a missing column, another type, a value that a
conversion would lose) stops the build.

Learnt numbers are JSON beside the step; learnt tables (categories by fold, ranges of strata) are
Parquet, however large, and are joined without gathering a hot key. A version is written once
and never changed; one writer a name at a time, a second one fails on the path.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import language
from tabloom.functions.exprs import num
from tabloom.functions.joins import attach
from tabloom.operators import binning, columns, convert, features, measures, split, variables
from tabloom.operators.columns import Roles
from tabloom.sources import store


class RecipeError(ValueError):
    """A step doesn't fit the table that it meets."""


@dataclass(frozen=True)
class Step:
    """One step: params are the user's, learnt and table come from ``fit``; needs are the columns it reads, with their types."""

    kind: str
    params: dict
    stage: str = "01"
    needs: dict[str, str] = field(default_factory=dict)
    learnt: dict = field(default_factory=dict)
    table: DataFrame | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Recipe:
    """Steps in order, and the columns of the base that they were learnt on."""

    base: dict[str, str]
    steps: tuple[Step, ...]
    roles: Roles = Roles()

    def until(self, stage: str | None) -> Recipe:
        """The recipe up to the end of a stage."""
        if stage is None:
            return self
        last = [i for i, s in enumerate(self.steps) if s.stage == stage]
        if not last:
            raise RecipeError(f"no stage {stage}")
        return replace(self, steps=self.steps[: last[-1] + 1])


@dataclass(frozen=True)
class Kind:
    """How a kind of step learns (JSON values, a table or none), applies, and which columns it reads and makes."""

    apply: Callable[[DataFrame, Step, Roles], DataFrame]
    reads: Callable[[dict], Sequence[str]]
    makes: Callable[[dict], Sequence[str]] = lambda p: ()
    learn: Callable[[DataFrame, dict], tuple[dict, DataFrame | None]] = lambda df, p: ({}, None)


def _train(df: DataFrame) -> Column:
    """Rows to learn from; without a split nothing may be learnt."""
    if split.SPLIT not in df.columns:
        raise RecipeError("a step that learns needs a split before it")
    return F.col(split.SPLIT) == split.TRAIN


def _learn_convert(df: DataFrame, p: dict) -> tuple[dict, None]:
    convert.apply(df, list(p["changes"].items()))
    return {"whole": convert.whole_floats(df, list(p["changes"]))}, None


def _convert(df: DataFrame, s: Step, roles: Roles) -> DataFrame:
    out = {}
    for name, code in s.params["changes"].items():
        c, kind, whole = F.col(f"`{name}`"), df.schema[name].dataType, s.learnt["whole"].get(name, False)
        text, made = convert.rendered(c, kind, whole), convert.convert(c, code, kind, whole)
        lost = F.raise_error(F.concat(F.lit(f"{code} can't convert a value of {name}: "), text))
        out[name] = F.when(text.isNull() | (text == "") | made.isNotNull(), made).otherwise(lost)
    return df.withColumns(out)


def _quantiles(df: DataFrame, names: Sequence[str], at: Sequence[float]) -> dict[str, list[float]]:
    """Exact train quantiles by column; a column without filled train rows has none."""
    found = features.learn_grid(df.where(_train(df)), list(names), at) if names else {}
    return {c: [float(x) for x in q] for c, q in found.items() if q[0] is not None}


def _learn_fill(df: DataFrame, p: dict) -> tuple[dict, None]:
    return {"medians": {c: q[0] for c, q in _quantiles(df, p["columns"], (0.5,)).items()}}, None


def _learn_clip(df: DataFrame, p: dict) -> tuple[dict, None]:
    return {"bounds": _quantiles(df, p["columns"], (p.get("low", 0.0), p.get("high", 0.99)))}, None


def _clip(df: DataFrame, s: Step, roles: Roles) -> DataFrame:
    x = {c: num(F.col(f"`{c}`")) for c in s.learnt["bounds"]}
    return df.withColumns({c: F.when(x[c].isNotNull(), F.least(F.greatest(x[c], F.lit(low)), F.lit(high))) for c, (low, high) in s.learnt["bounds"].items()})


def _learn_deciles(df: DataFrame, p: dict) -> tuple[dict, None]:
    _train(df)
    return {"cuts": features.decile_cuts(df.where(_train(df)), list(p["columns"]))}, None


def _deciles(df: DataFrame, s: Step, roles: Roles) -> DataFrame:
    return df.withColumns({k: v for c in s.params["columns"] for k, v in features.decile(c, s.learnt["cuts"].get(c, [])).items()})


def _learn_bins(df: DataFrame, p: dict) -> tuple[dict, None]:
    cells = F.array(*[F.struct(F.lit(c).alias("k"), num(F.col(f"`{c}`")).alias("v")) for c in p["columns"]])
    values = df.where(_train(df)).select(F.explode(cells).alias("c")).select("c.k", "c.v").where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    run = store.materialise(measures.cumulate(values, ["k"], "v", ["n"]).withColumn("upto", F.col("n_before") + F.col("n")), "bins")
    cuts = variables.equal_cuts(run, int(p.get("bins", 10)))
    store.release(run)
    return {"cuts": {c: [float(x) for x in cuts.get(c, [])] for c in p["columns"]}}, None


def _bins(df: DataFrame, s: Step, roles: Roles) -> DataFrame:
    return df.withColumns({f"{c}_ARALIK": binning.apply_cuts(c, cuts) for c, cuts in s.learnt["cuts"].items()})


def _learn_encode(df: DataFrame, p: dict) -> tuple[dict, DataFrame]:
    return {}, features.category_counts(df, _train(df), p["column"], p.get("target"), p["keys"])


def _encode_kinds(p: dict) -> list[str]:
    kinds = list(p.get("kinds", ("woe", "te", "frk")))
    return kinds if p.get("target") else [k for k in kinds if k == "frk"]


def _encode(df: DataFrame, s: Step, roles: Roles) -> DataFrame:
    p = s.params
    return features.encode(df, _train(df), p["column"], p.get("target"), p["keys"], _encode_kinds(p), float(p.get("weight", 20.0)), s.table)


def _ratios(p: dict) -> list[tuple[str, float]]:
    return [(name, float(r)) for name, r in p.get("ratios", {split.TEST: 0.2, split.VAL: 0.2}).items()]


def _ids(df: DataFrame, p: dict) -> DataFrame:
    """One row an id: its stratum values (the largest) and its rows."""
    ident = F.col(f"`{p['ident']}`")
    return df.where(ident.isNotNull()).groupBy(ident.alias("__id")).agg(*[F.max(f"`{s}`").alias(f"__s{i}") for i, s in enumerate(p.get("strata", []))], F.count(F.lit(1)).alias("__rows"))


def _learn_split(df: DataFrame, p: dict) -> tuple[dict, DataFrame | None]:
    match p["method"]:
        case "periods":
            return {"plan": split.learn_periods(df, p["period"], p["test"], int(p.get("gap", 0)), float(p.get("val", 0.2)))}, None
        case "ids":
            ids = _ids(df, p)
            return {}, split.learn_ranges(ids, ["__id"], [c for c in ids.columns if c.startswith("__s")], _ratios(p), int(p.get("seed", 42)))
        case "rows":
            return {}, split.learn_ranges(df, p["keys"], p.get("strata", []), _ratios(p), int(p.get("seed", 42)))
    raise RecipeError(f"no way to split by {p['method']}")


def _split(df: DataFrame, s: Step, roles: Roles) -> DataFrame:
    p, seed = s.params, int(s.params.get("seed", 42))
    if p["method"] == "periods":
        return split.by_period(df, p["period"], s.learnt["plan"])
    if p["method"] == "rows":
        return split.by_ranges(df, p["keys"], p.get("strata", []), s.table, seed)
    ids = _ids(df, p)
    labels = split.by_ranges(ids, ["__id"], [c for c in ids.columns if c.startswith("__s")], s.table, seed).select("__id", F.col("__rows").alias("__w"), F.col(split.SPLIT).alias("__label"))
    labels = store.materialise(labels, "labels")
    total = labels.agg(F.sum("__w")).first()[0] or 0
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{p['ident']}`").alias("__id"))
    return attach(rows, labels, "__id", "__w", int(total)).select("row.*", F.coalesce("__label", F.lit(split.TRAIN)).alias(split.SPLIT))


def _split_reads(p: dict) -> list[str]:
    own = {"periods": ["period"], "ids": ["ident"], "rows": []}.get(p["method"], [])
    return [p[k] for k in own] + (list(p["keys"]) if p["method"] == "rows" else []) + list(p.get("strata", []))


def _expression_reads(p: dict) -> list[str]:
    """Columns that the expressions name, but for those that earlier ones of the step make."""
    made, out = set(), []
    for name, text in p["columns"].items():
        out += [c for c in language.names(text) if c not in made and c not in out]
        made.add(name)
    return out


def _expressions(df: DataFrame, s: Step, roles: Roles) -> DataFrame:
    return language.apply(df, list(s.params["columns"].items()))


#: All kinds of steps.
KINDS: dict[str, Kind] = {
    "convert": Kind(_convert, lambda p: list(p["changes"]), learn=_learn_convert),
    "drop": Kind(lambda df, s, roles: columns.drop(df, s.params["columns"], roles), lambda p: p["columns"]),
    "rename": Kind(lambda df, s, roles: columns.rename(df, s.params["names"]), lambda p: list(p["names"]), lambda p: list(p["names"].values())),
    "split": Kind(_split, _split_reads, lambda p: [split.SPLIT], _learn_split),
    "fill": Kind(lambda df, s, roles: df.withColumns({c: F.coalesce(num(F.col(f"`{c}`")), F.lit(m)) for c, m in s.learnt["medians"].items()}), lambda p: p["columns"], learn=_learn_fill),
    "clip": Kind(_clip, lambda p: p["columns"], learn=_learn_clip),
    "deciles": Kind(_deciles, lambda p: p["columns"], lambda p: [f"{c}__DLM" for c in p["columns"]], _learn_deciles),
    "bins": Kind(_bins, lambda p: p["columns"], lambda p: [f"{c}_ARALIK" for c in p["columns"]], _learn_bins),
    "encode": Kind(_encode, lambda p: [p["column"], *p["keys"], *([p["target"]] if p.get("target") else [])], lambda p: [f"{p['column']}__{k.upper()}" for k in _encode_kinds(p)], _learn_encode),
    "expressions": Kind(_expressions, _expression_reads, lambda p: list(p["columns"])),
}


def _kind(step: Step, place: int) -> Kind:
    if step.kind not in KINDS:
        raise RecipeError(f"step {place} ({step.kind}): no such kind")
    return KINDS[step.kind]


def _apply(df: DataFrame, step: Step, place: int, roles: Roles) -> DataFrame:
    """A step on a table, after a look at the table's columns; no job runs for that."""
    kind, types = _kind(step, place), dict(df.dtypes)
    for c, want in step.needs.items():
        if types.get(c) != want:
            raise RecipeError(f"step {place} ({step.kind}): column {c} is {types.get(c, 'missing')}, was {want}")
    lower = {c.lower() for c in types}
    taken = [c for c in kind.makes(step.params) if c.lower() in lower]
    if taken:
        raise RecipeError(f"step {place} ({step.kind}): {', '.join(taken)} is there already")
    return kind.apply(df, step, roles)


def _digest(table: DataFrame) -> str:
    """A fingerprint of a table's rows, whatever their order: three sums of 21 bits of each row's hash."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in table.columns])
    piece = lambda i: F.coalesce(F.sum(F.shiftrightunsigned(h, 21 * i).bitwiseAND(F.lit(0x1FFFFF))), F.lit(0))
    row = table.agg(F.count(F.lit(1)), piece(0), piece(1), piece(2)).first()
    return "-".join(f"{x:x}" for x in row)


def fit(base: DataFrame, steps: Sequence[Step], roles: Roles = Roles()) -> tuple[Recipe, DataFrame]:
    """Learn steps in order, each on train rows of the table before it; the recipe, and the table as a lazy plan.

    Jobs: a constant number for each step that learns, whatever the number of its columns.
    """
    df, done = base, []
    for i, step in enumerate(steps):
        kind, types = _kind(step, i), dict(df.dtypes)
        missing = [c for c in kind.reads(step.params) if c not in types]
        if missing:
            raise RecipeError(f"step {i} ({step.kind}): no column {', '.join(missing)}")
        learnt, table = kind.learn(df, step.params)
        if table is not None:
            table = store.materialise(table, "learnt")
            learnt = {**learnt, "digest": _digest(table)}
        step = replace(step, needs={c: types[c] for c in kind.reads(step.params)}, learnt=learnt, table=table)
        df = _apply(df, step, i, roles)
        done.append(step)
    return Recipe(dict(base.dtypes), tuple(done), roles), df


def rebuild(recipe: Recipe, base: DataFrame, until: str | None = None) -> DataFrame:
    """The table at the end of a stage (the last one if none is named), from a base with the columns the recipe knows.

    Further columns of the base are carried along; one whose name a step makes is refused.
    """
    types = dict(base.dtypes)
    for c, want in recipe.base.items():
        if types.get(c) != want:
            raise RecipeError(f"base: column {c} is {types.get(c, 'missing')}, was {want}")
    df = base
    for i, step in enumerate(recipe.until(until).steps):
        df = _apply(df, step, i, recipe.roles)
    return df


def _rows(recipe: Recipe) -> list[tuple]:
    text = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=False)
    roles = {k: getattr(recipe.roles, k) for k in ("target", "ident", "period", "segment")}
    head = (-1, "", "base", text(roles), text(recipe.base), "{}", False)
    return [head, *[(i, s.stage, s.kind, text(s.params), text(s.needs), text(s.learnt), s.table is not None) for i, s in enumerate(recipe.steps)]]


_SCHEMA = "position int, stage string, kind string, params string, needs string, learnt string, has_table boolean"


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """The versions of a recipe that were written to their end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/steps")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(p.getName().removeprefix("v")) for p in found if _complete(spark, p.toString()))


def save(spark: SparkSession, recipe: Recipe, root: str, name: str) -> int:
    """Write the next version; learnt tables first, as the steps are what makes a version."""
    version = max(versions(spark, root, name), default=0) + 1
    for i, step in enumerate(recipe.steps):
        if step.table is not None:
            step.table.write.mode("overwrite").parquet(f"{root}/{name}/learnt/v{version}/{i}")
    spark.createDataFrame(_rows(recipe), _SCHEMA).coalesce(1).write.parquet(f"{root}/{name}/steps/v{version}")
    return version


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> Recipe:
    """A version, the latest if none is named; a learnt table that isn't the one that was learnt is refused."""
    found = versions(spark, root, name)
    version = version or max(found, default=0)
    if version not in found:
        raise RecipeError(f"no version {version} of {name}")
    rows = sorted(spark.read.schema(_SCHEMA).parquet(f"{root}/{name}/steps/v{version}").collect(), key=lambda r: r.position)
    steps = []
    for r in rows[1:]:
        learnt, table = json.loads(r.learnt), None
        if r.has_table:
            table = spark.read.parquet(f"{root}/{name}/learnt/v{version}/{r.position}")
            if _digest(table) != learnt["digest"]:
                raise RecipeError(f"step {r.position} ({r.kind}): the learnt table has changed")
        steps.append(Step(r.kind, json.loads(r.params), r.stage, json.loads(r.needs), learnt, table))
    return Recipe(json.loads(rows[0].needs), tuple(steps), Roles(**json.loads(rows[0].params)))


def signature(recipe: Recipe, base_path: str, until: str | None = None) -> str:
    """What a stage's table depends on: its base and the steps so far, with all they learnt."""
    return hashlib.sha256(json.dumps([base_path, _rows(recipe.until(until))], ensure_ascii=False).encode()).hexdigest()[:32]


def write_stage(spark: SparkSession, recipe: Recipe, base_path: str, root: str, until: str | None = None) -> DataFrame:
    """The table at the end of a stage, written once for each base and recipe, always from the base; read if it is there.

    The base must not change: a copy by ``tables.base_copy``.
    """
    path = f"{root}/tables/{signature(recipe, base_path, until)}"
    if _complete(spark, path):
        return spark.read.parquet(path)
    made = rebuild(recipe, spark.read.parquet(base_path), until)
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)
