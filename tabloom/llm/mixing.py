"""Mixing sources to target weights by capped water-filling, native expressions only.

A source's size is the sum of its documents' sizes. Weights share the whole: sources whose
share is above ``max_epochs`` times their size are clamped there, and the excess goes to the
others in proportion to their weights, until none is above. Each document is then repeated
as often as its source's rate (target / size) says: whole repetitions for all documents, and
one more for the first documents of the source in a seeded order, until the target is met;
the document at the border gives the remaining words only. So every source's words meet its
target to within rounding, and a rerun gives the same mix.

A null source is a source of its own, last in order. Null texts have size 0 and are taken 0
times; a source without words has target 0. Repeated rows are documents of their own; ties
of the seeded order are broken by id and size; rows that agree in both are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.cascade import n_words, text_of
from tabloom.llm.common import free, materialise, quoted
from tabloom.sources.store import forget

#: Bits of the seeded order that one level of the border search resolves.
LEVEL_BITS = 12
LEVELS = 3


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source and size (words) of every row."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(text_of(text_col)).alias("size"))


def repeating_weights(sources: DataFrame, pattern: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Give sources (column source, one row each) weights in code-point order, null last.

    The sources are ranged and numbered range by range, as there may be one for each host.
    """
    null, parts = F.col("source").isNull(), int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(sources.repartitionByRange(parts, null, F.col("source")).withColumn("range", F.spark_partition_id()), "mix-ranges")
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))  # a row for each range
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(null, F.col("source"))) - 1
    picks = F.array(*[F.lit(float(x)) for x in pattern])
    return ranged.join(F.broadcast(before), "range").withColumn("weight", F.element_at(picks, (place % len(pattern) + 1).cast("int"))).drop("range", "before")


def water_fill(sources: DataFrame, max_epochs: float = 3.0, total: float | None = None) -> DataFrame:
    """Add ``target`` to sources (columns source_size and weight): level x weight, at most max_epochs x source_size.

    total: the words to share out (all sizes, unless given). The level rises until no source
    that isn't clamped lies above its cap; each round is one aggregation over the sources.
    """
    sources = sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    first = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w"), F.sum("cap").alias("c")).first()
    if not first.w:
        return sources.withColumn("target", F.lit(0.0)).drop("cap")
    total = min(float(first.t if total is None else total), float(first.c))
    level, clamped = total / first.w, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if row.n == clamped or not row.w:
            break
        clamped, level = row.n, (total - (row.c or 0.0)) / row.w
    return sources.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def _order_key(seed: int) -> Column:
    """A seeded 36-bit key of a row: the first nine hex digits of an md5, which SQL elsewhere has, too."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def plan(rows: DataFrame, max_epochs: float = 3.0, pattern: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """One row a source: s2 (the source), source_size, target, whole repetitions, the words that are left (rest), and the key of the
    seeded order at which they end (border), with what is left there (left). rows come from ``sizes``, materialised."""
    totals = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = materialise(water_fill(repeating_weights(totals, pattern), max_epochs), "mix-targets")
    full = targets.select(
        "source", "source_size", "target",
        F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) + 1e-12).alias("whole"),
    )
    full = full.withColumn("rest", F.greatest(F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
    # the border of each source in the seeded order, digit by digit: sums per digit, at most 2^12 a source
    keyed = rows.where(F.col("size") > 0).withColumn("key", _order_key(seed))
    border = full.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = keyed if not level else keyed.join(
            F.broadcast(border.withColumnRenamed("source", "s")) if _few(border) else border.withColumnRenamed("source", "s"),
            _same(F.col("source"), F.col("s")) & (F.shiftrightunsigned("key", shift + LEVEL_BITS) == F.col("prefix")), "left_semi",
        )
        digits = inside.groupBy("source", F.shiftrightunsigned("key", shift).alias("digit")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = digits.withColumn("upto", F.sum("n").over(run))
        b = border.withColumnRenamed("source", "s")
        # the digit in which the running sum passes what is left; none passes if all fit
        passing = sums.join(b, _same(F.col("source"), F.col("s"))).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
        border = materialise(passing.select("source", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), F.col("digit").alias("prefix")), f"mix-border{level}")
    at = border.select(F.col("source").alias("s"), F.col("rest").alias("left"), F.col("prefix").alias("border"))
    marks = materialise(full.withColumnRenamed("source", "s2").join(at, _same(F.col("s2"), F.col("s")), "left").drop("s"), "mix-marks")
    forget(rows.sparkSession)
    return marks


def take(rows: DataFrame, marks: DataFrame, seed: int = 17) -> DataFrame:
    """Add source_size, target and taken to rows (columns id, source and size; whatever else they carry stays).

    All but the rows on a border key are judged by themselves. Those on it are summed in
    classes of equal id and size first; the rows of a class are interchangeable, so they are
    numbered in parts, however many there are, and the first ones are taken.
    """
    joined = rows.join(F.broadcast(marks) if _few(marks) else marks, _same(F.col("source"), F.col("s2"))).withColumn("key", _order_key(seed))
    at_border = F.coalesce((F.col("key") == F.col("border")) & (F.col("size") > 0), F.lit(False))
    extra = F.when(F.col("rest") <= 0, 0).when(F.col("border").isNull() | (F.col("key") < F.col("border")), F.col("size")).otherwise(0).cast("long")
    head = joined.where(~at_border).withColumn("extra", extra)
    # the border: classes, what is left for each, and the rows of each by number
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = joined.where(at_border).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    on = materialise(on, "mix-border-rows")
    dealt = on.groupBy("source", "id", "size", "part").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    classes = dealt.groupBy("source", "id", "size").agg(F.sum("n").alias("m"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("source", "id", "size", (F.col("left") - F.coalesce(F.sum(F.col("m") * F.col("size")).over(run), F.lit(0))).alias("own_left"))
    within = Window.partitionBy("source", "id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.select("source", "id", "size", "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("source", "id", "size")]
    marked = dealt.alias("o").join(classes.alias("k"), same[0] & same[1] & same[2]).select("o.*", "own_left")
    number = F.row_number().over(Window.partitionBy("source", "id", "size", "part").orderBy("size")) - 1
    on = on.withColumn("number", number).alias("o").join(marked.alias("k"), same[0] & same[1] & same[2] & (F.col("o.part") == F.col("k.part"))).select("o.*", "before", "own_left")
    left = F.col("own_left") - (F.col("before") + F.col("number")) * F.col("size")
    tail = on.withColumn("extra", F.greatest(F.least(left, F.col("size")), F.lit(0)).cast("long")).drop("part", "number", "before", "own_left")
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    return head.unionByName(tail).select(*rows.columns, "source_size", "target", taken)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = 3.0, pattern: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """Per row: id, source, size, source_size, target (of its source) and taken (words the mix takes of it)."""
    rows = materialise(sizes(df, id_col, text_col, source_col), "mix-sizes")
    found = take(rows, plan(rows, max_epochs, pattern, seed), seed)
    return found.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


#: A table of one row per source is broadcast up to so many sources; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def _few(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_SOURCES


def _repeated(df: DataFrame, text_col: str, size: str, taken: str, time: str) -> DataFrame:
    """Each row as often as it is taken, the last time cut to the words still taken; columns size and taken are dropped."""
    part, times = F.col(taken) % F.col(size), F.ceil(F.col(taken) / F.col(size)).cast("int")
    words = F.filter(F.split(text_of(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    out = df.where((F.col(taken) > 0) & (F.col(size) > 0)).withColumn(time, F.explode(F.sequence(F.lit(1), times)))
    cut = F.when((F.col(time) == times) & (part > 0), F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")).otherwise(F.col(f"`{text_col}`"))
    return out.withColumn(text_col, cut).drop(size, taken, time)


def apply_mix(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed documents: each row of df as often as ``mixed`` takes it, the last time cut to the words still taken.

    ids must be unique here; ``mixed_documents`` needs no ids. The repeated rows keep their id and all columns.
    """
    own, size, taken, time = (free(df.columns, n) for n in ("tl_id", "tl_size", "tl_taken", "tl_time"))
    found = mixed.where((F.col("taken") > 0) & (F.col("size") > 0)).select(F.col(f"`{id_col}`").alias(own), F.col("size").alias(size), F.col("taken").alias(taken))
    out = df.join(found, F.col(f"`{id_col}`") == F.col(own)).drop(own)
    return _repeated(out, text_col, size, taken, time).select(*[F.col(f"`{c}`") for c in df.columns])


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float = 3.0, pattern: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """The mixed documents, with df's columns; texts are judged where they lie and not shuffled.

    Null ids and ids that several rows share are rows as all others. Documents without a word
    have nothing to be taken and leave.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    of = dict(zip(df.columns, names, strict=True))
    rows = df.select(*[F.col(quoted(c)).alias(n) for c, n in of.items()])
    rows = rows.withColumns({"id": F.col(of[id_col]), "source": F.col(of[source_col]), "size": n_words(text_of(of[text_col]))})
    marks = plan(materialise(rows.select("id", "source", "size"), "mix-sizes"), max_epochs, pattern, seed)
    found = take(rows, marks, seed).select(*names, "size", "taken")
    return _repeated(found, of[text_col], "size", "taken", "time").select(*[F.col(n).alias(c) for c, n in of.items()])
