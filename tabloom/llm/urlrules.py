"""URL filters: fixed rules by host and path, and association rules over URL tokens beside them.

A fixed rule names a host, which stands for all its subdomains, and a path prefix; the
longest rule that fits decides. The URLs that a rule decides are labels: FP-growth mines
token combinations of them, and rules "combination -> label" that have the support and the
confidence asked for, and that no shorter rule already implies with at least the same
confidence, are kept.

Mining reads every labelled URL, none is sampled: equal token lists are one basket with a
weight, tokens below the support leave, and every basket sends to each of its tokens the more
frequent tokens before it. These conditional baskets, summed, are all that is needed about
the combinations that end in the token; each token's are mined on their own, by an FP-tree.
A combination grows no further when it has ``max_tokens`` tokens (that is what a rule is
here), when a part of it lies in the same URLs, or when all its URLs have one label: what it
would grow into is implied by it. So a long URL that repeats is no more than its tokens.

Rules match through an inverted index: a posting (token, rule, size of the combination) for
every token, joined to the URL's tokens; a rule fires when as many postings met as its
combination has tokens. The most confident rule that fires (ties: more support, fewer tokens,
then the rule's text) decides an URL without a fixed rule; if none fires, the more frequent
label does. The number of rules has no limit; the join finds out itself whether the index is
small enough for a broadcast.

Null URLs, and those without ``://``, have an empty host and path, no tokens and no fixed
rule. Repeated rows give repeated results; without any label the verdict is allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import lookup, materialise

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as written, like ``net/es/``) and its verdict; both null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest ends up outermost
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels and the path's segments, with digits as one mark."""
    labels = F.transform(F.filter(F.split(host, "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), F.regexp_replace(x, "[0-9]+", "0")))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.concat(labels, segments))


class Tree:
    """An FP-tree: baskets as paths of items, the most frequent first; nodes carry counts by label."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.parent, self.item, self.counts = [0], [""], [[0, 0]]
        self.places: dict[str, list[int]] = {}

    def add(self, items: list[str], allow: int, block: int) -> None:
        at = 0
        for item in items:
            down = self.children[at].get(item)
            if down is None:
                down = self.children[at][item] = len(self.parent)
                self.children.append({})
                self.parent.append(at)
                self.item.append(item)
                self.counts.append([0, 0])
                self.places.setdefault(item, []).append(down)
            self.counts[down][0] += allow
            self.counts[down][1] += block
            at = down

    def total(self, item: str) -> tuple[int, int]:
        own = [self.counts[n] for n in self.places[item]]
        return sum(c[0] for c in own), sum(c[1] for c in own)

    def before(self, item: str) -> Iterator[tuple[list[str], int, int]]:
        """The conditional baskets of an item."""
        for n in self.places[item]:
            path, at = [], self.parent[n]
            while at:
                path.append(self.item[at])
                at = self.parent[at]
            yield path[::-1], *self.counts[n]


def grow(baskets: Iterator[tuple[list[str], int, int]], found: list[str], counts: tuple[int, int], least: int, max_tokens: int) -> Iterator[tuple[list[str], int, int]]:
    """The combinations that contain ``found`` (in the URLs that the baskets stand for; counts are theirs), with their counts."""
    yield found, *counts
    if len(found) == max_tokens or min(counts) == 0:  # one label: whatever contains it is implied
        return
    tree = Tree()
    for items, allow, block in baskets:
        tree.add(items, allow, block)
    own = {item: tree.total(item) for item in tree.places}
    for item, n in own.items():
        if max(n) >= least and n != counts:  # in all of the same URLs: implied, too
            kept = (([i for i in items if max(own[i]) >= least and own[i] != counts], a, b) for items, a, b in tree.before(item))
            yield from grow(kept, [*found, item], n, least, max_tokens)


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int) -> DataFrame:
    """tokens (sorted), label, confidence and support of the rules kept. labelled: tokens (array) and verdict.

    Tokens that lie in every URL say nothing and are left out.
    """
    spark = labelled.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = [F.sum(F.when(F.col("verdict") == what, F.col("n")).otherwise(0)).alias(name) for name, what in (("a", ALLOW), ("b", BLOCK))]
    weighted = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    baskets = materialise(weighted.groupBy("tokens").agg(*both).withColumn("basket", F.monotonically_increasing_id()), "url-baskets")
    n = (baskets.agg(F.sum(F.col("a") + F.col("b"))).first()[0]) or 0
    least = max(1, math.ceil(min_support * n - 1e-9))
    each = baskets.select("basket", "a", "b", F.explode(F.array_distinct("tokens")).alias("token"))
    items = each.groupBy("token").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")).where((F.greatest("ta", "tb") >= least) & (F.col("ta") + F.col("tb") < n))
    ranked = F.struct((-F.col("ta") - F.col("tb")).alias("r"), F.col("token").alias("t"))
    lists = each.join(items, "token").groupBy("basket", "a", "b").agg(F.sort_array(F.collect_list(ranked)).alias("items"))
    lists = lists.groupBy(F.col("items.t").alias("items")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sent = lists.select("a", "b", "items", F.posexplode("items").alias("at", "token"))
    paths = sent.groupBy("token", F.slice("items", F.lit(1), F.col("at")).alias("path")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        own: list[tuple[list[str], int, int]] = []

        def close() -> Iterator[pa.RecordBatch]:
            if own:
                counts = sum(x[1] for x in own), sum(x[2] for x in own)
                got = [(sorted(tokens), label, c, a + b) for tokens, a, b in grow(iter(own), [now], counts, least, max_tokens) for label, c in ((ALLOW, a), (BLOCK, b)) if c >= least and c >= min_confidence * (a + b)]
                if got:
                    tokens, labels, c, m = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array(labels), pa.array(c, pa.int64()), pa.array(m, pa.int64())], names=["tokens", "label", "c", "m"])

        for batch in batches:
            for token, path, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if token != now:
                    yield from close()
                    now, own = token, []
                own.append((path, a, b))
        yield from close()

    mined = paths.select("token", "path", "a", "b").repartition(parts, "token").sortWithinPartitions("token").mapInArrow(work, "tokens array<string>, label string, c long, m long")
    rules = materialise(mined.select("tokens", "label", (F.col("c") / F.col("m")).alias("confidence"), (F.col("c") / F.lit(max(n, 1))).alias("support")), "url-rules")
    # a rule goes if a part of it says the same with at least its confidence: each asks for its proper parts
    masks = F.sequence(F.lit(1).cast("long"), F.shiftleft(F.lit(1).cast("long"), max_tokens) - 1)
    part = F.transform(F.filter(masks, lambda m: m < F.expr("shiftleft(1L, size(tokens))") - 1), lambda m: F.filter("tokens", lambda t, i: F.getbit(m, i) == 1))
    asked = rules.where(F.size("tokens") > 1).select("tokens", "label", "confidence", F.explode(part).alias("part"))
    better = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("other"))
    implied = asked.join(better, ["part", "label"]).where(F.col("other") >= F.col("confidence")).select("tokens", "label").distinct()
    return rules.join(implied, ["tokens", "label"], "left_anti")


def mine(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int, top: int) -> list[tuple[list[str], str, float, float]]:
    """A report of the ``top`` rules (the shortest first, then by support): tokens, label, confidence, support."""
    rules = mined_rules(labelled, min_support, min_confidence, max_tokens)
    return [(r.tokens, r.label, r.confidence, r.support) for r in rules.orderBy(F.size("tokens"), F.desc("support"), F.array_join("tokens", " "), "label").limit(top).collect()]


def judge(df: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002, min_confidence: float = 0.6, max_tokens: int = 3) -> DataFrame:
    """Per row: the id, host, path, rule (the fixed rule or null), verdict and mined (the association rule that decided, or null).

    rules: (host/path prefix, verdict) pairs. max_tokens: how many tokens a mined rule joins at most.
    """
    url = F.col(f"`{url_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    text, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = materialise(rows.select("id", "host", "path", text.alias("rule"), verdict.alias("given"), url_tokens(F.col("host"), F.col("path")).alias("tokens")), "url-rows")
    labelled = rows.where(F.col("given").isNotNull())
    sums = {r.given: r.n for r in labelled.groupBy("given").agg(F.count("*").alias("n")).collect()}
    default = BLOCK if sums.get(BLOCK, 0) > sums.get(ALLOW, 0) else ALLOW
    kept = materialise(mined_rules(labelled.select("tokens", F.col("given").alias("verdict")), min_support, min_confidence, max_tokens), "url-kept")
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("need"), F.array_join("tokens", " ").alias("combination"), F.col("label"))
    index = kept.select(rank.alias("rule"), F.explode("tokens").alias("token"))
    # equal token lists get one verdict, so it is looked up once for each
    lists = rows.where(F.col("given").isNull()).select("tokens").distinct().withColumn("list", F.monotonically_increasing_id())
    lists = materialise(lists, "url-lists")
    met = lists.select("list", F.explode("tokens").alias("token")).join(index, "token").groupBy("list", "rule").agg(F.count("*").alias("n")).where(F.col("n") == F.col("rule.need"))
    best = met.groupBy("list").agg(F.min("rule").alias("best"))
    decided = lists.join(best, "list").select("tokens", F.col("best.label").alias("label"), F.col("best.combination").alias("mined"))
    asked = rows.where(F.col("given").isNull()).groupBy("tokens").agg(F.count("*").alias("n"))
    open_rows = lookup(rows.where(F.col("given").isNull()), asked.join(decided, "tokens", "left"), "tokens", "n", rows.count())
    columns = ["id", "host", "path", "rule"]
    found = open_rows.select(*columns, F.coalesce("label", F.lit(default)).alias("verdict"), "mined")
    given = labelled.select(*columns, F.col("given").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    return given.unionByName(found).withColumnRenamed("id", id_col)
