"""Hot keys, near copies by similarity, mixing without ids, and the pipeline's stages on awkward tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import cascade, mixing, queries, simhash, urlrules
from tabloom.llm.common import free, lookup, prepare
from tabloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def partition(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_lookup_answers_every_row(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 0), (3, 1)], "k long, x long")
    found = spark.createDataFrame([(1, "a", 500), (2, "b", 1), (4, "d", 0)], "k long, v string, n long")
    for least in (0, 100, 10_000):
        got = lookup(rows, found, "k", "n", 502, least).collect()
        assert Counter(tuple(r) for r in got) == Counter([(1, i, "a") for i in range(500)] + [(2, 0, "b")])


@pytest.mark.parametrize("heavy_links", [2, 1_000])
def test_components_with_hot_nodes(spark, heavy_links):
    rng = random.Random(8)
    pairs = [(0, i) for i in range(1, 200)] + [(900, i) for i in range(600, 700)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(650, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), heavy_links=heavy_links).collect()}
    assert got == partition(pairs, {n for p in pairs if p[0] != p[1] for n in p})


def near_texts():
    """Texts, and for each the text it was made from."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    texts, of = [], []
    for n in (40, 120, 500):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            of.append(len(texts) - 1)
            first = of[-1]
            for changes in (0, n // 100, n // 50, n // 4):
                copy = list(base)
                for i in rng.sample(range(n), changes):
                    copy[i] = rng.choice(words)
                texts.append(" ".join(copy))
                of.append(first)
    # a passage that many texts share
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(12):
        texts.append(" ".join(rng.choice(words) for _ in range(80)) + " " + passage)
        of.append(len(texts) - 1)
    return [*texts, "", None, "one two"], of


@pytest.mark.parametrize("max_bucket", [2_000, 3])
def test_similar_texts_against_brute_force(spark, max_bucket):
    texts, of = near_texts()
    hashes = [simhash.shingle_hashes((t or "").encode(), 5) for t in texts]
    prints, keys = [simhash.wide_fingerprint(h) for h in hashes], [set(simhash.class_keys(h)) for h in hashes]
    fps, radius = [simhash.fingerprint(h) for h in hashes], simhash.wide_radius(0.8)
    links = []
    for i in range(len(texts)):
        for j in range(i):
            near = (fps[i] ^ fps[j]).bit_count() <= 3
            if near or (keys[i] & keys[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius):
                links.append((j, i))
    want = partition(links, range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, width=5, max_bucket=max_bucket, similarity=0.8).collect()}
    assert got == want
    # and what that finds, against the shingle sets themselves
    sets = [set(h.tolist()) for h in hashes]
    for i, first in enumerate(of):
        if i != first:
            similarity = len(sets[i] & sets[first]) / len(sets[i] | sets[first])
            assert similarity < 0.83 or got[i] == got[first]
            assert similarity > 0.6 or got[i] != got[first]
    assert len({got[i] for i in range(len(of) - 12, len(of))}) == 12


def test_wide_fingerprints_go_in_steps():
    hashes = np.random.default_rng(3).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (simhash.wide_fingerprint(hashes, 77) == simhash.wide_fingerprint(hashes)).all()
    mixed = simhash._mix(hashes ^ simhash._SEEDS[5])
    assert int(simhash.wide_fingerprint(hashes)[5]) == simhash.fingerprint(mixed)


def test_mixing_takes_interchangeable_rows(spark):
    """Many equal rows lie on one key of the order; they are numbered in parts."""
    rows = [(None, "a b c", None, "x", 0)] * 300 + [(i, "d e", None, "y", 0) for i in range(40)] + [(1, "f g h i", None, "z", 0)] * 50
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in target)
    equal = Counter(r.taken for r in got if r.source == "x")
    assert len(equal) <= 3  # so many repetitions, one more, and one row between


def test_many_sources_get_weights_in_order(spark):
    names = [f"s{i:03}" for i in range(50)] + ["Z", "é", None]
    random.Random(1).shuffle(names)
    got = {r.source: r.weight for r in mixing.repeating_weights(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: n.encode()) + [None]
    assert got == {n: float(i % 3 + 1) for i, n in enumerate(order)}


def test_mixed_documents_without_ids(spark):
    rows = [(None, f"w{i} x y", None, "a", 1) for i in range(30)] + [(7, "p q", None, "b", 1), (7, "r s t", None, "b", 1), (7, None, None, "b", 1), (8, "u", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("clash"), "taken": F.lit(1), "key": F.lit(2)})
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
    assert got == want and set(got) == {"a", "b", None}


def test_free_names():
    assert free(["a", "KEY", "key_"], "key") == "key__"


def test_prepare_keeps_a_size_of_the_session(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("32m", "33554432", "16mb"):
            spark.conf.set(name, size)
            prepare(spark)
            assert spark.conf.get(name) == size
    finally:
        spark.conf.set(name, before)


def test_cascade_is_ordered_alike_on_reruns(docs):
    text = cascade.text_of("text")
    rules = cascade.standard_rules(text, F.col("r"))
    sample = cascade.with_repeats(cascade.with_words(docs.select("doc_id", "text"), text), "r")
    first = [r.name for r in cascade.order_rules(sample, rules)]
    assert all([r.name for r in cascade.order_rules(sample, rules)] == first for _ in range(3))
    seen = [r for r in first if sample.where(F.coalesce(next(x for x in rules if x.name == r).rejects, F.lit(False))).count()]
    assert first[: len(seen)] == seen  # rules that reject nothing come last


def test_rules_that_are_timed(spark):
    """A dear rule that rejects a little more comes after a cheap one."""
    df = spark.range(300).withColumn("x", F.col("id") % 10)
    dear = F.aggregate(F.sequence(F.lit(1), F.lit(3000)), F.col("x"), lambda a, b: (a * 31 + b) % 10007)
    rules = [cascade.Rule("dear", (dear >= 0) & (F.col("x") < 6)), cascade.Rule("cheap", F.col("x") < 5)]
    assert [r.name for r in cascade.order_rules(df, rules)] == ["cheap", "dear"]


def test_samples_are_no_prefix_and_never_empty(spark):
    assert cascade.sample_of(spark.range(12), "id", 1000).count() == 12
    got = [r.id for r in cascade.sample_of(spark.range(20_000), "id", 1000).collect()]
    assert 800 < len(got) < 1200 and min(got) < 500 and max(got) > 19_500


def awkward(spark):
    rng = random.Random(12)
    words = ["the", "house", "green", "river", "walks", "under", "quiet", "light", "paper", "seven", "friend", "window", "carries", "old", "stone"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(7, prose(40), "en", "a", 1), (7, prose(41), "en", "a", 1), (None, prose(42), "en", "b", 1), (None, prose(43), None, "b", 1), (None, prose(30_000), "en", None, 1)]
    rows += [rows[0], rows[2], (-3, rows[1][1], "en", "c", 1), (9, "", None, None, None), (None, None, None, None, None)]
    names = ("__repeats", "__tl_words", "__tl_windows", "key", "size", "id", "fp", "found", "share", "c0", "tl_id", "back`quote")
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in names}), rows


def test_stages_keep_rows_without_and_with_shared_ids(spark, small):
    import corpus_pipeline

    df, rows = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, small)
        assert out.columns == df.columns, name
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "near_duplicates":
            # equal texts are one document, under the least id; texts that differ stay, whatever their ids
            assert got == Counter([(7, rows[0][1]), (-3, rows[1][1]), (None, rows[2][1]), (None, rows[3][1]), (None, rows[4][1]), (9, "")])
        if name == "mixing":
            assert {t for _, t in got} >= {rows[i][1] for i in (0, 1, 2, 3)}


def brute_rules(baskets, support, confidence, most):
    """All combinations of tokens that lie together in some basket, then the rules that no shorter one implies."""
    from itertools import combinations

    n = len(baskets)
    everywhere = set.intersection(*(set(t) for t, _ in baskets)) if baskets else set()
    rules = {}
    for c in {frozenset(x) for t, _ in baskets for k in range(1, most + 1) for x in combinations(sorted(set(t) - everywhere), k)}:
        inside = [v for t, v in baskets if c <= set(t)]
        for label in ("allow", "block"):
            m = inside.count(label)
            if m >= support * n and m >= confidence * len(inside):
                rules[c, label] = (m / len(inside), m / n)
    return {(tuple(sorted(c)), label): x for (c, label), x in rules.items() if not any(o < c and lab == label and y[0] >= x[0] for (o, lab), y in rules.items())}


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_are_all_rules(spark, seed):
    rng = random.Random(seed)
    baskets = [(["e", *rng.sample("abcdfgh", rng.randint(0, 5))], rng.choice(["allow", "block", "block"])) for _ in range(150)]
    got = {(tuple(r.tokens), r.label): (r.confidence, r.support) for r in urlrules.mined_rules(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), 0.04, 0.55, 3).collect()}
    want = brute_rules(baskets, 0.04, 0.55, 3)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_a_long_url_that_repeats(spark):
    """300 times one URL of 30 segments, 20 of 500 segments, and others: as many rules as tokens, at once."""
    urls = ["http://x.net/es/" + "/".join(f"seg{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))] * 300
    urls += ["http://y.com/" + "/".join("s" + "q" * i for i in range(500))] * 20
    urls += [f"http://h{'abcdefgh'[i % 8]}.net/{'es' if i % 3 else 'de'}/t{'uvw'[i % 3]}" for i in range(680)] + [None] * 40
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlrules.judge(df, queries.URL_RULES).collect()
    assert len(got) == len(urls) and {r.verdict for r in got} <= {"allow", "block"}


def test_verdicts_against_brute_force(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice('abcd')}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.choice(['x', 'y', 'z'])}" for _ in range(300)]
    got = urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()

    def tokens(r):
        return [f"h:{x}" for x in r.host.split(".")] + [f"p:{x}" for x in r.path.split("/") if x]

    labelled = [(tokens(r), r.verdict) for r in got if r.rule]
    rules = sorted(brute_rules(labelled, 0.002, 0.6, 3).items(), key=lambda x: (-x[1][0], -x[1][1], len(x[0][0]), " ".join(x[0][0]), x[0][1]))
    common = "block" if sum(v == "block" for _, v in labelled) > sum(v == "allow" for _, v in labelled) else "allow"
    open_rows = [r for r in got if not r.rule]
    assert open_rows
    for r in open_rows:
        fires = next(((" ".join(c), label) for (c, label), _ in rules if set(c) <= set(tokens(r))), (None, common))
        assert (r.mined, r.verdict) == fires
