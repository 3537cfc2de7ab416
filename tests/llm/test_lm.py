"""The Pitman-Yor model: its seating against an enumerated posterior, its scores against plain Python, its independence of partitions."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import lm


def stirling(c, d):
    """Generalised Stirling numbers of c customers at t = 0..c tables: the sums over seatings of the product of rising factors."""
    row = {0: 1.0}
    for n in range(c):
        step = defaultdict(float)
        for t, x in row.items():
            step[t + 1] += x
            step[t] += x * (n - t * d)
        row = step
    return row


@pytest.mark.parametrize(("c", "base", "others"), [(2, 0.4, 3), (5, 0.2, 7), (9, 0.02, 40), (30, 0.05, 20)])
def test_seating_samples_the_posterior(c, base, others):
    """One word in 20,000 like restaurants with ``others`` tables besides, from one table on: the share of each number of tables."""
    n, discount = 20_000, 700
    d, key = discount / lm.UNIT, lm._mix(np.arange(1, n + 1, dtype=np.uint64))
    seats = lm.Seats.one(np.full(n, c))

    def weight(at, now):
        return (lm.THETA + d * (others + now)) * base

    for number in range(1, 41):
        seats = seats.visited(key, weight, discount, number)
        assert (seats.customers() == c).all() and seats.sizes.min() > 0
    s = stirling(c, d)
    exact = {t: s[t] * math.prod((lm.THETA + d * (others + k)) * base for k in range(1, t)) for t in range(1, c + 1)}
    total = sum(exact.values())
    got = Counter(seats.tables.tolist())
    for t, x in exact.items():
        assert abs(got[t] / n - x / total) < 0.015, (t, got[t] / n, x / total)


def test_customers_come_and_go():
    rng = np.random.default_rng(2)
    key, many = lm._mix(np.arange(1, 301, dtype=np.uint64)), rng.integers(1, 5000, 300)
    none = lm.Seats(np.zeros(300, np.int64), np.zeros(0, np.int64))
    seats = none.changed(key, many, lambda at, now: np.full(len(at), 0.6), 600, 1)
    assert (seats.customers() == many).all() and (seats.tables >= 1).all()
    less = rng.integers(1, many + 1)
    seats = seats.changed(key, less - many, lambda at, now: np.full(len(at), 0.6), 600, 2)
    assert (seats.customers() == less).all() and seats.sizes.min() > 0


class Brute:
    """The model with dictionaries and lists, one customer after the other; random numbers are the operator's."""

    def __init__(self, texts, learn, rounds=3, burn=1):
        self.count, self.words = Counter(), Counter()
        for text, teach in zip(texts, learn, strict=True):
            w = self.tokens(text)
            if teach:
                self.words.update(w)
                self.count.update(zip([int(lm._START), *w[:-1]], w, strict=True))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.of = Counter(u for u, _ in self.count.elements())
        contexts = Counter(w for _, w in self.count)
        self.d1 = lm.discount(*(sum(c == k for c in self.count.values()) for k in (1, 2)))
        self.d0 = lm.discount(*(sum(c == k for c in contexts.values()) for k in (1, 2)))
        seats, parent = {p: [c] for p, c in self.count.items()}, {w: [] for w in contexts}
        customers, tables, before = dict(contexts), self.v, dict.fromkeys(contexts, 1)
        self.samples = []
        for number in range(1, rounds + 1):
            as_context, all_customers = Counter(), sum(customers.values())
            for (u, _), sizes in seats.items():
                as_context[u] += len(sizes)
            fresh = {}
            for (u, w), sizes in seats.items():
                own = len(sizes)

                def weight(now, u=u, w=w, own=own):
                    more, d = now - own, self.d1 / lm.UNIT
                    return (1 + d * (as_context[u] + more)) * self.unigram(customers[w] + more, before[w], all_customers + more, tables)

                key = lm.pair_key(np.array([u], np.uint64), np.array([w], np.uint64))
                fresh[u, w] = self.visit(sizes, key, weight, self.d1, number)
            seats = fresh
            customers = Counter()
            for (_, w), sizes in seats.items():
                customers[w] += len(sizes)
            new = {}
            for w, sizes in parent.items():
                def weight(now, w=w):
                    return (1 + self.d0 / lm.UNIT * (tables + now - before[w])) / (self.v + 1)

                key = lm._mix(np.array([w], np.uint64))
                moved = self.change(sizes, customers[w], key, weight, self.d0, 2 * number)
                new[w] = self.visit(moved, key, weight, self.d0, 2 * number + 1)
            parent = new
            before = {w: len(sizes) for w, sizes in parent.items()}
            tables = sum(before.values())
            if number > burn:
                as_context = Counter()
                for (u, _), sizes in seats.items():
                    as_context[u] += len(sizes)
                self.samples.append(({p: len(x) for p, x in seats.items()}, as_context, customers, before, sum(customers.values()), tables))

    @staticmethod
    def tokens(text):
        return [*(xxhash.xxh64_intdigest(w, 0) for w in (text or "").encode().lower().split()), int(lm._END)]

    def unigram(self, customers, own, all_customers, tables):
        d = self.d0 / lm.UNIT
        return (max(customers - d * own, 0) + (1 + d * tables) / (self.v + 1)) / (1 + all_customers)

    @staticmethod
    def draw(key, *at):
        return float(lm.draws(key, *at)[0])

    @staticmethod
    def find(weights, x):
        for i, w in enumerate(weights):
            if x < w:
                return i
            x -= w
        raise AssertionError

    def visit(self, sizes, key, weight, d, number):
        sizes, c = list(sizes), sum(sizes)
        for visit in range(min(lm.VISITS, c) if c > 1 else 0):
            sizes[self.find(sizes, int(self.draw(key, number, visit, 0) * c))] -= 1
            now = sum(s > 0 for s in sizes)
            old, w = lm.UNIT * (c - 1) - d * now, weight(now)
            if self.draw(key, number, visit, 1) * (w + old / lm.UNIT) < w:
                sizes.append(1)
            else:
                sizes[self.find([lm.UNIT * s - d if s else 0 for s in sizes], int(self.draw(key, number, visit, 2) * old))] += 1
        return [s for s in sizes if s]

    def change(self, sizes, to, key, weight, d, number):
        sizes, visit = list(sizes), 0
        while (c := sum(sizes)) != to:
            group = min(abs(to - c), max(1, c // 16))
            if to < c:
                at = self.find(sizes, int(self.draw(key, number, visit, 0) * c))
                sizes[at] -= min(group, sizes[at])
            else:
                now = sum(s > 0 for s in sizes)
                old, w = lm.UNIT * c - d * now, weight(now)
                opens = self.draw(key, number, visit, 1) * (w + old / lm.UNIT) < w
                if group > opens:
                    sizes[self.find([lm.UNIT * s - d if s else 0 for s in sizes], int(self.draw(key, number, visit, 2) * old))] += group - opens
                if opens:
                    sizes.append(1)
            visit += 1
        return [s for s in sizes if s]

    def probability(self, u, w):
        d, total = self.d1 / lm.UNIT, 0.0
        for seats, as_context, customers, before, all_customers, tables in self.samples:
            own = self.count[u, w] - d * seats[u, w] if (u, w) in seats else 0.0
            total += (own + (1 + d * as_context[u]) * self.unigram(customers.get(w, 0), before.get(w, 0), all_customers, tables)) / (1 + self.of[u])
        return total / len(self.samples)

    def score(self, text):
        w = self.tokens(text)
        return sum(math.log10(self.probability(*p)) for p in zip([int(lm._START), *w[:-1]], w, strict=True))


@pytest.fixture(scope="module")
def corpus(rows):
    """The shared rows, and texts of few words, whose pairs occur often."""
    rng = np.random.default_rng(7)
    common = [f"c{i}" for i in range(12)]
    more = [(1000 + i, " ".join(rng.choice(common, 150, p=np.arange(12, 0, -1) / 78))) for i in range(12)]
    return [(r[0], r[1]) for r in rows] + more + [(1100, "go " * 400), (1101, "go " * 30)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def brute(corpus):
    return Brute([r[1] for r in corpus], [r[0] is not None and r[0] % 3 != 0 for r in corpus])


def scores(docs, **settings):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(docs, F.col("doc_id") % 3 != 0, **settings).collect())


def test_scores_against_brute_force(docs, corpus, brute):
    got = scores(docs)
    want = sorted((str(r[0]), len(brute.tokens(r[1])), sum(brute.words[w] > 0 for w in brute.tokens(r[1])), brute.score(r[1])) for r in corpus)
    assert max(brute.count.values()) > lm.VISITS and len(brute.samples) == 2
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[4] == pytest.approx(b[3], rel=1e-6, abs=1e-5)


def test_probabilities_sum_to_one(brute):
    """Over all words and the unseen rest, in contexts seen often, once and never."""
    contexts = [u for u, _ in brute.of.most_common(5)] + [u for u, n in brute.of.items() if n == 1][:3] + [12345]
    for u in contexts:
        assert abs(sum(brute.probability(u, w) for w in brute.words) + brute.probability(u, 999) - 1) < 1e-9


@pytest.mark.parametrize(("parts", "tokens", "size"), [(3, 300, 2_000), (7, 50, 700), (11, 10**9, 16 << 20)])
def test_scores_do_not_depend_on_placement(spark, docs, parts, tokens, size, monkeypatch):
    """Other numbers of partitions, buckets and slices, and another sample for the head."""
    want = scores(docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(lm, "BUCKET_TOKENS", tokens)
    real = lm._head_words
    monkeypatch.setattr(lm, "_head_words", lambda rows, n: real(rows, n)[: 1 + parts])
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = scores(docs.repartition(parts + 2), slice_bytes=size)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-12)


def test_string_ids(spark):
    df = spark.createDataFrame([("a", "x y x y"), (None, "x"), ("c", None)], "k string, t string")
    got = {r.k: r.n_tokens for r in lm.score(df, F.col("k") == "a", "k", "t").collect()}
    assert got == {"a": 5, None: 2, "c": 1}


@pytest.mark.parametrize("discount", [102, 512, 830, 972])
def test_stirling_ratios(discount, monkeypatch):
    """From the table and from integrals: against the recurrence, and in closed form for very many customers."""
    monkeypatch.setattr(lm, "STIRLING", 100)
    lm._stirling_table.cache_clear()
    d, row = discount / lm.UNIT, np.array([1.0])  # S(n, t) / S(n, 1) for t = 1, 2, ..., as far as 120
    for n in range(1, 1500):
        t = np.arange(1, min(n + 1, 120) + 1)
        row = np.append(row, 0.0)[: len(t)]
        row = (np.concatenate(([0.0], row[:-1])) + (n - t * d) * row) / (n - d)
        if n + 1 in (2, 5, 60, 100, 101, 400, 1500):
            for k in (1, 2, 3, 10, 50, 99):
                if k <= n and (n < 100 or 2 * k <= n):
                    assert lm.stirling_ratio(np.array([n + 1]), k, discount)[0] == pytest.approx(row[k] / row[k - 1], rel=1e-9), (n + 1, k)
    lm._stirling_table.cache_clear()
    c = 50_000_000  # the coefficients of (1 - x) ** d and (1 - x) ** 2d
    ratio = math.exp(math.lgamma(c - 2 * d) - math.lgamma(c - d) + math.lgamma(1 - d)) * (math.sin(2 * math.pi * d) / math.sin(math.pi * d) * math.gamma(1 + 2 * d) / math.gamma(1 + d) / math.gamma(1 - d))
    if discount != 512:
        assert lm.stirling_ratio(np.array([c]), 1, discount)[0] == pytest.approx((2 - ratio) / (2 * d), rel=1e-6)


@pytest.mark.parametrize(("c", "base", "others"), [(2, 0.4, 3), (30, 0.05, 20), (600, 0.3, 30), (1500, 0.5, 60)])
def test_every_customer_is_seated_anew(c, base, others):
    """One round from one table on samples the posterior, with far more customers than VISITS, too; visits don't get there."""
    n, discount = 20_000, 700
    d, key = discount / lm.UNIT, lm._mix(np.arange(1, n + 1, dtype=np.uint64))

    def weight(at, now):
        return (lm.THETA + d * (others + now)) * base

    customers = np.full(n, c)
    seats = lm.seated(customers, np.ones(n, np.int64), key, weight, discount, 1)
    assert (seats.customers() == c).all() and seats.sizes.min() > 0
    row = np.array([0.0])  # logarithms of S(c, t) w(1) ... w(t - 1)
    for k in range(1, c):
        t = np.arange(1, k + 2)
        row = np.logaddexp(np.concatenate(([-np.inf], row)), np.append(row, -np.inf) + np.log(np.maximum(k - t * d, 1e-300)))
    share = row + np.cumsum([0.0, *(math.log((lm.THETA + d * (others + k)) * base) for k in range(1, c))])
    share = np.exp(share - share.max())
    share /= share.sum()
    got = np.bincount(seats.tables, minlength=c + 1)[1:] / n
    assert np.abs(np.cumsum(got) - np.cumsum(share)).max() < 0.015
    if c > 100:
        few = lm.Seats.one(customers[:500])
        for number in range(1, 4):
            few = few.visited(key[:500], weight, discount, number)
        assert few.tables.mean() < 0.8 * (share * np.arange(1, c + 1)).sum()


def every_model(brute, rounds=3, burn=1):
    """Brute's model with all customers seated anew by log probabilities from the recurrence, a word in a restaurant at a time."""
    tables, parent, before = {p: 1 for p in brute.count}, Counter(w for _, w in brute.count), Counter()
    before.update(dict.fromkeys(parent, 1))
    customers, samples, rows = Counter(parent), [], {}

    def seat(c, key, weight, discount, number):
        d = discount / lm.UNIT
        if (c, discount) not in rows:
            row = [1.0]
            for k in range(1, c):
                row = [(row[t - 1] if t else 0.0) + (k - (t + 1) * d) * (row[t] if t < k else 0.0) for t in range(k + 1)]
                row = [x / (k - d) for x in row]
            rows[c, discount] = row
        chosen, now, total = 1, 1.0, 1.0
        for t in range(1, c):
            now *= weight(t) * rows[c, discount][t] / rows[c, discount][t - 1] if rows[c, discount][t - 1] else 0.0
            total += now
            if brute.draw(key, number, t, 0) * total < now:
                chosen = t + 1
        return chosen

    for number in range(1, rounds + 1):
        as_context, all_customers, all_tables = Counter(), sum(customers.values()), sum(before.values())
        for (u, _), t in tables.items():
            as_context[u] += t
        fresh = {}
        for (u, w), own in tables.items():
            def weight(now, u=u, w=w, own=own):
                return (1 + brute.d1 / lm.UNIT * (as_context[u] + now - own)) * brute.unigram(customers[w] + now - own, before[w], all_customers + now - own, all_tables)

            fresh[u, w] = seat(brute.count[u, w], lm.pair_key(np.array([u], np.uint64), np.array([w], np.uint64)), weight, brute.d1, number)
        tables, customers = fresh, Counter()
        for (_, w), t in tables.items():
            customers[w] += t
        fresh = {}
        for w, own in before.items():
            def weight(now, own=own):
                return (1 + brute.d0 / lm.UNIT * (all_tables + now - own)) / (brute.v + 1)

            fresh[w] = seat(customers[w], lm._mix(np.array([w], np.uint64)), weight, brute.d0, 2 * number)
        before = Counter(fresh)
        if number > burn:
            as_context = Counter()
            for (u, _), t in tables.items():
                as_context[u] += t
            samples.append((tables, as_context, customers, before, sum(customers.values()), sum(before.values())))
    return samples


def test_every_against_brute_force(docs, corpus, brute, monkeypatch):
    monkeypatch.setattr(brute, "samples", every_model(brute))
    got = scores(docs, every=True)
    want = sorted((str(r[0]), len(brute.tokens(r[1])), sum(brute.words[w] > 0 for w in brute.tokens(r[1])), brute.score(r[1])) for r in corpus)
    assert max(brute.count.values()) > lm.VISITS
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[4] == pytest.approx(b[3], rel=1e-6, abs=1e-5)


def test_the_query_bounds_no_visits(spark, small, monkeypatch):
    """The query's scores don't depend on VISITS."""
    from tabloom.llm import queries

    def told():
        return {r.doc_id: r.score for r in queries.op3_pitman_yor(spark, small).collect()}

    want = told()
    monkeypatch.setattr(lm, "VISITS", 1)
    assert told() == want
