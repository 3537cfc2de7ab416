"""LM scoring by a hierarchical Pitman-Yor model.

Two levels of restaurants over a base. A token is a customer of the restaurant of its context,
the token before it (or the start of the text); contexts are told apart by 64-bit hashes of
words, and there are as many as the corpus has words. All context restaurants share one
parent, the unigram restaurant: every table of theirs is a customer there. Its own tables
draw from the uniform base 1 / (V + 1), which leaves one part for all words never seen.

Seating is sampled by Gibbs rounds. Of every word in every restaurant up to ``VISITS``
customers a round (all, of words with no more) leave their table, one after the other, and
sit down again: at a table of n by n - d, at a new one by (theta + d T) p(w). Then the
parent's customers come and go as tables below opened and closed, and are visited alike. A
round is bulk-synchronous: what other words and other restaurants do in it is seen in the
next; what a word's own customers do is seen at once. After the burn-in every round gives a
sample; a token's probability is the mean of its predictive probabilities over the samples,
and perplexity is 10 ** (-score / n_tokens). Discounts come from the counts of counts
(n1 / (n1 + 2 n2)), in steps of 1/1024. Random numbers are hashes of word, context, round and
visit, and what is added up are whole numbers: the scores don't depend on partitions.

With ``every`` no number of visits bounds a round: all customers of a word in a restaurant leave
and sit down again together. What the scores and other restaurants see of them is the number of
their tables t, and given all else its probability is in proportion to S(c, t) w(1) ... w(t - 1), with
generalised Stirling numbers S and the weights w(k) of a table beside k: it is drawn from that, however many they are.

Where things live. Texts become slices of tokens (``SLICE_BYTES`` of text, written once). A
slice sends its distinct pairs of tokens, not their occurrences, to buckets, ranges of the
context's hash; those of the ``HOT`` most frequent contexts of a sample are dealt by the pair,
so no bucket holds a hot context. A bucket answers each slice with counts, and keeps the
seating of the pairs that occur twice or more (others have one table for good). The words of
the parent lie in buckets by their own hash; buckets exchange sums of tables and the parent's
state. A bucket's rows are bounded blocks, and the number of buckets follows the tokens. The
most frequent words of the sample (``HEAD``) travel as two bytes. Samples and buckets only
place work and change no result. Steps have a partition for each bucket, or for two slices,
where that is more than the session's.

Null and empty texts are one end token. Without a training row the model is the base alone.
Null ids count as empty text for the fold; repeated rows get repeated results. What a worker
holds is a slice (at least one text) or a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import id_field, materialise, only, slices
from tabloom.sources.store import forget, release

THETA = 1.0
VISITS = 16
HEAD = 65_000
HOT = 1_024
UNIT = 1_024
SLICE_BYTES = 16 << 20
#: Tokens for each bucket.
BUCKET_TOKENS = 2_000_000
#: Words that a worker's memo holds before it starts anew.
MEMO = 250_000
#: Customers up to which ratios of Stirling numbers come from a table.
STIRLING = 1_024
_END = np.uint64(xxhash.xxh64_intdigest(b" end", 0))
_START = np.uint64(xxhash.xxh64_intdigest(b" start", 0))
_STATE, _PARENT, _USES, _TABLES, _ANSWER, _HOT, _COUNTS, _VOCABULARY = range(8)
_ROWS = "bucket long, kind int, src long, x long, y long, blob binary"
_NAMES = ["bucket", "kind", "src", "x", "y", "blob"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


# seating


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(context + np.uint64(0x9E3779B97F4A7C15)) ^ word)


def draws(key: np.ndarray, number: int, visit: int, which: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the key, the round, the visit and which draw of it this is."""
    salt = _mix(np.array([(number << 24 | visit << 2 | which) + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (_mix(key ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _pick(weights: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place where the running sum of whole weights, from ``first`` on, passes ``at``."""
    sums = np.concatenate(([0], np.cumsum(weights)))
    return np.searchsorted(sums, sums[first] + at, side="right") - 1


class Seats:
    """The tables of one word in each of many restaurants: how many, and their sizes one after the other."""

    def __init__(self, tables: np.ndarray, sizes: np.ndarray):
        self.tables, self.sizes = tables.astype(np.int64), sizes.astype(np.int64)

    @classmethod
    def one(cls, customers: np.ndarray) -> Seats:
        """All customers at one table."""
        return cls(np.ones(len(customers), np.int64), customers)

    def customers(self) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(self.sizes)))
        ends = np.cumsum(self.tables)
        return sums[ends] - sums[ends - self.tables]

    def _laid(self, order: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes in the given order of restaurants, with room for more tables, and where each begins."""
        t = self.tables[order]
        first = np.concatenate(([0], np.cumsum(t + room)))
        flat = np.zeros(first[-1], np.int64)
        flat[_spread(first[:-1], t)] = self.sizes[_spread((np.cumsum(self.tables) - self.tables)[order], t)]
        return flat, first

    def _taken(self, order: np.ndarray, flat: np.ndarray, first: np.ndarray, now: np.ndarray) -> Seats:
        """Seats in the restaurants' own order, without empty tables."""
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        kept, starts = flat[flat > 0], np.cumsum(now) - now
        return Seats(now[back], kept[_spread(starts[back], now[back])])

    def visited(self, key: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: int, number: int, visits: int = VISITS) -> Seats:
        """After up to ``visits`` customers of each left their table and sat down again.

        weight(restaurants, tables): the weight of a new table. discount in parts of UNIT.
        """
        if not len(self.tables):
            return self
        customers = self.customers()
        order = np.argsort(-customers, kind="stable")
        c, key, now = customers[order], key[order], self.tables[order].copy()
        flat, first = self._laid(order, np.minimum(visits, c))
        used = now.copy()
        for visit in range(visits):
            k = int(np.searchsorted(-c, -max(visit, 1), side="left"))  # those with more customers, two at least
            if not k:
                break
            end, own = first[k], np.arange(k)
            at = _pick(flat[:end], first[:k], (draws(key[:k], number, visit, 0) * c[:k]).astype(np.int64))
            flat[at] -= 1
            now[:k] -= flat[at] == 0
            old = UNIT * (c[:k] - 1) - discount * now[:k]
            w = weight(order[:k], now[:k])
            opens = draws(key[:k], number, visit, 1) * (w + old / UNIT) < w
            joins = own[~opens]
            at = _pick(UNIT * flat[:end] - discount * (flat[:end] > 0), first[joins], (draws(key[joins], number, visit, 2) * old[joins]).astype(np.int64))
            flat[at] += 1
            new = own[opens]
            flat[first[new] + used[new]] = 1
            used[new] += 1
            now[new] += 1
        return self._taken(order, flat, first, now)

    def changed(self, key: np.ndarray, delta: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: int, number: int) -> Seats:
        """After delta customers came (went, if negative): one by one, in a group of a sixteenth where there are more.

        Of a group at most one opens a table; visits then move them one by one.
        """
        n = len(delta)
        customers = self.customers()
        left, c, steps = np.maximum(delta, 0), customers.copy(), np.zeros(n, np.int64)
        while left.any():  # how many tables may open
            group = np.minimum(left, np.maximum(1, c // 16))
            steps += group > 0
            left, c = left - group, c + group
        flat, first = self._laid(np.arange(n), steps)
        now, c, left = self.tables.copy(), customers, delta.copy()
        used, visit = now.copy(), 0
        while len(some := np.flatnonzero(left)):
            group = np.minimum(np.abs(left[some]), np.maximum(1, c[some] // 16))
            go, come = some[left[some] < 0], some[left[some] > 0]
            if len(go):
                at = _pick(flat, first[go], (draws(key[go], number, visit, 0) * c[go]).astype(np.int64))
                m = np.minimum(group[left[some] < 0], flat[at])
                flat[at] -= m
                now[go] -= flat[at] == 0
                c[go] -= m
                left[go] += m
            if len(come):
                m = group[left[some] > 0]
                old, w = UNIT * c[come] - discount * now[come], weight(come, now[come])
                opens = draws(key[come], number, visit, 1) * (w + old / UNIT) < w
                sit = (m - opens) > 0
                at = _pick(UNIT * flat - discount * (flat > 0), first[come[sit]], (draws(key[come[sit]], number, visit, 2) * old[sit]).astype(np.int64))
                flat[at] += (m - opens)[sit]
                new = come[opens]
                flat[first[new] + used[new]] = 1
                used[new] += 1
                now[new] += 1
                c[come] += m
                left[come] -= m
            visit += 1
        return self._taken(np.arange(n), flat, first, now)


@lru_cache(2)
def _stirling_table(discount: int) -> np.ndarray:
    """S(c, t + 1) / S(c, t) of generalised Stirling numbers, for c up to STIRLING."""
    d, out = discount / UNIT, np.zeros((STIRLING + 1, STIRLING + 1))
    for n in range(1, STIRLING):
        t, back = np.arange(1, n + 1), np.zeros(n)
        back[1:] = 1 / out[n, 1:n]
        out[n + 1, 1 : n + 1] = (1 + (n - (t + 1) * d) * out[n, 1 : n + 1]) / (back + (n - t * d))
    return out


def _stirling_contour(c: np.ndarray, t: int, discount: int, points: int = 64) -> np.ndarray:
    """The same for any c above t: S(c, t) is c! / t! times the coefficient of x ** c in ((1 - (1 - x) ** d) / d) ** t, and the
    coefficients are integrals over s = 1 - x along a parabola through the saddle point, around the cut of s ** d. Relative errors
    are below 1e-9, but where all customers but ten or fewer sit alone (1e-6 to 0.03)."""
    d, c = discount / UNIT, c.astype(np.float64)
    low, high = np.log(3 / c), np.full(len(c), -1e-12)
    for _ in range(50):
        middle = (low + high) / 2
        s = np.exp(middle)
        right = (c + 1) * s / (1 - s) > d * t * s**d / (1 - s**d)
        low, high = np.where(right, low, middle), np.where(right, middle, high)
    s = np.exp(low)
    a = s**d
    curve = (c + 1) * (s / (1 - s)) ** 2 - t * d * a * (d - 1 + a) / (1 - a) ** 2
    reach = np.minimum(12, 1.3 * np.sqrt(22 / np.maximum(curve, 1e-9)))
    z = 1 + 1j * reach[:, None] * (np.arange(points) + 0.5) / points
    at = s[:, None] * z * z
    power, rest = np.log(1 - at**d), -(c[:, None] + 1) * np.log(1 - at) + ((c + 1) * np.log1p(-s) - t * np.log1p(-a))[:, None]
    few = (t * a < 8)[:, None]  # here the constant 1 of the power, whose integral is 0, would outweigh the rest

    def part(k: int) -> np.ndarray:
        less = np.exp(np.where(few, rest, 0)) * np.expm1(np.where(few, k * power, 0))
        return (np.where(few, less, np.exp(np.where(few, 0, rest + k * power))) * z).real.sum(1)

    return part(t + 1) / part(t) / d / (t + 1)


def stirling_ratio(c: np.ndarray, t: int, discount: int) -> np.ndarray:
    """S(c, t + 1) / S(c, t), for c above t."""
    out = np.empty(len(c))
    small = c <= STIRLING
    if small.any():
        out[small] = _stirling_table(discount)[c[small], t]
    if not small.all():
        many, back = np.unique(c[~small], return_inverse=True)
        out[~small] = _stirling_contour(many, t, discount)[back]
    return out


def seated(customers: np.ndarray, before: np.ndarray, key: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], discount: int, number: int) -> Seats:
    """All customers of each seated anew, together: the number of tables from its distribution given all else.

    The running sum of the distribution goes on, past the ``before`` tables that there were, until what comes is below 1e-18 of it.
    The sizes kept are those of one seating with so many tables.
    """
    tables, live = np.ones(len(customers), np.int64), np.flatnonzero(customers > 1)
    now, total, t = np.ones(len(live)), np.ones(len(live)), 0
    while len(live):
        t += 1
        step = weight(live, np.full(len(live), t)) * stirling_ratio(customers[live], t, discount)
        now = now * step
        total = total + now
        tables[live[draws(key[live], number, t, 0) * total < now]] = t + 1
        scale = np.where(total > 1e200, 1e-200, 1.0)
        more = (customers[live] > t + 1) & ((now > 1e-18 * total) | (step > 1) | (before[live] > t))
        live, now, total = live[more], (now * scale)[more], (total * scale)[more]
    sizes = np.ones(tables.sum(), np.int64)
    sizes[np.cumsum(tables) - tables] += customers - tables
    return Seats(tables, sizes)


class Shape:
    """What is fixed before the first round, and the parent's totals after each."""

    def __init__(self, tokens: int, vocabulary: int, discounts: tuple[int, int]):
        self.tokens, self.vocabulary, self.discounts = tokens, vocabulary, discounts
        self.customers, self.tables = 0, vocabulary

    def parent(self, customers: np.ndarray, tables: np.ndarray, more: np.ndarray | float = 0) -> np.ndarray:
        """The parent's probability of words, with ``more`` customers than counted."""
        d = self.discounts[1] / UNIT
        own = np.maximum(customers + more - d * tables, 0)
        return (own + (THETA + d * self.tables) / (self.vocabulary + 1)) / (THETA + self.customers + more)


def sweep_contexts(shape: Shape, seats: Seats, key: np.ndarray, context_tables: np.ndarray, parent_customers: np.ndarray, parent_tables: np.ndarray, number: int, every: bool = False) -> Seats:
    """A round over pairs: tables in all of the pair's context, the parent's customers and tables of its word, as of the last round."""
    before, d = seats.tables, shape.discounts[0] / UNIT

    def weight(at: np.ndarray, now: np.ndarray) -> np.ndarray:
        more = now - before[at]
        return (THETA + d * (context_tables[at] + more)) * shape.parent(parent_customers[at], parent_tables[at], more)

    if every:
        return seated(seats.customers(), before, key, weight, shape.discounts[0], number)
    return seats.visited(key, weight, shape.discounts[0], number)


def sweep_parent(shape: Shape, seats: Seats, key: np.ndarray, customers: np.ndarray, number: int, every: bool = False) -> Seats:
    """A round over words: customers come and go until there are so many, then are visited (or all seated anew). The first round seats all of them."""
    d, before = shape.discounts[1] / UNIT, seats.tables

    def weight(at: np.ndarray, now: np.ndarray) -> np.ndarray:
        return (THETA + d * (shape.tables + now - before[at])) / (shape.vocabulary + 1)

    if every:
        return seated(customers, before, key, weight, shape.discounts[1], 2 * number)
    if number > 1:
        delta = customers - seats.customers()
    else:
        seats, delta = Seats(np.zeros(len(key), np.int64), np.zeros(0, np.int64)), customers
    return seats.changed(key, delta, weight, shape.discounts[1], 2 * number).visited(key, weight, shape.discounts[1], 2 * number + 1)


def discount(once: int, twice: int) -> int:
    """n1 / (n1 + 2 n2), in parts of UNIT."""
    return int(np.clip(round(UNIT * once / (once + 2 * twice)), UNIT // 10, UNIT * 19 // 20)) if once else UNIT // 2


# blocks


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        for a in arrays:
            np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return sink.getvalue().to_pybytes()


def _unpack(block: bytes) -> list[np.ndarray]:
    found = []
    with pa.CompressedInputStream(pa.BufferReader(block), "zstd") as stream:
        data = stream.read()
    reader = pa.BufferReader(data)
    while reader.tell() < len(data):
        found.append(np.lib.format.read_array(reader, allow_pickle=False))
    return found


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers that aren't negative, in as few bytes as hold the largest."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _steps(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0))


def _sum(steps: np.ndarray, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(steps, dtype=kind)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _ranges(place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal numbers of a sorted array: the number, start and stop."""
    if not len(place):
        return
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    for start, stop in zip(starts.tolist(), np.append(starts[1:], len(place)).tolist(), strict=True):
        yield int(place[start]), start, stop


def _batch(rows: list[tuple], names: list[str] = _NAMES, kinds: list[pa.DataType] = _KINDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _batches(rows: Iterator[tuple], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += len(row[5])
        if load > limit:
            yield _batch(held)
            held, load = [], 0
    if held:
        yield _batch(held)


def _parts(df: DataFrame, least: int) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _by_bucket(rows: DataFrame, buckets: int, work: Callable[[int, list[tuple[int, int, bytes]]], Iterator[tuple]]) -> DataFrame:
    """work(bucket, its rows (kind, src, blob) in order) for each bucket; gives rows of the same form."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, kind, src, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)), strict=True):
                if bucket != now:
                    if held:
                        yield from _batches(work(now, held))
                    now, held = bucket, []
                held.append((kind, src, blob))
        if held:
            yield from _batches(work(now, held))

    return rows.repartition(_parts(rows, buckets), "bucket").sortWithinPartitions("bucket", "kind", "src").mapInArrow(each, _ROWS)


# texts to slices


class Words:
    """Hashes of the words of texts, by a memo of distinct words."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.hash: np.ndarray = np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Per text the hash of every token, the end last."""
        split = [(t or b"").lower().split() for t in texts]
        fresh: set[bytes] = set()
        for words in split:
            fresh.update(words)
        if len(self.place) > MEMO:
            self.place.clear()
            self.hash = self.hash[:0]
        fresh.difference_update(self.place)
        start, new = len(self.place), list(fresh)
        self.place.update(zip(new, range(start, start + len(new)), strict=True))
        digest = xxhash.xxh64_intdigest
        self.hash = np.concatenate((self.hash, np.array([digest(w, 0) for w in new], np.uint64)))
        for words in split:
            yield np.append(self.hash[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))], _END)


def _head_words(rows: DataFrame, sample_docs: int) -> np.ndarray:
    """The end token, then the most frequent words of about sample_docs texts, HEAD in all at most."""
    n = rows.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for _, texts in slices(batches, 8 << 20):
            w, times = np.unique(np.concatenate(list(words(texts))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(times.astype(np.int64))], names=["w", "n"])

    part = rows.select("id", "text")
    part = part if n <= sample_docs else part.sample(fraction=sample_docs / n, seed=5)
    top = part.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(HEAD - 1).toArrow()
    found = top.column("w").to_numpy().astype(np.int64).view(np.uint64)
    return np.concatenate(([_END], found[found != _END])).astype(np.uint64)


def _slices(rows: DataFrame, id_type: str, slice_bytes: int) -> DataFrame:
    """Rows of about slice_bytes of text: their ids, whether they teach, their lengths, and tokens as places in a sorted vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, made = Words(), TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        learn: list[pa.Array] = []
        held: list[np.ndarray] = []
        load = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(h) for h in held], np.int64)
            vocabulary, tokens = np.unique(np.concatenate([*held, np.array([_START, _END], np.uint64)]), return_inverse=True)
            teach = pa.concat_arrays(learn)
            known = teach.to_numpy(zero_copy_only=False).astype(bool)
            every = pa.concat_arrays(ids)
            ends = pa.array([0, len(every)], pa.int32())
            blob = _pack(_small(lengths), _small(tokens[:-2]), _steps(vocabulary), known)
            n = int(lengths[known].sum())
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([n], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.ListArray.from_arrays(ends, every), pa.array([blob], pa.binary())], names=["slice", "train", "tokens", "ids", "blob"])

        for batch, texts in slices(batches, slice_bytes):
            ids.append(batch.column(0))
            learn.append(batch.column(2))
            held += words(texts)
            load += sum(len(t or b"") for t in texts)
            if load >= slice_bytes // 2:
                yield flush()
                ids, learn, held, load, made = [], [], [], 0, made + 1
        if held:
            yield flush()

    return rows.select("id", "text", "learn").mapInArrow(work, f"slice long, train long, tokens long, ids array<{id_type}>, blob binary")


class Slice:
    """The tokens of a slice, its distinct pairs in the order in which buckets get them, and each token's pair."""

    def __init__(self, blob: bytes, buckets: int, hot: np.ndarray):
        lengths, tokens, steps, self.learn = _unpack(blob)
        self.lengths, self.tokens, self.vocabulary = lengths.astype(np.int64), tokens.astype(np.int64), _sum(steps)
        n = len(self.vocabulary)
        self.starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.starts] = int(np.searchsorted(self.vocabulary, _START))
        pairs, self.pair = np.unique(before * n + self.tokens, return_inverse=True)
        self.context, self.word = np.divmod(pairs, n)
        # contexts in the sorted list of hot ones, -1 for others
        place = np.minimum(np.searchsorted(hot, self.vocabulary), len(hot) - 1)
        self.hot = np.where(hot[place] == self.vocabulary, place, -1)
        is_hot = self.hot[self.context] >= 0
        own = _bucket(self.vocabulary, buckets)
        bucket = own[self.context]
        spread = pair_key(self.vocabulary[self.context[is_hot]], self.vocabulary[self.word[is_hot]])
        bucket[is_hot] = _bucket(spread, buckets)
        self.order = np.argsort(2 * bucket + is_hot, kind="stable")
        self.bucket, self.word_bucket, self.is_hot = bucket[self.order], own, is_hot[self.order]

    def trained(self) -> np.ndarray:
        return np.repeat(self.learn, self.lengths)


def _requests(found: DataFrame, buckets: int, hot: np.ndarray, head: np.ndarray) -> DataFrame:
    """A block for each slice and bucket: words of the bucket's range with training counts, and pairs with theirs."""
    by_hash = np.sort(head)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Slice(blob, buckets, hot)
                teach = s.trained()
                n = np.bincount(s.tokens[teach], minlength=len(s.vocabulary))
                n[np.searchsorted(s.vocabulary, _START)] = s.learn.sum()
                times = np.bincount(s.pair[teach], minlength=len(s.context))[s.order]
                context, word = s.context[s.order], s.word[s.order]
                place = np.minimum(np.searchsorted(by_hash, s.vocabulary), len(by_hash) - 1)
                code = np.where(by_hash[place] == s.vocabulary, place + 1, 0).astype(np.uint16)
                words = {b: (i, j) for b, i, j in _ranges(s.word_bucket)}
                pairs = {b: (i, j) for b, i, j in _ranges(s.bucket)}
                rows = []
                for b in sorted(words.keys() | pairs.keys()):
                    (i, j), (k, m) = words.get(b, (0, 0)), pairs.get(b, (0, 0))
                    split = k + int(np.searchsorted(s.is_hot[k:m], True))
                    own = np.bincount(context[k:split] - i, minlength=j - i)
                    codes = code[word[k:m]]
                    blob = _pack(_steps(s.vocabulary[i:j]), _small(n[i:j]), _small(own), s.hot[context[split:m]].astype(np.uint16), codes, s.vocabulary[word[k:m][codes == 0]], _small(times[k:m]))
                    rows.append((b, 0, name, 0, 0, blob))
                yield _batch(rows)

    return found.select("slice", "blob").mapInArrow(work, _ROWS)


# buckets


def _merge(requests: DataFrame, buckets: int, head: np.ndarray) -> DataFrame:
    """Of each bucket the state, what every slice asked for, and the tables by word for the parent's buckets."""
    by_hash = np.sort(head)

    def work(bucket: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        blocks = [_unpack(blob) for _, _, blob in rows]
        hashes = [_sum(b[0]) for b in blocks]
        words = np.unique(np.concatenate(hashes))
        at = [np.searchsorted(words, h) for h in hashes]
        n = np.zeros(len(words), np.int64)
        context, word, times = [], [], []
        for b, place in zip(blocks, at, strict=True):
            n[place] += b[1].astype(np.int64)
            context.append(np.concatenate((np.repeat(place, b[2]), len(words) + b[3].astype(np.int64))))
            w = by_hash[np.maximum(b[4].astype(np.int64) - 1, 0)]
            w[b[4] == 0] = b[5]
            word.append(w)
            times.append(b[6].astype(np.int64))
        ends = np.cumsum([0] + [len(c) for c in context])
        u, w, c = (np.concatenate(x) for x in (context, word, times))
        del context, word, times, blocks
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        fresh = np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]))) if len(u) else np.zeros(0, bool)
        entry = np.cumsum(fresh) - 1
        u, w = u[fresh], w[fresh]
        c = np.bincount(entry, c[order], len(u)).astype(np.int64)
        many = c > 1
        code = np.where(many, np.cumsum(many) + 1, c)  # 0 never seen, 1 seen once, from 2 on the pairs seen more often
        asked = np.empty(len(order), np.int64)
        asked[order] = code[entry]
        for i, (_, src, _) in enumerate(rows):
            own = asked[ends[i] : ends[i + 1]]
            more = own[own > 1]
            yield bucket, _USES, src, 0, 0, _pack(_small(_steps(at[i])), np.minimum(own, 2).astype(np.uint8), _small(_steps(more)))
        single = np.bincount(u[c == 1], minlength=len(words) + HOT)
        mw, to = np.unique(w[many], return_inverse=True)
        # contexts of these pairs: those of the bucket, then the hot ones
        far = u[many] - len(words)
        mu, back = np.unique(u[many][far < 0], return_inverse=True)
        at_context = np.concatenate((back, len(mu) + far[far >= 0]))
        seats = Seats.one(c[many])
        yield bucket, _VOCABULARY, 0, 0, 0, _pack(_steps(words), _small(n), _small(single[: len(words)]))
        yield bucket, _STATE, 0, int((c == 1).sum()), int((c == 2).sum()), _pack(_steps(words[mu]), _small(single[mu]), _small(_steps(at_context)), _small(to), _steps(mw), _small(seats.tables), _small(seats.sizes), np.zeros(len(to), np.uint8), np.zeros((0, len(mu)), np.uint8))
        sw, alone = np.unique(w[c == 1], return_counts=True)
        sums = np.bincount(to, minlength=len(mw))
        first, second = {b: (i, j) for b, i, j in _ranges(_bucket(mw, buckets))}, {b: (i, j) for b, i, j in _ranges(_bucket(sw, buckets))}
        for dest in sorted(first.keys() | second.keys()):
            (i, j), (k, m) = first.get(dest, (0, 0)), second.get(dest, (0, 0))
            yield dest, _TABLES, bucket, 0, 0, _pack(_steps(mw[i:j]), _small(sums[i:j]), _steps(sw[k:m]), _small(alone[k:m]))
        alone, tables = single[len(words) :], np.bincount(far[far >= 0], minlength=HOT)
        for place in np.flatnonzero(alone + tables).tolist():
            yield 0, _HOT, place, int(alone[place]), int(tables[place]), b""

    return _by_bucket(requests, buckets, work)


def _parents(rows: DataFrame, shape: Shape, buckets: int, number: int, keep: bool, every: bool = False) -> DataFrame:
    """The parent's words of each bucket after a round, and the answers to the buckets that sent tables."""

    def work(bucket: int, got: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        sent = [(src, _unpack(blob)) for kind, src, blob in got if kind == _TABLES]
        old = [_unpack(blob) for kind, _, blob in got if kind == _PARENT]
        if old:
            steps, alone, srcs, counts, gaps, tables, sizes, kept = old[0]
            words, alone = _sum(steps), alone.astype(np.int64)
            ends = np.cumsum(counts.astype(np.int64))
            index = [_sum(g, np.int64) for g in np.split(gaps, ends[:-1])]
            seats = Seats(tables, sizes)
            now = {src: x[0] for src, x in sent}
            # a bucket that has sent words seen once alone sends nothing more
            sums = [now.get(src, np.zeros(0)).astype(np.int64) for src in srcs.tolist()]
        else:
            words = np.unique(np.concatenate([_sum(x) for _, b in sent for x in (b[0], b[2])]))
            alone = np.zeros(len(words), np.int64)
            for _, b in sent:
                alone[np.searchsorted(words, _sum(b[2]))] += b[3].astype(np.int64)
            srcs = np.array([src for src, _ in sent], np.int64)
            index = [np.searchsorted(words, _sum(b[0])) for _, b in sent]
            sums = [b[1].astype(np.int64) for _, b in sent]
            kept = np.zeros((0, len(words)), np.int64)
        customers = alone.copy()
        for place, n in zip(index, sums, strict=True):
            customers[place] += n
        if old:
            seats = sweep_parent(shape, seats, _mix(words), customers, number, every)
        else:
            seats = Seats.one(customers)
            yield bucket, _COUNTS, 0, int((customers == 1).sum()), int((customers == 2).sum()), b""
        if keep:
            kept = np.vstack((kept, customers, seats.tables))
        gaps = np.concatenate([_steps(i) for i in index]) if index else np.zeros(0, np.int64)
        counts = np.array([len(i) for i in index], np.int64)
        yield bucket, _PARENT, 0, int(customers.sum()), int(seats.tables.sum()), _pack(_steps(words), _small(alone), srcs, counts, _small(gaps), _small(seats.tables), _small(seats.sizes), _small(kept.ravel()).reshape(kept.shape))
        for src, place in zip(srcs.tolist(), index, strict=True):
            if len(place):
                yield src, _ANSWER, bucket, 0, 0, _pack(_small(customers[place]), _small(seats.tables[place]))

    return _by_bucket(rows, buckets, work)


def _contexts(rows: DataFrame, shape: Shape, buckets: int, hot: np.ndarray, hot_tables: np.ndarray, number: int, keep: bool, every: bool) -> DataFrame:
    """The pairs of each bucket after a round, and their tables by word for the parent's buckets."""

    def work(bucket: int, got: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        state = [blob for kind, _, blob in got if kind == _STATE]
        answers = [_unpack(blob) for kind, _, blob in got if kind == _ANSWER]
        steps, single, gaps, to, mws, tables, sizes, total, kept = _unpack(state[0])
        mu, u, mw, to = _sum(steps), _sum(gaps, np.int64), _sum(mws), to.astype(np.int64)
        parent = [np.concatenate([a[i].astype(np.int64) for a in answers]) if answers else np.zeros(0, np.int64) for i in (0, 1)]
        seats = Seats(tables, sizes)

        def by_context() -> np.ndarray:
            return np.bincount(u, seats.tables, len(mu) + HOT).astype(np.int64)

        of = np.concatenate((by_context()[: len(mu)] + single, hot_tables))
        names = np.concatenate((mu, hot, np.zeros(HOT - len(hot), np.uint64)))
        seats = sweep_contexts(shape, seats, pair_key(names[u], mw[to]), of[u], parent[0][to], parent[1][to], number, every)
        after = by_context()
        if keep:
            total = total.astype(np.int64) + seats.tables
            kept = np.vstack((kept.astype(np.int64), after[: len(mu)] + single))
        yield bucket, _STATE, 0, 0, 0, _pack(steps, single, gaps, _small(to), mws, _small(seats.tables), _small(seats.sizes), _small(total), _small(kept.ravel()).reshape(kept.shape))
        sums = np.bincount(to, seats.tables, len(mw)).astype(np.int64)
        for dest, i, j in _ranges(_bucket(mw, buckets)):
            yield dest, _TABLES, bucket, 0, 0, _pack(_small(sums[i:j]))
        for place in np.flatnonzero(after[len(mu) :]).tolist():
            yield 0, _HOT, place, 0, int(after[len(mu) + place]), b""

    return _by_bucket(rows, buckets, work)


def _hot_tables(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the hot contexts, at most HOT numbers: of pairs seen once, and of others."""
    out = np.zeros((2, HOT), np.int64)
    for r in rows.where(F.col("kind") == _HOT).groupBy("src").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect():
        out[:, r.src] = r.x, r.y
    return out[0], out[1]


def _answers(rows: DataFrame, shape: Shape, buckets: int, samples: int, hot: np.ndarray, hot_tables: list[np.ndarray]) -> DataFrame:
    """For each slice and bucket: of its words the training count, and by sample the tables as a context and the parent's customers and
    tables; of its pairs the mean of customers less discounted tables."""

    def work(bucket: int, got: list[tuple[int, int, bytes]]) -> Iterator[tuple]:
        by_kind = {kind: blob for kind, _, blob in got if kind != _USES}
        if _STATE not in by_kind:
            return
        steps, n, single = _unpack(by_kind[_VOCABULARY])
        own, _, _, _, _, tables, sizes, total, as_context = _unpack(by_kind[_STATE])
        words, d = _sum(steps), shape.discounts[0] / UNIT
        facts = np.zeros((1 + 3 * samples, len(words)), np.int64)
        facts[0], facts[1 : 1 + samples] = n, single
        facts[1 : 1 + samples, np.searchsorted(words, _sum(own))] = as_context
        place = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        is_hot = hot[place] == words
        for i in range(samples):
            facts[1 + i, is_hot] = hot_tables[i][place[is_hot]]
        if _PARENT in by_kind:
            old = _unpack(by_kind[_PARENT])
            facts[1 + samples :, np.searchsorted(words, _sum(old[0]))] = old[7]
        value = np.concatenate(([0.0, 1 - d], Seats(tables, sizes).customers() - d * total / samples)).astype(np.float32)
        for kind, src, blob in got:
            if kind == _USES:
                at, kinds, more = _unpack(blob)
                code = kinds.astype(np.int64)
                code[kinds == 2] = _sum(more, np.int64)
                yield src, 1, bucket, 0, 0, _pack(*[_small(f) for f in facts[:, _sum(at, np.int64)]], value[code])

    return _by_bucket(rows, buckets, work)


def _scored(found: DataFrame, answers: DataFrame, shape: Shape, totals: list[tuple[int, int]], buckets: int, hot: np.ndarray, id_type: str, count: int) -> DataFrame:
    """The texts of each slice with their scores, once its answers are there."""
    samples, size = len(totals), shape.tokens + shape.vocabulary + 1
    d1, d0 = (x / UNIT for x in shape.discounts)
    names = ["id", "learned", "n_tokens", "n_known", "base_score", "score"]

    def close(ids: pa.Array, blob: bytes, blocks: list[bytes]) -> pa.RecordBatch:
        s, got = Slice(blob, buckets, hot), [_unpack(b) for b in blocks]
        n, *facts = (np.concatenate([b[i].astype(np.int64) for b in got]) for i in range(1 + 3 * samples))
        value = np.empty(len(s.context))
        value[s.order] = np.concatenate([b[-1] for b in got])
        p = value / (THETA + n[s.context])
        for i, (customers, tables) in enumerate(totals):
            back = (THETA + d1 * facts[i]) / (THETA + n)
            own = np.maximum(facts[samples + 2 * i] - d0 * facts[samples + 2 * i + 1], 0)
            unigram = (own + (THETA + d0 * tables) / (shape.vocabulary + 1)) / (THETA + customers)
            p += back[s.context] * unigram[s.word] / samples
        n[np.searchsorted(s.vocabulary, _START)] = 0
        plain, known = np.log10((n + 1) / size)[s.tokens], (n > 0).astype(np.int64)[s.tokens]
        sums = [np.add.reduceat(x, s.starts) for x in (known, plain, np.log10(p)[s.pair])]
        return pa.RecordBatch.from_arrays([ids, pa.array(s.learn), pa.array(s.lengths), *map(pa.array, sums)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blob, blocks = None, b"", []
        for batch in batches:
            for at, (kind, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if kind == 0:
                    if ids is not None:
                        yield close(ids, blob, blocks)
                    ids, blob, blocks = batch.column(3)[at].values, data, []
                else:
                    blocks.append(data)
        if ids is not None:
            yield close(ids, blob, blocks)

    none = F.lit(None).cast(f"array<{id_type}>")
    rows = found.select("slice", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("src"), "ids", "blob")
    rows = rows.unionAll(answers.select("bucket", "kind", "src", none, "blob"))
    return rows.repartition(_parts(found, count // 2), "slice").sortWithinPartitions("slice", "kind", "src").mapInArrow(work, f"id {id_type}, learned boolean, n_tokens long, n_known long, base_score double, score double")


def score(df: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, burn: int = 1, sample_docs: int = 6_000, slice_bytes: int = SLICE_BYTES, every: bool = False) -> DataFrame:
    """Per row: the id, learned (whether it trained), n_tokens, n_known, train_tokens, base_score and score.

    learn_from: a condition on df's rows. score is the model's log10 probability of the text,
    base_score that of add-one unigrams. The last rounds - burn rounds, one at least, are
    samples. every: all customers are seated anew in each round, instead of up to VISITS of a word and restaurant.
    """
    spark = df.sparkSession
    id_type = id_field(df, id_col)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    rows = only(rows, id="id", text="text", learn="learn")
    head = _head_words(rows, sample_docs)
    hot = np.unique(np.concatenate(([_START], head[head != _END][: HOT - 1])).astype(np.uint64))
    found = materialise(_slices(rows, id_type, slice_bytes), "lm-slices")
    sums = found.agg(F.sum("train").alias("n"), F.sum("tokens").alias("m"), F.count("*").alias("slices")).first()
    tokens, size = sums.n or 0, sums.m or 0
    buckets = max(1, size // BUCKET_TOKENS)
    state = materialise(_merge(_requests(found, buckets, hot, head), buckets, head), "lm-state")

    def totals(table: DataFrame, kind: int) -> tuple[int, int]:
        got = table.where(F.col("kind") == kind).agg(F.sum("x").alias("x"), F.sum("y").alias("y")).first()
        return int(got.x or 0), int(got.y or 0)

    forget(spark)
    parent = materialise(_parents(state.where(F.col("kind") == _TABLES), Shape(0, 0, (0, 0)), buckets, 0, False), "lm-parent")
    customers, vocabulary = totals(parent, _PARENT)
    shape = Shape(tokens, vocabulary, (discount(*totals(state, _STATE)), discount(*totals(parent, _COUNTS))))
    shape.customers = customers
    pairs, kept, at_hot, last = state, [], [], max(1, rounds)
    alone, others = _hot_tables(state)
    for number in range(1, last + 1):
        keep = number > min(burn, last - 1)
        own = pairs.where(F.col("kind") == _STATE).unionAll(parent.where(F.col("kind") == _ANSWER))
        fresh = materialise(_contexts(own, shape, buckets, hot, alone + others, number, keep, every), "lm-pairs")
        if pairs is not state:
            release(pairs)
        pairs, others = fresh, _hot_tables(fresh)[1]
        sent = pairs.where(F.col("kind") == _TABLES).unionAll(parent.where(F.col("kind") == _PARENT))
        fresh = materialise(_parents(sent, shape, buckets, number, keep, every), "lm-parent")
        release(parent)
        parent = fresh
        shape.customers, shape.tables = totals(parent, _PARENT)
        if keep:
            kept.append((shape.customers, shape.tables))
            at_hot.append(alone + others)
    last_rows = state.where(F.col("kind").isin(_USES, _VOCABULARY)).unionAll(pairs.where(F.col("kind") == _STATE)).unionAll(parent.where(F.col("kind") == _PARENT))
    answers = materialise(_answers(last_rows, shape, buckets, len(kept), hot, at_hot), "lm-answers")
    for table in {id(t): t for t in (state, pairs, parent)}.values():
        release(table)
    return _scored(found, answers, shape, kept, buckets, hot, id_type, sums.slices).select(
        F.col("id").alias(id_col), "learned", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
