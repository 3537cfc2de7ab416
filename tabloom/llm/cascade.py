"""Quality rules as a short-circuit cascade, native expressions only.

Each rule is a boolean column that says *reject*. On a sample the cascade estimates every
rule's cost and selectivity (share rejected), orders the rules by rejection per cost and nests
them, so that a row leaves at its first rejecting rule and dear rules see few rows. The
verdict is the disjunction of the rules, so it never depends on the order.

A rule's cost is its ``work``: the nanoseconds a row takes, from the bytes or words that the
rule reads in that row, summed over the sample; so reruns give one order. A rule without
``work`` is timed: over the sample repeated ``REPEATS`` times, the least of three runs less
the least of three runs of a rule that reads nothing, as starting a job costs more than a
cheap rule does.

Null texts count as texts without words. A rule that gives null rejects nothing. An empty
table, or an empty sample, leaves the rules in their given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, WORD

#: Characters that count as symbols: # * $ % & | < >
SYMBOLS = "#*$%&|<>"
_SPACE_CHARS = " \t\n\x0b\f\r"
HASHES, _WINDOWS = "__tl_words", "__tl_windows"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    work: Column | None = None


def text_of(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row, also inside the lambdas of body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, *characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count_of(text: Column, character: str) -> Column:
    """How often an ASCII character occurs: the bytes that go with it."""
    return F.octet_length(text) - F.octet_length(_without(text, character))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in order; none for a text of white space."""
    return F.transform(F.filter(F.split(text, SPACES + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def n_words(text: Column) -> Column:
    """Words of a text, counted as its word starts: no array of words is built."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points that are no white space; white space is ASCII, so its bytes are its code points."""
    return (F.length(text) - F.octet_length(text) + F.octet_length(_without(text, *_SPACE_CHARS))).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACE_CHARS)) != "")
    return let(filled, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_upper(text: Column) -> Column:
    """Upper-case code points."""
    return F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))


def n_stutters(hashes: Column) -> Column:
    """Words that equal the word before them."""
    return F.size(F.filter(hashes, lambda w, i: F.coalesce(w == F.get(hashes, i - 1), F.lit(False))))


def window_hashes(hashes: Column, width: int) -> Column:
    """A 64-bit hash of each window of ``width`` words, in order; none for fewer words. hashes must be a plain column."""
    starts = F.sequence(F.lit(0), F.size(hashes) - width)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    return F.when(F.size(hashes) >= width, windows).otherwise(F.array().cast("array<bigint>"))


def _once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that is computed once per row, whatever uses it.

    Filters are not pushed into a generator; through a projection they would carry the whole
    expression along, into each of their uses and into the lambdas there.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """Add the word hashes, under ``HASHES``, for the rules and counts that need them."""
    return _once(df, word_hashes(text), HASHES)


def with_repeats(df: DataFrame, out: str, width: int = 5) -> DataFrame:
    """Add ``out``: words that lie in windows of ``width`` words found twice or more in the text. df comes from ``with_words``.

    One pass per text, no shuffle. Only texts that have a repeated window are sorted: the
    positions of repeated windows follow from neighbours in (hash, position) order, and the
    words they cover from the gaps between positions.
    """
    h = F.col(_WINDOWS)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def repeated(ordered: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["p"]))

    def covered(positions: Column) -> Column:
        each = F.transform(positions, lambda p, i: F.least(F.coalesce(F.get(positions, i + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    some = F.size(F.array_distinct(h)) < F.size(h)
    value = F.when(some, let(let(pairs, repeated), covered)).otherwise(F.lit(0)).cast("long")
    return _once(_once(df, window_hashes(F.col(HASHES), width), _WINDOWS), value, out).drop(_WINDOWS)


def standard_rules(text: Column, repeats: Column, symbols: Column | None = None, dup_lines: Column | None = None, chars: Column | None = None) -> list[Rule]:
    """The rules of this pipeline, over rows that ``with_words`` prepared.

    Columns that are at hand may be given, so as not to be computed twice.
    """
    hashes = F.col(HASHES)
    words = F.size(hashes)
    given = [symbols is not None, dup_lines is not None, chars is not None]
    symbols = n_symbols(text) if symbols is None else symbols
    dup_lines = n_dup_lines(text) if dup_lines is None else dup_lines
    chars = word_chars(text) if chars is None else chars
    lines = _count_of(text, "\n") + 1

    def work(per_byte: float, per_word: float = 0.0) -> Column:
        return F.octet_length(text) * per_byte + words * per_word + ROW_NS

    chars_ns = 0.0 if given[2] else CHARS_NS
    return [
        Rule("symbols", 10 * symbols > 2 * words, work(0.0 if given[0] else SYMBOLS_NS)),
        Rule("shouting", 5 * n_upper(text) > 2 * chars, work(UPPER_NS + chars_ns)),
        Rule("word_length", (words > 0) & ((chars < 2 * words) | (chars > 15 * words)), work(chars_ns)),
        Rule("exclamations", 5 * _count_of(text, "!") > words, work(COUNT_NS)),
        Rule("dup_lines", (lines >= 4) & (2 * dup_lines > lines), work(COUNT_NS + (0.0 if given[1] else LINES_NS))),
        Rule("few_words", words < 10, work(0.0)),
        Rule("stutters", 5 * n_stutters(hashes) > 2 * words, work(0.0, STUTTER_NS)),
        Rule("repeats", 100 * repeats > 20 * words, work(0.0, REPEAT_NS)),
    ]


#: Nanoseconds a byte or a word, as measured once on one core over 25 MB of text; only their ratios matter.
SYMBOLS_NS, UPPER_NS, CHARS_NS, COUNT_NS, LINES_NS, STUTTER_NS, REPEAT_NS, ROW_NS = 10.0, 13.0, 18.0, 3.0, 7.0, 30.0, 350.0, 20.0
#: How often the sample is read when a rule is timed.
REPEATS = 20


def _seconds(sample: DataFrame, rejects: Column) -> float:
    often = sample.withColumn("__tl_time", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    found = []
    for _ in range(3):
        began = time.perf_counter()
        often.where(F.coalesce(rejects, F.lit(False))).count()
        found.append(time.perf_counter() - began)
    return min(found)


def order_rules(sample: DataFrame, rules: list[Rule], least_seconds: float = 1e-5) -> list[Rule]:
    """The rules by falling rejection per cost on the sample, a bounded table."""
    sample = sample.cache()
    try:
        sums = [F.count_if(F.coalesce(r.rejects, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
        sums += [F.sum(r.work).alias(f"w{i}") for i, r in enumerate(rules) if r.work is not None]
        seen = sample.agg(F.count("*").alias("n"), *sums).first()
        if not seen.n:
            return rules
        idle = _seconds(sample, F.lit(False)) if any(r.work is None for r in rules) else 0.0
        scores = []
        for place, rule in enumerate(rules):
            seconds = seen[f"w{place}"] * 1e-9 if rule.work is not None else max((_seconds(sample, rule.rejects) - idle) / REPEATS, least_seconds)
            scores.append((-seen[f"r{place}"] / max(seconds, 1e-12), place))
        return [rules[place] for _, place in sorted(scores)]
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated for that row."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def sample_of(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows, drawn one by one from the whole table (all of a small one), for the estimates only."""
    n = df.select(F.col(f"`{id_col}`")).count()
    return df if n <= rows else df.sample(fraction=rows / n, seed=17)
