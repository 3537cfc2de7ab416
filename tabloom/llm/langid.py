"""Language ID by word-first backoff.

A word that the training sample knows is scored by its log frequency in each language; an
unseen word falls back to the longest character n-grams of it that are known, from
``MAX_GRAM`` characters down to one. A text's language is the one with the largest sum.

Learning reads a bounded sample: of every language that occurs at most ``per_lang`` distinct
documents, and fewer if there are so many languages that ``max_rows`` would be passed, taken
by a hash of id and text, so that it is the same on every run. Texts of any length teach,
and all words and n-grams of the sample are kept: they are counted where the documents lie,
and only the counts go to the driver. All else covers every whole text.

Letters are Unicode's category L; digits, number forms and marks separate words.

Null texts and texts without a letter give ``und`` with score 0; so does every text if there
is nothing to learn from. Ties go to the first language in code-point order. Repeated rows
give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import id_field, only, slices
from tabloom.sources.store import forget

UNKNOWN = "und"
MAX_GRAM = 5
_LETTERS = regex.compile(r"\p{L}+")
#: Words that a worker's memo holds before it starts anew; fewer, where their rows of one value a language would take more cells.
MEMO, MEMO_CELLS = 200_000, 8 << 20
#: Values of n-grams that are looked up at once.
CELLS = 1 << 20


#: What of ASCII is no letter separates words; capitals become small.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w.encode()) for w in words], np.uint64)


def _edged(word: str, n: int) -> str:
    """A word with its ends marked; single characters need no ends."""
    return f" {word} " if n > 1 else word


@dataclass
class LogTable:
    """Log frequencies of entries by language, add-half smoothed, less each entry's largest one: only differences matter.

    Only the languages that have an entry hold a value for it; in all others it has their constant for count 0. So
    a table takes what was counted, however many languages there are. Tables put one after the other keep constants of their own.
    """

    absent: np.ndarray  # tables x languages
    ends: np.ndarray  # entries up to the end of each table
    top: np.ndarray
    first: np.ndarray  # entry -> where its values begin; one more at the end
    langs: np.ndarray
    values: np.ndarray

    def dense(self, entries: np.ndarray) -> np.ndarray:
        """Rows of float32, one for each of the given entries."""
        out = (self.absent[np.searchsorted(self.ends, entries, side="right")] - self.top[entries, None]).astype(np.float32)
        sizes = self.first[entries + 1] - self.first[entries]
        row = np.repeat(np.arange(len(entries)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[entries], sizes)
        out[row, self.langs[at]] = self.values[at]
        return out


def _log_table(counts: dict[int, Counter], languages: int) -> tuple[dict[str, int], LogTable]:
    """The entries of all languages, in order, and their table."""
    totals = np.array([sum(counts[i].values()) for i in range(languages)], float)
    entries = {k: at for at, k in enumerate(sorted(set().union(*counts.values())))}
    sizes = [len(counts[i]) for i in range(languages)]
    row = np.fromiter((entries[k] for i in range(languages) for k in counts[i]), np.int64, sum(sizes))
    times = np.fromiter((n for i in range(languages) for n in counts[i].values()), float, sum(sizes))
    lang = np.repeat(np.arange(languages, dtype=np.int32), sizes)
    scale = totals + 0.5 * (len(entries) + 1)
    absent, logs = np.log(0.5 / scale), np.log((times + 0.5) / scale[lang])
    order = np.lexsort((lang, row))
    row, lang, logs = row[order], lang[order], logs[order]
    first = np.searchsorted(row, np.arange(len(entries) + 1))
    top = np.maximum(np.maximum.reduceat(logs, first[:-1]), absent.max()) if len(entries) else np.zeros(0)  # a counted value is above its own constant
    return entries, LogTable(absent[None], np.array([len(entries)]), top, first, lang, (logs - top[row]).astype(np.float32))


def _one_after_another(tables: list[LogTable]) -> LogTable:
    starts = np.cumsum([0, *(len(x.values) for x in tables)])
    first = np.concatenate([*(x.first[:-1] + at for x, at in zip(tables, starts, strict=False)), starts[-1:]])
    joined = {k: np.concatenate([getattr(x, k) for x in tables]) for k in ("absent", "top", "langs", "values")}
    return LogTable(ends=np.cumsum([x.ends[-1] for x in tables]), first=first, **joined)


@dataclass
class LanguageModel:
    """Log probabilities by language of each known word, and of each n-gram of a length (from 1)."""

    languages: list[str]
    words: np.ndarray  # sorted 64-bit hashes
    word_entries: np.ndarray
    word_table: LogTable
    grams: list[dict[str, int]]
    gram_table: LogTable
    prior: np.ndarray

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of lower-case words of letters; an unseen word's is the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.languages)))
        hashes = _hashes(words)
        row = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        known = self.words[row] == hashes if len(self.words) else np.zeros(len(words), bool)
        out[known] = self.word_table.dense(self.word_entries[row[known]])
        places, hits, owners = [], [], []
        for at in np.flatnonzero(~known).tolist():
            word = words[at]
            for n in range(min(MAX_GRAM, len(word) + 2), 0, -1):
                grams, edged = self.grams[n - 1], _edged(word, n)
                found = [g for i in range(len(edged) - n + 1) if (g := grams.get(edged[i : i + n])) is not None]
                if found:
                    places.append(at)
                    owners.append(len(found))
                    hits += found
                    break
        owner, entry = np.repeat(places, owners).astype(np.int64), np.array(hits, np.int64)
        step = max(1, CELLS // max(1, len(self.languages)))
        for start in range(0, len(entry), step):  # a long word's n-grams may fill several steps
            own = owner[start : start + step]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[starts]] += np.add.reduceat(self.gram_table.dense(entry[start : start + step]), starts, axis=0, dtype=np.float64)
        if places:
            out[places] /= np.array(owners)[:, None]
        return out


def learn(rows: Iterable[tuple[str, str]]) -> LanguageModel:
    """The model of (text, language) pairs."""
    words: dict[str, Counter] = {}
    documents: Counter = Counter()
    for text, lang in rows:
        documents[lang] += 1
        words.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
    return build(words, documents)


def build(bags: dict[str, Counter], documents: dict[str, int]) -> LanguageModel:
    """The model of the words and the number of documents of each language."""
    languages = sorted(documents)
    words = {i: bags.get(lang, Counter()) for i, lang in enumerate(languages)}
    grams: list[dict[str, int]] = []
    tables: list[LogTable] = []
    offset = 0
    for n in range(1, MAX_GRAM + 1):
        counts: dict[int, Counter] = {}
        for i, bag in words.items():
            own = counts[i] = Counter()
            for word, times in bag.items():
                edged = _edged(word, n)
                for k in range(len(edged) - n + 1):
                    own[edged[k : k + n]] += times
        place, table = _log_table(counts, len(languages))
        grams.append({k: offset + v for k, v in place.items()})
        offset += len(place)
        tables.append(table)
    prior = np.log(np.array([documents[lang] + 1.0 for lang in languages]) / (sum(documents.values()) + len(languages)))
    known, word_table = _log_table(words, len(languages))
    hashes = _hashes(list(known))
    order = np.argsort(hashes)
    return LanguageModel(languages, hashes[order], order, word_table, grams, _one_after_another(tables), prior)


def sample(df: DataFrame, learn_from: Column, id_col: str, text_col: str, lang_col: str, per_lang: int, max_rows: int) -> DataFrame | None:
    """lang and text of at most per_lang distinct documents of each language, by a hash of id and text; None without any.

    A hash limit draws about twice as many, equal rows become one, and a rank cuts to the
    bound: so no number of null ids or repeated rows makes the sample larger.
    """
    fit = df.where(learn_from & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    fit = only(fit, id=id_col, text=text_col, lang=lang_col).select("lang", "text", F.xxhash64("id", "text").alias("h"))
    counts = {r.lang: r.n for r in fit.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return None
    unit, most = 1 << 30, max(1, min(per_lang, max_rows // len(counts)))
    shares = df.sparkSession.createDataFrame([(lang, int(min(unit, 2 * unit * most / max(n, 1)))) for lang, n in sorted(counts.items())], "lang string, share long")
    drawn = fit.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(unit)) < F.col("share"))  # a row for each language
    once = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= most).select("lang", "text")


def _count_words(rows: DataFrame, slice_bytes: int = 4 << 20) -> DataFrame:
    """lang, word and n; the word null counts documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, slice_bytes):
            bags: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                bag = bags.setdefault(lang, Counter())
                bag[None] += 1
                bag.update(_LETTERS.findall((text or b"").decode("utf-8", "replace").lower()))
            found = [(lang, word, n) for lang, bag in bags.items() for word, n in bag.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    return rows.mapInArrow(work, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: tuple[str, str] = ("lang_pred", "score"), slice_bytes: int = 2 << 20) -> DataFrame:
    """Per row: the id, the ``keep`` columns as they are, and under the names ``out`` the language and its score (0 to 1: the share of the best language).

    The model, bounded by its sample, is broadcast once.
    """
    width = len(model.languages)
    sent_model = df.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c != id_col)
    sent = {id_col: id_col, **{c: c for c in keep}} | ({} if text_col in keep else {"__text": text_col})
    text_at = list(sent.values()).index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent_model.value
        place: dict[bytes, int] = {}
        most = max(2, min(MEMO, MEMO_CELLS // max(1, width)))
        table = np.zeros((most + 1, width), np.float32)
        lettered = np.zeros(most + 1, bool)

        def learn_words(fresh: list[bytes]) -> None:
            start = len(place)
            parts = [[w.decode()] if w.isalpha() else _LETTERS.findall(w.decode("utf-8", "replace").lower()) for w in fresh]
            every = list(dict.fromkeys(p for own in parts for p in own))
            row = {p: i for i, p in enumerate(every)}
            rows = np.vstack((model.rows(every), np.zeros((1, width))))
            single = [row[own[0]] if own else len(every) for own in parts]
            table[start : start + len(fresh)] = rows[single]
            for i, own in enumerate(parts):
                if len(own) > 1:
                    table[start + i] = sum(rows[row[p]] for p in own)
            lettered[start : start + len(fresh)] = [bool(own) for own in parts]
            place.update(zip(fresh, range(start, start + len(fresh)), strict=True))

        for batch, texts in slices(batches, slice_bytes, text_at):
            langs, scores = [], []
            split = [(t or b"").translate(_CLEAN).split() for t in texts]
            fresh: set[bytes] = set()
            for words in split:
                fresh.update(words)
            fresh.difference_update(place)
            # all at once where the memo takes them, else run by run
            if whole := len(place) + len(fresh) <= most:
                learn_words(list(fresh))
            for words in split:
                total, letters = model.prior.copy() if width else np.zeros(0), False
                for start in range(0, len(words), most // 2):  # a run's words always fit the memo
                    run = words[start : start + most // 2]
                    if not whole:
                        new = set(run).difference(place)
                        if len(place) + len(new) > most:
                            place.clear()
                            new = set(run)
                        learn_words(list(new))
                    at = np.fromiter(map(place.__getitem__, run), np.int64, len(run))
                    total = total + table[at].sum(axis=0, dtype=np.float64) if width else total
                    letters = letters or bool(lettered[at].any())
                if not letters or not width:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total))
                langs.append(model.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(batch.column(1 + i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[id_col, *keep, *out],
            )

    schema = ", ".join([f"`{id_col}` {id_field(df, id_col)}", *(f"`{c}` {id_field(df, c)}" for c in keep), f"`{out[0]}` string", f"`{out[1]}` double"])
    return only(df, **sent).mapInArrow(work, schema)


def fit(df: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1_500, max_rows: int = 60_000) -> LanguageModel:
    """The model of a bounded sample of the rows that satisfy learn_from."""
    chosen = sample(df, learn_from, id_col, text_col, lang_col, per_lang, max_rows)
    bags: dict[str, Counter] = {}
    documents: dict[str, int] = {}
    if chosen is not None:
        for batch in _count_words(chosen).toArrow().to_batches():
            langs = batch.column(0).dictionary_encode()
            names = langs.dictionary.to_pylist()
            for at, word, n in zip(langs.indices.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if word is None:
                    documents[names[at]] = n
                else:
                    bags.setdefault(names[at], Counter())[word] = n
    model = build(bags, documents)
    forget(df.sparkSession)
    return model
