"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries (``units``), which no token of a word tokenizer crosses, the
fragments that were not met before are encoded in batches balanced by bytes, and a text's
length is the sum over its fragments, so a fragment that repeats is encoded once per worker
and memo generation. A text above ``PART_BYTES`` is taken part by part, each ending at white
space, and a fragment above ``FRAGMENT_BYTES`` without white space is cut between letters and
marks. What remains whole is what the library itself can't cut: a run of letters alone, a
long fragment outside ASCII, or one that may hold a special string. Beside the memo a worker
holds the fragments of one slice or part.

Null text counts as empty: no bytes, no tokens. Empty tables give empty results; repeated
rows give repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.common import id_field, only, slices

#: Trailing characters that a word tokenizer always cuts from a run of letters. No apostrophe: it joins contractions.
_TAIL = b".,;:!?#*$%&|<>()[]{}\"-+=/~^@_`\\"
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in _PRINTED)} | {32: 32}
#: Letters below this one are the same in all normal forms.
_PLAIN = "\u0250"
#: Fragments that a memo holds before it starts anew.
MEMO = 350_000
#: Bytes of fragments in one call of the encoder.
BATCH_BYTES = 64 << 10


#: A stop or comma before white space that does not directly follow a letter (ASCII, or one of U+00C0 to U+00FF).
_LOOSE = re.compile(rb"(?<![A-Za-z])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,](?=[ \n])")


#: Bytes from which on a text is taken in parts, and a fragment is cut inside.
PART_BYTES, FRAGMENT_BYTES = 2 << 20, 16 << 10
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Between a letter and a mark or digit; next to an apostrophe it might cut a contraction.
_INSIDE = re.compile(rb"(?<=[A-Za-z])(?=[^A-Za-z'])|(?<=[^A-Za-z'])(?=[A-Za-z])")


def parts(text: bytes | None, limit: int = PART_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes that end before white space."""
    text, at = text or b"", 0
    while at < len(text):
        end = _SPACE.search(text, at + limit)
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


def _cut(fragments: list[bytes], limit: int) -> list[bytes]:
    if max(map(len, fragments), default=0) <= limit:
        return fragments
    return [x for f in fragments for x in (_INSIDE.split(f) if len(f) > limit and f.isascii() and b"<|" not in f else [f])]


def units(text: bytes | None, limit: int = FRAGMENT_BYTES) -> list[bytes]:
    """The text cut at safe boundaries: white space and, where each follows a letter, stops and commas before it.

    A word tokenizer cuts runs of letters from the marks behind them and ignores case, so the
    units' ids, one after the other, are the text's. Texts that may hold a special string, or
    marks that could belong to a longer run, are cut at white space alone. Fragments above
    ``limit`` bytes are cut inside.
    """
    if not text:
        return []
    if b"<|" in text or _LOOSE.search(text):
        return _cut(text.split(), limit) if len(text) > limit else text.split()
    text = text.lower()
    for mark in (b".", b","):
        for space in (b" ", b"\n"):
            text = text.replace(mark + space, b" " + mark + space)
    return _cut(text.split(), limit) if len(text) > limit else text.split()


class WordEncoder:
    """Ids of white-space separated words, by a tokenizers file whose tokens never cross white space.

    ``ids`` maps a word (bytes, as it stands in the text) to its ids, little-endian unsigned
    32-bit. Special strings inside words are handled as the library does by default.

    Plain runs of letters are encoded many at a time, joined by spaces: the token that ends a
    word is marked as such in the vocabulary, which gives each run its share of the ids.
    Should the number of word ends not match, the runs are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        vocabulary = self.encoder.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[at for word, at in vocabulary.items() if word.endswith("</w>")]] = True
        # for runs that are normal already: the same model, cut at spaces only
        self.plain = Tokenizer(self.encoder.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.ids: dict[bytes, bytes] = {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Make ``ids`` hold all of words, of which there may be more than the memo keeps."""
        ids = self.ids
        if len(ids) > MEMO:
            ids.clear()
        made, plain, other = [], set(), set()
        for word in words:
            if word in ids:
                continue
            if word.isalpha():  # ASCII letters
                core, tail = word.lower(), b""
                plain.add(core)
            else:
                core = word.rstrip(_TAIL)
                low, tail = core.decode("utf-8", "replace").lower(), word[len(core) :]
                if not low.isalpha() or max(low) >= _PLAIN:
                    other.add(word)
                    continue
                core = low.encode()
                plain.add(core)
                if tail:
                    other.add(tail)
            if tail or core != word:
                made.append((word, core, tail))
        self._encode([x for x in other if x not in ids])
        self._encode_joined([x for x in plain if x not in ids])
        for word, core, tail in made:
            ids[word] = ids[core] + ids[tail] if tail else ids[core]

    def _encode(self, fragments: list[bytes]) -> None:
        for batch in _balanced(fragments):
            for fragment, got in zip(batch, self.encoder.encode_batch_fast([x.decode("utf-8", "replace") for x in batch], add_special_tokens=False), strict=True):
                found = got.ids
                self.ids[fragment] = struct.pack(f"<{len(found)}I", *found)

    def _encode_joined(self, fragments: list[bytes]) -> None:
        for batch in _balanced(fragments):
            groups = [batch[i : i + 256] for i in range(0, len(batch), 256)]
            for group, got in zip(groups, self.plain.encode_batch_fast([b" ".join(g).decode("latin-1").translate(_BYTE_LEVEL) for g in groups], add_special_tokens=False), strict=True):
                found = np.array(got.ids, "<u4")
                stops = (4 * (np.flatnonzero(self.ends[found]) + 1)).tolist()
                if len(stops) == len(group):
                    data = found.tobytes()
                    self.ids.update(zip(group, (data[i:j] for i, j in zip([0, *stops], stops, strict=False)), strict=True))
                else:
                    self._encode(group)


def _balanced(fragments: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of fragments of about BATCH_BYTES."""
    batch, load = [], 0
    for fragment in fragments:
        if batch and load + len(fragment) > BATCH_BYTES:
            yield batch
            batch, load = [], 0
        batch.append(fragment)
        load += len(fragment)
    if batch:
        yield batch


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_counts(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2 << 20) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    ``slice_bytes`` bounds the text bytes that a worker splits into words at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch, texts in slices(batches, slice_bytes):
            n = np.zeros(len(texts), np.int64)
            # a long text is a slice of its own: its parts one after the other; else all texts of the slice at once
            long = len(texts) == 1 and len(texts[0] or b"") > PART_BYTES
            for group in ([p] for p in parts(texts[0])) if long else (texts,):
                split = [units(x) for x in group]
                # the memo may be emptied when it is full, so all units are learnt, known or not
                known.learn(set().union(*split))
                at = known.ids.__getitem__
                n += np.fromiter((sum(map(len, map(at, words))) >> 2 for words in split), np.int64, len(split))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"`{id_col}` {id_field(df, id_col)}, n_bytes long, n_tokens long, over_limit boolean"
    return only(df, **{id_col: id_col, "__text": text_col}).mapInArrow(count, schema)
