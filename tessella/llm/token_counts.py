"""Token counts by prefix dynamic programming (operator 7).

For a BPE vocabulary whose merges are ordered by the resulting piece, the
encoding of a prefix is the encoding of a shorter prefix plus one piece: of all
pieces that end here, exactly one fits the last piece of the prefix before it,
that is, the two are encoded as these two pieces. So the count at each prefix is
the count before its last piece plus one, and one pass gives them all.

No piece has a space after another character, so a run of spaces with the word
behind it is encoded on its own, and the counts of words add up. Likewise a word
falls into parts at each pair of neighbours that stands in no piece, as letters
and most signs behind them.

The counts are stored as their differences, one signed byte a character; a
count at a prefix is a sum over this store, and truncation and budget questions
need no encoder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.byte_bpe import ship
from tessella.llm.common import small_batches, text_or_empty

SPACE = "▁"
#: Bytes of words kept with their counts in a Python worker, about; longer words than LONG are not kept.
KEPT_BYTES, LONG = 160 << 20, 64
#: Bytes of pairs of pieces whose fit is kept, about; bytes that an entry has besides its characters.
PAIR_BYTES, ENTRY_BYTES = 80 << 20, 200
NORMAL, BYTE = 1, 6


class _Known(dict):
    """Words and their differences; finds what is missing, keeps short words and starts anew at KEPT_BYTES."""

    def __init__(self, find):
        super().__init__()
        self.find, self.held = find, 0

    def __missing__(self, word: str) -> bytes:
        found = self.find(word)
        if len(word) <= LONG:
            if self.held > KEPT_BYTES:
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + 4 * len(word) + len(found)
            self[word] = found
        return found


class PrefixCounts:
    """The counts of a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        pieces = [p for p in proto.pieces if p.type == NORMAL]
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without normalisation is asked for")
        if any(p.type not in (1, 2, 3, BYTE) for p in proto.pieces) or any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in pieces):
            raise ValueError("pieces must neither be user-defined nor span words")
        self.score = {p.piece: p.score for p in pieces}
        # A prefix has at most 4 tokens a character of its last piece fewer than the one before it.
        if 4 * max(map(len, self.score), default=1) > 128:
            raise ValueError("pieces of over 32 characters do not fit the store's signed bytes")
        self.fallback = train.byte_fallback
        self.dummy = norm.add_dummy_prefix
        self.fits: dict[tuple[str, str], bool] = {}
        self.fits_held = 0
        #: All pairs of characters within pieces: nothing merges across another pair.
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # Letters, without the few number signs that would spoil the split of letters and signs.
        numbers = "".join({p[0] for p in self.joined if p[0].isnumeric() and not p[0].isdecimal()})
        letter = rf"[^\W\d_{re.escape(numbers)}]"
        signs = (c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(p[1] == c and re.match(letter, p[0]) for p in self.joined))
        after = "".join(map(re.escape, signs))
        split = f"{SPACE}*{letter}++(?=[{after}])|" if after else ""
        self.words = re.compile(f"{split}{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.parts = _Known(self.part_differences)
        self.known = _Known(self.differences)

    def encode(self, word: str) -> list[str]:
        """The word's pieces by merging, the best score first and the leftmost of equals."""
        parts, score = list(word), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair_fits(self, left: str, right: str) -> bool:
        """The two are encoded as these two; with an empty left, right as itself."""
        if self.fits_held > PAIR_BYTES:
            self.fits.clear()
            self.fits_held = 0
        self.fits_held += ENTRY_BYTES + 4 * len(left + right)
        known = self.fits[left, right] = self.encode(left + right) == [p for p in (left, right) if p]
        return known

    def counts(self, word: str) -> list[int]:
        """The token count of each prefix of the word, of one character and more."""
        last, count = [""] * (len(word) + 1), [0] * (len(word) + 1)
        score, fits = self.score, self.fits.get
        for end in range(1, len(word) + 1):
            start = end - 1
            while True:
                piece = word[start:end]
                if piece in score or start == end - 1:
                    good = fits((last[start], piece))
                    if self.pair_fits(last[start], piece) if good is None else good:
                        break
                start -= 1
            last[end] = piece
            count[end] = count[start] + (1 if piece in score or not self.fallback else len(piece.encode("utf-8")))
        return count[1:]

    def differences(self, word: str) -> bytes:
        """The differences of a word's counts, from those of its parts that no piece spans."""
        if word.lstrip(SPACE).isalpha():
            return self.part_differences(word)
        out, start, joined, parts = [], 0, self.joined, self.parts
        for i in range(1, len(word) + 1):
            if word[i - 1 : i + 1] not in joined:  # at the end too
                out.append(parts[word[start:i]])
                start = i
        return b"".join(out)

    def part_differences(self, part: str) -> bytes:
        counts = self.counts(part)
        return bytes([n - before & 255 for n, before in zip(counts, [0, *counts], strict=False)])

    def store(self, text: str) -> bytes:
        """Differences of the counts at the text's prefixes, a signed byte a character (and one for the prefixed space)."""
        if not text:
            return b""
        words = self.words.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))
        return b"".join(map(self.known.__getitem__, words))


def prefix_counts(store: bytes) -> np.ndarray:
    """The token count at each stored prefix."""
    return np.cumsum(np.frombuffer(store, np.int8), dtype=np.int64)


def longest_prefix(store: bytes, budget: int, dummy: bool = True) -> int:
    """Characters of the longest prefix of the text with at most budget tokens."""
    fitting = np.flatnonzero(prefix_counts(store) <= budget)
    return max(0, int(fitting[-1]) + 1 - dummy) if len(fitting) else 0


@lru_cache(maxsize=2)
def _loaded(name: str) -> PrefixCounts:
    with open(SparkFiles.get(name), "rb") as f:
        return PrefixCounts(f.read())


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, counts (the store) for every row of docs.

    Special strings are ordinary text; no begin, end or padding. Null and empty
    texts have no tokens. Rows that repeat stand each; empty table: no rows;
    other columns are not read. Long words take time in proportion to their
    length.
    """
    small_batches(docs.sparkSession)
    name = ship(docs.sparkSession, model_path)

    @F.pandas_udf("n_tokens long, counts binary")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _loaded(name)
        for texts in batches:
            stores = [model.store(t) for t in texts]
            totals = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in stores]
            yield pd.DataFrame({"n_tokens": totals, "counts": pd.Series(stores, dtype=object)})

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body"))
    rows = rows.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), counted("body").alias("counted"))
    return rows.select("doc_id", "n_bytes", "counted.n_tokens", "counted.counts")


def cut_to_budget(counted: DataFrame, budget: int) -> DataFrame:
    """counted with fitting_chars: how much of each text budget tokens can hold, from the store alone."""

    @F.pandas_udf("long")
    def fitting(stores: pd.Series) -> pd.Series:
        return pd.Series([longest_prefix(s, budget) for s in stores], dtype="int64")

    return counted.withColumn("fitting_chars", fitting("counts"))
