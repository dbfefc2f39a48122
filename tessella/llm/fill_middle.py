"""Fill-in-middle transformation by displacement scatter (operator 12).

The texts of a batch stand one behind the other as bytes. A scan finds the line
ends and from them each text's two cuts. Prefix, middle and suffix move as
wholes, so the shift from a byte's place to its place in the output is constant
within them: a difference array holds the jumps where a part begins, its
cumulative sum is every byte's own shift, and one scatter builds all outputs.
Restoring finds the three marks of each output, forms the shifts of the inverse
in the same way and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import small_batches, text_or_empty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of texts that are put together at once, and bytes whose shifts are held at once.
BATCH, WINDOW = 4 << 20, 1 << 20
_MARK = 3


def _shifts(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, place) for each window of size bytes; place: where each byte goes or comes from.

    starts: where parts begin, in order, an empty part at the start of the next
    one; shifts: what to add within each part.
    """
    jumps, carry = np.diff(shifts, prepend=0), 0
    for a in range(0, size, WINDOW):
        b = min(a + WINDOW, size)
        lo, hi = np.searchsorted(starts, [a, b])
        steps = np.zeros(b - a, np.int64)
        np.add.at(steps, starts[lo:hi] - a, jumps[lo:hi])
        steps[0] += carry
        shift = np.cumsum(steps)
        carry = int(shift[-1])
        yield a, b, shift + np.arange(a, b)


def _marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the marks stand in data, and in which text each stands; none spans two texts."""
    open_ = np.flatnonzero(data[:-2] == 60) if len(data) > 2 else np.empty(0, np.int64)
    inner = data[open_ + 1]
    at = open_[(data[open_ + 2] == 62) & ((inner == 80) | (inner == 83) | (inner == 77))]
    of = np.searchsorted(ends, at, "right")
    inside = at + _MARK <= ends[of] if len(at) else np.empty(0, bool)
    return at[inside], of[inside]


def _laid_out(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum([len(x) for x in bodies], dtype=np.int64)
    return data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def transformed(bodies: list[bytes], h: np.ndarray, rate: int, spm: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text; h: its four numbers, a row each."""
    data, starts, ends = _laid_out(bodies)
    size = ends - starts
    lines = np.flatnonzero(data == 10)
    before, upto = np.searchsorted(lines, starts), np.searchsorted(lines, ends)
    open_end = (size > 0) & (data[np.maximum(ends - 1, 0)] != 10) if len(data) else np.zeros(len(bodies), bool)
    n = upto - before + open_end

    def cut(unit: np.ndarray) -> np.ndarray:
        """Where so many units of each text end."""
        at = np.append(lines, 0)[np.minimum(before + np.maximum(unit, 1) - 1, len(lines))] + 1
        return np.where(unit == 0, starts, np.where(unit == n, ends, at))

    drawn = h[:, :2] % (n + 1)[:, None]
    one, two = cut(drawn.min(1)), cut(drawn.max(1))
    marked = np.zeros(len(bodies), bool)
    marked[_marks(data, starts, ends)[1]] = True
    plain = (size == 0) | marked | (h[:, 2] % 100 >= rate)
    is_spm = ~plain & (h[:, 3] % 100 < spm)
    one, two = np.where(plain, ends, one), np.where(plain, ends, two)
    out_size = size + np.where(plain, 0, 3 * _MARK)
    out_ends = np.cumsum(out_size)
    begin = out_ends - out_size
    prefix, suffix = one - starts, ends - two
    # Where prefix, middle and suffix begin in the output, each behind its mark.
    to_prefix = begin + np.where(plain, 0, np.where(is_spm, 2 * _MARK + suffix, _MARK))
    to_suffix = begin + np.where(is_spm, _MARK, 2 * _MARK + prefix)
    to_middle = begin + 3 * _MARK + prefix + suffix
    out = np.empty(int(out_ends[-1]), np.uint8)
    for mark, at in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for i, byte in enumerate(mark):
            out[at[~plain] - _MARK + i] = byte
    part = np.stack([starts, one, two], 1).ravel()
    shift = np.stack([to_prefix - starts, to_middle - one, to_suffix - two], 1)
    shift = np.where(plain[:, None], (begin - starts)[:, None], shift).ravel()
    for a, b, place in _shifts(part, shift, len(data)):
        out[place] = data[a:b]
    view = out.tobytes()
    chars = lambda a, b: int(np.count_nonzero(data[a:b] & 0xC0 != 0x80))
    return [
        (int(n[i]), "plain", None, None, view[begin[i] : out_ends[i]]) if plain[i]
        else (int(n[i]), "spm" if is_spm[i] else "psm", chars(starts[i], one[i]), chars(one[i], two[i]), view[begin[i] : out_ends[i]])
        for i in range(len(bodies))
    ]


def restored(outputs: list[bytes], forms: list[str]) -> list[bytes]:
    """The texts again, from outputs and forms alone."""
    data, starts, ends = _laid_out(outputs)
    moved = np.array([f != "plain" for f in forms], bool)
    is_spm = np.array([f == "spm" for f in forms], bool)
    at, of = _marks(data, starts, ends)
    at = at[moved[of]]
    if len(at) != 3 * moved.sum() or not np.array_equal(of[moved[of]], np.repeat(np.flatnonzero(moved), 3)):
        raise ValueError("an output does not hold its three marks once each")
    first, second, third = np.zeros((3, len(outputs)), np.int64)
    first[moved], second[moved], third[moved] = at.reshape(-1, 3).T if len(at) else np.empty((3, 0), np.int64)
    size = ends - starts - np.where(moved, 3 * _MARK, 0)
    to_end = np.cumsum(size)
    to = to_end - size
    from_prefix = np.where(is_spm, second, first) + _MARK
    from_suffix = np.where(is_spm, first, second) + _MARK
    prefix = np.where(is_spm, third - second, second - first) - _MARK
    middle = ends - third - _MARK
    part = np.stack([to, np.where(moved, to + prefix, to_end), np.where(moved, to + prefix + middle, to_end)], 1)
    shift = np.stack([from_prefix, third + _MARK, from_suffix], 1) - part
    shift = np.where(moved[:, None], shift, (starts - to)[:, None])
    out = np.empty(int(to_end[-1]), np.uint8)
    for a, b, place in _shifts(part.ravel(), shift.ravel(), len(out)):
        out[a:b] = data[place]
    view = out.tobytes()
    return [view[a:b] for a, b in zip(to, to_end, strict=True)]


def _pieces(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of at most BATCH bytes together, or one longer row."""
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if i > at and held + size > BATCH:
            yield slice(at, i)
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield slice(at, len(sizes))


_OUT = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.BinaryType())])


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of `seed:doc_id`; of a null id, of `seed:`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (UTF-8) for every row of docs.

    rate: per cent of texts that are transformed; spm: per cent of these with
    the suffix first. A null text is empty; empty texts and those that hold a
    mark stay plain. A text of one line has cuts at its ends only. Rows that
    repeat a doc_id are cut alike if their texts are; rows without one draw
    from the seed alone. Empty table: no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(_OUT)
    def scattered(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for body, *numbers in batches:
            texts, h, rows = body.tolist(), np.stack([x.to_numpy(np.int64) for x in numbers], 1), []
            for piece in _pieces([len(x) for x in texts]):
                rows += transformed(texts[piece], h[piece], rate, spm)
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"n": n, "form": form, "prefix_chars": pd.Series(prefix, dtype="Int64"), "middle_chars": pd.Series(middle, dtype="Int64"), "output": output})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.encode(text_or_empty(text), "UTF-8").alias("body"))
    return rows.select("doc_id", scattered("body", *drawn(F.col("doc_id"), seed)).alias("out")).select("doc_id", "out.*")


def restored_text(output: str = "output", form: str = "form") -> Column:
    """The text (UTF-8) that an output and its form stand for."""

    @F.pandas_udf("binary")
    def gathered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            outputs, forms, texts = outputs.tolist(), forms.tolist(), []
            for piece in _pieces([len(x) for x in outputs]):
                texts += restored(outputs[piece], forms[piece])
            yield pd.Series(texts, dtype=object)

    return gathered(output, form)
