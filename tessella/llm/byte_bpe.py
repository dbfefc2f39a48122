"""Byte-level BPE encoding and decoding (operator 8).

Pieces of a text are merged by a segment tree over their byte positions: each
leaf holds the rank of the pair that begins there, each inner node the leftmost
minimum below it. The root names the next merge; the merge changes the leaves
of the pair's live neighbours, and each change climbs one path. The trees of
many pieces of like length stand side by side in one array and climb together;
a piece with few of its kind has a tree of its own.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import small_batches, text_or_empty

#: Bytes of pieces and ids kept in a Python worker, each with what Python's objects take beside; longer ones than LONG characters are not kept.
KEPT_BYTES, OBJECT_BYTES, LONG = 24 << 20, 190, 64
#: Texts of more characters are split piece by piece, CHUNK pieces at a time, so that their pieces are never all in memory.
LONG_TEXT, CHUNK = 1 << 20, 100_000
#: From so many pieces of like length on, their trees climb side by side.
SIDE_BY_SIDE = 8


class ByteBPE:
    """The encoder and decoder of a file of ranks (base64 token, rank a line)."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.tokens: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        # White space of Unicode; the regular-expression library's own class holds four control characters more.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        top = max(self.tokens.values(), default=-1) + 1
        self.by_id: list[bytes] = [b""] * top
        for token, rank in self.tokens.items():
            self.by_id[rank] = token
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = self.tokens.get(bytes([b]), -1)
        pairs: dict[int, int] = {}
        for token, rank in self.tokens.items():
            for cut in range(1, len(token)):
                left, right = self.tokens.get(token[:cut]), self.tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        #: Leaves that are no pair have this rank, one above every other; a leaf then fits 64 bits at any length.
        self.none = np.int64(top)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(ranks[order], self.none)
        self.keys, self.ranks = array("q", self.pair_keys.tobytes()), array("q", self.pair_ranks.tobytes())
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none)

    def rank_of(self, left: int, right: int) -> int:
        key = left << 32 | right
        at = bisect_left(self.keys, key)
        return self.ranks[at] if self.keys[at] == key else int(self.none)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. Pieces of like length share an array of trees."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            sizes.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for bits, chosen in sizes.items():
            for start in range(0, len(chosen), step := max(1, (1 << 20) >> bits)):
                some = chosen[start : start + step]
                if len(some) < SIDE_BY_SIDE:
                    for i in some:
                        out[i] = self._merge_alone(pieces[i], 1 << bits)
                    continue
                for i, ids in zip(some, self._merge_side_by_side([pieces[i] for i in some], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge_alone(self, piece: bytes, width: int) -> np.ndarray:
        n, none = len(piece), int(self.none)
        token = array("q", self.single[np.frombuffer(piece, np.uint8)].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        leaf = np.full(width, none, np.int64)
        tokens = np.frombuffer(token, np.int64)
        leaf[: n - 1] = self.ranks_of(tokens[:-1], tokens[1:])
        levels = [leaf * width + np.arange(width)]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tobytes())
        del levels, leaf, tokens

        def put(at: int, rank: int) -> None:
            node = at + width
            tree[node] = rank * width + at
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while tree[1] < none * width:
            best, at = divmod(tree[1], width)
            gone = after[at]
            follow = after[gone]
            token[at], token[gone], after[at] = best, -1, follow
            if follow < n:
                before[follow] = at
            put(gone, none)
            put(at, self.rank_of(best, token[follow]) if follow < n else none)
            left = before[at]
            if left >= 0:
                put(left, self.rank_of(token[left], best))
        ids = np.frombuffer(token, np.int64)
        return ids[ids >= 0].copy()

    def _merge_side_by_side(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n, none = len(pieces), self.none
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        live = np.arange(width) < length[:, None]
        token = np.where(live, self.single[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()  # the next live position
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        # A leaf is rank * width + position, so the least is the leftmost of the least rank.
        tree = np.full((n, 2 * width), none * width, np.int64)
        rank = np.full((n, width), none, np.int64)
        rank[:, :-1] = np.where(live[:, 1:], self.ranks_of(token[:, :-1], token[:, 1:]), none)
        tree[:, width:] = rank * width + np.arange(width)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] < none * width)
        while len(rows):
            best, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            follow = after[rows, gone]
            token[rows, at], live[rows, gone] = best, False
            after[rows, at] = follow
            inner = follow < length[rows]
            before[rows[inner], follow[inner]] = at[inner]
            fresh = np.full(len(rows), none, np.int64)
            fresh[inner] = self.ranks_of(best[inner], token[rows[inner], follow[inner]])
            self._put(tree, rows, gone, np.full(len(rows), none, np.int64), width)
            self._put(tree, rows, at, fresh, width)
            left = before[rows, at]
            has = left >= 0
            self._put(tree, rows[has], left[has], self.ranks_of(token[rows[has], left[has]], best[has]), width)
            rows = rows[tree[rows, 1] < none * width]
        flat, counts = token[live], live.sum(1)
        return np.split(flat, np.cumsum(counts)[:-1])

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> None:
        """A point update in each row's tree."""
        node = at + width
        tree[rows, node] = rank * width + at
        while node.size and node[0] > 1:  # all are on one level
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The pieces' ids as little-endian unsigned 32-bit integers; short ones are kept."""
        raw = {p: p.encode("utf-8") for p in pieces}
        found = {p: int(self.tokens[b]).to_bytes(4, "little") for p, b in raw.items() if b in self.tokens}
        rest = [p for p in pieces if p not in found]
        for p, ids in zip(rest, self.merge([raw[p] for p in rest]), strict=True):
            found[p] = ids.astype("<u4").tobytes()
        kept = {p: ids for p, ids in found.items() if len(p) <= LONG}
        size = sum(len(p) + len(ids) + OBJECT_BYTES for p, ids in kept.items())
        if self.known_bytes + size > KEPT_BYTES:
            self.known, self.known_bytes = {}, 0
        self.known.update(kept)
        self.known_bytes += size
        return found

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        known = self.known
        new = set().union(*split) - known.keys()
        if new:
            found = self.learn(new)
            if known is not self.known or any(len(p) > LONG for p in found):  # what was forgotten or is never kept serves this call
                known = known | found
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        long = [i for i, t in enumerate(texts) if len(t) > LONG_TEXT]
        out = self._joined([[] if len(t) > LONG_TEXT else self.pattern.findall(t) for t in texts])
        for i in long:
            whole, found = bytearray(), self.pattern.finditer(texts[i])
            while part := [m[0] for m in islice(found, CHUNK)]:
                whole += self._joined([part])[0]
            out[i] = bytes(whole)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _loaded(name: str, pattern: str) -> ByteBPE:
    with open(SparkFiles.get(name), "rb") as f:
        return ByteBPE(f.read().splitlines(), pattern)


def ship(spark, path: str) -> str:
    """Sends a small vocabulary file to every executor; returns its name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids for every row of docs; ids: binary, little-endian unsigned 32-bit.

    Each match of pattern is encoded on its own; special tokens are ordinary
    text. Null and empty texts have no ids. Long texts and long pieces are
    encoded whole, in n log n steps. Rows that repeat stand each; empty table:
    no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    name = ship(docs.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(name, pattern)
        for texts in batches:
            yield pd.Series(bpe.encode_batch(texts.tolist()), dtype=object)

    return docs.select(F.col(doc_id).alias("doc_id"), ids_of(text_or_empty(text)).alias("ids"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded with the column decoded: the bytes that the ids stand for; null ids have null."""
    name = ship(encoded.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(name, pattern)
        for ids in batches:
            yield pd.Series([None if x is None else bpe.decode(x) for x in ids], dtype=object)

    return encoded.withColumn("decoded", bytes_of("ids"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded: encode and decode in one pass, with one vocabulary a worker; see encode for odd rows."""
    small_batches(docs.sparkSession)
    name = ship(docs.sparkSession, ranks_path)

    @F.pandas_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _loaded(name, pattern)
        for texts in batches:
            ids = bpe.encode_batch(texts.tolist())
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([bpe.decode(x) for x in ids], dtype=object)})

    out = docs.select(F.col(doc_id).alias("doc_id"), both(text_or_empty(text)).alias("both"))
    return out.select("doc_id", "both.ids", "both.decoded")
