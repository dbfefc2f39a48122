"""MinHash near-dedup by weighted shingles (operator 9).

Documents are multisets of five-word shingles. Improved consistent weighted
sampling draws ROWS * BANDS samples of each by its TF-IDF weights: 1 + ln(count
in the document) times an inverse document frequency between DAMP and 1.
Documents that share a band's samples are candidates, and a candidate pair
becomes a link only when its weighted Jaccard similarity, computed from both
whole texts, reaches the threshold. There a shingle weighs 1 + ln(count): the
threshold says how alike two texts are, whatever else the corpus holds. With
the inverse document frequency in it, thousands of near copies would stop being
near copies of each other, because what they share would be the commonest.

Recall of the bands. A pair of similarity s has a TF-IDF similarity of at least
s * DAMP / (s * DAMP + 1 - s), 0.667 at the threshold, if each shared shingle
stands in every document. It then shares a band with probability 0.996, and
with 0.99999 if the shared shingles are rare.

Document frequency. Only shingles in over RARE of all documents weigh less than
1 (before their count). The MOST_FREQUENT commonest shingles are broadcast, for
these weights and to order shingles by rarity; that bounds the table whatever
the corpus' size. The counts themselves are exact and made by a shuffle of all
shingles' hashes, packed in sorted blocks.

Groups. Documents with equal shingle multisets are one class at once and go on
as one representative. First each member of a bucket is compared with one hub,
the member that meets most others over all bands (an original meets more of its
copies than these meet each other). A bucket of two is settled by that. The
members of larger buckets that still hold several components draw LONG_ROWS *
LONG_BANDS further samples by their weights in the verification. Where texts
are made of shared blocks, nearly all share a short band with nearly all; a
long band tells a pair at the threshold, which it finds with probability
0.999, from one that has half in common, which it meets once in 500 times. In
buckets of long bands of at most SMALL members every pair of components is
compared; in larger ones the hub, and what is then still apart is settled by a
prefix-filter join on rare shingles (see _prefix_pairs), which passes no pair
at the threshold over. No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import persist, small_batches, text_or_empty

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 25
RARE, DAMP = 0.0005, 0.5
#: Bands of the second look at crowded buckets, bands drawn at once, and members up to which a long band's bucket is compared pair by pair.
LONG_ROWS, LONG_BANDS, LONG_AT_ONCE, SMALL = 16, 243, 16, 16
#: Document frequencies below this are not told apart.
FEWEST = 4
#: Entries of the table of frequent shingles that is broadcast, 16 bytes each.
MOST_FREQUENT = 1_000_000
#: Bytes of a text whose words are hashed at once, and of shingle vectors that a worker keeps.
WINDOW, KEPT_BYTES = 1 << 20, 16 << 20
#: Shingles that a task sorts at once.
BLOCK_SHINGLES = 1_000_000
SEED = 20_011
#: Shingles whose long bands are drawn together.
LONG_SHINGLES = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLE_BITS, _LONG_TABLE_BITS = 14, 12

_punct = bytes(b for b in range(127) if not chr(b).isalnum())
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _punct, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_punct))
_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as needed."""

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    place = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)

    def __init__(self):
        self.grow(1 << 17)

    def grow(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, np.uint64(b), np.uint64)])) for b in (self.base, self.inverse))


@lru_cache(maxsize=1)
def _rolling() -> _Rolling:
    return _Rolling()


def _word_hashes(codes: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = codes != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    roll = _rolling()
    if len(codes) > len(roll.up):
        roll.grow(2 * len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(roll.byte[codes] * roll.up[: len(codes)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * roll.down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the text's shingles, and their counts.

    Words are runs of characters other than ASCII white space and punctuation,
    A-Z lower-cased (all but white space if there are no others). A text with
    fewer words than a shingle is one shingle; one without words has none.
    """
    raw = text.encode("utf-8")
    codes = np.frombuffer(raw.translate(_FOLD), np.uint8)
    if not (codes != 32).any():
        codes = np.frombuffer(raw.translate(_SPACES), np.uint8)
    found, at = [], 0
    while at < len(codes):
        end = at + WINDOW
        if end < len(codes):  # a window ends at white space
            gaps = np.flatnonzero(codes[at:end] == 32)
            after = np.flatnonzero(codes[end:] == 32) if not len(gaps) else gaps
            end = at + int(gaps[-1]) + 1 if len(gaps) else end + int(after[0]) + 1 if len(after) else len(codes)
        found.append(_word_hashes(codes[at:end]))
        at = end
    word = np.concatenate(found) if found else np.empty(0, np.uint64)
    if not len(word):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = max(1, len(word) - words + 1)
    roll = _rolling()
    joined = np.zeros(n, np.uint64)
    for i in range(min(words, len(word))):
        joined += word[i : i + n] * roll.place[i % WORDS] + np.uint64(i)
    found = np.sort(_mix(joined))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], np.diff(np.append(first, n))


def _blocks(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Sorted blocks of hashes by their leading bits; hashes in byte planes, which compress well."""

    def flush(held: list[np.ndarray]) -> pd.DataFrame:
        every = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        value, count = every[first], np.diff(np.append(first, len(every)))
        rows = []
        for many in (False, True):
            some, n = value[(count > 1) == many], count[(count > 1) == many]
            block = (some >> np.uint64(64 - bits)).astype(np.int64)
            cuts = [*np.flatnonzero(np.diff(block, prepend=-1)), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((int(block[a]), some[a:b].view(np.uint8).reshape(-1, 8).T.tobytes(), n[a:b].astype(np.int32).tobytes() if many else b""))
        return pd.DataFrame(rows, columns=["block", "hashes", "counts"])

    held, size = [], 0
    for batch in batches:
        for text in batch["body"]:
            found = shingles(text)[0]
            held.append(found)
            size += len(found)
            if size > BLOCK_SHINGLES:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def _frequent_in(least: int):
    def frequent(rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = [], []
        for hashes, count in zip(rows["hashes"], rows["counts"], strict=True):
            value = np.ascontiguousarray(np.frombuffer(hashes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
            values.append(value)
            counts.append(np.frombuffer(count, np.int32) if count else np.ones(len(value), np.int32))
        value, count = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(value)
        value = value[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        total = np.add.reduceat(count[order].astype(np.int64), first)
        keep = total >= least
        return pd.DataFrame({"hash": value[first][keep].view(np.int64), "n": total[keep]})

    return frequent


def frequent_shingles(docs: DataFrame, n_bytes: int, text: str = "text", fewest: int = FEWEST) -> DataFrame:
    """hash, n: the exact document frequency of every shingle in at least fewest documents."""
    bits = min(24, max(7, (n_bytes // 6 // 1_000_000).bit_length()))
    blocks = docs.select(text_or_empty(text).alias("body")).mapInPandas(lambda it: _blocks(it, bits), "block long, hashes binary, counts binary")
    return blocks.groupBy("block").applyInPandas(_frequent_in(fewest), "hash long, n long")


def least_kept(counted: DataFrame) -> int:
    """The least frequency from which on at most MOST_FREQUENT shingles are left (frequencies over 1,024 in steps of doubling)."""
    n = F.col("n")
    step = F.when(n <= 1024, n).otherwise((1024 * F.pow(F.lit(2.0), F.floor(F.log2(n / 1024)))).cast("long"))
    left, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left += r["count"]
        if left > MOST_FREQUENT and r["step"] < 1024:
            return r["step"] + 1
        if left > MOST_FREQUENT:
            return 2 * r["step"] if least is None else least
        least = r["step"]
    return FEWEST


def by_count(counts: np.ndarray) -> np.ndarray:
    """Sublinear in the count, so that a passage repeated hundreds of times does not outweigh the rest of a text."""
    return 1.0 + np.log(counts)


class Weights:
    """Inverse document frequency from 1 for shingles in at most `rare` documents down to DAMP for one in every document."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_docs: int, rare: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        spread = np.log(max(1, n_docs) / np.maximum(1, self.counts)) / max(1e-9, np.log(max(1, n_docs) / rare))
        self.inverse = (DAMP + (1 - DAMP) * np.clip(spread, 0, 1)).astype(np.float32)

    def _held(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return at, self.hashes[at] == found

    def of(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The TF-IDF weights of a document's shingles."""
        if not len(self.hashes):
            return by_count(counts)
        at, held = self._held(found)
        return by_count(counts) * np.where(held, self.inverse[at], 1.0)

    def documents(self, found: np.ndarray) -> np.ndarray:
        """Document frequencies, 0 for those that are not frequent."""
        if not len(self.hashes):
            return np.zeros(len(found), np.int64)
        at, held = self._held(found)
        return np.where(held, self.counts[at], 0)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    low = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


class Sampler:
    """Improved consistent weighted sampling.

    Sample k of an element of weight S: with r, c ~ Gamma(2, 1) and b uniform,
    drawn for (element, k), t = floor(ln S / r + b) and
    ln a = ln c - r (t - b + 1); the element with the least a is the sample,
    together with t. The draws stand in tables that a hash of the element
    enters. At weight 1 t is 0 and ln a a constant of the table, so most
    elements cost one lookup.
    """

    def __init__(self, samples: int = ROWS * BANDS, bits: int = _TABLE_BITS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        size, self.bits = (samples, 1 << bits), bits
        self.r = draw.gamma(2.0, 1.0, size).astype(np.float32)
        self.b = draw.random(size, np.float32)
        self.lead = (np.log(draw.gamma(2.0, 1.0, size)) - self.r * (1 - self.b)).astype(np.float32)
        self.unit = self._ordered(self.lead).astype(np.uint64) << np.uint64(32)
        self.turn = draw.integers(0, 1 << 63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def _ordered(x: np.ndarray) -> np.ndarray:
        """Unsigned integers in the order of the floats."""
        bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
        return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))

    def sample(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row for each document (none may be empty), a column for each sample: 32 bits that name it."""
        out = np.empty((len(starts), len(self.turn)), np.uint32)
        name = hashes >> np.uint64(32)
        odd = np.flatnonzero(weights != 1.0)
        log_weight = np.log(weights[odd]).astype(np.float32)
        shift = np.uint64(64 - self.bits)
        for k, turn in enumerate(self.turn):
            at = ((hashes * turn) >> shift).astype(np.int64)
            least = self.unit[k][at] | name
            if len(odd):
                i = at[odd]
                t = np.floor(log_weight / self.r[k][i] + self.b[k][i])
                drawn = self._ordered(self.lead[k][i] - self.r[k][i] * t).astype(np.uint64) << np.uint64(32)
                least[odd] = drawn | ((name[odd] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF))
            out[:, k] = np.minimum.reduceat(least, starts) & np.uint64(0xFFFFFFFF)
        return out


def band_keys(samples: np.ndarray, rows: int = ROWS, first: int = 0) -> np.ndarray:
    """A 64-bit key for each band of each document; first: the number of bands before these."""
    bands = samples.shape[1] // rows
    keys = np.empty((len(samples), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(samples), first + band + 1, np.uint64)
        for row in range(rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, band * rows + row])
        keys[:, band] = key
    return keys


def _long_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """rep, key: the long bands of each text (rep, body), drawn by the weights of the verification."""

    def flush(held: list[tuple]) -> Iterator[pd.DataFrame]:
        starts = np.concatenate([[0], np.cumsum([len(h) for _, h, _ in held])[:-1]])
        hashes, weights = np.concatenate([h for _, h, _ in held]), np.concatenate([by_count(n) for _, _, n in held])
        reps = np.array([r for r, _, _ in held])
        for first in range(0, LONG_BANDS, LONG_AT_ONCE):
            bands = min(LONG_AT_ONCE, LONG_BANDS - first)
            # Drawn anew for each part: tables for all samples would not fit beside the texts.
            sampler = Sampler(bands * LONG_ROWS, _LONG_TABLE_BITS, SEED + 1 + first)
            keys = band_keys(sampler.sample(hashes, weights, starts), LONG_ROWS, first)
            yield pd.DataFrame({"rep": np.repeat(reps, bands), "key": keys.view(np.int64).ravel()})

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for rep, text in zip(batch["rep"], batch["body"], strict=True):
            h, n = shingles(text)
            held.append((rep, h, n))
            size += len(h)
            if size > LONG_SHINGLES:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


@lru_cache(maxsize=1)
def _sampler() -> Sampler:
    return Sampler()


_SIGNATURE = T.StructType([T.StructField("content1", T.LongType()), T.StructField("content2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _signer(shared):
    """A column function: two hashes of the weighted shingles, and the bands' keys; nulls for a text without words."""

    def signed(texts: list[str]) -> list[tuple]:
        weights, sampler = shared.value, _sampler()
        out: list[tuple] = []
        held: list[tuple] = []

        def flush() -> None:
            full = [x for x in held if len(x[0])]
            rows = iter(())
            if full:
                starts = np.concatenate([[0], np.cumsum([len(h) for h, _ in full])[:-1]])
                hashes, counts = np.concatenate([h for h, _ in full]), np.concatenate([n for _, n in full])
                own = _mix(hashes + _mix(counts.astype(np.uint64)))
                keys = band_keys(sampler.sample(hashes, weights.of(hashes, counts), starts)).view(np.int64)
                rows = zip(np.add.reduceat(own, starts).view(np.int64).tolist(), np.add.reduceat(_mix(own ^ _M2), starts).view(np.int64).tolist(), keys, strict=True)
            out.extend(next(rows) if len(h) else (None, None, None) for h, _ in held)
            held.clear()

        size = 0
        for text in texts:
            held.append(shingles(text))
            size += len(held[-1][0])
            if size > 60_000:
                flush()
                size = 0
        flush()
        return out

    @F.pandas_udf(_SIGNATURE)
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            one, two, bands = zip(*signed(texts.tolist()), strict=True) if len(texts) else ((), (), ())
            yield pd.DataFrame({"content1": pd.Series(one, dtype="Int64"), "content2": pd.Series(two, dtype="Int64"), "bands": pd.Series(bands, dtype=object)})

    return column


def _verified(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    cached: dict[int, tuple] = {}
    size = 0

    def vector(rep, text):
        nonlocal size
        if rep not in cached:
            h, n = shingles(text)
            if size + 16 * len(h) > KEPT_BYTES:
                cached.clear()
                size = 0
            size += 16 * len(h)
            cached[rep] = h, by_count(n)
        return cached[rep]

    for batch in batches:
        kept = []
        for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
            hub = vector(b, text_b)
            h, n = shingles(text_a)
            kept.append(similarity((h, by_count(n)), hub) >= threshold - 1e-9)
        yield batch.loc[kept, ["a", "b"]]


def components(links: DataFrame, pairs: tuple[str, str] = ("a", "b")) -> DataFrame:
    """node, label: the least node of each connected component, for every node of a link.

    Each round a node takes the least label of its neighbours and then the
    label of that label, so chains shorten by halves and stars end at once.
    """
    a, b = pairs
    edges = persist(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct(), narrow=True)
    labels = persist(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), narrow=True)
    while True:
        offered = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("offer"))
        better = labels.join(offered, labels["node"] == offered["u"]).select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = persist(better.join(jump, better["label"] == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), narrow=True)
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def _prefixes(batches: Iterator[pd.DataFrame], shared, threshold: float) -> Iterator[pd.DataFrame]:
    """A row for each shingle of a text's prefix: rep, label, is_apart, hash, before, total, lesser."""
    names = ["rep", "label", "is_apart", "hash", "before", "total", "lesser"]
    slack = 1e-6
    for batch in batches:
        rows = []
        for rep, label, is_apart, text in zip(batch["rep"], batch["label"], batch["is_apart"], batch["body"], strict=True):
            h, n = shingles(text)
            order = np.lexsort((h, shared.value.documents(h)))
            weight = by_count(n)[order]
            total = float(weight.sum())
            before = np.cumsum(weight) - weight
            upto = int(np.searchsorted(before, (1 - threshold + slack) * total, "right"))
            lesser = before[:upto] <= ((1 - threshold) / (1 + threshold) + slack) * total
            rows.append(pd.DataFrame({"rep": rep, "label": label, "is_apart": is_apart, "hash": h[order][:upto].view(np.int64), "before": before[:upto], "total": total, "lesser": lesser}))
        yield pd.concat(rows)[names] if rows else pd.DataFrame(columns=names)


def _prefix_pairs(members: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """a, b: pairs across components, among them every one at the threshold that shares a bucket.

    A text's shingles are ordered by their document frequency in the corpus,
    rarest first. What two texts share is at most what either weighs from their
    first common shingle on, and at the threshold t at least t / (1 + t) of
    both weights together. So that shingle stands within the first 1 - t of
    the greater text's weight, and within the first (1 - t) / (1 + t) of the
    lesser one's. Texts that share only frequent passages and are below the
    threshold have their own words there, so they do not meet. One end of each
    pair is apart from its bucket's largest component.
    """
    sized = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    top = persist(sized.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("top")), narrow=True)
    apart = members.join(top, "key").where("label <> top").select(F.col("rep").alias("apart")).distinct()
    labelled = persist(members.select("rep", "label").distinct().join(apart, F.col("rep") == F.col("apart"), "left").select("rep", "label", F.col("apart").isNotNull().alias("is_apart")), narrow=True)
    rows = texts.join(labelled, "rep").select("rep", "label", "is_apart", "body").repartition("rep")
    prefix = persist(rows.mapInPandas(lambda it: _prefixes(it, shared, threshold), "rep long, label long, is_apart boolean, hash long, before double, total double, lesser boolean"))
    one = prefix.where("lesser").select("hash", *[F.col(c).alias(f"{c}_x") for c in ("rep", "label", "is_apart", "before", "total")])
    two = prefix.select("hash", *[F.col(c).alias(f"{c}_y") for c in ("rep", "label", "is_apart", "before", "total")])
    least = (threshold / (1 + threshold) - 1e-6) * (F.col("total_x") + F.col("total_y"))
    enough = F.least(F.col("total_x") - F.col("before_x"), F.col("total_y") - F.col("before_y")) >= least
    across = (F.col("label_x") != F.col("label_y")) & (F.col("is_apart_x") | F.col("is_apart_y")) & (F.col("total_x") <= F.col("total_y") * (1 + 1e-9))
    return one.join(two, "hash").where(across & enough).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def _share(spark: SparkSession, docs: DataFrame, text: str):
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_or_empty(text))), F.lit(0)).alias("bytes")).first()
    # At most MOST_FREQUENT rows, see least_kept.
    counted = persist(frequent_shingles(docs, size["bytes"], text))
    least = least_kept(counted)
    found = counted.where(F.col("n") >= least).select("hash", F.col("n").cast("int").alias("n")).toArrow()
    rare = max(2, least, int(np.ceil(RARE * size["n"])))
    weights = Weights(found["hash"].to_numpy().view(np.uint64), found["n"].to_numpy(), size["n"], rare)
    return spark.sparkContext.broadcast(weights)


def _classes(docs: DataFrame, threshold: float, doc_id: str, text: str, carried: Column) -> DataFrame:
    """uid, row (the struct carried, which holds text), doc_id, keep (doc_id and uid of the row that stands for the class) for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = _share(spark, docs, text)
    sign = _signer(shared)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), sign(text_or_empty(text)).alias("signature"), carried.alias("row"))
    # Written once: from here on a row is known by its uid, whatever its doc_id.
    signed = persist(rows.select("uid", "doc_id", "row", "signature.*"))
    body = F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")).alias("body")
    same = ["content1", "content2"]
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid")
    reps = persist(signed.where("content1 is not null").groupBy(*same).agg(F.min(own).alias("pick"), F.min_by("bands", "uid").alias("bands")).select(F.col("pick.uid").alias("rep"), "pick", *same, "bands"))

    held = reps.select("rep", F.explode("bands").alias("key"))
    # Written before it is joined: a crowded bucket can then be split among tasks.
    several = persist(held.groupBy("key").agg(F.count("rep").alias("n")).where("n > 1"), narrow=True)
    members = persist(held.join(several, "key"), narrow=True)
    labels = None
    if not members.isEmpty():
        degree = persist(members.groupBy("rep").agg(F.sum("n").alias("degree")), narrow=True)
        texts = persist(signed.select(F.col("uid").alias("rep"), body).join(degree.select("rep"), "rep", "left_semi"))
        verify = lambda pairs: persist(_pair_texts(pairs, texts).mapInPandas(lambda it: _verified(it, threshold), "a long, b long"))
        links = verify(_hub_pairs(members, degree))
        labels = components(links)
        left = persist(_unsettled(members.where("n > 2").drop("n"), labels), narrow=True)
        if not left.isEmpty():
            long_members = _long_members(left, texts)
            more = persist(links.union(verify(_long_pairs(long_members, labels))), narrow=True)
            labels = components(more)
            crowded = persist(_unsettled(long_members.where(F.col("n") > SMALL).drop("n"), labels), narrow=True)
            if not crowded.isEmpty():
                labels = components(more.union(verify(_prefix_pairs(crowded, texts, shared, threshold))))
    joined = reps.select(F.col("rep").alias("node"), *same, "pick") if labels is None else reps.select("rep", *same, "pick").join(labels, reps["rep"] == labels["node"], "left").select(F.coalesce("label", "rep").alias("node"), *same, "pick")
    best = joined.groupBy("node").agg(F.min("pick").alias("keep"))
    kept = joined.select("node", *same).join(best, "node").select(*same, "keep")
    return signed.join(kept, same, "left").select("uid", "row", "doc_id", F.coalesce(F.col("keep"), own).alias("keep"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id for every row of docs; class_id: the least doc_id of the class.

    A class is a connected component of links of weighted Jaccard similarity
    of at least threshold. Null texts are empty; texts without words are alone,
    each in its own class. Rows that repeat a doc_id are judged each by its own
    text. Rows with a null doc_id take part; a class of such rows alone has a
    null class_id. Empty table: no rows. Other columns are not read.
    """
    return _classes(docs, threshold, doc_id, text, F.struct(F.col(text))).select("doc_id", F.col("keep.doc_id").alias("class_id"))


def _hub_pairs(members: DataFrame, degree: DataFrame) -> DataFrame:
    """a, b: every member of a bucket with the one of the greatest degree."""
    hubs = persist(members.join(degree, "rep").groupBy("key").agg(F.max_by("rep", F.struct("degree", "rep")).alias("hub")), narrow=True)
    return members.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()


def _long_members(left: DataFrame, texts: DataFrame) -> DataFrame:
    """rep, key, n: the long bands of left's texts that several have."""
    own = texts.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", "body").repartition("rep")
    drawn = persist(own.mapInPandas(_long_bands, "rep long, key long"))
    several = persist(drawn.groupBy("key").agg(F.count("rep").alias("n")).where("n > 1"), narrow=True)
    return persist(drawn.join(several, "key"), narrow=True)


def _long_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b across components: all pairs of a bucket of at most SMALL members, and those with the hub of a larger one."""
    marked = members.join(labels, members["rep"] == labels["node"], "left").select("rep", "key", "n", F.coalesce("label", "rep").alias("label"))
    few = marked.where(F.col("n") <= SMALL)
    one, two = (few.select("key", F.col("rep").alias(a), F.col("label").alias(f"label_{a}")) for a in "ab")
    near = one.join(two, "key").where("a < b and label_a <> label_b").select("a", "b")
    many = marked.where(F.col("n") > SMALL)
    hubs = _hub_pairs(many.select("rep", "key"), many.groupBy("rep").agg(F.sum("n").alias("degree")))
    known = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    of = lambda df, c: df.join(known, F.col(c) == F.col("_node"), "left").withColumn(f"label_{c}", F.coalesce("_label", c)).drop("_node", "_label")
    apart = of(of(hubs, "a"), "b").where("label_a <> label_b").select("a", "b")
    return near.union(apart).distinct()


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with the labels of these; a member without links is its own."""
    marked = persist(members.join(labels, members["rep"] == labels["node"], "left").select("rep", "key", F.coalesce("label", "rep").alias("label")), narrow=True)
    several = persist(marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), narrow=True)
    return marked.join(several, "key", "left_semi")


def _pair_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    ta = texts.select(F.col("rep").alias("a"), F.col("body").alias("text_a"))
    tb = texts.select(F.col("rep").alias("b"), F.col("body").alias("text_b"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")


def near_distinct(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with its columns: of each class one row, that with the least doc_id.

    Among rows that repeat it any one of them, and of a class without ids any
    row. Texts without words all stay. See near_classes for other odd rows.
    """
    classes = _classes(docs, threshold, doc_id, text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return classes.where(F.col("uid") == F.col("keep.uid")).select("row.*")
