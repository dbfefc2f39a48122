"""Hard-negative mining by rotated one-bit codes (operator 13).

Components become floor(scale * x). A row is rotated and stored as LEVELS
one-bit codes: the first holds the signs of the rotated vector u, each further
one the signs of what the codes before leave of it. With each code b, as a unit
vector, stands its alignment with what it encodes, so that
u = a1 b1 + ... + aL bL + rest * r, r being a unit vector at right angles to bL.

An anchor q, rotated alike, is split into bit planes; popcounts of planes and
codes give each <q, b> up to the planes' rounding. What is left, <q, r>, is by
Cauchy-Schwarz at most sqrt(|q|^2 - <q, bL>^2). So each score lies in a known
interval, with certainty. Of each block the best estimates are scored first;
rows whose interval cannot reach the k-th best score found are passed over, all
others are scored by integers. So results are those of a full comparison.

One level leaves 0.6 of a vector's length, which tells little apart among
vectors without clusters; four leave about 0.15.

Anchors and rows are dealt to blocks; a cell of both is one group of a bounded
size, from which at most k rows an anchor leave. First the positives are found,
then, with their scores as bounds, the negatives.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import persist

#: Codes of a row, bit planes of an anchor, and rows of a block that are scored before others are passed over.
LEVELS, PLANES, FIRST = 4, 6, 32
#: Rows of a block at most, and bytes of its vectors once unpacked.
BLOCK, BLOCK_BYTES = 65_536, 64 << 20
SEED = 20_013


@lru_cache(maxsize=2)
def rotation(size: int) -> np.ndarray:
    """An orthogonal matrix, drawn at random."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _bits(n: int) -> int:
    return max(64, (n + 63) // 64 * 64)


def _words(signs: np.ndarray) -> np.ndarray:
    """Bits in words of 64, a row for each row."""
    return np.packbits(signs, axis=1).view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of integer vectors, a row each: codes (words of 64 bits, level by level), alignments with them, length, and length of what they leave."""
    size = _bits(vectors.shape[1])
    left = np.pad(vectors, ((0, 0), (0, size - vectors.shape[1]))) @ rotation(size).T
    norm = np.sqrt((left * left).sum(1))
    codes, along = [], np.empty((len(vectors), LEVELS))
    for level in range(LEVELS):
        signs = left >= 0
        along[:, level] = np.abs(left).sum(1) / np.sqrt(size)
        left = left - np.where(signs, 1.0, -1.0) * (along[:, level] / np.sqrt(size))[:, None]
        codes.append(_words(signs))
    return np.hstack(codes), along, norm, np.sqrt((left * left).sum(1))


class Anchor:
    """A vector that rows' codes are compared with."""

    def __init__(self, vector: np.ndarray):
        size = _bits(len(vector))
        turned = rotation(size) @ np.pad(vector, (0, size - len(vector)))
        self.top = (1 << PLANES - 1) - 1
        step = np.abs(turned).max() / self.top or 1.0
        whole = np.rint(turned / step).astype(np.int64)
        self.rounding = float(np.sqrt(((turned - whole * step) ** 2).sum()))
        self.planes = [np.tile(_words(((whole + self.top) >> j & 1)[None, :])[0], LEVELS) for j in range(PLANES)]
        self.unit, self.sum, self.square = step / np.sqrt(size), int(whole.sum()), float((turned**2).sum())

    def intervals(self, codes: np.ndarray, along: np.ndarray, norm: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimate, least and greatest possible score with each row."""
        count = lambda words: np.bitwise_count(words).reshape(len(codes), LEVELS, -1).sum(2, dtype=np.int64)
        inside = -self.top * count(codes)  # planes hold numbers raised by top
        for j, plane in enumerate(self.planes):
            inside += count(codes & plane) << j
        # Twice the sum over a code's bits, less the sum over all.
        with_codes = (2 * inside - self.sum) * self.unit
        middle = (along * with_codes).sum(1)
        last = np.maximum(0.0, np.abs(with_codes[:, -1]) - self.rounding)
        half = rest * np.sqrt(np.maximum(0.0, self.square - last**2)) + self.rounding * (norm + rest)
        half += 1e-9 * (half + norm * np.sqrt(self.square)) + 1e-6
        return middle, middle - half, middle + half


def integer_scores(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles below 2**53, else as whole numbers of any size, held within a long."""
    bound = np.abs(vectors).max(initial=0) * np.abs(anchor).max(initial=0) * max(1, len(anchor))
    if bound < 2**53:
        return (vectors @ anchor).astype(np.int64)
    whole = vectors.astype(object)
    for i, row in enumerate(vectors):
        whole[i] = [int(x) for x in row]
    exact = whole @ np.array([int(x) for x in anchor], object)
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


class _Rows:
    """A block of rows, unpacked; in the order of ids, those without one last, so that of equal scores the lesser place comes first."""

    def __init__(self, rows: pd.DataFrame, size: int):
        rows = rows.sort_values(["named", "vec_id", "uid"], ascending=[False, True, True])
        self.uid, self.label, self.vec_id, self.named = (rows[c].to_numpy() for c in ("uid", "label", "vec_id", "named"))
        stored = b"".join(rows["vector"])
        self.vector = np.frombuffer(stored, "<i2" if len(stored) == 2 * size * len(rows) else "<f8").reshape(len(rows), size).astype(float)
        self.code = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1)
        self.along = np.frombuffer(b"".join(rows["along"]), "<f8").reshape(len(rows), LEVELS)
        self.norm, self.rest = rows["norm"].to_numpy(), rows["rest"].to_numpy()
        self.bounds = rows["bounds"].to_list() if "bounds" in rows else None


Range = tuple[int, int]


def _best(anchor: np.ndarray, rows: _Rows, own: np.ndarray, k: int, ranges: list[Range | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each range (None: all) the k best rows of own with least <= 100 * score <= greatest: (places, scores)."""
    asked = Anchor(anchor)
    estimate, low, high = asked.intervals(rows.code[own], rows.along[own], rows.norm[own], rows.rest[own])

    def possible(r: Range | None) -> np.ndarray:
        return np.ones(len(own), bool) if r is None else (high * 100 >= r[0] - 1) & (low * 100 <= r[1] + 1)

    def fitting(r: Range | None, places: np.ndarray) -> np.ndarray:
        return places if r is None else places[_within(scores[places], r)]

    left = np.flatnonzero(np.logical_or.reduce([possible(r) for r in ranges]))
    first = left[np.argpartition(-estimate[left], FIRST - 1)[:FIRST]] if len(left) > FIRST else left
    scores, done, reach = np.zeros(len(own), np.int64), np.zeros(len(own), bool), np.zeros(len(own), bool)
    scores[first], done[first] = integer_scores(rows.vector[own[first]], anchor), True
    for r in ranges:
        found = np.sort(scores[fitting(r, first)])[::-1]
        reach |= possible(r) & ((high >= found[k - 1]) if len(found) >= k else True)
    more = np.flatnonzero(reach & ~done)
    scores[more], done[more] = integer_scores(rows.vector[own[more]], anchor), True
    out = []
    for r in ranges:
        fit = fitting(r, np.flatnonzero(done))
        top = fit[np.lexsort((fit, -scores[fit]))[:k]]
        out.append((own[top], scores[top]))
    return out


def _within(scores: np.ndarray, r: Range) -> np.ndarray:
    """least <= 100 * score <= greatest, without overflow."""
    least, greatest = r
    return (scores >= -(-least // 100)) & (scores <= greatest // 100)


_FOUND = {"anchor": "int64", "slot": "int32", "named": "bool", "vec_id": "int64", "uid": "int64", "score": "int64"}


def _cell(size: int, k: int, share: int):
    """The best rows of a cell for each of its anchors: positives, or negatives where anchors carry positives' scores."""

    def search(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple] = []
        if len(anchors) and len(rows):
            block, asked = _Rows(rows, size), _Rows(anchors, size)
            for i in range(len(asked.uid)):
                ranges = [None] if asked.bounds is None else [(share * int(p), 100 * int(p)) for p in asked.bounds[i]]
                own = np.flatnonzero(((block.label == asked.label[i]) == (asked.bounds is None)) & ~(block.named & (block.vec_id == asked.vec_id[i])))
                for slot, (places, scores) in enumerate(_best(asked.vector[i], block, own, k, ranges) if len(own) else ()):
                    parts.append((np.full(len(places), asked.uid[i]), np.full(len(places), slot), block.named[places], block.vec_id[places], block.uid[places], scores))
        columns = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([] for _ in _FOUND)
        return pd.DataFrame(dict(zip(_FOUND, columns, strict=True))).astype(_FOUND)

    return search


def coded(vectors: DataFrame, scale: float = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """The rows that take part with their codes, written once, and the vectors' length.

    uid, named (has an id), vec_id (0 for none), label, vector, code, along,
    norm, rest. vector holds the components floor(scale * x), as 16-bit integers if
    all fit, else as doubles.
    """
    good = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own_id = F.col(vec_id).cast("long")
    rows = vectors.where(good).select(
        F.monotonically_increasing_id().alias("uid"), own_id.isNotNull().alias("named"), F.coalesce(own_id, F.lit(0)).alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    most = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("size"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    size, stored = most["size"], "<i2" if (most["most"] or 0) * scale < 32_000 else "<f8"

    def codes(batches):
        for batch in batches:
            found = np.zeros((len(batch), size))
            for i, v in enumerate(batch["vector"]):
                found[i, : len(v)] = v
            found = np.floor(scale * found)
            code, along, norm, rest = encode(found)
            packed = {"vector": found.astype(stored), "code": code, "along": along.astype("<f8")}
            yield batch[["uid", "named", "vec_id", "label"]].assign(**{k: [x.tobytes() for x in v] for k, v in packed.items()}, norm=norm, rest=rest)

    return persist(rows.mapInPandas(codes, "uid long, named boolean, vec_id long, label long, vector binary, code binary, along binary, norm double, rest double")), size


def _cells(anchors: DataFrame, rows: DataFrame, size: int, k: int, share: int, n_anchors: int, n_rows: int) -> DataFrame:
    """The k best of each anchor and slot over all cells."""
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    block_rows = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, size))))
    # Blocks of rows are smaller where there would be fewer than cores.
    n_a, n_r = max(1, -(-n_anchors // block_rows)), max(1, -(-n_rows // min(block_rows, max(1024, n_rows // (4 * cores)))))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    left = anchors.withColumn("a", block(n_a)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    right = rows.withColumn("r", block(n_r)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))))
    found = left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInPandas(_cell(size, k, share), "anchor long, slot int, named boolean, vec_id long, uid long, score long")
    best = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("named").desc(), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least_share: int = 80, relabel: int = 7, labels: int = 10, scale: float = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by every. An anchor's positives
    are its best other rows of its label; for each, its negatives are the best
    rows of other labels that score at least least_share per cent of the
    positive and at most as much. Where an id is divisible by relabel, label
    first becomes (label + 1) % labels (0: nowhere).

    Rows with a null label or vector, or with a component that is null or not
    finite, take no part. Rows without an id are no anchors and come last among
    equal scores. Rows that repeat an id count each, but are never others of
    that id; each anchor among them has its own result. Shorter vectors are
    filled up by 0. Scores beyond a long are held at its ends. An anchor
    without positives, and a positive without negatives, have no row. Empty
    table: no rows. Only the three named columns are read.
    """
    rows = vectors
    if relabel:
        moved = F.when(F.col(vec_id) % relabel == 0, (F.col(label).cast("long") + 1) % labels).otherwise(F.col(label).cast("long"))
        rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), moved.alias("label"))
        vec_id, vector, label = "vec_id", "vector", "label"
    codes, size = coded(rows, scale, vec_id, vector, label)
    own = F.col("named") & (F.col("vec_id") % every == 0)
    found_id = F.when(F.col("named"), F.col("vec_id"))
    counts = codes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(own, 1)).alias("anchors")).first()
    anchors = codes.where(own)
    best = _cells(anchors, codes, size, positives, least_share, counts["anchors"], counts["n"])
    positive = persist(best.select("anchor", "rank", found_id.alias("positive_id"), F.col("score").alias("positive_score")), narrow=True)
    bounds = positive.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("found")).select("anchor", F.col("found.positive_score").alias("bounds"))
    # Columns by new names of their own: both sides of a cell come from the same table.
    asking = anchors.join(bounds, F.col("uid") == F.col("anchor")).select("bounds", *[F.col(c).alias(c) for c in codes.columns])
    worst = _cells(asking, codes, size, negatives, least_share, counts["anchors"], counts["n"])
    negative = worst.select(F.col("anchor").alias("of"), (F.col("slot") + 1).alias("of_rank"), F.col("rank").alias("place"), found_id.alias("negative_id"), F.col("score").alias("negative_score"))
    named = positive.join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    joined = named.join(negative, (F.col("anchor") == F.col("of")) & (F.col("rank") == F.col("of_rank")))
    return joined.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
