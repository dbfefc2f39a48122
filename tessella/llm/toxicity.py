"""Toxicity by gradient-boosted trees over dense features (operator 4).

The features are densities of one pass over the text's bytes: words of a
lexicon, the same words in disguise, their nearness to the second person,
capitals, punctuation, symbols, digits and repetition. The lexicon has a fixed
part and one learnt from labelled rows: words and beginnings of words that
stand in toxic documents far more often than in others, each with a weight.
The trees see densities that a lexicon of other rows gave (cross-fitting), so
words that only chance made telling do not mislead them. The trees' probability
is calibrated by isotonic regression on rows that neither has seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import persist, small_batches, text_or_empty

# Insulting words, and words that address somebody.
LEXICON = frozenset(
    w.encode()
    for w in """
    idiot idiots moron morons stupid loser losers clown clowns trash garbage scum pathetic worthless disgusting dumb dumbass fool fools jerk ugly
    imbecile cretin dimwit halfwit lowlife scumbag vermin parasite filth filthy creep freak pig swine coward liar hate kill damn crap
    bastard bitch asshole shit fuck fucking bullshit retard retarded whore slut degenerate disgrace braindead brainless clueless useless hopeless
    dummkopf trottel depp arschloch scheisse abschaum versager idioten imbécile crétin connard salaud merde ordure débile imbecil estúpido
    estúpida basura mierda cabrón pendejo escoria
    """.split()
)
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur youre du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
NEAR = 5
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_FOLD = bytes.maketrans(LETTERS.upper() + _PUNCT, LETTERS + b" " * len(_PUNCT))
_LEET = bytes.maketrans(LETTERS.upper() + b"013457@$!|", LETTERS + b"oieastasil")
_SPELLED = re.compile(rb"(?<![a-z0-9])[a-z](?:[ .*_-][a-z]){2,}(?![a-z0-9])")
_RUNS = re.compile(rb"([a-z])\1+")

#: Beginnings of words that the lexicon may hold, in bytes; a whole word ends with END.
SHORTEST, LONGEST, END = 3, 10, b" "
#: A gram enters the lexicon if at least so many toxic documents, and this share of them, have it.
LEAST_DOCS, LEAST_SHARE = 3, 0.002
#: A gram's weight is its log-odds less DOUBT standard errors. Densities are taken in bands of weight; words of the last are treated like the fixed ones.
DOUBT, WEIGHT_BANDS = 2.0, (0.5, 1.5, 2.5)
#: Entries of the learnt lexicon, the weightiest first.
MOST_GRAMS = 4_000
#: Labelled rows that the whole model is fitted on.
MOST_ROWS = 40_000

FEATURES = (
    "log_words", "lexicon", "distinct_lexicon", "disguised", "near_second_person", "second_person", "capitals", "capital_runs", "punctuation", "exclamation", "question",
    "symbols", "digits", "non_ascii", "line_ends", "repetition", "word_length", "learnt_weak", "learnt_middle", "learnt_strong", "learnt_most", "learnt_distinct",
)


class Lexicon:
    """The fixed words, and learnt grams with their weights."""

    def __init__(self, learnt: dict[bytes, float] | None = None):
        self.learnt = learnt or {}
        self.heads = frozenset(g.removesuffix(END)[:SHORTEST] for g in self.learnt)
        strong = {g[:-1] for g, w in self.learnt.items() if g.endswith(END) and w >= WEIGHT_BANDS[-1]}
        self.words = LEXICON | strong
        self.single = frozenset(_RUNS.sub(rb"\1", w) for w in self.words if len(w) > 3)
        self.by_length: dict[int, list[bytes]] = {}
        for w in self.words:
            self.by_length.setdefault(len(w), []).append(w)

    def weights(self, words) -> dict[bytes, float]:
        """Of the given words those that the learnt part knows, each with its greatest weight."""
        if not self.learnt:
            return {}
        known, found = self.learnt.get, {}
        for w in [w for w in words if w[:SHORTEST] in self.heads]:
            best = max(known(w + END, 0.0), *(known(w[:k], 0.0) for k in range(SHORTEST, min(len(w), LONGEST) + 1)), 0.0)
            if best > 0:
                found[w] = best
        return found


def grams(text: str) -> set[bytes]:
    """The different words of a text, and their beginnings."""
    words = set(text.encode("utf-8").translate(_FOLD).split())
    return {w + END for w in words} | {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


_FIXED = Lexicon()


def features(text: str, lexicon: Lexicon = _FIXED) -> list[float]:
    """The features of a text, in the order of FEATURES; an empty text has zeros."""
    raw = text.encode("utf-8")
    if not raw:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(raw, np.uint8)
    byte = np.bincount(codes, minlength=256)
    words = raw.translate(_FOLD).split()
    counts = Counter(words)
    n, size = max(1, len(words)), len(raw)
    weights = lexicon.weights(counts)
    bands = [0, 0, 0]
    for w, weight in weights.items():
        if weight >= WEIGHT_BANDS[0]:
            bands[sum(weight >= x for x in WEIGHT_BANDS) - 1] += counts[w]
    fixed = counts.keys() & LEXICON
    insults = fixed | {w for w, weight in weights.items() if weight >= WEIGHT_BANDS[-1]}
    you = sum(counts[w] for w in counts.keys() & SECOND_PERSON)
    near = 0
    if insults and you:
        hits = np.array([i for i, w in enumerate(words) if w in insults])
        spots = np.array([-NEAR - 1_000_000, *(i for i, w in enumerate(words) if w in SECOND_PERSON), len(words) + NEAR + 1_000_000])
        at = np.searchsorted(spots, hits)
        near = int((np.minimum(spots[at] - hits, hits - spots[at - 1]) <= NEAR).sum())
    upper = (codes >= 65) & (codes <= 90)
    letters = max(1, int(byte[65:91].sum() + byte[97:123].sum()))
    symbols = int(byte[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
    punct = int(byte[list(_PUNCT)].sum())
    return [
        float(np.log1p(len(words))), 100 * sum(counts[w] for w in fixed) / n, float(len(fixed)), 100 * disguised(raw, words, lexicon) / n, 100 * near / n, 100 * you / n,
        byte[65:91].sum() / letters, float((upper[1:] & upper[:-1]).sum()) / letters, punct / size, byte[33] / size, byte[63] / size,
        symbols / size, byte[48:58].sum() / size, byte[128:].sum() / size, byte[10] / size, 1 - len(counts) / n, sum(map(len, words)) / n,
        *(100 * x / n for x in bands), max(weights.values(), default=0.0), float(len(insults)),
    ]


def disguised(raw: bytes, words: list[bytes], lexicon: Lexicon = _FIXED) -> int:
    """Words of the lexicon written with digits and signs, stars, stretched or spelled out."""
    found, known = 0, lexicon.words
    for token in raw.split():
        if token.isalpha():
            continue
        token = token.strip(b".,;:?\"'()[]")
        plain = token.translate(_FOLD).replace(b" ", b"")
        if plain in known and len(plain) > 3:
            found += token.strip(_PUNCT).lower() != plain  # signs inside the word
        elif (token.translate(_LEET) in known or token.rstrip(b"!").translate(_LEET) in known) and not plain.isalpha() | (token.rstrip(b"!").lower() in known):
            found += 1
        elif len(token) > 3 and len(token) in lexicon.by_length and b"*" in token.strip(b"*"):
            low = token.lower()
            found += any(all(a == b or a == 42 for a, b in zip(low, w, strict=True)) for w in lexicon.by_length[len(token)])
    low = raw.lower()
    for m in _SPELLED.findall(low):
        found += bytes(c for c in m if c in LETTERS) in known
    codes = np.frombuffer(low, np.uint8)
    if len(codes) > 2 and ((codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2]) & (codes[2:] >= 97) & (codes[2:] <= 122)).any():
        found += sum(w not in known and _RUNS.sub(rb"\1", w) in lexicon.single for w in words if len(w) > 4 and _RUNS.search(w))
    return found


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from: crc32 of the id's digits divisible by 5."""
    return _fold(doc_id) == 0


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)).cast("int")


def _with_features(df: DataFrame, lexicons: dict[int, Lexicon], text: str = "text", fold: str | None = None) -> DataFrame:
    """df with a column features; by the lexicon of the row's fold, else by that of fold 0."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast({k: x.learnt for k, x in lexicons.items()})

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        built = {k: Lexicon(x) for k, x in shared.value.items()}
        for texts, folds in batches:
            yield pd.Series([[float(x) for x in features(t, built.get(k, built[0]))] for t, k in zip(texts, folds, strict=True)], dtype=object)

    return df.withColumn("features", of(text_or_empty(text), F.lit(0) if fold is None else F.col(fold)))


def _gram_counts(batches: Iterator[pd.DataFrame], shared=None) -> Iterator[pd.DataFrame]:
    """gram, fold, n: documents of the task's rows that have the gram; only grams in shared, if it is given."""
    counts: dict[int, Counter] = {}
    for batch in batches:
        for text, fold in zip(batch["body"], batch["fold"], strict=True):
            found = grams(text)
            counts.setdefault(fold, Counter()).update(found if shared is None else found & shared.value)
    for fold, own in counts.items():
        items = list(own.items())
        for start in range(0, len(items), 50_000):
            part = items[start : start + 50_000]
            yield pd.DataFrame({"gram": [g for g, _ in part], "fold": fold, "n": [n for _, n in part]})


def _counted(sample: DataFrame, shared=None) -> DataFrame:
    """gram, and its documents in each of the folds 1 to 3."""
    rows = sample.select(text_or_empty("text").alias("body"), "fold").mapInPandas(lambda it: _gram_counts(it, shared), "gram binary, fold int, n long")
    return rows.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (1, 2, 3)])


def learn_lexicons(sample: DataFrame) -> dict[int, Lexicon]:
    """Lexicons from sample (text, label, fold 1 to 3): at 0 that of all rows, at k that of all but fold k.

    A gram is kept by its document frequencies among toxic and other rows, both
    counted over the whole sample; at most MOST_GRAMS of each lexicon come to
    the driver.
    """
    spark = sample.sparkSession
    sizes = {(r["label"], r["fold"]): r["count"] for r in sample.groupBy("label", "fold").count().collect()}
    toxic = sum(n for (label, _), n in sizes.items() if label > 0)
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    bad = persist(_counted(sample.where("label > 0")).where(F.col("n1") + F.col("n2") + F.col("n3") >= least))
    # At most (grams of a mean toxic document) / LEAST_SHARE entries.
    shared = spark.sparkContext.broadcast(frozenset(bytes(r["gram"]) for r in bad.select("gram").toLocalIterator()))
    good = _counted(sample.where("label = 0"), shared)
    both = persist(bad.join(good.select("gram", *[F.col(f"n{k}").alias(f"m{k}") for k in (1, 2, 3)]), "gram", "left").na.fill(0))
    out = {}
    for left_out in (0, 1, 2, 3):
        folds = [k for k in (1, 2, 3) if k != left_out]
        n, m = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0.0)) + 0.5 for c in "nm")
        n_all, m_all = (1.0 + sum(v for (label, k), v in sizes.items() if (label > 0) == bad_label and k in folds) for bad_label in (True, False))
        weight = F.log(n / n_all) - F.log(m / m_all) - DOUBT * F.sqrt(1 / n + 1 / m)
        top = both.select("gram", weight.alias("weight")).where(F.col("weight") >= WEIGHT_BANDS[0]).orderBy(F.col("weight").desc(), "gram").limit(MOST_GRAMS)
        out[left_out] = Lexicon({bytes(r["gram"]): r["weight"] for r in top.collect()})
    return out


class ToxicityModel:
    """A lexicon, trees and their calibration; without both classes among the labels a constant score."""

    def __init__(self, lexicon: Lexicon = _FIXED, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with a column score."""
        if self.trees is None:
            return df.withColumn("score", F.lit(self.constant))
        return self._judge(_with_features(df, {0: self.lexicon}, text))

    def _judge(self, df: DataFrame) -> DataFrame:
        out = self.trees.transform(df.withColumn("_vector", array_to_vector(F.col("features")))).withColumn("_margin", vector_to_array("_probability")[1])
        out = out.withColumn("_score", F.col("_margin")) if self.calibration is None else self.calibration.transform(out)
        return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score")))).drop("features", "_vector", "_raw", "_probability", "_tree", "_margin", "_score")


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """text, label, fold: about most_rows labelled rows of docs, none of them held out.

    Ids are chosen by a hash among the labels before any text is read, so
    their table is bounded and may be broadcast. A document with several labels
    is toxic if one says so; null labels and ids are left out.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_marked")).agg(F.max("toxic").cast("double").alias("label"))
    marks = marks.withColumn("fold", _fold(F.col("_marked"))).where("fold <> 0")
    total = marks.count()
    if total > most_rows:
        marks = marks.where(F.pmod(F.xxhash64("_marked"), F.lit(1_000_000)) < int(1_000_000 * most_rows / total))
    rows = docs.select(F.col("doc_id").alias("_id"), text_or_empty("text").alias("text"))
    rows = rows.join(F.broadcast(marks), F.col("_id") == F.col("_marked")).select(F.col("_id").alias("doc_id"), "text", "label", "fold")
    return persist(rows.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic); see training_rows for the sample.

    Folds 1 to 3 give the lexicon and grow the trees, fold 4 calibrates, fold 0
    is never read.
    """
    sample = training_rows(docs, labels, most_rows)
    counts = {(r["calibrates"], r["label"]): r["count"] for r in sample.groupBy((F.col("fold") == 4).alias("calibrates"), "label").count().collect()}
    good, bad = counts.get((False, 0.0), 0), counts.get((False, 1.0), 0)
    if not good or not bad:
        return ToxicityModel(constant=float(bool(bad)))
    lexicons = learn_lexicons(sample.where("fold <> 4"))
    table = _with_features(sample, lexicons, fold="fold").select("doc_id", "features", "label", "fold")
    table = persist(table.repartition(6, "doc_id").sortWithinPartitions("doc_id", "features"))
    grown = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_tree", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=1)
    grown = grown.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(table.where("fold <> 4").withColumn("_vector", array_to_vector("features")))
    model = ToxicityModel(lexicons[0], grown)
    if counts.get((True, 0.0)) and counts.get((True, 1.0)):
        seen = grown.transform(table.where("fold = 4").withColumn("_vector", array_to_vector("features"))).select(vector_to_array("_probability")[1].alias("_margin"), "label")
        model.calibration = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_score").fit(seen)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored by zero features. A null doc_id is never
    learnt from. Rows that repeat are scored each. Without labels of both
    kinds every score is the kind that is there, 0 if none. Empty table: no
    rows. Only doc_id and text of docs, doc_id and toxic of labels are read.
    """
    scored = fit(docs, labels, **options).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below threshold, with its columns; one pass over the texts."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return fit(docs, labels).score(inner).where(F.col("score") < threshold).select("row.*")
