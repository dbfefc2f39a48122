"""Mixing sources to target weights (operator 1).

Every document gets a hash-random key. Within a source the keys put the
documents in a random but repeatable order; the key's leading digits cut this
order into ranges, each sorted on its own, and the ranges' word totals give
each range its offset (a distributed prefix sum). A source's budget is cut at
its exact word: whole epochs first, then the documents up to the remainder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, persist, text_or_empty

#: Hexadecimal digits of the key that name a range: 4,096 ranges a source, so a
#: source of 10**10 documents sorts about 2.4 million of them in a task.
RANGE_DIGITS = 3


def word_count(text: str):
    return F.regexp_count(text_or_empty(text), F.lit(f"[^{SPACES}]+")).cast("long")


def source_targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """A row for each source: source, nth, source_size, target.

    Sources by code point, null last, take the weights in turn and share
    `share` of all words. No target passes `most` times its source; what is
    above goes to the others by weight. That ends where every target is
    min(most * size, level * weight): sources in order of their limit by
    weight, the first whose limit reaches the level of the rest fixes it.
    The sources' totals, one row each and none of their documents, meet in one
    task; that is fine for sources that people weigh (up to some 100,000), not
    for a column with a value of its own for each document.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("nth", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1)
    )
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("fixed", F.coalesce(F.sum(F.col("source_size") * most).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_limit))
        .withColumn("reached", F.col("source_size") * most * F.col("open_weight") >= (F.col("budget") - F.col("fixed")) * F.col("weight"))
        .withColumn("first", F.min(F.when(F.col("reached"), F.struct("place", "fixed", "open_weight", "budget"))).over(everything))
    )
    limit = (F.col("source_size") * most).cast("double")
    level = (F.col("first.budget") - F.col("first.fixed")) * F.col("weight") / F.col("first.open_weight")
    return levels.select("source", "nth", "source_size", F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), limit).otherwise(level).alias("target"))


def _plan(sized: DataFrame, weights, share: float, most: int) -> DataFrame:
    """sized (doc_id, source, size, key, uid) with source_size, target, taken."""
    targets = persist(source_targets(sized, weights, share, most))
    placed = sized.withColumn("is_null", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    named = targets.select(F.col("source").isNull().alias("is_null"), F.coalesce("source", F.lit("")).alias("name"), "nth", "source_size", "target")
    placed = placed.join(named, ["is_null", "name"]).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = placed.groupBy("nth", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("nth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("nth", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("nth", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = (epochs * F.col("size") + part).cast("long")
    return placed.join(offsets, ["nth", "range"]).withColumn("before", before).select("uid", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def _sized(docs: DataFrame, doc_id: str, source: str, text: str, uid: Column) -> DataFrame:
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return persist(docs.select(uid.alias("uid"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), key.alias("key")))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs.

    Nulls: a null text has size 0; a null source is a source of its own, the
    last; a null doc_id has its own key. Repeated rows count each; rows that
    tie in key, doc_id and size are interchangeable. A document of size 0 takes
    0. An empty table gives no rows. Other columns of docs are not read, so
    names of theirs cannot clash.
    """
    return _plan(_sized(docs, doc_id, source, text, F.lit(0)), weights, share, most).drop("uid")


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs as the mix takes them: whole texts, each as often as it is taken.

    A text is repeated for each epoch; of the one that the budget cuts, at
    least half must be taken for it to stand once more. A text without words
    costs nothing and stays once. Columns and texts are those of docs. Each row
    is planned by itself, those with a null doc_id and those that repeat too.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Written once: from here on a row is known by its uid, whatever its doc_id.
    held = persist(docs.select(F.monotonically_increasing_id().alias("uid"), row.alias("row")))
    flat = held.select("uid", *[F.col("row").getField(c).alias(c) for c in ("doc_id", "source", "text")])
    plan = _plan(_sized(flat, "doc_id", "source", "text", F.col("uid")), weights, share, most)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).cast("int")
    by_uid = plan.select("uid", copies.alias("copies")).where("copies > 0")
    return held.join(by_uid, "uid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
