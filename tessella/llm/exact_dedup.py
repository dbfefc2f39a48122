"""Exact dedup (operator 5): skew-safe combining with full content at every stage.

1. Each map task merges its own rows with equal texts.
2. The tasks' winners merge in salted digest groups, so that a text that a
   third of all rows share spreads over many tasks.
3. The salts' winners, at most SALTS for a text, merge globally.

Digest and whole normalised text are the grouping key in each, so texts with
equal digests but different content never meet. Rows then find their class by
the digest; where one digest stands for several texts, by the text as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import SPACES, persist, text_or_empty

SALTS = 16


def normalised(text: str):
    """Each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), f"[{SPACES}]+", " ")


def exact_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text_sha256, keep_id, group_size, body: a row for each different text; body only where texts share a digest."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("body")).withColumn("text_sha256", F.sha2("body", 256)).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = rows.groupBy("text_sha256", "body", "salt").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # Dealt by digest alone: the texts of a digest are then counted where they are, without another exchange.
    dealt = salted.repartition(F.col("text_sha256"))
    merged = dealt.groupBy("text_sha256", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    merged = merged.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("text_sha256")))
    return merged.select("text_sha256", "keep_id", "group_size", F.when(F.col("texts") > 1, F.col("body")).alias("body"))


def _with_class(rows: DataFrame, classes: DataFrame, body: Column) -> DataFrame:
    """rows (with text_sha256) and their class' keep_id, group_size and own_body: the normalised text body where a digest is not enough, else null."""
    alone = classes.where("body is null").select("text_sha256", "keep_id", "group_size")
    shared = classes.where("body is not null").select("text_sha256", F.col("body").alias("own_body"), "keep_id", "group_size")
    found = rows.join(alone, "text_sha256").withColumn("own_body", F.lit(None).cast("string"))
    if shared.isEmpty():  # no digest stands for two texts, so no text has to move once more
        return found
    return found.unionByName(rows.withColumn("own_body", body).join(shared, ["text_sha256", "own_body"]))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    A null text equals the empty one. Rows with a null doc_id are members but
    never chosen while another is there; kept compares null-safely. A row that
    repeats doc_id and text is the same document: each counts in group_size and
    has the same kept. Empty table: no rows. Other columns are not read.
    """
    classes = persist(exact_classes(docs, doc_id, text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("text_sha256", F.sha2(normalised("text"), 256))
    return _with_class(rows, classes, normalised("text")).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with its columns.

    What goes is joined, not what stays: it is usually little, and then its
    table is small enough to broadcast and no text moves once more. Rows that
    repeat the doc_id and text of one that stays, stay with it.
    """
    classes = persist(exact_classes(docs).where("group_size > 1 or body is not null"))
    rows = docs.select(F.col("doc_id").alias("_gone_id"), "text", F.xxhash64(normalised("text")).alias("_check")).withColumn("text_sha256", F.sha2(normalised("text"), 256))
    gone = _with_class(rows, classes, normalised("text")).where(~F.col("_gone_id").eqNullSafe(F.col("keep_id")))
    # A row that goes is named by its id and a short hash of its text, and by the text itself where digests met.
    check = F.xxhash64(normalised("text"))
    gone = persist(gone.select("_gone_id", F.col("_check").alias("_gone_check"), F.col("own_body").alias("_gone_body")).distinct())
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (check == gone["_gone_check"]) & (gone["_gone_body"].isNull() | (normalised("text") == gone["_gone_body"]))
    return docs.join(gone, same, "left_anti")
