"""Line dedup (operator 6).

Lines are exploded as 16-byte hashes of their normalised key, counted by
document, and those over the threshold dropped by position. A frequent line is
counted by partial sums, so it never gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, persist, text_or_empty


def line_key(line):
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\v\f\r")))


def _candidates(docs: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """doc_id, version, pos, hash of each line whose key is long enough; version tells different texts of a doc_id apart."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")).where(F.col("doc_id").isNotNull())
    lines = rows.select("doc_id", F.xxhash64("body").alias("version"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keys.select("doc_id", "version", "pos", F.unhex(F.md5("key")).alias("hash"))


def repeated_lines(lines: DataFrame, least_docs: int = 3) -> DataFrame:
    """hash, n_docs, last_doc: keys in at least least_docs documents, and the largest doc_id holding each. lines: doc_id, hash."""
    held = lines.groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
    counted = held.groupBy("hash").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    return counted.where(F.col("n_docs") >= least_docs)


def _without(body: Column, gone: Column) -> Column:
    """body without the lines at the ascending positions gone: the stretches between them, put together again."""

    def stretches(parts: Column) -> Column:
        after = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1)) + 1
        upto = lambda i: F.coalesce(F.get(gone, i), F.size(parts))
        return F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(parts, after(i) + 1, upto(i) - after(i)))

    # The one-element array binds the split text once for all stretches.
    return F.array_join(F.flatten(F.transform(F.array(F.split(body, "\n", -1)), lambda parts: F.flatten(stretches(parts)))), "\n")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs.

    A null or empty text has one empty line. Rows that repeat a doc_id are one
    document in the counts, but each loses its own lines only. A null doc_id
    counts in no document and loses no line. Empty table: no rows. Other
    columns aren't read.
    """
    lines = persist(_candidates(docs, doc_id, text, least_chars))
    frequent = persist(repeated_lines(lines, least_docs))
    found = lines.join(frequent, "hash").where(F.col("doc_id") != F.col("last_doc"))
    drops = found.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")).withColumn("version", F.xxhash64("body"))
    joined = rows.join(drops, ["doc_id", "version"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(_without(F.col("body"), F.col("gone")))
    n_lines = (F.length("body") - F.length(F.regexp_replace("body", "\n", "")) + 1).cast("long")
    return joined.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
