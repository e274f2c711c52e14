"""Helpers that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.session import checkpointed

#: The word separators of the contracts, as bytes and as a Java character class.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of an Arrow batch of texts at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bytes_of(setting: str) -> int:
    """The number that a size in Spark's notation stands for: ``4194304``, ``64m``, ``1 GB``; no unit means bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches to BATCH_ROWS and BATCH_BYTES where they are wider.

    A batch is held by the JVM and by its Python worker at once, and texts of megabytes come in any table; the operators
    here gain nothing from batches beyond this. Frames are lazy and Spark reads the limits when a frame runs, so they
    stay lowered in the session that the operators were given.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < bytes_of(str(spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def text_sha256(text: str = "text") -> Column:
    """Null and empty texts have the same hash."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def with_verdicts(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, text_sha256, kept) keeps, all columns as they were.

    An id alone does not name a row: null or repeated ids may stand beside other texts, so rows are named by id and text.
    Of kept rows that agree in both one stays, whichever; they may differ in other columns only.
    """
    found = judged.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    found = checkpointed(found.where("not kept or n > 1").select(F.col("doc_id").alias("id"), "text_sha256", F.col("kept").alias("one")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_sha256().alias("sha"))
    same = (own["sha"] == found["text_sha256"]) & own["row.doc_id"].eqNullSafe(found["id"])
    if found.where("one").isEmpty():  # no kept row repeats another: texts are moved once
        return own.join(found, same, "left_anti").select("row.*")
    both = own.join(found, same, "left").select("row", "sha", "one")
    once = both.where("one").withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "sha"])
    return both.where("one is null").select("row.*").union(once.select("row.*"))
