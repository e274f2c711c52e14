"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so, each chunk becomes an identifier, and a text becomes the ordered list
of its chunks' identifiers (its recipe). Chunks are moved once, to make sure that no identifier stands for two
different chunks; after that only recipes are compared, some 1 % of the size of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import with_verdicts
from roadloom.operators.graph import split_join
from roadloom.session import checkpointed

#: Chunks have at least MIN and at most MAX characters, but for the last one of a text.
MIN_CHARS, MAX_CHARS = 512, 4096


def _class(step: int, rest: int) -> str:
    return "[" + "".join(f"\\x{c:02x}" for c in range(256) if c % step == rest) + "]"


def chunks_of(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """The text as consecutive chunks. A chunk ends at the first pair of characters past ``low`` of which the first has
    a code of 5 and the second one of 0 modulo 8 (below 256), so equal passages meet equal cuts; at ``high`` at last."""
    cut = f"(?s).{{{low - 2},{high - 2}}}?{_class(8, 5)}{_class(8, 0)}|.{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(cut), 0)


def default_id(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_recipes(docs: DataFrame, chunk_id=default_id) -> DataFrame:
    """(doc_id, text_sha256, recipe array<bigint>) of each row; equal recipes mean equal texts.

    An identifier is a hash at first. All chunks are then grouped by hash and content (combined before the shuffle, so a
    chunk that a third of the corpus shares costs a row per task). Where a hash turns out to stand for several contents,
    those chunks get the hash of a numbered form instead, again checked, and the recipes that hold them are made anew.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = base.select("text", F.explode(chunks_of(F.col("text"))).alias("chunk")).select("chunk", chunk_id(F.col("chunk")).alias("id"))
    contents = cut.groupBy("id", "chunk").agg(F.count("*").alias("n"))
    shared = contents.groupBy("id").agg(F.count("*").alias("contents"), F.min("id").alias("_")).where("contents > 1").select("id")
    shared = checkpointed(shared)
    sha = F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    plain = base.select("doc_id", sha, F.transform(chunks_of(F.col("text")), lambda c: chunk_id(c)).alias("recipe"))
    if shared.isEmpty():
        return plain
    # Ambiguous hashes: the recipe names the chunk by the hash and its rank among the contents of that hash.
    from pyspark.sql import Window

    ranked = contents.join(shared, "id").select(
        "id", "chunk", F.dense_rank().over(Window.partitionBy("id").orderBy("chunk")).cast("long").alias("rank")
    )
    keyed = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    keyed = checkpointed(keyed)
    placed = keyed.select("row", F.posexplode(chunks_of(F.col("text"))).alias("pos", "chunk")).select(
        "row", "pos", "chunk", chunk_id(F.col("chunk")).alias("id")
    )
    named = placed.join(ranked, ["id", "chunk"], "left").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("parts")
    )
    flat = F.flatten(F.transform("parts", lambda p: F.array(p["id"], p["rank"])))
    return keyed.join(named, "row", "left").select(
        "doc_id", sha, F.coalesce(flat, F.array().cast("array<bigint>")).alias("recipe")
    )


def exact_dedup(docs: DataFrame, chunk_id=default_id) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs`` (doc_id, text, any others).

    Of equal texts the row with the largest doc_id stays. Null and empty texts are equal, with an empty recipe. Groups
    are counted before the shuffle and joined back by recipe, so a group of copies that holds a third of the rows is
    never gathered. Rows that repeat a doc_id and its text count in group_size and share the verdict of that doc_id;
    null doc_ids come last, and if all of a group are null then all of them are kept. No rows: no rows.
    """
    rows = chunk_recipes(docs, chunk_id)
    # Length and hash in front make the join compare whole recipes only for likely equals.
    keyed = rows.withColumn("h", F.xxhash64("recipe"))
    groups = keyed.groupBy("h", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    both = split_join(keyed, groups, ["h", "recipe"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    both = both.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    return both.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, and with one of those that repeat a doc_id, null or not, and
    its text; all columns as they were."""
    return with_verdicts(docs, exact_dedup(docs))
