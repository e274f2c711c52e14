"""Line deduplication: hash normalised lines, count documents per hash, drop, reassemble."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import SPACE_BYTES, bound_batches
from roadloom.operators.graph import split_join
from roadloom.session import checkpointed

MIN_CHARS, MIN_DOCS = 20, 3


def line_keys(text: str, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """For each line, the 128-bit hash of its key, or None where the key is too short."""
    out: list[bytes | None] = []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        key = line.strip(SPACE_BYTES).lower()  # bytes lower only A-Z
        long_enough = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh128_digest(key) if long_enough else None)
    return out


def named_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, r1, r2): a null text is empty, and two hashes of id and text name the row. Rows that agree in both
    have one name; they lose the same lines."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", "text", *[F.xxhash64(F.lit(i), "doc_id", "text").alias(f"r{i}") for i in (1, 2)])


def document_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, r1, r2, k1, k2): the hashes of a row's line keys, each once."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "r1", "r2", "k1", "k2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [{k for k in line_keys(t.as_py(), min_chars) if k} for t in batch.column(1)]
            ids = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            flat = np.frombuffer(b"".join(k for s in sets for k in sorted(s)), np.int64).reshape(-1, 2)
            own = [batch.column(i).take(ids) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], schema=schema)

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, k1 long, k2 long")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), a row for each row of ``docs`` (doc_id, text, any others).

    Keys are lines stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars`` code points in at
    least ``min_docs`` different doc_ids lose their lines everywhere but in the largest of those. The others stay in
    place. Null and empty texts are one empty line. Rows that repeat a doc_id are one document in the counts; a null
    doc_id is one that no other is below. Only 16-byte hashes are counted; the counts combine before each shuffle and
    the join back is an equi-join that can be split, so a line that a third of the documents share is no hot spot. What a
    row loses is gathered by the row and not by its doc_id, so a null id that a third of the rows have is none either.
    """
    rows = named_rows(docs)
    lines = document_lines(rows, min_chars)
    counted = lines.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("rows")).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    frequent = counted.where(F.col("n") >= min_docs).select("k1", "k2", "keeper")
    lost = split_join(lines, frequent, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = checkpointed(lost.groupBy("r1", "r2").agg(F.collect_set(F.struct("k1", "k2")).alias("drop")))
    both = split_join(rows, drops, ["r1", "r2"], "left").select("doc_id", "text", F.col("drop.k1").alias("k1"), F.col("drop.k2").alias("k2"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, k1, k2 in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                parts = text.split("\n")
                kept = parts
                if k1:
                    drop = {np.array(k, np.int64).tobytes() for k in zip(k1, k2, strict=True)}
                    kept = [p for p, k in zip(parts, line_keys(text, min_chars), strict=True) if k not in drop]
                texts.append("\n".join(kept))
                total.append(len(parts))
                gone.append(len(parts) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], schema=schema)

    return both.mapInArrow(rebuild, "doc_id long, text string, n_lines long, n_dropped long")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
