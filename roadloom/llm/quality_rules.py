"""Quality rules as a cascade that stops at the first rejection, its order fitted on a sample.

A rule is a predicate on the facts of a text, and facts are computed when a rule first asks for them: where a cheap rule
rejects, the costly facts of the rules behind it are never made.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from roadloom.llm.common import bound_batches
from roadloom.llm.text_stats import COUNTS, TextFacts, base_stats_udf, counts_array
from roadloom.session import checkpointed

#: Rows on which costs and rejections are estimated, and times that each is measured. They only set the order.
SAMPLE_ROWS, REPEATS = 512, 3


@dataclass(frozen=True)
class Rule:
    """A document goes if ``rejects`` is true of its facts."""

    name: str
    rejects: Callable[[TextFacts], bool]


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", lambda f: f.n_symbols * 10 > f.n_words),
        Rule("exclamations", lambda f: f.n_exclamations * 5 > f.n_words),
        Rule("duplicate_lines", lambda f: f.n_dup_lines * 2 > f.n_lines),
        Rule("capitals", lambda f: f.n_capitals * 10 > f.word_chars * 3),
        Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 15 * f.n_words),
        Rule("repeated_words", lambda f: f.n_repeat_words * 10 > f.n_words * 4),
    ]


def base_rules() -> list[Rule]:
    """The two that make ``base_failed``."""
    return [
        Rule("few_words", lambda f: f.n_words < 50),
        Rule("mostly_repeats", lambda f: f.n_repeat_words * 100 > f.n_words * 50),
    ]


def with_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, stats, base_failed)"""
    s = F.col("stats")
    return docs.select("doc_id", "text").withColumn("stats", base_stats_udf(F.col("text"))).withColumn(
        "base_failed", (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)
    )


def rule_costs(texts: DataFrame, rules: Sequence[Rule], repeats: int = REPEATS) -> dict[str, tuple[float, int, int]]:
    """For each rule (seconds a row, rejections, rows) over ``texts`` (text).

    A rule's time in a row is taken where the row is, in the task: from facts not yet asked for to its verdict, the least
    of several tries, less the least time that the same steps take without a rule. So neither the start of a job nor what
    else the machine does counts, and a rule pays for all facts that it needs.
    """
    schema = pa.schema([("rule", pa.int32()), ("seconds", pa.float64()), ("rejected", pa.int64()), ("n", pa.int64())])
    tests: list[Callable[[TextFacts], bool]] = [lambda f: False, *[r.rejects for r in rules]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = [0.0] * len(tests), [0] * len(tests), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                empty = 0.0
                for k, test in enumerate(tests):
                    least = float("inf")
                    for _ in range(repeats):
                        facts = TextFacts(text)
                        began = time.perf_counter()
                        hit = test(facts)
                        least = min(least, time.perf_counter() - began)
                    empty = empty if k else least
                    seconds[k] += max(least - empty, 0.0)
                    rejected[k] += bool(hit)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([range(len(tests)), seconds, rejected, [n] * len(tests)], schema, strict=True)], schema=schema)

    rows = texts.select("text").mapInArrow(run, "rule int, seconds double, rejected long, n long")
    rows = rows.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("hit"), F.sum("n").alias("n")).collect()
    found = {r["rule"]: (r["s"] / max(r["n"], 1), r["hit"], r["n"]) for r in rows}
    return {r.name: found.get(k, (0.0, 0, 0)) for k, r in enumerate(rules, 1)}


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejection per cost, both estimated on a bounded sample (the rows of smallest hashed doc_id).
    Rules that reject nothing there come last, the cheaper first. An empty table keeps the given order."""
    bound_batches(docs.sparkSession)
    picked = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # An id that many rows repeat must not make the sample grow.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id", "left_semi").limit(sample_rows)
    cost = rule_costs(checkpointed(texts), rules)
    return sorted(rules, key=lambda r: (-cost[r.name][1] / max(cost[r.name][2], 1) / max(cost[r.name][0], 1e-9), cost[r.name][0]))


def first_rejection(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects the column ``text``, else null; the rules behind it are not tried."""
    own = tuple(rules)

    @arrow_udf("string")
    def name(texts: pa.Array) -> pa.Array:
        return pa.array([_first(TextFacts(t.as_py()), own) for t in texts], pa.string())

    return name(F.col("text"))


def _first(facts: TextFacts, rules: Sequence[Rule]) -> str | None:
    for rule in rules:
        if rule.rejects(facts):
            return rule.name
    return None


def quality_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row.

    Null and empty texts have no words and fail. The order of the rules changes the work and never the verdict, so
    results do not depend on the sample. The counts are made of every text, since each row returns them; the rules are
    not tried on a text that fails the base. Nothing is shuffled; other columns of ``docs`` do not matter.
    """
    own, base = tuple(order_rules(docs, default_rules() if rules is None else rules, sample_rows)), tuple(base_rules())

    @arrow_udf(", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")
    def judge(texts: pa.Array) -> pa.Array:
        counts, failed, kept = [], [], []
        for t in texts:
            facts = TextFacts(t.as_py())
            counts.append(facts.counts())
            failed.append(_first(facts, base) is not None)
            kept.append(not failed[-1] and _first(facts, own) is None)
        return counts_array(counts, base_failed=pa.array(failed, pa.bool_()), kept=pa.array(kept, pa.bool_()))

    return docs.select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")


def drop_rejected(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rejected rows, all columns as they were; decided in place, without a join. The base checks are
    rules like the others here, so that costly counts are made only of texts that cheaper rules let through. Null and
    empty texts have no words and go; equal rows share their verdict, whatever their doc_id. No rows: no rows."""
    return docs.where(first_rejection(order_rules(docs, base_rules() + default_rules(), sample_rows)).isNull())
