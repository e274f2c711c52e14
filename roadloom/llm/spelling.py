"""Spelling variants: words at one edit from each other, found by a relational search over a trie.

The vocabulary's trie is a distributed edge table, kept by level. A state of the search is (word, position, node, edits):
``position`` code points of a word have led to ``node`` with so many edits. Words that share those code points share the
state, so a state names its words by the trie node of their first code points. Level by level the frontier is joined
with the edges of both nodes: states without an edit branch into those with one, states with one edit go on only by equal
code points. A state with one edit in which both sides are whole words makes these neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import UPPER, bound_batches
from roadloom.operators.graph import split_join
from roadloom.session import checkpointed

#: What a run is made of, and which occurrences lose a code point.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SPOILED_OF = 97
_LOWER = str.maketrans(UPPER, UPPER.lower())
MIN_CHARS, MIN_COUNT, FACTOR = 5, 3, 2
#: Words with more code points than this have no path in the trie, since each level costs a round.
MOST_LEVELS = 48
#: Distinct words whose counts a task holds at once.
HELD_WORDS = 200_000


def lower_word(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text, any others) of enough code points and occurrences.

    Every occurrence counts, of repeated rows too; null texts have none. A null doc_id is an empty one in the hash. Tasks
    add up counts before the shuffle and never hold more than HELD_WORDS words besides those of one text.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flat(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[str, int] = {}
                for word, n in Counter(RUN.findall(text.as_py() or "")).items():
                    word = lower_word(word)
                    own[word] = own.get(word, 0) + n
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % SPOILED_OF == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                    if len(word) >= min_chars:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield flat(held)
                    held = {}
        yield flat(held)

    bound_batches(docs.sparkSession)
    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def trie_edges(words: DataFrame) -> DataFrame:
    """(level, node, n, nexts): the trie of words (word, n), a row for each node.

    A node is the prefix that leads to it and ``level`` its length; n is the word's count where the node is a whole word;
    ``nexts`` are the code points of the edges to its children, of which there are as many as the alphabet has at most.
    """
    at = F.sequence(F.lit(0), F.char_length("word"))
    steps = words.select(F.explode(F.transform(at, lambda i: F.struct(
        i.alias("level"), F.substring("word", F.lit(1), i).alias("node"), F.substring("word", i + 1, F.lit(1)).alias("next"), F.when(i == F.char_length("word"), F.col("n")).alias("n"),
    ))).alias("s")).select("s.*")
    return steps.groupBy("level", "node").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.when(F.col("next") != "", F.col("next")))).alias("nexts"))


def trie_neighbours(words: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(word, n, near, near_n) pairs of distinct words (word, n) at one edit, each pair once; words of at most
    ``most_levels`` code points.

    A pair is one of a substitution, whose first word has the smaller code point there, or of a deletion, whose first word
    is the longer one and loses the first of a run of equal code points: so no pair is found twice, and insertions are
    deletions seen from the other side. A node has few one-edit neighbours, so no key of these joins is hot.
    """
    spark = words.sparkSession
    trie = trie_edges(words.where(F.char_length("word") <= most_levels))
    trie = checkpointed(trie.repartitionByRange("level", "node"), partition_by=("level",))
    depth = trie.agg(F.max("level")).first()[0]
    pairs, frontier = [], None
    state = "q string, qn long, t string, tn long"
    for level in range(depth or 0):
        here, there = (trie.where(F.col("level") == i).drop("level") for i in (level, level + 1))
        child = lambda c: F.concat("node", c)
        # Branches of the state without edits, which has the word's own node on both sides.
        other = F.flatten(F.transform("nexts", lambda a: F.transform(F.filter("nexts", lambda b: a < b), lambda b: F.struct(child(a).alias("q"), child(b).alias("t")))))
        last = F.substring("node", level, 1) if level else F.lit("")
        lost = F.transform(F.filter("nexts", lambda a: a != last), lambda a: F.struct(child(a).alias("q"), F.col("node").alias("t")))
        moved = here.select(F.explode(F.concat(other, lost)).alias("s")).select("s.q", "s.t")
        if frontier is not None:
            moved = moved.union(frontier.select(F.explode(F.array_intersect("qnext", "tnext")).alias("c"), "q", "t").select(F.concat("q", "c").alias("q"), F.concat("t", "c").alias("t")))
        q = there.select(F.col("node").alias("q"), F.col("n").alias("qn"), F.col("nexts").alias("qnext"))
        both = here.unionByName(there)
        t = both.select(F.col("node").alias("t"), F.col("n").alias("tn"), F.col("nexts").alias("tnext"))
        frontier = checkpointed(moved.join(q, "q").join(t, "t").where("qn is not null and tn is not null or arrays_overlap(qnext, tnext)"))
        pairs.append(frontier.where("qn is not null and tn is not null").select("q", "qn", "t", "tn"))
    out = spark.createDataFrame([], state)
    for found in pairs:
        out = out.union(found)
    return out.toDF("word", "n", "near", "near_n")


def _forms(word: str) -> list[int]:
    """Hashes of ``word`` and then of its forms without the code point at each place, from prefix sums."""
    mod, base = (1 << 61) - 1, 0x1F3A5C7B9D
    terms, nearer, power = [], [], 1
    for i, c in enumerate(word):
        nearer.append(ord(c) * power if i else 0)  # as it counts once an earlier code point is gone: the power before its own
        power = power * base % mod if i else 1
        terms.append(ord(c) * power % mod)
    whole, after, before, forms = sum(terms) % mod, sum(nearer) % mod, 0, []
    for term, near in zip(terms, nearer, strict=True):
        after = (after - near) % mod
        forms.append((before + after) % mod)
        before = (before + term) % mod
    return [whole, *forms]


def long_neighbours(words: DataFrame, least: int = MOST_LEVELS) -> DataFrame:
    """As ``trie_neighbours`` for words of at least ``least`` code points, whose trie would take a round for each of them.

    Words at one substitution are equal without the code point at one same place; a word at one deletion from a longer one
    equals it without a code point. So words meet by hashes of these forms, of which each has one row, and pairs are
    compared in full. Words that agree but for one place are as many as the alphabet has code points at most.
    """
    schema = pa.schema([("id", pa.int64()), ("place", pa.int32()), ("form", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                forms = _forms(word)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(forms), pa.int64()), pa.array(range(-1, len(word)), pa.int32()), pa.array(forms, pa.int64())], schema=schema)

    own = words.where(F.char_length("word") >= least).select(F.xxhash64("word").alias("id"), "word", "n")
    forms = checkpointed(own.select("id", "word").mapInArrow(run, "id long, place int, form long"))
    other = forms.select(F.col("id").alias("near_id"), F.col("place").alias("near_place"), "form")
    same = forms.where("place >= 0").join(other.withColumnRenamed("near_place", "place"), ["form", "place"]).where("id < near_id")
    shorter = forms.where("place >= 0").join(other.where("near_place < 0"), "form").where("id <> near_id")
    met = same.select("id", "near_id").union(shorter.select("id", "near_id")).distinct()
    pairs = met.join(own, "id").join(own.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_id")
    return pairs.where("levenshtein(word, near, 1) = 1").select("word", "n", "near", "near_n")


def neighbours(words: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(word, n, near, near_n): all pairs of distinct words (word, n) at one inserted, deleted or replaced code point, each
    pair once, whichever comes first."""
    pairs = trie_neighbours(words, most_levels)
    if words.where(F.char_length("word") > most_levels).isEmpty():
        return pairs
    more = long_neighbours(words, most_levels).where((F.char_length("word") > most_levels) | (F.char_length("near") > most_levels))
    return pairs.union(more)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), followed to the last. A form occurs at least FACTOR times as often as its word, so
    chains are short; each round doubles what is followed, and a root that many words share is split."""
    found = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        then = found.select(F.col("word").alias("root"), F.col("root").alias("then"))
        further = split_join(found, then, ["root"], "left")
        if further.where("then is not null").isEmpty():
            return found
        found = checkpointed(further.select("word", F.coalesce("then", "root").alias("root")), instead_of=found)


def spelling_variants(docs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of ``docs`` (doc_id, text, any others).

    A word's form is its neighbour of most occurrences, the first in code-point order among equals, if that occurs at least
    ``factor`` times as often; root is the last of a chain of forms. No words: no rows.
    """
    words = checkpointed(word_counts(docs))
    pairs = neighbours(words)
    both = pairs.select("word", "near", "near_n").union(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    has_form = -F.col("best.less") >= factor * F.col("n")
    rows = checkpointed(rows.select(
        "word", F.when(has_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.less")).alias("form_n"),
    ))
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
