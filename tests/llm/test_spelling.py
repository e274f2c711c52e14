"""Spelling variants against a comparison of every word with every other."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadloom.llm import spelling as S

DOCS = "doc_id long, text string, word string, n int, root int"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_counts(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    near = {w: sorted((-counts[v], v) for v in counts if v != w and one_edit(w, v)) for w in counts}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * counts[w] else None for w in counts}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(near[w]), form[w] and counts[form[w]]) for w in counts}


def fixture():
    rng = random.Random(7)
    parts = ["th", "er", "on", "an", "re", "é", "ou", "ß", "Ü", "a", "aa", "x"]
    stem = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 5))) for _ in range(60)]

    def noisy(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("aeé") + w[i:], w[:i] + rng.choice("aexÿ") + w[i + 1 :], w.upper()])

    long = "ab" * 40
    tail = [long, long[:-1], long[1:], long[:30] + "x" + long[31:], long + "b", "q" * 47, "q" * 48, "q" * 49, "q" * 50, "z" * 3000, "z" * 2999, "z" * 1500 + "y" + "z" * 1499]
    rows = [(i, " ".join(noisy(rng.choice(stem[: 1 + i % 60])) for _ in range(rng.choice([0, 5, 80]))), "w", 1, 2) for i in range(400)]
    rows += [(1000 + i, ",".join(tail), "w", 1, 2) for i in range(4)]
    return rows + [(None, "nulls nulls nulls", "w", 1, 2), (None, None, None, None, None), (3, "", "w", 1, 2), (5, "Repeat repeat\nREPEAT1repeat×÷repeats", "w", 1, 2), (5, "Repeat repeat\nREPEAT1repeat×÷repeats", "w", 1, 2), (6, "repeats, repeats", "w", 1, 2)]


def test_variants_equal_brute_force(spark):
    docs = spark.createDataFrame(fixture(), DOCS).repartition(4)
    counts = plain_counts(fixture())
    want = plain_groups(counts)
    assert len(counts) > 150 and any(r[1] and r[1] != r[2] for r in want)
    got = S.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("levels", [3, 6, 48])
def test_each_pair_once_whatever_the_depth(spark, levels):
    rng = random.Random(levels)
    words = list({"".join(rng.choice("aab") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = [frozenset((r.word, r.near)) for r in S.neighbours(frame, levels).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}


def test_roots_of_long_chains(spark):
    chain = spark.range(1, 41).select(F.concat(F.lit("w"), "id").alias("word"), F.concat(F.lit("w"), F.col("id") - 1).alias("form"))
    assert {r.root for r in S.roots(chain).collect()} == {"w0"}


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_WORDS", 1)
    docs = spark.createDataFrame(fixture(), DOCS).coalesce(1)
    assert {r.word: r.n for r in S.word_counts(docs).collect()} == plain_counts(fixture())


def test_no_words(spark):
    assert S.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert S.spelling_variants(spark.createDataFrame([(1, "a b c", None, None, None), (2, "1234 5678", None, None, None)], DOCS)).count() == 0
