"""The filter audit against a plain walk of every document through every order."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

from roadloom.llm.filter_audit import audit_cells, filter_audit

DOCS = "doc_id long, text string, lang string, mask int, part int"


def plain(rows, marks):
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = defaultdict(Counter)
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text), i is not None and first[text] < i), strict=True) if x}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                cell = out[lang or "", order, step]
                cell["redundant"] += f in fails and gone
                cell["unique_fails"] += fails == {f}
                if f in fails and not gone:
                    gone = True
                    cell["removed"] += 1
                    cell["good_lost"] += i in good
                    cell["toxic_lost"] += i in toxic
                cell["kept"] += not gone
    total = Counter()
    for (part, order, step), cell in out.items():
        total[part, order[step - 1]] += cell["removed"]
    return {(*k, *(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), total[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def prose(n: int, kinds: int, extra: str = "") -> str:
    return " ".join(f"word{i % kinds}" for i in range(n)) + extra


def fixture():
    rows = [
        (1, prose(150, 150), "en"), (2, prose(150, 150), "en"), (3, prose(150, 150), "fr"), (4, prose(150, 20), "en"), (5, prose(150, 20, " $"), "en"), (6, prose(120, 119, " | A"), "fr"),
        (7, None, "en"), (8, "", None), (9, " \x0b\r\n", ""), (10, "SHOUT " * 200, "fr"), (10, "SHOUT " * 200, "fr"), (None, prose(150, 150), "en"), (None, None, "de"), (11, "shout " * 99 + "A", "de"),
        (12, "x" * 90 + "A" * 10, "de"), (13, "x" * 89 + "A" * 10, "de"), (14, prose(100, 80), "de"), (15, prose(100, 79), "de"), (16, "\n".join(f"日本{i}" for i in range(40_000)), "en"), (17, "é " * 101, "es"),
    ]
    marks = [(1, 1, 0), (2, 1, 0), (3, 0, 1), (4, 1, None), (4, None, 1), (10, 0, 1), (None, 1, 1), (99, 1, 1), (7, 1, 0), (17, 1, 1)]
    return [(*r, 1, 2) for r in rows], marks


def test_audit_equals_a_plain_walk(spark):
    rows, marks = fixture()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = filter_audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 600 * 5 and set(found) == plain(rows, marks)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], DOCS), labels).count() == 0
    only = filter_audit(spark.createDataFrame([(None, None, None, 0, 0)], DOCS), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [tuple(r)[3:] for r in only] == [(0, 1, 0, 1, 0, 0, 120)] + [(0, 0, 0, 0, 0, 0, 0)] * 4


def test_cells_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 0b11, 5, 2, 1), ("p", 0b01, 3, 1, 0), ("p", 0, 2, 2, 2), ("p", 0b01, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): tuple(r)[3:] for r in audit_cells(cells, "XY").collect()}
    assert rows == {("XY", 1): (2, 9, 0, 4, 3, 1, 13), ("XY", 2): (2, 0, 5, 0, 0, 0, 5), ("YX", 1): (6, 5, 0, 0, 2, 1, 5), ("YX", 2): (2, 4, 5, 4, 1, 0, 13)}
