"""Facts of a whole text, each computed when it is first asked for."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from roadloom.llm.common import SPACE_BYTES

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
_CAPITAL = regex.compile(r"\p{Lu}")

#: The counts that a row of results carries.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    a = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    k = len(codes)
    if k < 2_000_000:
        key = (a[:-2] * k + a[1:-1]) * k + a[2:]
    else:  # three codes of over 21 bits don't fit in one key
        pair = np.unique(a[:-2] * k + a[1:-1], return_inverse=True)[1]
        key = pair * k + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


class TextFacts:
    """A null text has the facts of an empty one."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at exactly the six ASCII spaces

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACE_BYTES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_lines(self) -> int:
        return self.text.count("\n") + 1

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_exclamations(self) -> int:
        return self.text.count("!")

    @cached_property
    def n_capitals(self) -> int:
        """Characters of the class Lu."""
        if self.text.isascii():
            return len(self.raw) - len(self.raw.translate(None, CAPITALS))
        return len(_CAPITAL.findall(self.text))

    def counts(self) -> tuple[int, ...]:
        return tuple(getattr(self, c) for c in COUNTS)


def base_stats_udf(text: Column) -> Column:
    """The counts of ``text`` as a struct of longs."""

    @arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    def stats(texts: pa.Array) -> pa.Array:
        return counts_array([TextFacts(t.as_py()).counts() for t in texts])

    return stats(text)


def counts_array(rows: list[tuple[int, ...]], **more: pa.Array) -> pa.StructArray:
    """Rows of COUNTS, and further columns, as a struct."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns] + list(more.values()), names=[*COUNTS, *more])
