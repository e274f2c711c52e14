"""Which filter removes what, in every order: an audit of filters that overlap, by higher-order SQL folds.

Documents are reduced to one cell for each part and set of filters that they fail, with counts. A cell is folded over all
orders of the filters, which the plan holds as one array: what a filter does to a cell depends on the filters before it
only by whether one of them removed the cell already. The fold gives one struct for each order and step, weighted by the
cell's counts, and the cells of a part are merged by sums element by element.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.graph import split_join
from roadloom.session import checkpointed

#: Fixed values of the five filters.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
#: Fixed value: what separates words.
SPACES = " \t\n\x0b\x0c\r"
FILTERS = "ABCDE"
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> Column:
    """The set of the filters but the last that ``text``, not null, fails by itself, as bits."""
    bare = F.btrim(text, F.lit(SPACES))
    # A lambda's argument is computed once, whatever is asked of it.
    by_words = F.transform(F.array(F.split(bare, f"[{SPACES}]+")), lambda w: bit(0, F.size(w) < MIN_WORDS) + bit(1, 100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w)))[0]
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    chars = bit(2, 100 * capitals > CAPITAL_PERCENT * F.char_length(text)) + bit(3, text.rlike(SYMBOLS))
    return F.when(bare == "", bit(0, F.lit(True))).otherwise(by_words) + chars


def bit(i: int, fails: Column) -> Column:
    return F.when(fails, 1 << i).otherwise(0)


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, bit 0 for the first.

    Whether a smaller doc_id has the same text is told by the least doc_id of each text's hash, over the whole table.
    Minima combine before the shuffle and are joined back only where a text occurs again, so copies by the thousand are
    never gathered. Texts do not leave their task. Rows without doc_id have no smaller one and are smaller than none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"), own_failures(text).alias("own"))
    rows = checkpointed(rows)
    first = rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("sha", "first")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    both = split_join(split_join(rows, first, ["sha"], "left"), marks, ["doc_id"], "left")
    failed = F.col("own") + bit(4, F.col("first") < F.col("doc_id"))
    return both.groupBy("part", failed.alias("mask")).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def all_orders(n: int) -> Column:
    """The orders of n filters as arrays of bits, in the order of the alphabet; a constant of the plan."""
    return F.array(*[F.array(*[F.lit(1 << i) for i in order]) for order in permutations(range(n))])


def fold_order(order: Column, mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """What each step of ``order`` does to a cell: an array of structs of SUMS and the step's bit."""
    none = F.lit(0).cast("long")

    def step(acc: Column, bit: Column) -> Column:
        fails, gone = mask.bitwiseAND(bit) > 0, mask.bitwiseAND(acc["before"]) > 0
        weigh = lambda when, by: F.when(when, by).otherwise(none)
        removed = fails & ~gone
        now = F.struct(
            bit.alias("bit"), weigh(~fails & ~gone, n).alias("kept"), weigh(removed, n).alias("removed"), weigh(fails & gone, n).alias("redundant"),
            weigh(mask == bit, n).alias("unique_fails"), weigh(removed, good).alias("good_lost"), weigh(removed, toxic).alias("toxic_lost"),
        )
        return F.struct(acc["before"].bitwiseOR(bit).alias("before"), F.concat(acc["steps"], F.array(now)).alias("steps"))

    kind = "array<struct<bit:int," + ",".join(f"{c}:bigint" for c in SUMS) + ">>"
    return F.aggregate(order, F.struct(F.lit(0).alias("before"), F.array().cast(kind).alias("steps")), step, lambda acc: acc["steps"])


def audit_cells(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, SUMS..., shapley) from cells (part, mask, n, good, toxic) of any filters.

    A part has a cell at most for each set of filters, so its cells are merged in one array of 2^k folds at most. All
    orders and steps come with their zeros. ``shapley`` is what the step's filter removes, summed over all orders.
    """
    folds = F.flatten(F.transform(all_orders(len(filters)), lambda o: fold_order(o, F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"))))
    cells = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = cells.select("part", folds.alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("cells"))
    add = lambda a, b: F.struct(a["bit"].alias("bit"), *[(a[c] + b[c]).alias(c) for c in SUMS])
    merged = F.aggregate(F.slice("cells", 2, F.size("cells")), F.col("cells")[0], lambda acc, more: F.zip_with(acc, more, add))
    parts = parts.select("part", merged.alias("steps"))
    total = lambda bit: F.aggregate(F.filter("steps", lambda s: s["bit"] == bit), F.lit(0).cast("long"), lambda acc, s: acc + s["removed"])
    shapley = F.map_from_arrays(F.array(*[F.lit(1 << i) for i in range(len(filters))]), F.array(*[total(1 << i) for i in range(len(filters))]))
    rows = parts.select("part", shapley.alias("shapley"), F.posexplode("steps").alias("at", "s"))
    names = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    order, step = F.element_at(names, F.floor(F.col("at") / len(filters)).cast("int") + 1), (F.col("at") % len(filters) + 1).cast("int")
    return rows.select("part", order.alias("filter_order"), step.alias("step"), *[F.col(f"s.{c}").alias(c) for c in SUMS], F.col("shapley")[F.col("s.bit")].alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part of ``docs`` (doc_id, text, lang, any others), order of the five filters and step.

    The part is the lang, a null one the empty string. Null texts are empty: they fail the first filter, and all but the
    smallest doc_id of them the last. Rows that repeat a doc_id and its text all count and are no copies of each other.
    A document is good (toxic) if any row of ``labels`` (doc_id, quality, toxic) says so; nulls there say nothing. No
    rows: no rows.
    """
    return audit_cells(failure_cells(docs, labels))
