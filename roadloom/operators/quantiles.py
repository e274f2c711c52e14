"""Exact quantiles of groups of any size, without a buffer that holds a column.

The values between two bounds are counted by ranges, whose ends an approximate sketch proposes; the range that holds a
wanted rank becomes the new bounds. Every round leaves a sixtieth or so of the values, and equal values by themselves,
until few enough are left to be sorted in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.session import checkpointed

#: Values that are sorted in one row at most, and ranges of a round.
SORTED_AT_ONCE, RANGES = 4096, 64


def _ranked(data: DataFrame, wanted: DataFrame, keys: list[str], most: int, ranges: int) -> DataFrame:
    """(keys, rank, value) of the ranks of wanted (keys, rank, low, high, before, n) among data (keys, v): low to high holds n
    values, the rank's among them, and ``before`` values are lower."""
    done = []
    while True:
        wanted = checkpointed(wanted)
        done.append(wanted.where("low = high").select(*keys, "rank", F.col("low").alias("value")))
        few = wanted.where((F.col("low") < F.col("high")) & (F.col("n") <= most))
        own = data.join(few, keys).where("v >= low and v <= high")
        place = (F.col("rank") - F.first("before") + 1).cast("int")
        done.append(own.groupBy(*keys, "rank").agg(F.element_at(F.sort_array(F.collect_list("v")), place).alias("value")))
        many = wanted.where((F.col("low") < F.col("high")) & (F.col("n") > most))
        if many.isEmpty():
            break
        inside = data.join(many, keys).where("v >= low and v <= high")
        cuts = inside.groupBy(*keys, "rank").agg(F.percentile_approx("v", [i / ranges for i in range(ranges + 1)], 10_000).alias("cuts"))
        # A value that is itself a cut has a range of its own, so that many equal values do not stand in the way.
        bin_ = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        counted = inside.join(checkpointed(cuts), [*keys, "rank"]).groupBy(*keys, "rank", "before", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        below = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin")) - F.col("n")
        placed = counted.withColumn("below", F.col("before") + below).where("below <= rank and rank < below + n")
        wanted = placed.select(*keys, "rank", "low", "high", F.col("below").alias("before"), "n")
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float | None], most: int = SORTED_AT_ONCE, ranges: int = RANGES) -> DataFrame:
    """(keys, n, low, high, a column for each name of ``wanted``) of each group of ``df``: quantiles at shares between 0 and 1,
    interpolated between the two nearest values, or the upper median where the share is None.

    Null values do not count; a group of nulls alone has no row. Null keys are a group. NaN is above all numbers.
    """
    given = df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("v")).where("v is not null")
    safe = [f"_{i}" for i in range(len(keys))]
    data = checkpointed(given.select(*[F.struct(F.col(k)).alias(s) for k, s in zip(keys, safe, strict=True)], "v")) if keys else checkpointed(given.withColumn("_0", F.struct(F.lit(0).alias("all"))))
    safe = safe or ["_0"]
    groups = checkpointed(data.groupBy(*safe).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))

    def position(p: float | None) -> Column:
        return F.floor(F.col("n") / 2).cast("double") if p is None else p * (F.col("n") - 1).cast("double")

    ranks = [F.struct(F.lit(name).alias("name"), position(p).alias("at")) for name, p in wanted.items()]
    asked = checkpointed(groups.select(*safe, "n", "low", "high", F.explode(F.array(*ranks)).alias("a")).select(*safe, "n", "low", "high", "a.name", "a.at"))
    needed = asked.select(*safe, F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), "n").distinct()
    found = checkpointed(_ranked(data, needed, safe, most, ranges))
    side = lambda end: found.select(*safe, F.col("rank").alias(end), F.col("value").alias(f"{end}_value"))
    both = asked.withColumn("a", F.floor("at")).withColumn("b", F.ceil("at")).join(side("a"), [*safe, "a"]).join(side("b"), [*safe, "b"])
    mixed = F.when(F.col("a") == F.col("b"), F.col("a_value")).otherwise((F.col("b") - F.col("at")) * F.col("a_value") + (F.col("at") - F.col("a")) * F.col("b_value"))
    out = both.withColumn("q", mixed).groupBy(*safe, "n", "low", "high").agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in wanted])
    return out.select(*[F.col(f"{s}.{k}").alias(k) for s, k in zip(safe, keys, strict=False)], "n", "low", "high", *wanted)
