"""Short links of an undirected network, contracted or merged by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import join_lines, point
from roadloom.session import checkpointed

SHORT_M = 12.0


def contract_short_links(nodes: DataFrame, links: DataFrame, short_m: float = SHORT_M) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of nodes (nid, x, y) and links (link_id, a, b, length, category, ids, line) without short links.

    A link shorter than ``short_m`` between two nodes of degree three or more becomes one node at its middle, the smaller
    nid. One with an end of degree two is joined with the other link there: the longer one gives link_id and category,
    lengths add, ids are appended, lines are joined; not where that would close a loop. One with a dead end is joined so too
    if its other end has degree two, and stays otherwise.
    A round takes all short links that are the shortest (then of smallest link_id) round every node they touch, so no two
    of a round meet, and rounds go on until nothing is left to do. Loops of one node are left out.
    """
    links = checkpointed(links.where("a <> b").select("link_id", "a", "b", "length", "category", "ids", "line"))
    nodes = checkpointed(nodes.select("nid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    while True:
        chosen = checkpointed(_chosen(links, short_m))
        if chosen.isEmpty():
            return nodes, links
        pairs = chosen.where("other is null").select(F.greatest("a", "b").alias("gone"), F.least("a", "b").alias("stays"))
        joined = _joined(chosen.where("other is not null"), links, nodes)
        used = chosen.select("link_id").union(chosen.where("other is not null").select(F.col("other").alias("link_id")))
        left = links.join(used, "link_id", "left_anti").unionByName(joined)
        to = lambda end: pairs.select(F.col("gone").alias(end), F.col("stays").alias(f"_{end}"))  # noqa: E731, B023
        moved = left.join(to("a"), "a", "left").join(to("b"), "b", "left").select("link_id", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "length", "category", "ids", "line")
        spot = lambda key: nodes.select(F.col("nid").alias(key), F.col("x").alias(f"x_{key}"), F.col("y").alias(f"y_{key}"))  # noqa: E731, B023
        middle = pairs.join(spot("gone"), "gone").join(spot("stays"), "stays").select(F.col("stays").alias("nid"), ((F.col("x_gone") + F.col("x_stays")) / 2).alias("mx"), ((F.col("y_gone") + F.col("y_stays")) / 2).alias("my"))
        lost = pairs.select(F.col("gone").alias("nid")).union(chosen.where("other is not null").select(F.col("mid").alias("nid")))
        placed = nodes.join(lost, "nid", "left_anti").join(middle, "nid", "left").select("nid", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"))
        new_links = checkpointed(moved.where("a <> b"))
        nodes, links = checkpointed(placed, instead_of=nodes), new_links


def _chosen(links: DataFrame, short_m: float) -> DataFrame:
    """(link_id, a, b, mid, far, other) of the short links of a round; other is null for links between two junctions."""
    ends = links.select("link_id", F.explode(F.array(F.struct(F.col("a").alias("nid"), F.col("b").alias("far")), F.struct(F.col("b").alias("nid"), F.col("a").alias("far")))).alias("e")).select("link_id", "e.*")
    degree = ends.groupBy("nid").agg(F.count("*").alias("n"))
    of = lambda end: degree.select(F.col("nid").alias(end), F.col("n").alias(f"n_{end}"))
    short = links.where(F.col("length") < short_m).select("link_id", "a", "b", "length").join(of("a"), "a").join(of("b"), "b")
    crossing = short.where("n_a >= 3 and n_b >= 3").select("link_id", "a", "b", "length")
    through = short.where("n_a = 2 or n_b = 2").withColumn("mid", F.when(F.col("n_a") == 2, F.col("a")).otherwise(F.col("b")))
    # The middle node has two links, so this join gives one row for each.
    beside = ends.select(F.col("link_id").alias("other"), F.col("nid").alias("mid"), F.col("far"))
    through = through.join(beside, "mid").where("other <> link_id and far <> a and far <> b").select("link_id", "a", "b", "length", "mid", "far", "other")
    able = checkpointed(crossing.unionByName(through, allowMissingColumns=True))
    touched = able.select("link_id", "length", F.explode(F.array_compact(F.array("a", "b", "far"))).alias("nid"))
    first = touched.groupBy("nid").agg(F.min(F.struct("length", "link_id")).alias("m")).select("nid", F.col("m.link_id").alias("first"))
    beaten = touched.join(first, "nid").where("first <> link_id").select("link_id")
    return able.join(beaten, "link_id", "left_anti").select("link_id", "a", "b", "mid", "far", "other")


def _joined(chosen: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each chosen short link as one with the other link at its middle node."""
    other = links.select(*[F.col(c).alias(f"o_{c}") for c in ("link_id", "length", "category", "ids", "line")])
    at = nodes.select(F.col("nid").alias("mid"), point(F.col("x"), F.col("y")).alias("via"))
    both = chosen.join(links.select("link_id", "length", "category", "ids", "line"), "link_id").join(other, F.col("other") == F.col("o_link_id")).join(at, "mid")
    longer = F.col("length") >= F.col("o_length")
    return both.select(
        F.when(longer, F.col("link_id")).otherwise(F.col("o_link_id")).alias("link_id"), F.when(F.col("a") == F.col("mid"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("far").alias("b"),
        (F.col("length") + F.col("o_length")).alias("length"), F.when(longer, F.col("category")).otherwise(F.col("o_category")).alias("category"),
        F.concat("ids", "o_ids").alias("ids"), join_lines(F.col("line"), F.col("o_line"), F.col("via")).alias("line"),
    )
