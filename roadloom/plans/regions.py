"""Regions and their gates, zones, approach axes, section summaries and small joins of the road tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.geo import angle_diff, bearing
from roadloom.functions.stats import dec
from roadloom.operators.spatial_join import around, in_cells
from roadloom.plans.network import _EDGES_SQL, _TURN_SQL, edges
from roadloom.plans.registry import query
from roadloom.plans.validation import dec_sql
from roadloom.sources.fixtures import table, view

#: Sides of the region (x1, y1, x2, y2) and of a zone's cell; reach of the nearest join; tolerance of an approach axis.
REGION, ZONE_M, REACH_M, AXIS_DEG = (1000, 200, 5000, 100_000), 500, 20, 45
_IN_SQL = "{x} > 1000 and {x} < 5000 and {y} > 200 and {y} < 100000"


def inside(x: Column, y: Column) -> Column:
    return (x > REGION[0]) & (x < REGION[2]) & (y > REGION[1]) & (y < REGION[3])


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m') as ym from orders
where strftime(o_orderdate, '%Y-%m') = (select max(strftime(o_orderdate, '%Y-%m')) from orders)""")
def a13_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the latest month."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"))
    return rows.join(F.broadcast(rows.agg(F.max("ym").alias("ym"))), "ym", "left_semi").select("o_orderkey", "ym")


@query("select nid, exists (select 1 from fx_signs s where s.x between n.x - 20 and n.x + 20 and s.y between n.y - 20 and n.y + 20 and (s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) <= 400) as has_any from fx_nodes n")
def e10_has_any_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sign lies within 20 m of each node. The side with many rows, the signs, is spread over no cells; a cell of
    a node is kept or not, so no pairs are made, and hits are merged, since their size too is taken for that of the nodes."""
    nodes = view(spark, sf_dir, "fx_nodes").select("nid", "x", "y")
    signs = view(spark, sf_dir, "fx_signs").select(F.col("x").alias("sx"), F.col("y").alias("sy"))
    own, placed = around(nodes, "x", "y", REACH_M).alias("n"), in_cells(signs.distinct(), "sx", "sy", REACH_M).alias("s")
    near = (F.col("sx") - F.col("x")) ** 2 + (F.col("sy") - F.col("y")) ** 2 <= REACH_M**2
    hits = own.join(placed, F.expr("n.cx = s.cx and n.cy = s.cy") & near, "left_semi").select("nid", F.lit(True).alias("hit")).distinct().hint("merge")
    return nodes.join(hits, "nid", "left").select("nid", F.coalesce("hit", F.lit(False)).alias("has_any"))


@query(f"""with s as (select hour, flow / cast(cnt as double) as ratio, cnt, 20 + flow % 40 - (20 + cnt % 40) as dv from (select eid, hour, sum(cnt) as cnt from fx_obs group by 1, 2) join fx_flow using (eid, hour) where cnt > 0),
t as (select hour, {dec_sql('ratio')} as r, cnt, dv from s)
select hour, count(*) as n_sections, {dec_sql('cast(sum(cast(r as decimal(18,3)) * cnt) as double) / cast(sum(cnt) as double)')} as ratio_weighted, percentile_disc(0.5) within group (order by r desc) as ratio_median,
  {dec_sql('sum(abs(dv)) / cast(count(*) as double)')} as speed_mae, {dec_sql('sum(dv) / cast(count(*) as double)')} as speed_bias from t group by 1""")
def f12_section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hour: ratio of volumes weighted by the observed one, upper median of the ratios, error and bias of speeds."""
    obs = view(spark, sf_dir, "fx_obs").groupBy("eid", "hour").agg(F.sum("cnt").alias("cnt"))
    both = obs.join(view(spark, sf_dir, "fx_flow"), ["eid", "hour"]).where("cnt > 0")
    rows = both.select("hour", dec(F.col("flow") / F.col("cnt").cast("double")).alias("r"), "cnt", (F.col("flow") % 40 - F.col("cnt") % 40).alias("dv"))
    n = F.count("*").cast("double")
    weighted = F.sum(F.col("r").cast("decimal(18,3)") * F.col("cnt").cast("decimal(18,0)")).cast("double") / F.sum("cnt").cast("double")
    return rows.groupBy("hour").agg(
        F.count("*").alias("n_sections"), dec(weighted).alias("ratio_weighted"), F.expr("percentile_disc(0.5) within group (order by r desc)").alias("ratio_median"),
        dec(F.sum(F.abs("dv")) / n).alias("speed_mae"), dec(F.sum("dv") / n).alias("speed_bias"),
    )


@query("""select source, count(*) as n, count(flow) as checked, count(case when abs(flow - cnt) * 5 <= cnt then 1 end) as agree, max(case when abs(flow - cnt) * 5 <= cnt then abs(flow - cnt) end) as max_residual
from fx_obs left join fx_flow using (eid, hour) group by 1""")
def f32_agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows with a counterpart, rows that agree to a fifth, and the largest residual among those."""
    both = view(spark, sf_dir, "fx_obs").join(view(spark, sf_dir, "fx_flow"), ["eid", "hour"], "left")
    off = F.abs(F.col("flow") - F.col("cnt"))
    near = off * 5 <= F.col("cnt")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("flow").alias("checked"), F.count(F.when(near, 1)).alias("agree"), F.max(F.when(near, off)).alias("max_residual"))


@query("select nid from (select unnest([a, b]) as nid, state from fx_links) group by 1 having count(distinct state) > 1")
def j04_mixed_layer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes where links of different layers meet."""
    ends = view(spark, sf_dir, "fx_links").select(F.explode(F.array("a", "b")).alias("nid"), "state")
    return ends.groupBy("nid").agg(F.min("state").alias("low"), F.max("state").alias("high")).where("low <> high").select("nid")


def gates(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, category, sources, sinks): nodes outside the region with edges that cross into it or come out of it, the
    best class among these, and their sorted ids. A node has a handful of edges, so the lists are short."""
    flags = nodes.select("nid", inside(F.col("x"), F.col("y")).alias("is_in"))
    a, b = (flags.select(F.col("nid").alias(c), F.col("is_in").alias(f"{c}_in")) for c in ("frm", "to"))
    cross = edge_rows.select("eid", "frm", "to", "category").join(a, "frm").join(b, "to").where("frm_in <> to_in")
    rows = cross.select(F.when(F.col("to_in"), F.col("frm")).otherwise(F.col("to")).alias("node"), "eid", "to_in", "category")
    ids = lambda into: F.sort_array(F.collect_list(F.when(F.col("to_in") == into, F.col("eid"))))
    return rows.groupBy("node").agg(F.min("category").alias("category"), ids(True).alias("sources"), ids(False).alias("sinks"))


@query(f"""with {_EDGES_SQL}, f as (select nid, {_IN_SQL.format(x="x", y="y")} as is_in from fx_nodes), c as (select e.eid, e.category, b.is_in as enters, case when b.is_in then e.frm else e.to_node end as node from edges e join f a on a.nid = e.frm join f b on b.nid = e.to_node where a.is_in <> b.is_in)
select node, min(category) as category, coalesce(string_agg(cast(eid as varchar), ',' order by eid) filter (enters), '') as sources, coalesce(string_agg(cast(eid as varchar), ',' order by eid) filter (not enters), '') as sinks from c group by 1""")
def j20_boundary_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gates(edges(spark, sf_dir), view(spark, sf_dir, "fx_nodes"))
    return rows.select("node", "category", F.concat_ws(",", F.col("sources").cast("array<string>")).alias("sources"), F.concat_ws(",", F.col("sinks").cast("array<string>")).alias("sinks"))


@query(f"with {_TURN_SQL} select e.eid, coalesce(bool_or(d >= 45 and d <= 135), false) as has_right_turn from edges e left join pd on pd.eid = e.eid group by 1")
def j21_has_right_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an edge has a successor 45 to 135 degrees clockwise that is not the way back."""
    e = edges(spark, sf_dir).select("eid", "frm", "to", "linked_edge", bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bear"))
    nxt = e.select(F.col("eid").alias("succ"), F.col("frm").alias("to"), F.col("bear").alias("bear2"))
    d = F.bround(angle_diff(F.col("bear2"), F.col("bear")), 6)
    turns = e.join(nxt, "to").where("linked_edge is null or succ <> linked_edge").groupBy("eid").agg(F.bool_or(d.between(45, 135)).alias("turns"))
    return e.join(turns, "eid", "left").select("eid", F.coalesce("turns", F.lit(False)).alias("has_right_turn"))


@query(f"""with {_TURN_SQL}, r as (select *, first_value(bear) over (partition by to_node order by category desc, width_cls desc, eid) as ref from bb)
select eid, to_node, case when least(abs(bear - ref) % 180, 180 - abs(bear - ref) % 180) <= 45 then 'A' else 'B' end as axis from r""")
def j24_approach_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis A for approaches within 45 degrees, whichever way, of the node's first approach; the others are B.

    The first approach is a minimum, combined before the shuffle, so a node of any degree is no window.
    """
    e = edges(spark, sf_dir).select("eid", F.col("to").alias("to_node"), "category", "width_cls", bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bear"))
    first = e.groupBy("to_node").agg(F.min(F.struct((-F.col("category")).alias("c"), (-F.col("width_cls")).alias("w"), "eid", "bear")).alias("m")).select("to_node", F.col("m.bear").alias("ref"))
    apart = F.abs(F.col("bear") - F.col("ref")) % 180
    return e.join(first, "to_node").select("eid", "to_node", F.when(F.least(apart, 180 - apart) <= AXIS_DEG, "A").otherwise("B").alias("axis"))


@query(f"""with c as (select cast(floor(x / 500.0) as bigint) as cx, cast(floor(y / 500.0) as bigint) as cy, count(case when code = '63' then 1 end) as pop, count(case when code = '98' then 1 end) * 7 as emp7 from fx_signs group by 1, 2),
l as (select cast(floor((x1 + x2) / 1000.0) as bigint) as cx, cast(floor((y1 + y2) / 1000.0) as bigint) as cy, count(*) as n_links from fx_links group by 1, 2)
select cx, cy, pop, emp7 / 10.0 as emp, n_links from c join l using (cx, cy) where (pop > 0 or emp7 > 0) and {_IN_SQL.format(x="(cx * 500 + 250)", y="(cy * 500 + 250)")}""")
def k02_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their centre in the region that have people or jobs and at least one link's middle."""
    at = lambda v, size: F.floor(v / F.lit(float(size))).cast("long")
    counts = view(spark, sf_dir, "fx_signs").groupBy(at(F.col("x"), ZONE_M).alias("cx"), at(F.col("y"), ZONE_M).alias("cy")).agg(F.count(F.when(F.col("code") == "63", 1)).alias("pop"), (F.count(F.when(F.col("code") == "98", 1)) * 7).alias("emp7"))
    links = view(spark, sf_dir, "fx_links").groupBy(at(F.col("x1") + F.col("x2"), 2 * ZONE_M).alias("cx"), at(F.col("y1") + F.col("y2"), 2 * ZONE_M).alias("cy")).agg(F.count("*").alias("n_links"))
    half = ZONE_M // 2
    good = counts.where((F.col("pop") > 0) | (F.col("emp7") > 0)).where(inside(F.col("cx") * ZONE_M + half, F.col("cy") * ZONE_M + half))
    return good.join(links, ["cx", "cy"]).select("cx", "cy", "pop", (F.col("emp7") / 10.0).alias("emp"), "n_links")
