"""Directed network: snapping, components, edges, lanes, speeds, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.stats import dec
from roadloom.operators import network as N
from roadloom.operators.graph import connected_components, near_stars
from roadloom.operators.spatial_join import cell, near_links
from roadloom.plans.registry import query
from roadloom.plans.validation import dec_sql
from roadloom.session import checkpointed
from roadloom.sources.fixtures import table, view

#: Side of the places within which near points are joined first.
SNAP_BLOCK_M = 520

_EDGES_SQL = """edges as (
  select link_id * 2 as eid, a as frm, b as to_node, case when oneway = '' then link_id * 2 + 1 end as linked_edge, oneway, link_id, width_cls, category, state, x1, y1, x2, y2 from fx_links where oneway in ('', 'F')
  union all select link_id * 2 + 1, b, a, case when oneway = '' then link_id * 2 end, oneway, link_id, width_cls, category, state, x2, y2, x1, y1 from fx_links where oneway in ('', 'R'))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.directed_edges(view(spark, sf_dir, "fx_links"))


@query(f"with {_EDGES_SQL} select eid, frm, to_node, linked_edge, case when oneway = '' then 'two_way' else 'regulation' end as source, x1, y1, x2, y2 from edges")
def j10_directed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("eid", "frm", F.col("to").alias("to_node"), "linked_edge", "source", "x1", "y1", "x2", "y2")


@query(f"with {_EDGES_SQL} select least(eid, coalesce(linked_edge, eid)) as pair, count(*) as directions from edges group by 1")
def e24_edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy(F.least("eid", F.coalesce("linked_edge", "eid")).alias("pair")).agg(F.count("*").alias("directions"))


_LANE_SQL = """v as (select *, oneway = '' as two, case when link_id % 3 = 0 then link_id % 11 end as census, case when link_id % 4 = 1 then 3.0 + link_id % 17 end as measured,
  case width_cls when 1 then 3.0 when 2 then 5.5 when 3 then 9.0 when 4 then 13.0 when 5 then 19.5 else 5.5 end as w from edges),
r as (select *, cast(round_even(census * case when two then 0.5 else 1.0 end, 0) as integer) as c, cast(round_even(case when two then measured / 2 else measured end * 0.68 / 4.25, 0) as integer) as m,
  cast(round_even(case when two then w / 2 else w end * 0.7 / 3.0, 0) as integer) as k from v),
u as (select *, census is not null and c < 5 and c >= 1 as usable from r)"""


@query(f"""with {_EDGES_SQL}, {_LANE_SQL} select eid, case when usable then c when measured is not null then least(greatest(m, 1), 4) else least(greatest(k, 1), 3) end as n_lanes,
  case when usable then 'census' when measured is not null then 'measured' else 'class' end as lane_source, greatest(cast(floor(coalesce(measured, w) / 1.75) as integer), 1) as n_sublanes from u""")
def j11_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    census = F.when(F.col("link_id") % 3 == 0, F.col("link_id") % 11)
    measured = F.when(F.col("link_id") % 4 == 1, 3.0 + F.col("link_id") % 17)
    n, source = N.lanes(census, F.col("linked_edge").isNotNull(), measured, F.col("width_cls"))
    width = F.coalesce(measured, F.create_map(*[F.lit(v) for kv in N.CLASS_WIDTH.items() for v in kv])[F.col("width_cls")])
    return e.select("eid", n.alias("n_lanes"), source.alias("lane_source"), N.sublanes(width).alias("n_sublanes"))


@query(f"""with {_EDGES_SQL}, v as (select *, case when link_id % 5 = 0 then 30 + 10 * (link_id % 4) end as reg, case when link_id % 3 = 0 then 40 + 10 * (link_id % 3) end as census from edges)
select eid, cast(coalesce(reg, census, case when category = 4 then case when width_cls <= 2 then 30 else 50 end end, case when category in (1, 2) then 50 else 40 end) as integer) as speed_kmh,
  case when reg is not null then 'regulation' when census is not null then 'census' when category = 4 then 'width' else 'class' end as speed_source from v""")
def j12_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg, census = F.when(F.col("link_id") % 5 == 0, 30 + 10 * (F.col("link_id") % 4)), F.when(F.col("link_id") % 3 == 0, 40 + 10 * (F.col("link_id") % 3))
    value, source = N.speed(reg, census, F.col("category"), F.col("width_cls"))
    return edges(spark, sf_dir).select("eid", value.alias("speed_kmh"), source.alias("speed_source"))


_D1_SQL = f"""{_EDGES_SQL}, p as (select distinct least(eid, coalesce(linked_edge, eid)) as pair, unnest([frm, to_node]) as nid from edges), deg1 as (select nid from p group by nid having count(*) = 1)"""


@query(f"with {_D1_SQL} select nid from deg1")
def j13_degree1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.degree1_nodes(edges(spark, sf_dir))


@query(f"""with {_D1_SQL}, rate as (select eid, avg(cnt) as r from fx_obs where hour = 8 group by 1)
select e.eid, {dec_sql("coalesce(rate.r, case when category in (1, 2) then 500.0 else 150.0 end)")} as vph, case when rate.r is not null then 'census' when category in (1, 2) then 'main' else 'other' end as origin from edges e join deg1 on deg1.nid = e.frm left join rate on rate.eid = e.link_id""")
def j14_entry_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    entry = e.join(N.degree1_nodes(e).withColumnRenamed("nid", "frm"), "frm", "left_semi")
    rate = view(spark, sf_dir, "fx_obs").where("hour = 8").groupBy(F.col("eid").alias("link_id")).agg(F.avg("cnt").alias("r"))
    main = F.col("category").isin(1, 2)
    return entry.join(rate, "link_id", "left").select("eid", dec(F.coalesce("r", F.when(main, 500.0).otherwise(150.0))).alias("vph"), F.when(F.col("r").isNotNull(), "census").when(main, "main").otherwise("other").alias("origin"))


_TURN_SQL = f"""{_EDGES_SQL}, b as (select *, degrees(atan2(cast(x2 - x1 as double), cast(y2 - y1 as double))) as raw from edges), bb as (select *, (raw % 360.0 + 360.0) % 360.0 as bear from b),
pr as (select p.eid, s.eid as succ, ((s.bear - p.bear) % 360.0 + 360.0) % 360.0 as d0 from bb p join bb s on s.frm = p.to_node where p.linked_edge is null or s.eid <> p.linked_edge),
pd as (select eid, succ, round_even(case when d0 > 180 then d0 - 360 else d0 end, 6) as d from pr),
pt as (select *, case when abs(d) <= 45 then 'straight' when abs(d) >= 135 then 'sharp' when d < 0 then 'left' else 'right' end as turn from pd),
pw as (select *, 1 / ((1 + abs(d - case turn when 'straight' then 0.0 when 'left' then -90.0 else 90.0 end)) * (1 + abs(d - case turn when 'straight' then 0.0 when 'left' then -90.0 else 90.0 end))) as w, case turn when 'straight' then 0.7 else 0.15 end as share from pt where turn <> 'sharp'),
pq as (select *, sum(w) over (partition by eid, turn) as tw, row_number() over (partition by eid, turn order by succ) as k from pw),
ps as (select *, sum(case when k = 1 then share end) over (partition by eid) as total from pq)"""


@query(f"""with {_TURN_SQL} select eid, succ, turn, {dec_sql('cast(share as double) / cast(total as double) * w / tw')} as p from ps
union all select eid, min(succ), 'sharp', 1.0 from pt where eid not in (select eid from pw) group by eid""")
def j15_turn_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.turn_probabilities(edges(spark, sf_dir)).select("eid", "succ", "turn", dec(F.col("p")).alias("p"))


@query(f"with {_EDGES_SQL} select eid, case when category = 4 then 4 when category = 1 then 3 when category = 2 then 2 else case when width_cls >= 4 then 3 else 1 end end as priority from edges")
def j22_edge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("category")
    return edges(spark, sf_dir).select("eid", F.when(c == 4, 4).when(c == 1, 3).when(c == 2, 2).otherwise(F.when(F.col("width_cls") >= 4, 3).otherwise(1)).alias("priority"))


@query("""with e as (select unnest([a, b]) as nid, category, state from fx_links where a <> b) select nid, count(*) as degree, count(distinct category) > 1 as mixed, bool_or(state in ('2', '3')) as separated from e group by 1""")
def j03_node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree, mixed classes and grade separation of each node, from the links' ends."""
    ends = view(spark, sf_dir, "fx_links").where("a <> b").select(F.explode(F.array("a", "b")).alias("nid"), "category", "state")
    return ends.groupBy("nid").agg(F.count("*").alias("degree"), (F.min("category") != F.max("category")).alias("mixed"), F.bool_or(F.col("state").isin("2", "3")).alias("separated"))


@query("select link_id, state in ('2', '3') as separated from fx_links")
def j07_grade_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_links").select("link_id", F.col("state").isin("2", "3").alias("separated"))


_CC_SQL = """l as (select a, b from fx_links), e as (select a as u, b as v from l union select b, a from l),
comp(nid, component) using key (nid) as (select u, u from e union select e.v, min(c.component) from comp c join e on e.u = c.nid
  join recurring.comp r on r.nid = e.v where c.component < r.component group by e.v)"""


@query(f"""with recursive {_CC_SQL}, size as (select component, count(*) as size from comp group by 1)
select nid, component, size, component = (select arg_min(component, (-size, component)) from size) as is_main from comp join size using (component)""")
def j08_whole_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all links and whether each is the largest; a test has a network of several."""
    return sized_components(all_links(spark, sf_dir))


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_links").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def sized_components(links: DataFrame) -> DataFrame:
    """(nid, component, size, is_main) of each node of ``links`` (src, dst); of the largest the smallest name is the main one."""
    comp = connected_components(links)
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    top = size.agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("t")).select((-F.col("t.c")).alias("top"))
    return comp.join(size, "component").join(F.broadcast(top)).select(F.col("node").alias("nid"), "component", "size", (F.col("component") == F.col("top")).alias("is_main"))


@query(None)
def j01_snap_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs at most 4 m apart become one node at their mean; components of distance pairs."""
    points = view(spark, sf_dir, "fx_signs").select(F.col("sign_id").alias("id"), "x", "y")
    stars = checkpointed(near_stars(near_links(points, 4.0), [cell(F.col(c), SNAP_BLOCK_M) for c in ("x", "y")]).select("src", "dst"))
    comp = connected_components(stars).select(F.col("node").alias("id"), "component")
    named = points.join(comp, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    return named.groupBy("cluster").agg(F.count("*").alias("members"), dec(F.sum("x") / F.count("*")).alias("x"), dec(F.sum("y") / F.count("*")).alias("y"))
