"""Faces, widths, contraction, reach and street names of the road network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo as G
from roadloom.functions.stats import dec
from roadloom.operators import faces as P
from roadloom.operators import reach as R
from roadloom.operators.contraction import contract_short_links
from roadloom.operators.spatial_join import around, cell, in_cells
from roadloom.plans.network import _D1_SQL, _EDGES_SQL, edges
from roadloom.operators.network import degree1_nodes
from roadloom.plans.regions import _IN_SQL, gates
from roadloom.plans.registry import query
from roadloom.plans.shapes import _C, _S, c19_link_axis
from roadloom.plans.validation import dec_sql
from roadloom.session import checkpointed
from roadloom.sources.fixtures import bent_links, table, view

#: Side of the blocks in which the network is walked, and of the cells that get values by area.
BLOCK_M, MESH_M = 5200, 200.0


def ring(x1, y1, x2, y2):
    """A closed ring of a box."""
    return F.array(*[G.point(x, y) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))])


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_faces").select("face_id", ring(*[F.col(c) for c in ("fx1", "fy1", "fx2", "fy2")]).alias("ring"))


_DEGREE_SQL = "ends as (select unnest([a, b]) as nid, state from fx_links), deg as (select nid, count(*) as n, bool_or(state in ('2', '3')) as high, count(distinct state) as layers from ends group by 1)"


@query(f"""with {_DEGREE_SQL} select distinct face_id from fx_faces f join fx_nodes n on n.x > fx1 and n.x < fx2 and n.y > fy1 and n.y < fy2 join deg using (nid)
where deg.n >= 3 and (fx2 - fx1) * (fy2 - fy1) <= 5000""")
def e13_junction_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small faces that hold a node of degree three or more."""
    links = view(spark, sf_dir, "fx_links")
    busy = links.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count("*").alias("n")).where("n >= 3")
    return P.junction_faces(faces(spark, sf_dir), view(spark, sf_dir, "fx_nodes").join(busy, "nid", "left_semi"))


_TOUCH_SQL = """near as (select nid, face_id, (fx2 - fx1) * (fy2 - fy1) as area, greatest(fx1 - x, 0, x - fx2) as gx, greatest(fy1 - y, 0, y - fy2) as gy from fx_nodes n join fx_faces f on n.x between fx1 - 1 and fx2 + 1 and n.y between fy1 - 1 and fy2 + 1),
touch as (select nid, face_id from (select *, row_number() over (partition by nid order by area, face_id) as k from near where gx * gx + gy * gy <= 1) where k = 1)"""


@query(f"with {_TOUCH_SQL} select nid, face_id from touch")
def e14_touching_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest face that a disc of one metre round each node touches."""
    return P.touching_face(faces(spark, sf_dir), view(spark, sf_dir, "fx_nodes"))


_MERGE_SQL = f"""{_DEGREE_SQL}, {_TOUCH_SQL}, fit as (select touch.* from touch join deg using (nid) where deg.n >= 3 and not high and layers = 1),
grp as (select face_id, min(nid) as node, avg(x) as x, avg(y) as y from fit join fx_nodes using (nid) group by 1), merged as (select fit.nid, node, grp.x, grp.y, face_id from fit join grp using (face_id))"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return P.merge_in_faces(view(spark, sf_dir, "fx_nodes"), view(spark, sf_dir, "fx_links"), faces(spark, sf_dir), F.col("state").isin("2", "3"), F.col("state"))


@query(f"with {_MERGE_SQL} select nid, node, {dec_sql('x')} as x, {dec_sql('y')} as y, face_id from merged")
def j06_face_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions of one face as one node at their centroid."""
    return _merged(spark, sf_dir)[0].select("nid", "node", dec(F.col("x")).alias("x"), dec(F.col("y")).alias("y"), "face_id")


@query(f"""with {_MERGE_SQL} select link_id, coalesce(p.node, a) as a, coalesce(q.node, b) as b from fx_links left join merged p on p.nid = a left join merged q on q.nid = b
where p.node is null or q.node is null or p.node <> q.node""")
def j06_face_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the merged nodes; those within a face go."""
    return _merged(spark, sf_dir)[1].select("link_id", "a", "b")


@query(f"""with g0 as (select *, sqrt(cast((sx2 - sx1) * (sx2 - sx1) + (sy2 - sy1) * (sy2 - sy1) as double)) as len from fx_bent),
seg as (select *, coalesce(sum(len) over (partition by link_id order by k rows between unbounded preceding and 1 preceding), 0) as d0, sum(len) over (partition by link_id) as total from g0),
n as (select distinct link_id, total, cast(greatest(floor((total - 16) / 10), 1) as int) as n from seg), j as (select *, unnest(range(n)) as k from n),
w as (select link_id, k, total, unnest([0, -1, 1]) as w, 8 + (total - 16) * (k + 0.5::double) / n as d from j),
v as (select link_id, k, w, least(greatest(d + w, 0), total) as d from w),
spot as (select v.link_id, v.k, w, sx1 + (d - d0) / len * (sx2 - sx1) as x, sy1 + (d - d0) / len * (sy2 - sy1) as y,
  row_number() over (partition by v.link_id, v.k, w order by d0 desc) as pick from v join seg on seg.link_id = v.link_id and d0 <= d),
q as (select link_id, k, max(x) filter (w = 0) as px, max(y) filter (w = 0) as py, max(x) filter (w = 1) - max(x) filter (w = -1) as dx, max(y) filter (w = 1) - max(y) filter (w = -1) as dy from spot where pick = 1 group by 1, 2),
c as (select link_id, k, px, py, -dy / sqrt(dx * dx + dy * dy) as ux, dx / sqrt(dx * dx + dy * dy) as uy from q),
b as (select link_id, k, case when abs(ux) < 1e-12 then -40.0 else least((rx1 - px) / ux, (rx2 - px) / ux) end as xl, case when abs(ux) < 1e-12 then 40.0 else greatest((rx1 - px) / ux, (rx2 - px) / ux) end as xh,
  case when abs(uy) < 1e-12 then -40.0 else least((ry1 - py) / uy, (ry2 - py) / uy) end as yl, case when abs(uy) < 1e-12 then 40.0 else greatest((ry1 - py) / uy, (ry2 - py) / uy) end as yh
  from c join fx_roads on rx1 <= px + 40 and rx2 >= px - 40 and ry1 <= py + 40 and ry2 >= py - 40 and (abs(ux) >= 1e-12 or rx1 < px and px < rx2) and (abs(uy) >= 1e-12 or ry1 < py and py < ry2)),
i as (select link_id, k, greatest(-40.0, xl, yl) as lo, least(40.0, xh, yh) as hi from b),
s as (select *, case when lo <= max(hi) over (partition by link_id, k order by lo, hi rows between unbounded preceding and 1 preceding) + 1e-7 then 0 else 1 end as new from i where hi > lo),
g as (select *, sum(new) over (partition by link_id, k order by lo, hi rows unbounded preceding) as grp from s),
u as (select link_id, k, max(hi) - min(lo) as w from g group by link_id, k, grp having min(lo) < 0.5 and max(hi) > -0.5)
select link_id, {dec_sql('median(w)')} as width_m from u group by 1""")
def e15_road_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median width of the road faces across each bent link."""
    roads = view(spark, sf_dir, "fx_roads").select(F.col("road_id").alias("face_id"), ring(*[F.col(c) for c in ("rx1", "ry1", "rx2", "ry2")]).alias("ring"))
    return P.road_widths(bent_links(spark, sf_dir).select("link_id", "line"), roads).select("link_id", dec(F.col("width_m")).alias("width_m"))


@query(f"""with a as (select *, (fx2 - fx1) * (fy2 - fy1) as area, 1 + face_id % 19 as value from fx_faces),
c as (select *, unnest(range(cast(floor(fx1 / 200.0) as bigint), cast(floor(fx2 / 200.0) as bigint) + 1)) as cx from a), d as (select *, unnest(range(cast(floor(fy1 / 200.0) as bigint), cast(floor(fy2 / 200.0) as bigint) + 1)) as cy from c),
o as (select cx, cy, value * greatest(0, least(fx2, cx * 200 + 200) - greatest(fx1, cx * 200)) * greatest(0, least(fy2, cy * 200 + 200) - greatest(fy1, cy * 200)) / cast(area as double) as v from d)
select cx, cy, {dec_sql('sum(v)')} as value from o where v > 0 group by 1, 2""")
def e16_areal_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of faces given to cells by the share of each face in each cell."""
    areas = faces(spark, sf_dir).select(F.col("face_id").alias("area_id"), (1 + F.col("face_id") % 19).alias("value"), "ring")
    return P.areal_interpolation(areas, MESH_M).select("cx", "cy", dec(F.col("value")).alias("value"))


_STREETS = 24
_LATTICE = [(130.0 * k / 2, f"street {k // 2}" if k % 2 == 0 else f"back of {k // 2}") for k in range(2 * _STREETS)]
_LATTICE_SQL = ", ".join(f"({at}, '{name}')" for at, name in _LATTICE)


@query(f"""with l as (select link_id, (x2 - x1) * {_C!r} + (y2 - y1) * {_S!r} as du, (y2 - y1) * {_C!r} - (x2 - x1) * {_S!r} as dv, (x1 + x2) / 2.0 * {_C!r} + (y1 + y2) / 2.0 * {_S!r} as mu, (y1 + y2) / 2.0 * {_C!r} - (x1 + x2) / 2.0 * {_S!r} as mv, link_id % 7 = 0 as skew from fx_links),
a as (select link_id, case when abs(du) >= abs(dv) then 'EW' else 'NS' end as axis, {dec_sql('case when abs(du) >= abs(dv) then mv else mu end')} as cross_m, {dec_sql('degrees(atan2(least(abs(du), abs(dv)), greatest(abs(du), abs(dv))))')} + case when skew then 20 else 0 end as off_deg from l),
t as (select * from (values {_LATTICE_SQL}) t(pos, name)), n as (select link_id, off_deg, t.name, abs(cross_m - pos) as err, row_number() over (partition by link_id order by abs(cross_m - pos), t.name) as k from a, t)
select link_id, case when off_deg > 25 then 'oblique' when err > 35 then 'off lattice' else name end as street, case when off_deg <= 25 then {dec_sql('err')} end as error_m from n where k = 1""")
def e29_lattice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice line, street or back street, nearest to each link; the lattice is a fixed short list and no table."""
    rows = c19_link_axis(spark, sf_dir).withColumn("off_deg", F.col("off_deg") + F.when(F.col("link_id") % 7 == 0, 20).otherwise(0))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("cross_m") - F.lit(at)).alias("err"), F.lit(name).alias("name")) for at, name in _LATTICE])).alias("m")
    near = rows.select("link_id", "off_deg", best)
    street = F.when(F.col("off_deg") > 25, "oblique").when(F.col("m.err") > 35, "off lattice").otherwise(F.col("m.name"))
    return near.select("link_id", street.alias("street"), F.when(F.col("off_deg") <= 25, dec(F.col("m.err"))).alias("error_m"))


@query("""with t as (select distinct case when y1 = y2 then 'EW' else 'NS' end as axis, case when y1 = y2 then y1 else x1 end as cross_m from fx_links),
n as (select case when y1 = y2 then 'EW' else 'NS' end as axis, case when y1 = y2 then y1 else x1 end + reg_id % 31 - 15 as cross_m, 'N' || reg_id % 5 as name, abs(x2 - x1) + abs(y2 - y1) as len from fx_reglines),
s as (select t.axis, t.cross_m, name, sum(len) as len from t join n on n.axis = t.axis and abs(n.cross_m - t.cross_m) <= 20 group by 1, 2, 3),
b as (select *, row_number() over (partition by axis, cross_m order by len desc, name) as k from s)
select t.axis, t.cross_m, b.name, cast(b.len as bigint) as length_m from t left join b on b.axis = t.axis and b.cross_m = t.cross_m and k = 1""")
def e30_name_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer name of greatest length within 20 m of each street: streets go to three cells, named lines to one."""
    flat = F.col("y1") == F.col("y2")
    axis, cross = F.when(flat, "EW").otherwise("NS").alias("axis"), F.when(flat, F.col("y1")).otherwise(F.col("x1"))
    streets = view(spark, sf_dir, "fx_links").select(axis, cross.alias("cross_m")).distinct()
    named = view(spark, sf_dir, "fx_reglines").select(axis, (cross + F.col("reg_id") % 31 - 15).alias("at"), F.concat(F.lit("N"), (F.col("reg_id") % 5).cast("string")).alias("name"), (F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("len"))
    named = named.groupBy("axis", "at", "name").agg(F.sum("len").alias("len")).withColumn("c", cell(F.col("at"), 20))
    spread = streets.withColumn("c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: cell(F.col("cross_m"), 20) + i)))
    near = spread.join(named, ["axis", "c"]).where(F.abs(F.col("at") - F.col("cross_m")) <= 20).groupBy("axis", "cross_m", "name").agg(F.sum("len").alias("len"))
    best = near.groupBy("axis", "cross_m").agg(F.min(F.struct((-F.col("len")).alias("n"), "name")).alias("m"))
    return streets.join(best, ["axis", "cross_m"], "left").select("axis", "cross_m", F.col("m.name").alias("name"), (-F.col("m.n")).alias("length_m"))


@query(None)
def j05_short_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that are left when short ones are contracted or merged; every ninth link counts as short."""
    links = view(spark, sf_dir, "fx_links")
    line = F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")))
    rows = links.select("link_id", "a", "b", F.when(F.col("link_id") % 9 == 0, 8.0).otherwise(130.0).alias("length"), "category", F.array("link_id").alias("ids"), line.alias("line"))
    left = contract_short_links(view(spark, sf_dir, "fx_nodes"), rows)[1]
    return left.select("link_id", "a", "b", "length", "category", F.size("ids").alias("parts"))


@query("""with l as (select * from fx_links where state in ('2', '3')), k as (select *, unnest(range(1, 26)) as k from l),
v as (select link_id, x1 + k as vx, y1 + k // 2 as vy from k union all select link_id, x2 + link_id % 3, y2 from l),
p as (select 'node' as kind, nid, x, y from fx_nodes union all select 'sign', sign_id, x, y from fx_signs)
select link_id, kind, nid, vx, vy from v join p on p.x = vx and p.y = vy""")
def j07_interior_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and signs within half a metre of an inner vertex of a bridge or tunnel; all places are whole metres."""
    point = lambda kind, key, name: view(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("nid"), "x", "y")
    points = point("node", "nid", "fx_nodes").unionByName(point("sign", "sign_id", "fx_signs"))
    return interior_contacts(bent_crossings(view(spark, sf_dir, "fx_links")), points).select("link_id", "kind", "nid", "vx", "vy")


def bent_crossings(links: DataFrame) -> DataFrame:
    """(link_id, line) of bridges and tunnels: 25 bends after the first end, one at or near the second, and a way on."""
    at = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    bends = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: at(F.col("x1") + k, F.col("y1") + F.floor(k / 2)))
    last = F.array(at(F.col("x2") + F.col("link_id") % 3, F.col("y2")), at(F.col("x2") + 130, F.col("y2") + 60))
    line = F.concat(F.array(at(F.col("x1"), F.col("y1"))), bends, last)
    return links.where("state in ('2', '3')").select("link_id", line.alias("line"))


def interior_contacts(lines: DataFrame, nodes: DataFrame, tol: float = 0.5) -> DataFrame:
    """(link_id, nid, vx, vy, ...) of nodes (nid, x, y, ...) at most ``tol`` from a vertex of a line (link_id, line) that is
    no end."""
    inner = lines.select("link_id", F.explode(F.slice("line", 2, F.greatest(F.size("line") - 2, F.lit(0)))).alias("v")).select("link_id", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"))
    near = around(inner, "vx", "vy", tol).join(in_cells(nodes, "x", "y", tol), ["cx", "cy"])
    return near.where(G.hypot((F.col("vx") - F.col("x")).cast("double"), (F.col("vy") - F.col("y")).cast("double")) <= tol).drop("x", "y", "cx", "cy")


def successors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((src, dst), (node, block)): the edges that may follow an edge, the way back left out, and the block of each edge."""
    e = checkpointed(edges(spark, sf_dir))
    after = e.select(F.col("eid").alias("dst"), F.col("frm").alias("to"))
    pairs = e.select(F.col("eid").alias("src"), "to", "linked_edge").join(after, "to").where("linked_edge is null or dst <> linked_edge").select("src", "dst")
    place = F.floor(F.col("x1") / BLOCK_M) * 1_000_000 + F.floor(F.col("y1") / BLOCK_M)
    return pairs, e.select(F.col("eid").alias("node"), place.alias("block"))


_SUCC_SQL = f"{_EDGES_SQL}, succ as (select p.eid as src, s.eid as dst from edges p join edges s on s.frm = p.to_node where p.linked_edge is null or s.eid <> p.linked_edge)"


@query(f"""with recursive {_SUCC_SQL}, hop(eid, hops) using key (eid) as (select eid, 0 from edges where eid not in (select src from succ)
  union select s.src, min(h.hops) + 1 from hop h join succ s on s.dst = h.eid left join recurring.hop r on r.eid = s.src where r.eid is null group by s.src)
select h.eid, cast(h.hops as bigint) as hops, min(s.dst) filter (g.hops = h.hops - 1) as next from hop h left join succ s on s.src = h.eid left join hop g on g.eid = s.dst group by h.eid, h.hops""")
def j16_exit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each edge to the nearest edge that nothing follows, and the next edge on that way: the chains of these are
    the paths."""
    return R.exit_hops(*successors(spark, sf_dir)).select(F.col("node").alias("eid"), "hops", "next")


@query(f"""with recursive {_D1_SQL}, succ as (select p.eid as src, s.eid as dst from edges p join edges s on s.frm = p.to_node where p.linked_edge is null or s.eid <> p.linked_edge),
entry as (select eid from edges join deg1 on nid = frm), out_ as (select eid from edges where eid not in (select src from succ)),
fw as (select eid from entry union select dst from fw join succ on src = eid), bw as (select eid from out_ union select src from bw join succ on dst = eid)
select eid, eid in (select eid from entry) as is_entry, eid in (select eid from out_) as is_exit, eid in (select eid from fw) as from_entry, eid in (select eid from bw) as to_exit from edges""")
def j18_entry_exit_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edges the entries lead to, and from which an exit can be reached."""
    e = edges(spark, sf_dir)
    entries = e.join(degree1_nodes(e).withColumnRenamed("nid", "frm"), "frm", "left_semi").select(F.col("eid").alias("node"))
    return R.entry_exit_reach(*successors(spark, sf_dir), entries).withColumnRenamed("node", "eid")


_MAIN_SQL = f"""{_SUCC_SQL}, outs as (select src as eid, count(*) as n from succ group by 1), ins as (select dst as eid, count(*) as n from succ group by 1),
hub as (select eid from edges left join outs using (eid) left join ins using (eid) order by coalesce(outs.n, 0) * coalesce(ins.n, 0) desc, eid limit 1),
fw as (select eid from hub union select dst from fw join succ on src = eid), bw as (select eid from hub union select src from bw join succ on dst = eid),
main as (select eid from fw intersect select eid from bw)"""


@query(f"with recursive {_MAIN_SQL} select eid from main where (select count(*) from main) * 2 > (select count(*) from edges)")
def j19_main_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest set of edges of which each leads to each. The SQL gives rows only if its one set holds most edges, for
    then it is the largest."""
    return R.largest_scc(*successors(spark, sf_dir)).select(F.col("node").alias("eid"))


@query(f"""with recursive {_MAIN_SQL}, f as (select nid, {_IN_SQL.format(x="x", y="y")} as is_in from fx_nodes),
c as (select e.eid, e.category, b.is_in as enters, case when b.is_in then e.frm else e.to_node end as node from edges e join main using (eid) join f a on a.nid = e.frm join f b on b.nid = e.to_node where a.is_in <> b.is_in)
select node, min(category) as category, count(*) filter (enters) as sources, count(*) filter (not enters) as sinks from c group by 1""")
def j20_gates_of_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates whose crossing edges belong to the main component, and how many go in and out."""
    main = R.largest_scc(*successors(spark, sf_dir)).select(F.col("node").alias("eid"))
    rows = gates(edges(spark, sf_dir).join(main, "eid", "left_semi"), view(spark, sf_dir, "fx_nodes"))
    return rows.select("node", "category", F.size("sources").cast("long").alias("sources"), F.size("sinks").cast("long").alias("sinks"))
