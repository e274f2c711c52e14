"""Cascades, unpivots, inventories and acceptance of the road tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import geo as G
from roadloom.functions.stats import dec
from roadloom.operators.faces import dissolve
from roadloom.operators.graph import connected_components, near_stars
from roadloom.operators.reach import lead_out
from roadloom.operators.spatial_join import around, cell, in_cells, near_links
from roadloom.plans.network import SNAP_BLOCK_M, _CC_SQL, _EDGES_SQL, all_links, edges
from roadloom.plans.regions import REGION, inside, k02_zones
from roadloom.plans.registry import _SQL, query
from roadloom.plans.shapes import doubles
from roadloom.plans.validation import dec_sql
from roadloom.session import checkpointed
from roadloom.sources.fixtures import table, view
from roadloom.sources.intervals import hourly_flows
from roadloom.streaming.jobs import frame_rollup, hourly_volume, signal_means

MAX_HOPS, BORDER_M, REJECT_DEG, GAP_M = 30, 30, 15.0, 100
_REGION_SQL = f"x > {REGION[0]} and x < {REGION[2]} and y > {REGION[1]} and y < {REGION[3]}"


@query("select event_id, 'k' as key, cast(json_extract(props, '$.k') as integer) as value from events where json_extract(props, '$.k') is not null")
def a06_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each key of the JSON object."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")))


@query("select hour, eid, cast(flow as double) as flow from fx_flow where eid % 7 <> 0 and hour % 5 <> 0")
def a09_hourly_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval rows to hourly flows; short intervals and the tails of split edges go."""
    begin = (F.col("hour") - 7) * 3600.0
    rows = view(spark, sf_dir, "fx_flow").select(
        F.concat(F.col("eid").cast("string"), F.when(F.col("eid") % 7 == 0, ".-60").otherwise("")).alias("id"),
        begin.alias("begin"), (begin + F.when(F.col("hour") % 5 == 0, 900.0).otherwise(3600.0)).alias("end"), F.col("flow").cast("double").alias("flow"),
    )
    return hourly_flows(rows, 7).select("hour", "eid", "flow")


@query("""with w as (select * from (values ('ECONOMY', 'Brand#13'), ('ECONOMY', 'Brand#5'), ('PROMO', 'Brand#1'), ('NONE', 'Brand#1')) t(kind, target)),
c as (select p_type as kind, unnest([p_brand, p_name]) as target, p_partkey as link from part)
select kind, target, link, 'found' as status from w join c using (kind, target) union all select kind, target, null, 'missing' from w where not exists (select 1 from c where c.kind = w.kind and c.target = w.target)""")
def a12_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the wanted (kind, target) pairs, and the pairs that have none. The wanted pairs are a fixed short list."""
    wanted = spark.createDataFrame([("ECONOMY", "Brand#13"), ("ECONOMY", "Brand#5"), ("PROMO", "Brand#1"), ("NONE", "Brand#1")], "kind string, target string")
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.explode(F.array("p_brand", "p_name")).alias("target"), F.col("p_partkey").alias("link"))
    both = F.broadcast(wanted).join(rows, ["kind", "target"])
    missing = wanted.join(both.select("kind", "target").distinct(), ["kind", "target"], "left_anti")
    return both.select("kind", "target", "link", F.lit("found").alias("status")).unionByName(missing.select("kind", "target", F.lit(None).cast("long").alias("link"), F.lit("missing").alias("status")))


@query(f"""with {_EDGES_SQL}, plan as (select o_custkey as nid, max(60 + o_orderkey % 90) as cycle_s from orders group by 1), stops as (select o_custkey as nid, count(*) as n_stops from orders where o_orderstatus = 'O' group by 1)
select e.eid, n.x, n.y, coalesce(p.cycle_s, 120) as cycle_s, coalesce(s.n_stops, 0) as n_stops, p.nid is not null as has_signal from edges e join fx_nodes n on n.nid = e.to_node left join plan p on p.nid = e.to_node left join stops s on s.nid = e.to_node""")
def a20_network_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their end node, its signal plan and stops, and defaults where there are none."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("to")).agg(F.max(60 + F.col("o_orderkey") % 90).alias("cycle"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("stops"))
    nodes = view(spark, sf_dir, "fx_nodes").select(F.col("nid").alias("to"), "x", "y")
    rows = edges(spark, sf_dir).select("eid", "to").join(nodes, "to").join(per, "to", "left")
    return rows.select("eid", "x", "y", F.coalesce("cycle", F.lit(120)).alias("cycle_s"), F.coalesce("stops", F.lit(0)).alias("n_stops"), F.col("cycle").isNotNull().alias("has_signal"))



@query("""with s as (select l.link_id, l.x1, l.y1, l.x2, l.y2, l.a, l.b, st.link_id as st, st.a as st_a, en.link_id as en from fx_links l left join fx_links st on st.link_id = l.link_id - 2 and st.y1 = st.y2 left join fx_links en on en.link_id = l.link_id + 2 and en.y1 = en.y2 where l.y1 = l.y2)
select link_id, case when en is null and st is null then null else x2 - x1 end as dx, case when en is null and st is null then null else y2 - y1 end as dy, case when en is not null then 'end' when st is not null then 'start' else 'none' end as how from s""")
def e20_down_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section runs towards its end neighbour, else away from its start neighbour; each is the nearer end's."""
    rows = view(spark, sf_dir, "fx_links").where("y1 = y2").select("link_id", *[c.alias(n) for c, n in zip(doubles("x1", "y1", "x2", "y2"), ("x1", "y1", "x2", "y2"), strict=True)], F.col("x2").alias("ix2"), F.col("x1").alias("ix1"), F.col("y2").alias("iy2"), F.col("y1").alias("iy1"))

    def beside(step: int, tag: str) -> DataFrame:
        return rows.select((F.col("link_id") + step).alias("link_id"), *[F.col(c).alias(f"{tag}_{c}") for c in ("x1", "y1", "x2", "y2")])

    both = rows.join(beside(2, "s"), "link_id", "left").join(beside(-2, "e"), "link_id", "left")
    far = lambda tag, k: G.point_segment_distance(F.col(f"x{k}"), F.col(f"y{k}"), *[F.col(f"{tag}_{c}") for c in ("x1", "y1", "x2", "y2")])
    has_end, has_start = F.col("e_x1").isNotNull(), F.col("s_x1").isNotNull()
    sign = F.when(has_end, F.when(far("e", 2) <= far("e", 1), 1).otherwise(-1)).when(has_start, F.when(far("s", 1) <= far("s", 2), 1).otherwise(-1))
    how = F.when(has_end, "end").when(has_start, "start").otherwise("none")
    return both.select("link_id", (sign * (F.col("ix2") - F.col("ix1"))).alias("dx"), (sign * (F.col("iy2") - F.col("iy1"))).alias("dy"), how.alias("how"))


_SENSOR_SQL = "sensor as (select c_custkey as det, c_nationkey % 4 + 1 as link_key, c_custkey * 2 % 7 < 3 as keyed, c_custkey % 50 * 130 + c_nationkey * 9 as sx, c_custkey // 50 * 130 + 11 as sy from customer)"


@query(f"""with {_EDGES_SQL}, {_SENSOR_SQL}, mid as (select eid, (x1 + x2) / 2.0 as mx, (y1 + y2) / 2.0 as my from edges where width_cls in (4, 5)),
c as (select det, eid, 1 as rank, 'in' as method, cast(0 as double) as dist from sensor join edges on to_node = det and category = link_key where keyed
union all select det, eid, 2, 'out', cast(0 as double) from sensor join edges on frm = det and category = link_key where keyed
union all select det, eid, 3, 'address', round_even(sqrt((sx - mx) * (sx - mx) + (sy - my) * (sy - my)), 6) from sensor join mid on mx between sx - 120 and sx + 120 and my between sy - 120 and sy + 120 where sqrt((sx - mx) * (sx - mx) + (sy - my) * (sy - my)) <= 120),
b as (select * from (select *, row_number() over (partition by det order by rank, dist, eid) as k from c) where k = 1)
select det, eid, coalesce(method, 'none') as method from sensor left join b using (det)""")
def e22_sensor_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sensor's edge by its key among the edges into its node, else out of it, else the nearest wide one. One table of
    candidates, ranked by minima that combine before the shuffle.

    Sensors with a key are many, however small Spark takes their file to be, so they are merged with the ends of edges.
    """
    k = F.col("c_custkey")
    sensor = table(spark, sf_dir, "customer").select(k.alias("det"), (F.col("c_nationkey") % 4 + 1).alias("category"), (k * 2 % 7 < 3).alias("keyed"), (k % 50 * 130 + F.col("c_nationkey") * 9).cast("double").alias("px"), (F.floor(k / 50) * 130 + 11).cast("double").alias("py"))
    e = edges(spark, sf_dir)
    end = lambda node, into: F.struct(F.col(node).alias("det"), F.lit(into).alias("into"))
    ends = e.select("category", "eid", F.explode(F.array(end("to", True), end("frm", False))).alias("s")).select("s.det", "category", "eid", "s.into")
    keyed = sensor.where("keyed").select("det", "category").hint("merge").join(ends, ["det", "category"])
    keyed = keyed.groupBy("det").agg(F.min(F.when(F.col("into"), F.col("eid"))).alias("in"), F.min(F.when(~F.col("into"), F.col("eid"))).alias("out"))
    mid = e.where("width_cls in (4, 5)").select("eid", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"))
    near = around(sensor.select("det", "px", "py"), "px", "py", 120).join(in_cells(mid, "mx", "my", 120), ["cx", "cy"]).withColumn("dist", G.hypot(F.col("px") - F.col("mx"), F.col("py") - F.col("my"))).where("dist <= 120")
    near = near.groupBy("det").agg(F.min(F.struct(F.bround("dist", 6).alias("dist"), "eid")).alias("b")).select("det", F.col("b.eid").alias("address"))
    rows = sensor.select("det").join(keyed.hint("merge"), "det", "left").join(near.hint("merge"), "det", "left")
    method = F.when(F.col("in").isNotNull(), "in").when(F.col("out").isNotNull(), "out").when(F.col("address").isNotNull(), "address").otherwise("none")
    return rows.select("det", F.coalesce("in", "out", "address").alias("eid"), method.alias("method"))


@query(f"""with piece as (select l_orderkey % 500 as edge, case l_linenumber % 3 when 0 then '' when 1 then '.1' else '.-60' end as tail, sum(cast(floor(l_quantity) as bigint)) as flow, sum(cast(floor(l_quantity) as bigint) * (20 + l_partkey % 40)) as moved from lineitem group by 1, 2),
down as (select edge, flow, moved from (select *, row_number() over (partition by edge order by length(tail) desc, tail desc) as k from piece) where k = 1),
pair as (select edge // 2 as pair, sum(flow) as flow, sum(moved) as moved, sum(flow) as weight from down group by 1)
select pair % 20 as section, {dec_sql('cast(sum(flow) as double) / cast(count(*) as double) * 3600 / 1800')} as vph, {dec_sql('case when sum(weight) > 0 then cast(sum(moved) as double) / cast(sum(weight) as double) end')} as speed_kmh from pair group by 1""")
def f11_section_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow of each edge's downstream piece, summed over opposite edges, averaged over pairs; speeds weighted by it."""
    q = F.floor("l_quantity").cast("long")
    k = F.col("l_linenumber") % 3
    pieces = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("edge"), F.when(k == 0, "").when(k == 1, ".1").otherwise(".-60").alias("tail")).agg(F.sum(q).alias("flow"), F.sum(q * (20 + F.col("l_partkey") % 40)).alias("moved"))
    down = pieces.groupBy("edge").agg(F.max(F.struct(F.length("tail").alias("n"), "tail", "flow", "moved")).alias("m")).select("edge", "m.flow", "m.moved")
    pairs = down.groupBy(F.floor(F.col("edge") / 2).alias("pair")).agg(F.sum("flow").alias("flow"), F.sum("moved").alias("moved"))
    vph = F.sum("flow").cast("double") / F.count("*").cast("double") * 3600 / 1800
    return pairs.groupBy((F.col("pair") % 20).alias("section")).agg(dec(vph).alias("vph"), dec(F.try_divide(F.sum("moved").cast("double"), F.sum("flow").cast("double"))).alias("speed_kmh"))


@query(f"""with l as (select case when y1 = y2 then 'EW' else 'NS' end as axis, case when y1 = y2 then y1 else x1 end as street, case when y1 = y2 then x1 else y1 end as lo, case when y1 = y2 then x2 else y2 end as hi, width_cls from fx_links)
select axis, street, count(*) as links, cast(sum(hi - lo) as bigint) as length_m, {dec_sql('cast(sum(hi - lo) as double) / cast(max(hi) - min(lo) as double)')} as coverage, sum(hi - lo) * 10 >= 6 * (max(hi) - min(lo)) as through, string_agg(distinct cast(width_cls as varchar), ',' order by cast(width_cls as varchar)) as classes from l group by 1, 2""")
def f22_street_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By street: links, length, the part of its span that they cover, and the classes of width."""
    flat = F.col("y1") == F.col("y2")
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    rows = view(spark, sf_dir, "fx_links").select(F.when(flat, "EW").otherwise("NS").alias("axis"), pick("y1", "x1").alias("street"), pick("x1", "y1").alias("lo"), pick("x2", "y2").alias("hi"), "width_cls")
    length, span = F.sum(F.col("hi") - F.col("lo")), F.max("hi") - F.min("lo")
    return rows.groupBy("axis", "street").agg(
        F.count("*").alias("links"), length.alias("length_m"), dec(length.cast("double") / span.cast("double")).alias("coverage"), (length * 10 >= span * 6).alias("through"),
        F.array_join(F.sort_array(F.collect_set(F.col("width_cls").cast("string"))), ",").alias("classes"),
    )


_ANG = "(o_orderkey * 37 % 200) / 10.0 + case when o_orderkey % 9 = 0 then 40 else 0 end"
_MEAN = "degrees(atan2(sum(w * sin(radians(a * 4))), sum(w * cos(radians(a * 4))))) / 4"
_OFF = "abs(((a - b + 45) % 90 + 90) % 90 - 45)"


@query(f"""with d as (select o_orderkey, cast({_ANG} as double) as a, cast(1 + o_custkey % 50 as double) as w from orders),
m0 as (select {_MEAN} as b from d), m1 as (select {_MEAN} as b from d, m0 where {_OFF} <= 15), m2 as (select {_MEAN} as b from d, m1 where {_OFF} <= 15), m3 as (select {_MEAN} as b, count(*) as n from d, m2 where {_OFF} <= 15)
select {dec_sql('b')} as bearing, n as kept from m3""")
def f23_grid_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted circular mean of bearings modulo 90, fitted again three times without those over 15 degrees off; a pass
    that would keep fewer than ten ends it. Each pass is one aggregate to one row."""
    rows = table(spark, sf_dir, "orders").select(F.expr(_ANG).cast("double").alias("a"), (1 + F.col("o_custkey") % 50).cast("double").alias("w"))
    angle = F.radians(F.col("a") * 4)
    mean = (F.degrees(F.atan2(F.sum(F.col("w") * F.sin(angle)), F.sum(F.col("w") * F.cos(angle)))) / 4).alias("b")
    best = rows.agg(mean, F.count("*").alias("n")).first()
    for _ in range(3):
        off = F.abs(F.pmod(F.col("a") - F.lit(best["b"]) + 45, F.lit(90.0)) - 45)
        now = rows.where(off <= REJECT_DEG).agg(mean, F.count("*").alias("n")).first()
        if now["n"] < 10:
            break
        best = now
    return spark.createDataFrame([(best["b"], best["n"])], "b double, n long").select(dec(F.col("b")).alias("bearing"), F.col("n").alias("kept"))


_LOTS = "select nid, x, y, x // 650 as city, (x // 260 + y // 390) % 3 as town from fx_nodes where nid % 11 <> 5"


@query(f"""with lot as ({_LOTS}), side as (select city, town, x, y, unnest([[0, -130], [130, 0], [0, 130], [-130, 0]]) as d from lot),
open as (select s.city, s.town, count(*) as n from side s left join lot l on l.city = s.city and l.town = s.town and l.x = s.x + d[1] and l.y = s.y + d[2] where l.x is null group by 1, 2)
select city, town, count(*) as parts, cast(count(*) * 16900 as double) as area_m2, cast(max(n) * 130 as double) as border_m from lot join open using (city, town) group by 1, 2""")
def f24_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square lots round the nodes, some missing, as one area for each city and town: area and border of its rings, holes
    taken off."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ring = F.array(*[G.point(x + a, y + b) for a, b in ((-65, -65), (65, -65), (65, 65), (-65, 65), (-65, -65))])
    town = (F.floor(F.col("x") / 260) + F.floor(F.col("y") / 390)) % 3
    lots = view(spark, sf_dir, "fx_nodes").where("nid % 11 <> 5").select(F.floor(F.col("x") / 650).alias("city"), town.alias("town"), ring.alias("ring"))
    signed = lambda r: F.aggregate(G.segments(r), F.lit(0.0), lambda a, s: a + s["x1"] * s["y2"] - s["x2"] * s["y1"]) / 2
    add = lambda a, v: a + v
    area = F.aggregate(F.transform("rings", signed), F.lit(0.0), add)
    border = F.aggregate(F.transform("rings", G.line_length), F.lit(0.0), add)
    parts = lots.groupBy("city", "town").agg(F.count("*").alias("parts"))
    return dissolve(lots, ["city", "town"]).join(parts, ["city", "town"]).select("city", "town", "parts", area.alias("area_m2"), border.alias("border_m"))


@query(f"""with h as (select distinct y1 // 130 as line, x1 as x from fx_links where x1 = x2), g as (select *, x - lag(x) over (partition by line order by x) as gap from h)
select line, count(*) as hits, count(case when gap > {GAP_M} or gap is null then 1 end) as groups, cast(percentile_disc(0.5) within group (order by gap) as double) as spacing_m from g group by 1""")
def g05_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links cross horizontal lines halfway between rows: hits, groups of near hits, median spacing."""
    links = view(spark, sf_dir, "fx_links")
    lines = F.explode(F.sequence(F.floor((F.least("y1", "y2") + 65) / 130), F.floor((F.greatest("y1", "y2") - 65) / 130)))
    hits = links.where("y1 <> y2").select(lines.alias("line"), "x1", "x2", "y1", "y2").withColumn("x", F.col("x1") + F.floor((F.col("line") * 130 + 65 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))).select("line", "x").distinct()
    gaps = hits.withColumn("gap", F.col("x") - F.lag("x").over(Window.partitionBy("line").orderBy("x")))
    return gaps.groupBy("line").agg(F.count("*").alias("hits"), F.count(F.when((F.col("gap") > GAP_M) | F.col("gap").isNull(), 1)).alias("groups"), F.expr("percentile_disc(0.5) within group (order by gap)").cast("double").alias("spacing_m"))


@query("select y as street, x as v, lag(x) over (partition by y order by x) as below, lead(x) over (partition by y order by x) as above from fx_nodes")
def g06_neighbour_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("y").orderBy("x")
    return view(spark, sf_dir, "fx_nodes").select(F.col("y").alias("street"), F.col("x").alias("v"), F.lag("x").over(w).alias("below"), F.lead("x").over(w).alias("above"))


@query("""with recursive t as (select unnest([2, 4, 6]) as tol), p as (select tol, a.sign_id as u, b.sign_id as v from t join fx_signs a on true join fx_signs b on a.sign_id < b.sign_id and b.x between a.x - 6 and a.x + 6 and b.y between a.y - 6 and a.y + 6 where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= tol * tol),
e as (select tol, u, v from p union select tol, v, u from p), walk as (select tol, u as id, u as root from e union select w.tol, e.v, w.root from walk w join e on e.tol = w.tol and e.u = w.id where w.root < e.v), comp as (select tol, id, min(root) as root from walk group by 1, 2),
size as (select tol, s.sign_id, coalesce(c.root, s.sign_id) as root from t join fx_signs s on true left join comp c using (tol) where c.id = s.sign_id or (c.id is null)), n as (select tol, count(*) as joined, count(distinct root) as roots from comp group by 1), big as (select tol, max(m) as m from (select tol, root, count(*) as m from comp group by 1, 2) group by 1)
select tol, (select count(*) from fx_signs) - coalesce(joined, 0) + coalesce(roots, 0) as nodes, coalesce(m, 1) as largest from t left join n using (tol) left join big using (tol)""")
def j02_tolerance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and the largest cluster when signs are snapped at several tolerances: one run, the tolerance part of the node."""
    signs = view(spark, sf_dir, "fx_signs").select(F.col("sign_id").alias("id"), "x", "y")
    tols = spark.createDataFrame([(2,), (4,), (6,)], "tol int")
    stars = near_stars(near_links(signs, 6.0), [cell(F.col(c), SNAP_BLOCK_M) for c in ("x", "y")], (2.0, 4.0, 6.0), "dist")
    node = lambda c: F.struct(F.col("limit").cast("int").alias("tol"), F.col(c).alias("id"))
    comp = connected_components(checkpointed(stars.select(node("src").alias("src"), node("dst").alias("dst"))))
    sizes = comp.groupBy("component").agg(F.count("*").alias("m")).groupBy(F.col("component.tol").alias("tol")).agg(F.sum("m").alias("joined"), F.count("*").alias("roots"), F.max("m").alias("largest"))
    total = signs.agg(F.count("*").alias("n"))
    zero = F.lit(0)
    return tols.join(sizes, "tol", "left").crossJoin(F.broadcast(total)).select("tol", (F.col("n") - F.coalesce("joined", zero) + F.coalesce("roots", zero)).alias("nodes"), F.coalesce("largest", F.lit(1)).alias("largest"))


@query(f"""with recursive {_CC_SQL}, size as (select component, count(*) as size from comp group by 1), main as (select arg_min(component, (-size, component)) as top from size),
n as (select nid, component = top as is_main, {_REGION_SQL} as is_in, {_REGION_SQL} and (x <= {REGION[0] + BORDER_M} or x >= {REGION[2] - BORDER_M} or y <= {REGION[1] + BORDER_M} or y >= {REGION[3] - BORDER_M}) as near from comp join fx_nodes using (nid), main),
deg as (select nid, count(*) as degree from (select unnest([a, b]) as nid from l) group by 1)
select count(*) as nodes, count(case when is_main then 1 end) as main_nodes, (select count(*) from size) as components, count(case when not is_in or near then 1 end) as boundary, coalesce(bool_and(is_main) filter (not is_in or near), true) as boundary_in_main, count(case when is_in and not near and degree = 1 then 1 end) as dead_ends from n join deg using (nid)""")
def j09_whole_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, boundary nodes (outside or near the border), whether all of these are in the main component, dead ends inside."""
    return acceptance(all_links(spark, sf_dir), view(spark, sf_dir, "fx_nodes"))


def acceptance(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of figures of ``links`` (src, dst) whose ends are placed by ``nodes`` (nid, x, y)."""
    comp = connected_components(links)
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    top = size.agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("t"), F.count("*").alias("components")).select((-F.col("t.c")).alias("top"), "components")
    degree = links.select(F.explode(F.array("src", "dst")).alias("nid")).groupBy("nid").agg(F.count("*").alias("degree"))
    x, y = F.col("x"), F.col("y")
    near = (x <= REGION[0] + BORDER_M) | (x >= REGION[2] - BORDER_M) | (y <= REGION[1] + BORDER_M) | (y >= REGION[3] - BORDER_M)
    rows = comp.withColumnRenamed("node", "nid").join(nodes.select("nid", "x", "y"), "nid").join(degree, "nid").crossJoin(F.broadcast(top))
    rows = rows.select("components", "degree", (F.col("component") == F.col("top")).alias("is_main"), (~inside(x, y) | near).alias("edge"))
    return rows.agg(
        F.count("*").alias("nodes"), F.count(F.when(F.col("is_main"), 1)).alias("main_nodes"), F.coalesce(F.max("components"), F.lit(0)).alias("components"), F.count(F.when(F.col("edge"), 1)).alias("boundary"),
        F.coalesce(F.bool_and(F.when(F.col("edge"), F.col("is_main"))), F.lit(True)).alias("boundary_in_main"), F.count(F.when(~F.col("edge") & (F.col("degree") == 1), 1)).alias("dead_ends"),
    )


@query(f"""with r as (select c_custkey as veh, unnest(range(c_custkey % 90)) as i, c_custkey from customer), s as (select veh, i, (c_custkey + i // 2) as b, c_custkey + i // 2 || case when i % 2 = 1 then '.1' else '' end as sid from r),
h as (select *, i // 2 + 1 as hops from s), c as (select * from h where not exists (select 1 from h p where p.veh = h.veh and p.i < h.i and p.hops > {MAX_HOPS})),
l as (select veh, max(hops) > {MAX_HOPS} as cut, string_agg(sid, ' ' order by i) as route, arg_max(b, i) as last from c group by 1)
select veh, cut, route || case when cut and last % 2 = 0 then ' ' || (last + 1000) || ' ' || (last + 2000) else '' end as route from l""")
def j17_hop_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes cut at the first edge past the cap, and led out by the exit path of that edge if it has one."""
    k = F.col("c_custkey")
    names = F.transform(F.sequence(F.lit(0), k % 90 - 1), lambda i: F.concat((k + F.floor(i / 2)).cast("string"), F.when(i % 2 == 1, ".1").otherwise("")))
    routes = table(spark, sf_dir, "customer").where("c_custkey % 90 > 0").select(k.alias("veh"), names.alias("route"))
    last = table(spark, sf_dir, "customer").select((k + MAX_HOPS).alias("e")).where("e % 2 = 0").distinct()
    name = lambda off: (F.col("e") + off).cast("string")
    # The way out of an even edge e is e + 1000, e + 2000, so ways may share their edges.
    ways = F.array(*[F.struct(name(1000 * i).alias("node"), F.lit(2 - i).alias("hops"), (name(1000 * i + 1000) if i < 2 else F.lit(None).cast("string")).alias("next")) for i in range(3)])
    steps = last.select(F.explode(ways).alias("s")).select("s.*").groupBy("node").agg(F.max_by("next", "hops").alias("next"), F.max("hops").alias("hops"))
    return lead_out(routes, steps, MAX_HOPS).select("veh", "cut", F.array_join("route", " ").alias("route"))


_FLAG = "((c_custkey * {m} + {s} * 7 + {i} * 3) % 5 = 0)"
_CASES = " union all ".join(f"select c_custkey as intersection, {s} as split, '{d}' as kind, {i} as link, {_FLAG.format(m=m, s=s, i=i)} as on_ from customer" for s in range(1, 4) for d, m in (("in", 3), ("out", 2)) for i in range(1, 5))


@query(f"""with f as ({_CASES}) select intersection, split, coalesce(string_agg(cast(link as varchar), ',' order by link) filter (kind = 'in'), '') as ins, coalesce(string_agg(cast(link as varchar), ',' order by link) filter (kind = 'out'), '') as outs from f where on_ group by 1, 2""")
def j25_phase_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag columns of splits and links to a row for each split with any flag; all within the row, without a shuffle."""
    flag = lambda m, s, i: F.expr(_FLAG.format(m=m, s=s, i=i))
    wide = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("intersection"), *[flag(m, s, i).alias(f"s{s}_{d}{i}") for s in range(1, 4) for d, m in (("in", 3), ("out", 2)) for i in range(1, 5)])
    on = lambda s, d: F.filter(F.array(*[F.when(F.col(f"s{s}_{d}{i}"), F.lit(str(i))) for i in range(1, 5)]), lambda v: v.isNotNull())
    rows = wide.select("intersection", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), on(s, "in").alias("i"), on(s, "out").alias("o")) for s in range(1, 4)])).alias("p"))
    return rows.where("size(p.i) + size(p.o) > 0").select("intersection", "p.split", F.array_join("p.i", ",").alias("ins"), F.array_join("p.o", ",").alias("outs"))


@query(f"""with z as ({_SQL['k02_zones']}) select count(*) as zones, cast(coalesce(sum(pop), 0) as bigint) as pop_in_zones, {dec_sql('coalesce(sum(emp), 0)')} as emp_in_zones, (select count(*) from fx_signs where code = '63') as pop_all, (select count(*) from fx_signs where code = '98') * 0.7 as emp_all, max(n_links) as most_links from z""")
def k04_zone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in zones beside those of all rows."""
    zones = k02_zones(spark, sf_dir).agg(F.count("*").alias("zones"), F.coalesce(F.sum("pop"), F.lit(0)).alias("pop_in_zones"), dec(F.coalesce(F.sum("emp"), F.lit(0.0))).alias("emp_in_zones"), F.max("n_links").alias("most_links"))
    total = view(spark, sf_dir, "fx_signs").agg(F.count(F.when(F.col("code") == "63", 1)).alias("pop_all"), (F.count(F.when(F.col("code") == "98", 1)) * 7 / 10).alias("emp_all"))
    return zones.crossJoin(total)


_EVENTS = "once as (select distinct event_id, user_id, ts, cast(floor(value) as bigint) as volume from events)"


@query(f"with {_EVENTS} select user_id as det, date_trunc('hour', ts) as hour, {dec_sql('case when count(*) < 12 then sum(volume) * 12.0 / count(*) else cast(sum(volume) as double) end')} as volume, count(*) as n from once group by 1, 2")
def l01_hourly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming job's rows, run over the whole table as a batch."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("det"), "ts", F.floor("value").cast("long").alias("volume"))
    return hourly_volume(rows).select("det", "hour", dec(F.col("volume").cast("double")).alias("volume"), "n")


@query(f"select user_id % 50 as id, date_trunc('hour', ts) as hour, {dec_sql('cast(sum(60 + event_id % 90) as double) / cast(count(*) as double)')} as cycle_s, count(*) as samples from events group by 1, 2")
def l02_signal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("id"), "ts", (60 + F.col("event_id") % 90).alias("cycle"))
    return signal_means(rows).select("id", "hour", dec(F.col("cycle_s")).alias("cycle_s"), "samples")


@query(f"select date_trunc('second', ts) as second, count(*) as n, {dec_sql('cast(sum(event_id % 70) as double) / cast(count(*) as double)')} as mean_speed from events where user_id % 9 > 0 group by 1")
def l03_frame_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("ts", F.when(F.col("user_id") % 9 > 0, F.col("event_id") % 70).cast("double").alias("speed"))
    return frame_rollup(rows).select("second", "n", dec(F.col("mean_speed")).alias("mean_speed"))
