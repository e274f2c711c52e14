"""Joins by distance, direction, name and key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.stats import dec
from roadloom.operators import spatial_join as S
from roadloom.plans.registry import query
from roadloom.plans.validation import dec_sql
from roadloom.sources.fixtures import bent_links, bent_regulations, table, view

_H = "sqrt(cast((s.x - n.x) * (s.x - n.x) + (s.y - n.y) * (s.y - n.y) as double))"
_NEAR_SQL = f"""near as (select sign_id, px, py, nid, dist from (
  select s.sign_id, s.x as px, s.y as py, n.nid, {_H} as dist, row_number() over (partition by s.sign_id order by {_H}, n.nid) as k
  from fx_signs s join fx_nodes n on n.x between s.x - 30 and s.x + 30 and n.y between s.y - 30 and s.y + 30 where {_H} <= 30) where k = 1)"""


def matched_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = view(spark, sf_dir, "fx_signs").select(F.col("sign_id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), "code")
    return S.nearest_within(signs, view(spark, sf_dir, "fx_nodes"), 30.0)


@query("select a.sign_id as id1, b.sign_id as id2 from fx_signs a join fx_signs b on a.sign_id < b.sign_id and b.x between a.x - 8 and a.x + 8 and b.y between a.y - 8 and a.y + 8 where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64")
def e01_distance_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distance_pairs(view(spark, sf_dir, "fx_signs").select(F.col("sign_id").alias("id"), "x", "y"), 8.0)


@query(f"with {_NEAR_SQL} select s.sign_id, n.nid, {dec_sql('n.dist')} as dist from fx_signs s left join near n using (sign_id)")
def e02_nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_signs(spark, sf_dir).select(F.col("pid").alias("sign_id"), "nid", dec(F.col("dist")).alias("dist"))


def _seg(px: str, py: str) -> str:
    t = f"greatest(0.0, least(1.0, cast(({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1) as double) / cast((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) as double)))"
    return f"sqrt(({px} - (x1 + {t} * (x2 - x1))) * ({px} - (x1 + {t} * (x2 - x1))) + ({py} - (y1 + {t} * (y2 - y1))) * ({py} - (y1 + {t} * (y2 - y1))))"


_INFLOW_SQL = f"""{_NEAR_SQL}, ends as (select link_id, unnest([a, b]) as nid, x1, y1, x2, y2 from fx_links),
inflow as (select sign_id, link_id, d from (select sign_id, link_id, {_seg('px', 'py')} as d, row_number() over (partition by sign_id order by {_seg('px', 'py')}, link_id) as k from near join ends using (nid)) where k = 1)"""


@query(f"with {_INFLOW_SQL} select sign_id, link_id, {dec_sql('d')} as dist from inflow")
def e03_inflow_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.nearest_incident(matched_signs(spark, sf_dir).where("nid is not null"), view(spark, sf_dir, "fx_links"))
    return best.select(F.col("pid").alias("sign_id"), "link_id", dec(F.col("dist")).alias("dist"))


@query(f"with {_INFLOW_SQL} select distinct l.link_id, l.a as frm, l.b as to_node from inflow i join fx_links l using (link_id) join fx_signs s using (sign_id) where s.code = '63'")
def e25_stop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = S.nearest_incident(matched_signs(spark, sf_dir).where("nid is not null and code = '63'"), view(spark, sf_dir, "fx_links")).select("link_id")
    return view(spark, sf_dir, "fx_links").join(stops, "link_id", "left_semi").select("link_id", F.col("a").alias("frm"), F.col("b").alias("to_node"))


_MATCH_SQL = """s0 as (select link_id, sx1 as x1, sy1 as y1, sx2 as x2, sy2 as y2, sqrt(cast((sx2 - sx1) * (sx2 - sx1) + (sy2 - sy1) * (sy2 - sy1) as double)) as len from fx_bent),
s2 as (select *, (x2 - x1) / len as ux, (y2 - y1) / len as uy, sum(len) over (partition by link_id) as total from s0),
reg as (select reg_id, (cast(sx1 as double) + sx2) / 2 as mx, (cast(sy1 as double) + sy2) / 2 as my, sqrt(cast((sx2 - sx1) * (sx2 - sx1) + (sy2 - sy1) * (sy2 - sy1) as double)) as rlen, sx2 - sx1 as dx, sy2 - sy1 as dy from fx_regbent),
m as (select link_id, reg_id, len, total, rlen, ux * (dx / rlen) + uy * (dy / rlen) as dot, (mx - x1) * ux + (my - y1) * uy as along, abs((mx - x1) * uy - (my - y1) * ux) as off
  from s2 join reg on mx between least(x1, x2) - 150 and greatest(x1, x2) + 150 and my between least(y1, y2) - 150 and greatest(y1, y2) + 150),
o as (select *, least(len, along + rlen / 2) - greatest(0.0, along - rlen / 2) as overlap from m),
pair as (select link_id, reg_id, sum(overlap) as cover, sum(dot * overlap) as dots, max(total) as len from o where abs(dot) >= 0.85 and off <= 15 and overlap > 0 group by 1, 2),
best as (select link_id, reg_id, case when dots > 0 then 1 else -1 end as sign from (select *, row_number() over (partition by link_id order by cover desc, reg_id) as k from pair) where k = 1 and cover >= 0.5 * len)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bent links against regulation lines of one or two bent parts."""
    return S.line_match(bent_links(spark, sf_dir), bent_regulations(spark, sf_dir), 15.0)


@query(f"with {_MATCH_SQL} select link_id, reg_id, {dec_sql('cover')} as cover, {dec_sql('dots')} as dots from pair")
def e04_line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("link_id", "reg_id", dec(F.col("cover")).alias("cover"), dec(F.col("dots")).alias("dots"))


@query(f"with {_MATCH_SQL} select link_id, reg_id, sign from best")
def e05_best_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_match(matches(spark, sf_dir))


@query(f"with {_MATCH_SQL} select link_id, case when sign > 0 then 'R' else 'F' end as oneway from best")
def e06_oneway_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulation lines run against travel, so the same direction means R."""
    return S.best_match(matches(spark, sf_dir)).select("link_id", F.when(F.col("sign") > 0, "R").otherwise("F").alias("oneway"))


@query(f"with {_MATCH_SQL} select b.link_id, r.speed from best b join fx_reglines r using (reg_id)")
def e07_speed_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.best_match(matches(spark, sf_dir))
    return best.join(view(spark, sf_dir, "fx_reglines").select("reg_id", "speed"), "reg_id").select("link_id", "speed")


@query(f"""with {_NEAR_SQL}, {_MATCH_SQL} select 'points' as stage, (select count(*) from fx_signs) as n_source, (select count(*) from near) as n_matched, {dec_sql('(select count(*) from near) / cast((select count(*) from fx_signs) as double)')} as rate
union all select 'lines', (select count(*) from fx_reglines), (select count(distinct reg_id) from best), {dec_sql('(select count(distinct reg_id) from best) / cast((select count(*) from fx_reglines) as double)')}""")
def f19_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = matched_signs(spark, sf_dir).agg(F.lit("points").alias("stage"), F.count("*").alias("n_source"), F.count("nid").alias("n_matched"))
    used = S.best_match(matches(spark, sf_dir)).select("reg_id").distinct().withColumn("hit", F.lit(1))
    regs = view(spark, sf_dir, "fx_reglines").select("reg_id").join(used, "reg_id", "left").agg(F.lit("lines").alias("stage"), F.count("*").alias("n_source"), F.count("hit").alias("n_matched"))
    return points.unionByName(regs).withColumn("rate", dec(F.col("n_matched") / F.col("n_source").cast("double")))


@query("select p.p_partkey as nid, p.p_partkey % 50 as ix, p.p_partkey // 50 as iy, count(s.sign_id) as signs from part p join fx_signs s on s.x // 130 = p.p_partkey % 50 and s.y // 130 = p.p_partkey // 50 and s.x >= 0 and s.y >= 0 group by 1, 2, 3")
def e11_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in cells by an equi-join on the cell's index."""
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("nid"), (F.col("p_partkey") % 50).alias("ix"), F.floor(F.col("p_partkey") / 50).alias("iy"))
    signs = view(spark, sf_dir, "fx_signs").where("x >= 0 and y >= 0").groupBy(F.floor(F.col("x") / 130).alias("ix"), F.floor(F.col("y") / 130).alias("iy")).agg(F.count("*").alias("signs"))
    return cells.join(signs, ["ix", "iy"])


@query("""with c as (select l.a as zone, l.link_id, case when category = 4 and width_cls <= 2 then 1 when category = 4 then 2 when width_cls <= 3 then 3 else 4 end as tier from fx_links l), t as (select *, min(tier) over (partition by zone) as best from c)
select zone, link_id, tier from t where tier = best""")
def e12_tiered_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when((F.col("category") == 4) & (F.col("width_cls") <= 2), 1).when(F.col("category") == 4, 2).when(F.col("width_cls") <= 3, 3).otherwise(4)
    c = view(spark, sf_dir, "fx_links").select(F.col("a").alias("zone"), "link_id", tier.alias("tier"))
    best = c.groupBy("zone").agg(F.min("tier").alias("tier"))
    return c.join(best, ["zone", "tier"]).select("zone", "link_id", "tier")


_TOWN_SQL = "src as (select c_custkey as id, c_nationkey as city, 'T' || c_custkey % 97 || case when c_custkey % 3 = 0 then 'X' || c_custkey % 5 else '' end as name from customer), town as (select distinct s_nationkey as city, 'T' || s_suppkey % 97 as name from supplier)"


@query(f"with {_TOWN_SQL}, m as (select s.id, t.name, row_number() over (partition by s.id order by length(t.name) desc) as k from src s join town t on t.city = s.city and starts_with(s.name, t.name) and length(t.name) >= 2) select s.id, m.name as town from src s left join m on m.id = s.id and k = 1")
def e17_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest boundary name that starts a source name, within a city: prefixes become an equi-join."""
    c = F.col("c_custkey")
    name = F.concat(F.lit("T"), (c % 97).cast("string"), F.when(c % 3 == 0, F.concat(F.lit("X"), (c % 5).cast("string"))).otherwise(""))
    src = table(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_nationkey").alias("city"), name.alias("name"))
    town = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("city"), F.concat(F.lit("T"), (F.col("s_suppkey") % 97).cast("string")).alias("town")).distinct()
    prefixes = src.where(F.length("name") >= 2).select("id", "city", F.explode(F.transform(F.sequence(F.lit(2), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k))).alias("town"))
    best = prefixes.join(town, ["city", "town"]).groupBy("id").agg(F.max(F.struct(F.length("town").alias("n"), F.col("town"))).alias("b"))
    return src.select("id").join(best, "id", "left").select("id", F.col("b.town").alias("town"))


@query("""select s.s_suppkey as id, s.s_nationkey as pos, d.n as definitions, d.n is not null as has_definition from supplier s join nation on n_nationkey = s_nationkey left join (select l_suppkey, count(*) as n from lineitem where l_linenumber = 1 group by 1) d on d.l_suppkey = s.s_suppkey""")
def e18_control_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("definitions"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("pos"))
    held = s.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos")), "pos")
    return held.join(d, "id", "left").select("id", "pos", "definitions", F.col("definitions").isNotNull().alias("has_definition"))


@query("select c.c_custkey as section, o.unit, o.hour, sum(o.cnt) as cnt from customer c join fx_obs o on o.unit = 'U' || c.c_nationkey and o.eid = c.c_custkey group by 1, 2, 3")
def e19_section_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eid"), F.concat(F.lit("U"), F.col("c_nationkey").cast("string")).alias("unit"))
    return view(spark, sf_dir, "fx_obs").join(c, ["eid", "unit"]).groupBy(F.col("eid").alias("section"), "unit", "hour").agg(F.sum("cnt").alias("cnt"))


@query("""with d as (select eid, hour, sum(case when direction = 'up' then cnt end) as up, sum(case when direction = 'down' then cnt end) as down from fx_obs group by 1, 2)
select eid, hour, cast(case when eid % 3 = 0 then down when eid % 3 = 1 then up else (up + down) / 2.0 end as double) as cnt, case when eid % 3 = 0 then 'down' when eid % 3 = 1 then 'up' else 'mean' end as how from d""")
def e21_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda way: F.sum(F.when(F.col("direction") == way, F.col("cnt")))
    d = view(spark, sf_dir, "fx_obs").groupBy("eid", "hour").agg(part("up").alias("up"), part("down").alias("down"))
    k = F.col("eid") % 3
    return d.select("eid", "hour", F.when(k == 0, F.col("down").cast("double")).when(k == 1, F.col("up").cast("double")).otherwise((F.col("up") + F.col("down")) / F.lit(2.0)).alias("cnt"), F.when(k == 0, "down").when(k == 1, "up").otherwise("mean").alias("how"))


@query("""with f as (select case when category % 2 = 0 then 1 else 2 end as flag, oneway, link_id from fx_links where oneway <> '') select flag, (flag = 1) = (oneway = 'F') as agree, count(*) as n from f group by 1, 2""")
def e28_flag_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "fx_links").where("oneway <> ''").select(F.when(F.col("category") % 2 == 0, 1).otherwise(2).alias("flag"), "oneway")
    return f.groupBy("flag", ((F.col("flag") == 1) == (F.col("oneway") == "F")).alias("agree")).agg(F.count("*").alias("n"))
