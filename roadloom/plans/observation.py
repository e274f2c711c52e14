"""Counts: sensor profiles, signal means, directions, keys, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import text as T
from roadloom.functions.stats import dec
from roadloom.plans.registry import query
from roadloom.plans.validation import dec_sql
from roadloom.sources.fixtures import table, view


@query(f"""with h as (
  select det, cast(date_trunc('day', ts) as date) as day, cast(extract(hour from ts) as integer) as hour, sum(volume) as total, count(*) as n from fx_sensor
  where isodow(ts) < 6 group by 1, 2, 3
), p as (select det, hour, avg(case when n < 12 then total * 12.0 / n else cast(total as double) end) as v, count(*) as days from h group by 1, 2)
select det, hour, {dec_sql('v')} as volume, days, max(days) over (partition by det) as n_days from p""")
def f03_sensor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute counts to hours, scaled to twelve samples, weekdays only, averaged over days."""
    rows = view(spark, sf_dir, "fx_sensor").where(F.weekday("ts") < 5)
    hours = rows.groupBy("det", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("volume").alias("total"), F.count("*").alias("n"))
    full = F.when(F.col("n") < 12, F.col("total") * F.lit(12.0) / F.col("n")).otherwise(F.col("total").cast("double"))
    own = hours.groupBy("det", "hour").agg(F.avg(full).alias("v"), F.count("*").alias("days"))
    top = own.groupBy("det").agg(F.max("days").alias("n_days"))
    return own.join(top, "det").select("det", "hour", dec(F.col("v")).alias("volume"), "days", "n_days")


@query("select cast(isodow(ts) < 6 as boolean) as weekday, count(*) as n from fx_sensor group by 1")
def b09_weekday_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_sensor").groupBy((F.weekday("ts") < 5).alias("weekday")).agg(F.count("*").alias("n"))


_CONTROL_SQL = """control as (
  select l_suppkey as id, l_orderkey % 24 as hour, 60 + l_partkey % 90 as cycle, l_linenumber * 5 as s1, cast(l_quantity as integer) as s2, case when l_linenumber % 2 = 0 then 0 else 10 + l_partkey % 20 end as s3 from lineitem
)"""


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal log (id, hour, cycle, three splits) derived from ``lineitem``."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), (F.col("l_orderkey") % 24).alias("hour"), (60 + F.col("l_partkey") % 90).alias("cycle"), (F.col("l_linenumber") * 5).alias("s1"),
        F.col("l_quantity").cast("int").alias("s2"), F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(10 + F.col("l_partkey") % 20).alias("s3"),
    )


@query(f"with {_CONTROL_SQL} select id, hour, count(*) as samples, {dec_sql('avg(cycle)')} as cycle_s, {dec_sql('avg(s1)')} as s1, {dec_sql('avg(s2)')} as s2, {dec_sql('avg(s3)')} as s3 from control group by 1, 2")
def f01_signal_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = [dec(F.avg(c)).alias(n) for c, n in (("cycle", "cycle_s"), ("s1", "s1"), ("s2", "s2"), ("s3", "s3"))]
    return control(spark, sf_dir).groupBy("id", "hour").agg(F.count("*").alias("samples"), *means)


@query(f"""with {_CONTROL_SQL}, m as (select id, hour, avg(cycle) as c, avg(s1) as s1, avg(s2) as s2, avg(s3) as s3 from control group by 1, 2),
p as (select id, hour, c, unnest([s1, s2, s3]) as split, unnest([1, 2, 3]) as phase from m)
select id, hour, phase, {dec_sql('c * split / 100 - 3 - 2')} as green_s, count(*) over (partition by id, hour) as n_phases from p where split > 0""")
def f02_phase_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = control(spark, sf_dir).groupBy("id", "hour").agg(F.avg("cycle").alias("c"), F.array(F.avg("s1"), F.avg("s2"), F.avg("s3")).alias("s"))
    m = m.withColumn("n_phases", F.size(F.filter("s", lambda x: x > 0)).cast("long"))
    rows = m.select("id", "hour", "c", "n_phases", F.posexplode("s").alias("at", "split")).where("split > 0")
    return rows.select("id", "hour", (F.col("at") + 1).alias("phase"), dec(F.col("c") * F.col("split") / 100 - 3 - 2).alias("green_s"), "n_phases")


@query("""with c as (select o_custkey as id, sum(case when o_orderstatus = 'F' then o_orderkey % 100 end) as s, sum(case when o_orderstatus = 'O' then o_orderkey % 100 end) as l from orders group by 1)
select id, case when s is null and l is null then null else coalesce(s, 0) + coalesce(l, 0) end as total from c""")
def f04_hour_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small plus large vehicles; null only if both are null."""
    part = lambda code: F.sum(F.when(F.col("o_orderstatus") == code, F.col("o_orderkey") % 100))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(part("F").alias("s"), part("O").alias("l"))
    return own.select("id", F.when(F.col("s").isNull() & F.col("l").isNull(), None).otherwise(F.coalesce("s", F.lit(0)) + F.coalesce("l", F.lit(0))).alias("total"))


@query("""with d as (select unit, hour, sum(case when direction = 'up' then cnt end) as up, sum(case when direction = 'down' then cnt end) as down from fx_obs group by 1, 2)
select unit, hour, (coalesce(up, 0) + coalesce(down, 0)) / cast((case when up is null then 0 else 1 end + case when down is null then 0 else 1 end) as double) as rate from d where up is not null or down is not null""")
def f05_direction_mean_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda way: F.sum(F.when(F.col("direction") == way, F.col("cnt")))
    own = view(spark, sf_dir, "fx_obs").groupBy("unit", "hour").agg(part("up").alias("up"), part("down").alias("down")).where("up is not null or down is not null")
    seen = F.col("up").isNotNull().cast("int") + F.col("down").isNotNull().cast("int")
    return own.select("unit", "hour", ((F.coalesce("up", F.lit(0)) + F.coalesce("down", F.lit(0))).cast("double") / seen.cast("double")).alias("rate"))


@query("with h as (select eid, hour, sum(cnt) as v from fx_obs group by 1, 2) select eid, sum(v) as total, arg_min(hour, (-v, hour)) as peak_hour from h group by eid")
def f18_peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = view(spark, sf_dir, "fx_obs").groupBy("eid", "hour").agg(F.sum("cnt").alias("v"))
    return h.groupBy("eid").agg(F.sum("v").alias("total"), F.min(F.struct((-F.col("v")).alias("v"), F.col("hour"))).alias("b")).select("eid", "total", F.col("b.hour").alias("peak_hour"))


@query("with k as (select unit, count(distinct hour) as observed_hours from fx_obs group by unit) select observed_hours, count(*) as units from k group by 1")
def f31_observed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = view(spark, sf_dir, "fx_obs").groupBy("unit", "hour").agg(F.count("*").alias("_")).groupBy("unit").agg(F.count("*").alias("observed_hours"))
    return k.groupBy("observed_hours").agg(F.count("*").alias("units"))


@query("select hour, eid, source, unit, direction, cnt, 'a' as tag from fx_obs where source = 'census' union all select hour, eid, source, unit, direction, cnt, 'b' from fx_obs where source = 'detector'")
def i01_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "fx_obs").select("hour", "eid", "source", "unit", "direction", "cnt")
    return obs.where("source = 'census'").withColumn("tag", F.lit("a")).unionByName(obs.where("source = 'detector'").withColumn("tag", F.lit("b")))


@query("""select (select count(*) from (select eid from fx_obs intersect select eid from fx_flow)) as common, (select count(*) from (select eid from fx_obs except select eid from fx_flow)) as only_obs,
  (select count(*) from (select eid from fx_flow except select eid from fx_obs)) as only_flow""")
def i02_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = view(spark, sf_dir, "fx_obs").select("eid"), view(spark, sf_dir, "fx_flow").select("eid")
    tag = lambda df, t: df.distinct().select(F.lit(t).alias("t"))
    rows = tag(a.intersect(b), 1).union(tag(a.subtract(b), 2)).union(tag(b.subtract(a), 3))
    return rows.agg(*[F.count(F.when(F.col("t") == k, 1)).alias(n) for k, n in ((1, "common"), (2, "only_obs"), (3, "only_flow"))])


@query("""select link_id, nid from (select nid, unnest([nid * 2, nid * 2 + 1]) as link_id from fx_nodes) where link_id not in (select link_id from fx_links)""")
def e31_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that a full grid would have, less those that are there."""
    expected = view(spark, sf_dir, "fx_nodes").select(F.explode(F.array(F.col("nid") * 2, F.col("nid") * 2 + 1)).alias("link_id"), "nid")
    return expected.join(view(spark, sf_dir, "fx_links").select("link_id"), "link_id", "left_anti")


@query(f"""with a as (select distinct o_custkey as k from orders), b as (select c_custkey as k from customer)
select count(*) filter (a.k is not null) as n_a, count(*) filter (b.k is not null) as n_b, count(*) filter (a.k is not null and b.k is not null) as both_n, {dec_sql('count(*) filter (a.k is not null and b.k is not null) / cast(greatest(count(*) filter (b.k is not null), 1) as double)')} as rate from a full join b on a.k = b.k""")
def f30_join_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ka")).distinct()
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb"))
    j = a.join(b, F.col("ka") == F.col("kb"), "full").agg(F.count("ka").alias("n_a"), F.count("kb").alias("n_b"), F.count(F.when(F.col("ka").isNotNull() & F.col("kb").isNotNull(), 1)).alias("both_n"))
    return j.withColumn("rate", dec(F.col("both_n") / F.greatest(F.col("n_b"), F.lit(1)).cast("double")))


@query("select eid, hour, unit, cnt from (select *, row_number() over (partition by eid order by cnt desc, hour, unit, direction) as k from fx_obs) where k = 1")
def g02_keep_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per edge, of most volume; a minimum that combines before the shuffle, not a window."""
    best = view(spark, sf_dir, "fx_obs").groupBy("eid").agg(F.min(F.struct((-F.col("cnt")).alias("c"), "hour", "unit", "direction")).alias("b"))
    return best.select("eid", "b.hour", "b.unit", (-F.col("b.c")).alias("cnt"))


@query("select o_custkey, min(o_orderkey) as first_order, max(o_orderkey) as last_order from orders group by 1")
def g03_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))


@query("""with v as (select o_custkey as k, o_orderkey as v from orders), g as (select *, case when v - lag(v) over (partition by k order by v) <= 200 then 0 else 1 end as new from v),
c as (select *, sum(new) over (partition by k order by v rows unbounded preceding) as grp from g)
select k, grp, count(*) as size, min(v) as low, max(v) as high from c group by 1, 2""")
def g01_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    w = Window.partitionBy("k").orderBy("v")
    g = v.withColumn("new", F.when(F.col("v") - F.lag("v").over(w) <= 200, 0).otherwise(1))
    c = g.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("k", "grp").agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("select 'K' || lpad(cast(k as varchar), 7, '0') as id, link_id from (select link_id, row_number() over (order by abs(x2 - x1) + abs(y2 - y1) desc, link_id) as k from fx_links)")
def g04_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids by falling length: rows are dealt by range, counted per partition, and numbered from the counts."""
    size = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    rows = view(spark, sf_dir, "fx_links").select("link_id", (-size).alias("key"))
    dealt = rows.repartitionByRange("key", "link_id").sortWithinPartitions("key", "link_id")
    numbered = dealt.withColumn("mono", F.monotonically_increasing_id())
    from roadloom.session import checkpointed

    numbered = checkpointed(numbered).withColumn("part", F.floor(F.col("mono") / F.lit(1 << 33)))
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    k = F.col("before") + F.pmod("mono", F.lit(1 << 33)) + 1
    return numbered.join(F.broadcast(before), "part").select(F.concat(F.lit("K"), F.lpad(k.cast("string"), 7, "0")).alias("id"), "link_id")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def h01_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("select eid, unit, hour, direction, cnt from fx_obs order by eid, hour, unit, direction")
def h02_full_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_obs").select("eid", "unit", "hour", "direction", "cnt").orderBy("eid", "hour", "unit", "direction")


_CAND_SQL = "cand as (select a as nid, link_id as eid, (link_id * 37 % 360) as bearing, (a * 90 % 360) as travel from fx_links)"


@query(f"""with {_CAND_SQL}, d as (select *, least(abs(bearing - travel), 360 - abs(bearing - travel)) as diff, count(*) over (partition by nid) as n from cand)
select nid, eid, diff from (select *, row_number() over (partition by nid order by diff, eid) as k from d) where k = 1 and diff <= 45""")
def e23_direction_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each node's candidates the one nearest to the travel bearing, at most 45 degrees off."""
    c = view(spark, sf_dir, "fx_links").select(F.col("a").alias("nid"), F.col("link_id").alias("eid"), (F.col("link_id") * 37 % 360).alias("bearing"), (F.col("a") * 90 % 360).alias("travel"))
    diff = F.least(F.abs(F.col("bearing") - F.col("travel")), 360 - F.abs(F.col("bearing") - F.col("travel")))
    best = c.groupBy("nid").agg(F.min(F.struct(diff.alias("diff"), F.col("eid"))).alias("b"))
    return best.where("b.diff <= 45").select("nid", "b.eid", "b.diff")


_NAME_SQL = """named as (select s_suppkey as id, case s_suppkey % 5 when 0 then '北７西２７東西' when 1 then '南１東 ３南北' when 2 then '国道３６号' when 3 then ' 北24西5西' else 'ＡＢＣ東' end as name from supplier)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "北７西２７東西").when(k == 1, "南１東 ３南北").when(k == 2, "国道３６号").when(k == 3, " 北24西5西").otherwise("ＡＢＣ東")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name"))


_NARROW_SQL = "replace(replace(translate(name, '０１２３４５６７８９ＡＢＣ', '0123456789ABC'), ' ', ''), '　', '')"


@query(f"with {_NAME_SQL} select id, {_NARROW_SQL} as plain from named")
def d01_narrow_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("id", T.narrow(F.col("name")).alias("plain"))


@query(f"with {_NAME_SQL} select id, nullif(regexp_extract({_NARROW_SQL}, '[東西南北]([東西南北])$', 1), '') as direction from named")
def d02_travel_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("id", T.travel_direction(F.col("name")).alias("direction"))


@query(f"""with {_NAME_SQL}, p as (select id, regexp_replace({_NARROW_SQL}, '[東西南北]{{2}}$', '') as s from named)
select id, nullif(regexp_extract(s, '^([北南])([0-9]+)([東西])([0-9]+)', 1), '') as ns, cast(nullif(regexp_extract(s, '^([北南])([0-9]+)([東西])([0-9]+)', 2), '') as integer) as n,
  nullif(regexp_extract(s, '^([北南])([0-9]+)([東西])([0-9]+)', 3), '') as ew, cast(nullif(regexp_extract(s, '^([北南])([0-9]+)([東西])([0-9]+)', 4), '') as integer) as m from p""")
def d03_grid_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("id", *[c.alias(k) for k, c in T.grid_address(F.col("name")).items()])


@query("""with t as (select s_suppkey as id, ['三', '十', '十二', '二十', '二十一', '九十九', 'x'][s_suppkey % 7 + 1] as word from supplier)
select id, case word when '三' then 3 when '十' then 10 when '十二' then 12 when '二十' then 20 when '二十一' then 21 when '九十九' then 99 end as number from t""")
def d04_kanji_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("三", "十", "十二", "二十", "二十一", "九十九", "x")])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.kanji_number(F.element_at(words, (F.col("s_suppkey") % 7 + 1).cast("int"))).alias("number"))


@query("select link_id, try_cast(split_part(case when link_id % 3 = 0 then link_id || '.-60' when link_id % 3 = 1 then 'x' || link_id else cast(link_id as varchar) end, '.', 1) as bigint) as base from fx_links")
def d06_base_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("link_id").cast("string")
    name = F.when(F.col("link_id") % 3 == 0, F.concat(i, F.lit(".-60"))).when(F.col("link_id") % 3 == 1, F.concat(F.lit("x"), i)).otherwise(i)
    return view(spark, sf_dir, "fx_links").select("link_id", T.base_id(name).alias("base"))


@query("select a, string_agg(cast(link_id as varchar), ',' order by link_id) as ids from fx_links group by a")
def d07_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_links").groupBy("a").agg(F.array_join(F.sort_array(F.collect_list("link_id")).cast("array<string>"), ",").alias("ids"))


@query("""select p_partkey, case when p_partkey % 4 = 3 then null else regexp_replace(trim(' ' || p_partkey || '.0 '), '\\.0$', '') || '-' || p_size end as key from part""")
def b11_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("p_partkey") % 4 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".0 ")))
    return table(spark, sf_dir, "part").select("p_partkey", T.composite_key(first, F.col("p_size").cast("string")).alias("key"))


@query("""select o_orderkey, coalesce(try_cast(case when o_orderkey % 3 = 0 then 'X' else cast(o_custkey as varchar) end as double), 0) as zone_value, try_cast(case when o_orderkey % 3 = 0 then 'X' else cast(o_custkey as varchar) end as double) as census_value from orders""")
def b10_numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_custkey").cast("string")).try_cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(raw, F.lit(0.0)).alias("zone_value"), raw.alias("census_value"))


@query("select s_suppkey, s_name from supplier where s_name not like '%7%'")
def b12_name_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").where(~F.col("s_name").contains("7"))


@query("select c_custkey, c_name from customer where regexp_matches(c_name, '[0-9]+$') and not regexp_matches(c_name, '(13|77)')")
def b08_name_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").where(F.col("c_name").rlike("[0-9]+$") & ~F.col("c_name").rlike("(13|77)"))
