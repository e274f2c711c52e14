"""Observed against modelled hourly volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.stats import HOLDOUT_LIMIT, HOLDOUT_SALT, dec, fit_from_sums, geh, is_holdout, sums
from roadloom.operators.quantiles import exact_quantiles
from roadloom.plans.registry import query
from roadloom.sources.fixtures import view

D = "decimal(18,3)"


def dec_sql(x: str) -> str:
    return f"cast(cast(cast({x} as decimal(18,9)) as decimal(18,3)) as double)"


HOLD_SQL = f"substr(sha256('{HOLDOUT_SALT}:' || unit), 1, 16) <= '{HOLDOUT_LIMIT}'"
GROUPS_SQL = f"""
groups as (
  select o.source, o.unit, o.direction, o.hour, {HOLD_SQL} as holdout, cast(avg(f.flow) as {D}) as s, cast(avg(o.cnt) as {D}) as o, count(*) as edges, count(f.flow) as with_flow
  from fx_obs o left join fx_flow f on f.eid = o.eid and f.hour = o.hour group by 1, 2, 3, 4, 5 having count(f.flow) > 0
)"""
GEH_SQL = "case when s + o <= 0 then 0.0 else sqrt(2 * (cast(s as double) - cast(o as double)) * (cast(s as double) - cast(o as double)) / (cast(s as double) + cast(o as double))) end"
SUMS_SQL = f"count(*) as n, cast(sum(s) as double) as ss, cast(sum(o) as double) as so, cast(sum(cast(s as decimal(38,3)) * s) as double) as sss, cast(sum(cast(o as decimal(38,3)) * o) as double) as soo, cast(sum(cast(s as decimal(38,3)) * o) as double) as sso, sum(case when {GEH_SQL} < 5 then 1 else 0 end) as good"
SPREAD = "(n * sss - ss * ss) * (n * soo - so * so)"
R = f"case when n >= 2 and {SPREAD} > 0 then (n * sso - ss * so) / sqrt({SPREAD}) end"
FIT_SQL = f"""{dec_sql(R)} as r, {dec_sql(f"({R}) * ({R})")} as r2, {dec_sql("case when n >= 2 and soo > 0 then sso / soo end")} as slope,
  {dec_sql("case when n >= 2 and so > 0 then sqrt((sss - 2 * sso + soo) / n) / (so / n) * 100 end")} as rmse_pct, {dec_sql("case when n >= 2 and so > 0 then ss / so end")} as ratio,
  {dec_sql("cast(good as double) / n")} as geh5"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean observed and modelled volume of each (source, unit, direction, hour); groups without any flow are left out."""
    both = view(spark, sf_dir, "fx_obs").join(view(spark, sf_dir, "fx_flow"), ["eid", "hour"], "left")
    own = both.groupBy("source", "unit", "direction", "hour").agg(F.avg("flow").cast(D).alias("s"), F.avg("cnt").cast(D).alias("o"), F.count("*").alias("edges"), F.count("flow").alias("with_flow")).where("with_flow > 0")
    return own.withColumn("holdout", is_holdout(F.col("unit")))


def _good() -> list:
    s, o = F.col("s").cast("double"), F.col("o").cast("double")
    return [F.sum(F.when(geh(s, o) < 5, 1).otherwise(0)).alias("good")]


def fit(df: DataFrame, *keys: str) -> DataFrame:
    own = df.groupBy(*keys).agg(*sums(F.col("s"), F.col("o")), *_good())
    return own.select(*keys, "n", *[c.alias(k) for k, c in fit_from_sums().items()], dec(F.col("good").cast("double") / F.col("n")).alias("geh5"))


@query(f"with {GROUPS_SQL} select source, unit, direction, hour, holdout, {dec_sql('s')} as s, {dec_sql('o')} as o, edges, with_flow from groups")
def e26_group_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).withColumn("s", dec(F.col("s"))).withColumn("o", dec(F.col("o")))


@query("select source, unit, direction, hour, avg(cnt) as mean_count, count(*) as edges from fx_obs group by 1, 2, 3, 4")
def f06_observation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_obs").groupBy("source", "unit", "direction", "hour").agg(F.avg("cnt").alias("mean_count"), F.count("*").alias("edges"))


@query(f"with {GROUPS_SQL}, t as (select {SUMS_SQL} from groups) select n, {FIT_SQL} from t")
def f07_fit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(groups(spark, sf_dir))


_CUBE_SQL = f"""with {GROUPS_SQL}, t as (
  select hour, case when grouping(source) = 1 then 'all' else source end as source, case when grouping(holdout) = 1 then 'all' when holdout then 'holdout' else 'calibration' end as part, {SUMS_SQL}
  from groups group by grouping sets ((hour), (hour, source), (hour, holdout), (hour, source, holdout))
) select hour, source, part, n, {FIT_SQL} from t"""


def metric_cube(df: DataFrame) -> DataFrame:
    """Fit by hour over {all, each source} x {all, calibration, holdout}, in one pass of grouping sets."""
    own = df.groupingSets([["hour"], ["hour", "source"], ["hour", "holdout"], ["hour", "source", "holdout"]], "hour", "source", "holdout").agg(
        F.grouping("source").alias("gs"), F.grouping("holdout").alias("gh"), *sums(F.col("s"), F.col("o")), *_good()
    )
    source = F.when(F.col("gs") == 1, "all").otherwise(F.col("source"))
    part = F.when(F.col("gh") == 1, "all").when(F.col("holdout"), "holdout").otherwise("calibration")
    return own.select("hour", source.alias("source"), part.alias("part"), "n", *[c.alias(k) for k, c in fit_from_sums().items()], dec(F.col("good").cast("double") / F.col("n")).alias("geh5"))


@query(_CUBE_SQL)
def f08_metric_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_cube(groups(spark, sf_dir))


@query(f"""with {GROUPS_SQL}, t as (select source, unit, direction, {SUMS_SQL} from groups group by 1, 2, 3 having count(*) >= 3),
r as (select source, unit, direction, {dec_sql(R)} as r from t), k as (select *, row_number() over (partition by source order by r, unit, direction) as k, count(*) over (partition by source) as n from r where r is not null)
select source, n as sites, r as median_r from k where k = n // 2 + 1""")
def f09_site_temporal_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = groups(spark, sf_dir).groupBy("source", "unit", "direction").agg(*sums(F.col("s"), F.col("o"))).where("n >= 3")
    r = own.select("source", "unit", "direction", fit_from_sums()["r"].alias("r")).where("r is not null")
    # One row per site by now; sites are few beside observations.
    w = Window.partitionBy("source")
    ranked = r.withColumn("k", F.row_number().over(w.orderBy("r", "unit", "direction"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("source", F.col("n").alias("sites"), F.col("r").alias("median_r"))


@query(f"""with cube as ({_CUBE_SQL.replace("with " + GROUPS_SQL.strip() + ",", "with " + GROUPS_SQL.strip() + ",")})
select a.hour, coalesce(a.r >= 0.9, false) as r_ok, coalesce(a.slope between 0.9 and 1.1, false) as slope_ok, coalesce(a.geh5 >= 0.6, false) as geh_ok, coalesce(h.r >= 0.85, false) as holdout_ok,
  coalesce(a.r >= 0.9 and a.slope between 0.9 and 1.1 and a.geh5 >= 0.6 and h.r >= 0.85, false) as passed
from cube a left join cube h on h.hour = a.hour and h.source = 'all' and h.part = 'holdout' where a.source = 'all' and a.part = 'all'""")
def f10_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = metric_cube(groups(spark, sf_dir)).where("source = 'all' and part in ('all', 'holdout')")
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    m = cube.groupBy("hour").agg(pick("all", "r").alias("r"), pick("all", "slope").alias("slope"), pick("all", "geh5").alias("geh5"), pick("holdout", "r").alias("hr"))
    tests = {"r_ok": F.col("r") >= 0.9, "slope_ok": F.col("slope").between(0.9, 1.1), "geh_ok": F.col("geh5") >= 0.6, "holdout_ok": F.col("hr") >= 0.85}
    tests = {k: F.coalesce(c, F.lit(False)) for k, c in tests.items()}
    return m.select("hour", *[c.alias(k) for k, c in tests.items()], (tests["r_ok"] & tests["slope_ok"] & tests["geh_ok"] & tests["holdout_ok"]).alias("passed"))


@query(f"with {GROUPS_SQL} select source, unit, direction, hour, {dec_sql(GEH_SQL)} as geh from groups")
def c18_geh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("source", "unit", "direction", "hour", dec(geh(F.col("s").cast("double"), F.col("o").cast("double"))).alias("geh"))


@query(f"select c_custkey, substr(sha256('{HOLDOUT_SALT}:' || c_name), 1, 16) <= '{HOLDOUT_LIMIT}' as holdout from customer")
def c21_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.sources.fixtures import table

    return table(spark, sf_dir, "customer").select("c_custkey", is_holdout(F.col("c_name")).alias("holdout"))


@query(f"""select o.hour, (o.hour - 6) * 3600 as begin_s, (o.hour - 5) * 3600 as end_s, o.eid, o.cnt from fx_obs o where o.hour between 6 and 20 and o.cnt is not null and not ({HOLD_SQL})""")
def a17_observation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_obs").where("hour between 6 and 20 and cnt is not null").where(~is_holdout(F.col("unit")))
    return rows.select("hour", ((F.col("hour") - 6) * 3600).alias("begin_s"), ((F.col("hour") - 5) * 3600).alias("end_s"), "eid", "cnt")


@query(f"""with p as (select a.eid, a.hour, cast(a.cnt as double) / f.flow as q from fx_obs a join fx_flow f using (eid, hour) where f.flow > 0)
select hour, count(*) as n, {dec_sql("quantile_cont(q, 0.5)")} as median, {dec_sql("quantile_cont(q, 0.25)")} as q1, {dec_sql("quantile_cont(q, 0.75)")} as q3, {dec_sql("avg(case when q between 0.7 and 1.3 then 1.0 else 0.0 end)")} as within from p group by hour""")
def e27_source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = view(spark, sf_dir, "fx_obs").join(view(spark, sf_dir, "fx_flow"), ["eid", "hour"]).where("flow > 0").withColumn("q", F.col("cnt").cast("double") / F.col("flow"))
    found = exact_quantiles(both, ["hour"], "q", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    within = both.groupBy("hour").agg(dec(F.avg(F.when(F.col("q").between(0.7, 1.3), 1.0).otherwise(0.0))).alias("within"))
    return found.join(within, "hour").select("hour", "n", *[dec(F.col(c)).alias(c) for c in ("median", "q1", "q3")], "within")
