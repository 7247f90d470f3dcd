"""Queries of the masks and summaries, and their SQL; registered beside those of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, summaries
from ..operators.series import monthly_climatology
from .registry import NDOY_SQL, OFA_SQL, STATE_SQL, _cycles, _t, ofa_table, query, r, states

c = F.col
RUNS_SQL = f"{STATE_SQL}, ol AS (SELECT * FROM st WHERE exp = 'F'), da AS (SELECT * FROM st WHERE exp = 'O')"


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = states(spark, d)
    return x.where("exp = 'F'"), x.where("exp = 'O'")


@query(f"""WITH {STATE_SQL}, k AS (SELECT tile, month(ts) AS m FROM st WHERE year(ts) BETWEEN 1995 AND 1997 GROUP BY 1, 2 HAVING avg(v) > 150)
  SELECT st.tile, CAST(month(ts) AS INTEGER) AS month, count(*) AS n FROM st JOIN k ON st.tile = k.tile AND month(ts) = m GROUP BY 1, 2""")
def snowy_months(spark: SparkSession, d: str) -> DataFrame:
    """F5."""
    return masks.snowy_months(states(spark, d), ["tile"], "v", 1995, 1997, 150.0).groupBy("tile", "month").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT tile, date_trunc('month', ts) AS month, avg(v) AS w FROM da GROUP BY 1, 2 HAVING avg(v) < 200)
  SELECT ol.id, ol.tile, round(CASE WHEN m.w IS NOT NULL THEN ol.v END, 6) AS v FROM ol LEFT JOIN m ON ol.tile = m.tile AND date_trunc('month', ol.ts) = m.month""")
def propagate_mask(spark: SparkSession, d: str) -> DataFrame:
    """F6."""
    ol, da = _runs(spark, d)
    month = F.trunc("ts", "month").alias("month")
    m = da.groupBy("tile", month).agg(F.avg("v").alias("w")).withColumn("w", F.when(c("w") < 200, c("w")))
    return r(masks.propagate(ol.select("id", "tile", "v", month), m, ["tile", "month"], "w", ["v"]).select("id", "tile", "v"), "v", places=6)


@query(f"WITH {STATE_SQL} SELECT tile, CASE WHEN month(ts) BETWEEN 5 AND 9 THEN 'summer' ELSE 'winter' END AS season, count(*) AS n, round(avg(v), 8) AS mean FROM st GROUP BY 1, 2")
def seasons(spark: SparkSession, d: str) -> DataFrame:
    """F12."""
    return r(states(spark, d).groupBy("tile", masks.season(F.month("ts")).alias("season")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), "mean", places=8)


@query(f"WITH {OFA_SQL}, d AS (SELECT tile, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS day, max(obs) AS v FROM ofa GROUP BY 1, 2, 3) SELECT tile, month, min(v) AS coldest FROM d GROUP BY 1, 2 HAVING min(v) > 10")
def always_warm(spark: SparkSession, d: str) -> DataFrame:
    """F16."""
    return masks.always_warm(ofa_table(spark, d).withColumn("month", F.trunc("ts", "month")), ["tile", "month"], "obs")


STATS_SQL = "SELECT tile, count(*) AS n, avg(v) AS m, stddev_samp(v) AS s FROM {} GROUP BY tile HAVING count(*) >= 10"


@query(f"WITH {RUNS_SQL}, a AS ({STATS_SQL.format('ol')}), b AS ({STATS_SQL.format('da')}) SELECT a.tile, a.n AS n_a, b.n AS n_b, round(a.m, 8) AS m_a, round(b.m, 8) AS m_b, round(a.s, 6) AS s_a, round(b.s, 6) AS s_b FROM a JOIN b USING (tile)")
def common_valid(spark: SparkSession, d: str) -> DataFrame:
    """F18, F19."""
    s = [x.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")) for x in _runs(spark, d)]
    return r(r(masks.common_valid(*s, ["tile"], ["m", "s"], 10), "m_a", "m_b", places=8), "s_a", "s_b", places=6)


@query(f"""WITH {STATE_SQL}, q AS (SELECT tile, year(ts) AS y, CASE WHEN count(CASE WHEN exp = 'F' THEN 1 END) > 0 THEN avg(v) END AS v FROM st GROUP BY 1, 2),
  k AS (SELECT tile FROM q GROUP BY tile HAVING bool_and(v IS NOT NULL) AND count(DISTINCT y) = (SELECT count(DISTINCT y) FROM q)) SELECT tile, CAST(y AS INTEGER) AS year, round(v, 8) AS v FROM q WHERE tile IN (SELECT tile FROM k)""")
def all_years_valid(spark: SparkSession, d: str) -> DataFrame:
    """F20."""
    q = states(spark, d).groupBy("tile", F.year("ts").alias("year")).agg(F.when(F.count_if(c("exp") == "F") > 0, F.avg("v")).alias("v"))
    return r(masks.complete(q, ["tile"], "year", ["v"]), "v", places=8)


@query(f"""WITH {RUNS_SQL}, p AS (SELECT a.tile, a.m AS base, b.m AS value FROM ({STATS_SQL.format('ol')}) a JOIN ({STATS_SQL.format('da')}) b USING (tile)), e AS (SELECT greatest(1e-8, quantile_cont(base, 0.1)) AS f FROM p),
  k AS (SELECT tile, CASE WHEN base > f THEN 100 * (value - base) / base END AS pc FROM p, e) SELECT tile, round(CASE WHEN pc > 5 THEN NULL ELSE pc END, 6) AS percent, coalesce(pc > 5, false) AS capped FROM k""")
def percent_change(spark: SparkSession, d: str) -> DataFrame:
    """F22, F23."""
    a, b = [x.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).where("n >= 10").select("tile", "m") for x in _runs(spark, d)]
    p = a.withColumnRenamed("m", "base").join(b.withColumnRenamed("m", "value"), "tile")
    return r(masks.cap(masks.percent_change(p, "base", "value"), "percent", 5.0).select("tile", "percent", "capped"), "percent", places=6)


@query(f"""WITH {OFA_SQL}, b AS (SELECT tile FROM ofa GROUP BY tile, date_trunc('month', ts) HAVING bool_or(species = 1) AND bool_or(species = 7)) SELECT tile, species, count(*) AS n FROM ofa WHERE tile IN (SELECT tile FROM b) GROUP BY 1, 2""")
def seen_by_both(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that species 1 and 7 both saw in one month."""
    x = ofa_table(spark, d)
    months = x.withColumn("key", F.struct("tile", F.trunc("ts", "month")))
    tiles = summaries.seen_by_both(months, "key", "species", 1, 7).select("tile").distinct()
    return x.join(tiles, "tile", "left_semi").groupBy("tile", "species").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OFA_SQL} SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN species = 1 THEN obs END), 8) AS a, round(avg(CASE WHEN species = 2 THEN obs END), 8) AS b, round(avg(CASE WHEN species = 3 THEN obs END), 8) AS c FROM ofa GROUP BY 1
  HAVING count(CASE WHEN species = 1 THEN 1 END) > 0 AND count(CASE WHEN species = 2 THEN 1 END) > 0 AND count(CASE WHEN species = 3 THEN 1 END) > 0""")
def three_sources(spark: SparkSession, d: str) -> DataFrame:
    """J8."""
    x = ofa_table(spark, d).withColumns({"day": F.to_date("ts"), "source": F.when(c("species") == 1, "a").when(c("species") == 2, "b").when(c("species") == 3, "c")})
    return r(summaries.in_every_source(x, ["day"], "source", ["a", "b", "c"], "obs"), "a", "b", "c", places=8)


@query(f"""WITH {RUNS_SQL}, k AS (SELECT tile, month(ts) AS m, avg(v) AS clim, count(v) AS n FROM ol GROUP BY 1, 2) SELECT da.id, da.tile, round(v - clim, 6) AS anom, k.n FROM da JOIN k ON da.tile = k.tile AND month(da.ts) = m""")
def climatology_lookup(spark: SparkSession, d: str) -> DataFrame:
    """J10."""
    ol, da = _runs(spark, d)
    x = summaries.lookup(da.withColumn("month", F.month("ts")), monthly_climatology(ol, ["tile"], "v", 0, 9999), ["tile", "month"])
    return r(x.select("id", "tile", (c("v") - c("clim")).alias("anom"), "n"), "anom", places=6)


@query("SELECT c_custkey AS site, CAST(greatest(0, least(39, ceil((c_acctbal + 1000) / 250 - 0.5))) AS INTEGER) AS k FROM customer")
def nearest_axis(spark: SparkSession, d: str) -> DataFrame:
    """J15."""
    return _t(spark, d, "customer").select(c("c_custkey").alias("site"), summaries.nearest_index(c("c_acctbal"), -1000.0, 250.0, 40).alias("k"))


@query("""WITH a AS (SELECT p_partkey AS k, p_size / 7.0 AS lon, p_partkey % 20 / 3.0 AS lat FROM part), b AS (SELECT min(c_custkey) AS near, c_custkey % 50 / 7.0 + 1e-5 AS lon, c_custkey % 20 / 3.0 AS lat FROM customer GROUP BY 2, 3)
  SELECT k, coalesce(near, -1) AS near FROM a LEFT JOIN b ON round(a.lon, 3) = round(b.lon, 3) AND round(a.lat, 3) = round(b.lat, 3)""")
def rounded_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """J17."""
    a = _t(spark, d, "part").select(c("p_partkey").alias("k"), (c("p_size") / 7.0).alias("lon"), (c("p_partkey") % 20 / 3.0).alias("lat"))
    b = _t(spark, d, "customer").groupBy((c("c_custkey") % 50 / 7.0 + 1e-5).alias("lon"), (c("c_custkey") % 20 / 3.0).alias("lat")).agg(F.min("c_custkey").alias("near"))
    return summaries.rounded_join(a, b, "lon", "lat").select("k", F.coalesce("near", F.lit(-1).cast("long")).alias("near"))


@query("""SELECT user_id AS site, date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 3) * 3 AS INTEGER)) AS at, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2""")
def station_time(spark: SparkSession, d: str) -> DataFrame:
    """To the three hours before."""
    return r(_t(spark, d, "events").groupBy(c("user_id").alias("site"), summaries.station_time(c("ts"), "floor3").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean", places=8)


CYCLE_SQL = f"{OFA_SQL}, y AS (SELECT *, CAST(date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) AS INTEGER) AS cycle, id * 10 + species AS rid FROM ofa), p AS (SELECT b.rid, b.cycle, min(a.rid) AS first_row FROM y b JOIN y a ON a.species = b.species AND a.cycle + 1 = b.cycle AND abs(a.obs - b.obs) <= 1e-6 GROUP BY 1, 2)"


@query(f"WITH {CYCLE_SQL} SELECT p.first_row, p.rid, min(q.rid) AS next_row, p.cycle FROM p JOIN p q ON q.first_row = p.rid GROUP BY 1, 2, 4")
def triplicates(spark: SparkSession, d: str) -> DataFrame:
    """J21."""
    return summaries.triplicates(_cycles(spark, d), ["species"], "cycle", "obs", "rid")


@query(f"WITH {OFA_SQL} SELECT tile, species, max(obs) AS max_obs, count(*) AS n, count(*) FILTER (obs > 45) AS n_high, round(avg(obs), 8) AS mean_obs, first(price ORDER BY id, price) AS first_price FROM ofa GROUP BY 1, 2")
def tile_profile(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return r(summaries.tile_profile(ofa_table(spark, d), ["tile", "species"], ["id", "price"], ["price"], 45.0), "mean_obs", places=8)


SUMS = {"o": "obs", "f": "fcst", "a": "ana", "omf": "obs - fcst", "oma": "obs - ana"}


@query(f"WITH {OFA_SQL} SELECT tile, species, count(*) AS n, " + ", ".join(f"round(sum({e}), 6) AS s_{k}, round(sum(({e}) * ({e})), 6) AS q_{k}" for k, e in SUMS.items()) + " FROM ofa GROUP BY 1, 2")
def tile_sums(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    return r(summaries.tile_sums(ofa_table(spark, d), ["tile", "species"]), *[f"{p}_{k}" for k in SUMS for p in "sq"], places=6)


@query(f"WITH {OFA_SQL}, k AS (SELECT CAST(ts AS DATE) AS day, species, obs, count(*) AS n FROM ofa GROUP BY 1, 2, 3) SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS n_duplicate FROM k GROUP BY day")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """A14."""
    return summaries.duplicate_keys(ofa_table(spark, d).withColumn("day", F.to_date("ts")), "day", ["species", "obs"])


@query(f"""WITH {CYCLE_SQL}, n AS (SELECT cycle, count(*) AS n FROM y GROUP BY 1), e AS (SELECT b.cycle, min(b.fcst) - first(a.fcst ORDER BY a.rid, a.fcst) AS d FROM y b JOIN y a ON a.species = b.species AND a.cycle + 1 = b.cycle AND abs(a.obs - b.obs) <= 1e-6 GROUP BY b.rid, b.cycle),
  s AS (SELECT cycle, count(*) AS n_dup, avg(d) AS mean, quantile_cont(d, 0.5) AS median, stddev_pop(d) AS std, quantile_cont(abs(d), 0.95) AS p95_abs, avg(CAST(abs(d) > 1e-3 AS INTEGER)) AS share_large FROM e GROUP BY 1)
  SELECT s.cycle, n_dup, round(mean, 8) AS mean, round(median, 8) AS median, round(std, 6) AS std, round(p95_abs, 8) AS p95_abs, round(share_large, 8) AS share_large, round(n_dup / a.n, 8) AS share_now, round(n_dup / b.n, 8) AS share_before FROM s JOIN n a ON a.cycle = s.cycle JOIN n b ON b.cycle + 1 = s.cycle""")
def duplicate_report(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return r(r(summaries.duplicate_report(_cycles(spark, d), ["species"], "cycle", "obs", "fcst", "rid"), "mean", "median", "p95_abs", "share_large", "share_now", "share_before", places=8), "std", places=6)


@query(f"""WITH {OFA_SQL}, v AS (SELECT *, least(365, dayofyear(ts)) AS d FROM ofa), g AS (SELECT unnest(generate_series(1, 365)) AS doy),
  k AS (SELECT species, doy, sum(obs) / count(*) AS clim FROM v JOIN g ON least((d - doy + 730) % 365, (doy - d + 730) % 365) <= 15 GROUP BY 1, 2 HAVING count(*) >= 60)
  SELECT v.species, CAST(v.d AS INTEGER) AS doy, count(*) AS n, round(avg(obs - clim), 8) AS anom FROM v LEFT JOIN k ON v.species = k.species AND v.d = k.doy GROUP BY 1, 2""")
def station_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    x = summaries.station_anomaly(ofa_table(spark, d), ["species"], "obs", 60)
    return r(x.groupBy("species", "doy").agg(F.count(F.lit(1)).alias("n"), F.avg("anom").alias("anom")), "anom", places=8)


@query(f"""WITH {OFA_SQL}, p AS (SELECT species, assim AS pol, {NDOY_SQL.replace('>= 60', '>= 61')} AS d, obs, fcst FROM ofa WHERE NOT (month(ts) = 2 AND day(ts) = 29)), g AS (SELECT k AS pentad, 5 * k - 2 AS doy FROM (SELECT unnest(generate_series(1, 73)) AS k)),
  j AS (SELECT *, least((d - doy + 730) % 365, (doy - d + 730) % 365) AS far FROM p JOIN g ON least((d - doy + 730) % 365, (doy - d + 730) % 365) <= 47)
  SELECT species, pol, CAST(pentad AS INTEGER) AS pentad, count(*) AS n, count(*) FILTER (far <= 15) AS n_inner, round(avg(obs), 8) AS o_mean, round(stddev_pop(obs), 6) AS o_std, round(avg(fcst), 8) AS m_mean, round(stddev_pop(fcst), 6) AS m_std
  FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND count(*) FILTER (far <= 15) > 8""")
def scaling_inner(spark: SparkSession, d: str) -> DataFrame:
    """A21, W4."""
    return r(r(summaries.scaling_inner(ofa_table(spark, d).withColumnRenamed("assim", "pol"), ["species", "pol"]), "o_mean", "m_mean", places=8), "o_std", "m_std", places=6)


@query(f"""WITH {OFA_SQL}, s AS (SELECT tile, tile % 5 AS network, avg(obs - fcst) AS m, min(obs - fcst) AS lo, max(obs - fcst) AS up FROM ofa GROUP BY 1)
  SELECT network, count(m) AS n_sites, round(avg(m), 8) AS mean, round(stddev_samp(m), 6) AS std, round(avg(lo) / sqrt(count(m)), 8) AS ci_lo, round(avg(up) / sqrt(count(m)), 8) AS ci_up FROM s GROUP BY 1""")
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    o = c("obs") - c("fcst")
    s = ofa_table(spark, d).groupBy("tile", (c("tile") % 5).alias("network")).agg(F.avg(o).alias("m"), F.min(o).alias("lo"), F.max(o).alias("up"))
    return r(r(summaries.network_summary(s, ["network"], "m", "lo", "up"), "mean", "ci_lo", "ci_up", places=8), "std", places=6)


@query(f"WITH {STATE_SQL}, y AS (SELECT tile, year(ts) AS y, avg(v) AS v FROM st GROUP BY 1, 2) SELECT tile, count(v) AS n_years, round(avg(v), 8) AS mean, round(stddev_samp(v), 6) AS std FROM y GROUP BY tile")
def annual_summary(spark: SparkSession, d: str) -> DataFrame:
    """A36."""
    return r(r(summaries.annual_summary(states(spark, d), ["tile"], "v"), "mean", places=8), "std", places=6)


@query(f"WITH {STATE_SQL} SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(v) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS se FROM st GROUP BY 1")
def standard_error(spark: SparkSession, d: str) -> DataFrame:
    """A39."""
    return r(r(summaries.standard_error(states(spark, d).withColumn("month", F.trunc("ts", "month")), ["month"], "v"), "mean", places=8), "se", places=6)


@query(f"WITH {OFA_SQL}, k AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, nullif(obs, 50) AS v, price AS area FROM ofa) SELECT month, round(sum(v * area) / nullif(sum(CASE WHEN v IS NOT NULL THEN area END), 0), 8) AS v FROM k GROUP BY 1")
def area_series(spark: SparkSession, d: str) -> DataFrame:
    """A41."""
    x = ofa_table(spark, d).select(F.trunc("ts", "month").alias("month"), F.nullif(c("obs"), F.lit(50.0)).alias("v"), c("price").alias("area"))
    return r(summaries.area_series(x, ["month"], "v", "area"), "v", places=8)


INCR_SQL = f"{OFA_SQL}, w AS (SELECT *, obsvar + fcstvar - (obs - ana) / 40 AS w FROM ofa)"


def _increments(spark: SparkSession, d: str) -> DataFrame:
    return ofa_table(spark, d).withColumn("w", summaries.increment_total(c("obsvar"), c("fcstvar"), (c("obs") - c("ana")) / 40))


@query(f"WITH {INCR_SQL} SELECT tile, count(*) AS n, round(avg(w), 8) AS mean, round(stddev_pop(w), 6) AS std FROM w WHERE abs(w) > 0.0101 GROUP BY tile")
def increment_stats(spark: SparkSession, d: str) -> DataFrame:
    """A43, F15."""
    return r(r(summaries.increment_stats(_increments(spark, d), ["tile"], "w", 0.0101), "mean", places=8), "std", places=6)


@query(f"WITH {INCR_SQL}, k AS (SELECT *, CASE WHEN abs(w) > 0.1001 THEN w END AS big FROM w) SELECT species, CAST(date_trunc('month', ts) AS DATE) AS month, round(sum(w), 6) AS total, count(big) AS n_material, round(avg(big), 8) AS mean_material FROM k GROUP BY 1, 2")
def monthly_increments(spark: SparkSession, d: str) -> DataFrame:
    """A44."""
    return r(r(summaries.monthly_increments(_increments(spark, d), ["species"], "w", 0.1001), "total", places=6), "mean_material", places=8)


@query(f"WITH {OFA_SQL} SELECT tile, round(avg(obs), 8) AS mean_obs, round(avg(fcst), 8) AS mean_fcst, round(avg(ana), 8) AS mean_ana, round(stddev_pop(obs), 6) AS std_obs, round(stddev_pop(fcst), 6) AS std_fcst, round(stddev_pop(ana), 6) AS std_ana FROM ofa GROUP BY tile")
def state_summary(spark: SparkSession, d: str) -> DataFrame:
    """A45."""
    x = summaries.state_summary(ofa_table(spark, d), ["tile"], ["obs", "fcst", "ana"])
    return r(r(x, "mean_obs", "mean_fcst", "mean_ana", places=8), "std_obs", "std_fcst", "std_ana", places=6)


@query("SELECT user_id AS site, event_type AS depth, count(DISTINCT CAST(ts AS DATE)) AS n_days, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A51."""
    return summaries.coverage(_t(spark, d, "events").withColumnsRenamed({"user_id": "site", "event_type": "depth"}), ["site", "depth"], "value")


@query(f"WITH {OFA_SQL}, k AS (SELECT species, tile, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM ofa GROUP BY 1, 2, 3) SELECT species, count(*) AS n_cells, round(avg(CAST(n < 2 AS INTEGER)), 8) AS below_2, round(avg(CAST(n < 6 AS INTEGER)), 8) AS below_6, round(avg(CAST(n < 11 AS INTEGER)), 8) AS below_11 FROM k GROUP BY 1")
def count_shares(spark: SparkSession, d: str) -> DataFrame:
    """A52."""
    k = ofa_table(spark, d).groupBy("species", "tile", F.trunc("ts", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return r(summaries.count_shares(k, ["species"], "n", (2, 6, 11)), "below_2", "below_6", "below_11", places=8)


@query(f"WITH {OFA_SQL}, k AS (SELECT species, CAST(ts AS DATE) AS day, count(*) FILTER (fcstvar > 0.07) / count(obs) AS loss FROM ofa GROUP BY 1, 2) SELECT species, count(loss) AS n_slices, round(avg(loss), 8) AS loss FROM k GROUP BY 1")
def qc_loss(spark: SparkSession, d: str) -> DataFrame:
    """A53."""
    return r(summaries.qc_loss(ofa_table(spark, d).withColumn("day", F.to_date("ts")), ["species"], ["day"], "obs", c("fcstvar") > 0.07), "loss", places=8)


@query(f"""WITH {RUNS_SQL}, a AS (SELECT tile, month(ts) AS m, avg(v) AS v FROM ol GROUP BY 1, 2), b AS (SELECT tile, month(ts) AS m, avg(v) AS v FROM da GROUP BY 1, 2)
  SELECT a.tile, CAST(a.m AS INTEGER) AS month, round(b.v - a.v, 8) AS diff, round(CASE WHEN a.v <> 0 THEN 100 * (b.v - a.v) / a.v END, 8) AS percent FROM a JOIN b ON a.tile = b.tile AND a.m = b.m""")
def run_difference(spark: SparkSession, d: str) -> DataFrame:
    """A59."""
    a, b = [x.groupBy("tile", F.month("ts").alias("month")).agg(F.avg("v").alias("v")) for x in _runs(spark, d)]
    return r(summaries.difference(a, b, ["tile", "month"], "v"), "diff", "percent", places=8)


@query(f"""WITH {STATE_SQL}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM st), k AS (SELECT exp, CAST(least(40, floor((v - lo) / ((hi - lo) / 40)) + 1) AS INTEGER) AS bin, count(*) AS n FROM st, e GROUP BY 1, 2)
  SELECT exp, bin, n, round(sum(n) OVER (PARTITION BY exp ORDER BY bin) / sum(n) OVER (PARTITION BY exp), 8) AS cumulative FROM k""")
def distributions(spark: SparkSession, d: str) -> DataFrame:
    """A60."""
    return r(summaries.distributions(states(spark, d), "exp", "v", 40), "cumulative", places=8)


@query(f"WITH {OFA_SQL}, m AS (SELECT tile, CAST(date_trunc('month', ts) AS DATE) AS month, avg(obs) AS mean FROM ofa GROUP BY 1, 2) SELECT tile, month, round(mean, 8) AS mean, round(mean - avg(mean) OVER (PARTITION BY tile), 8) AS anom FROM m")
def monthly_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """A63, W10."""
    return r(summaries.monthly_anomaly(ofa_table(spark, d), ["tile"], "obs"), "mean", "anom", places=8)


@query(f"WITH {OFA_SQL}, k AS (SELECT species, CAST(ts AS DATE) AS day, CASE WHEN obs - 10 >= 0 THEN obs - 10 END AS v FROM ofa) SELECT species, day, round(avg(v), 8) AS v, count(v) AS n FROM k GROUP BY 1, 2")
def day_mean(spark: SparkSession, d: str) -> DataFrame:
    """A64."""
    return r(summaries.day_mean(ofa_table(spark, d).withColumn("v", c("obs") - 10), ["species"], "v"), "v", places=8)


@query(f"""WITH {OFA_SQL}, a AS (SELECT tile, avg(obs) AS v FROM ofa WHERE species = 6 AND year(ts) = 1994 GROUP BY 1), b AS (SELECT tile, avg(obs) AS v FROM ofa WHERE species = 7 AND year(ts) = 1995 GROUP BY 1), t AS (SELECT s_suppkey AS tile, s_suppkey % 12 AS i, s_nationkey AS j FROM supplier),
  p AS (SELECT coalesce(a.tile, b.tile) AS tile, a.v AS a, b.v AS b FROM a FULL JOIN b ON a.tile = b.tile) SELECT i, j, tile, round(CASE WHEN b IS NOT NULL THEN a END, 8) AS a, round(CASE WHEN a IS NOT NULL THEN b END, 8) AS b FROM p JOIN t USING (tile)""")
def place(spark: SparkSession, d: str) -> DataFrame:
    """A65, J3."""
    x = ofa_table(spark, d)
    a, b = [x.where((c("species") == s) & (F.year("ts") == y)).groupBy("tile").agg(F.avg("obs").alias("v")) for s, y in ((6, 1994), (7, 1995))]
    tiles = _t(spark, d, "supplier").select(c("s_suppkey").alias("tile"), (c("s_suppkey") % 12).alias("i"), c("s_nationkey").alias("j"))
    return r(summaries.place(a, b, tiles, "tile", "v"), "a", "b", places=8)


@query(f"WITH {OFA_SQL}, k AS (SELECT species, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM ofa GROUP BY 1, 2) SELECT species, month, n, sum(n) OVER (PARTITION BY species ORDER BY month) / 1e6 AS millions FROM k")
def cumulative_counts(spark: SparkSession, d: str) -> DataFrame:
    """A66."""
    k = ofa_table(spark, d).groupBy("species", F.trunc("ts", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return summaries.cumulative_millions(k, ["species"], ["month"], "n")


PROFILE = {"omf": "obs - fcst", "oma": "obs - ana", "amf": "ana - fcst"}


@query(f"WITH {OFA_SQL} SELECT CAST(floor(obs / 5) AS BIGINT) AS i, species AS j, count(*) AS n, round(avg(obs), 8) AS mean_o, round(avg(fcst), 8) AS mean_f, " + ", ".join(f"round(avg({e}), 8) AS mean_{k}, round(max(abs({e})), 8) AS max_{k}, round(stddev_pop({e}), 6) AS std_{k}" for k, e in PROFILE.items()) + " FROM ofa GROUP BY 1, 2")
def innovation_profile(spark: SparkSession, d: str) -> DataFrame:
    """A67."""
    x = ofa_table(spark, d).withColumns({"i": F.floor(c("obs") / 5), "j": c("species")})
    return r(r(summaries.innovation_profile(x, ["i", "j"]), "mean_o", "mean_f", *[f"{p}_{k}" for k in PROFILE for p in ("mean", "max")], places=8), *[f"std_{k}" for k in PROFILE], places=6)


SMOOTH_SQL = "{0} OVER (PARTITION BY tile ORDER BY ts, id ROWS BETWEEN {1} PRECEDING AND {1} FOLLOWING)"


@query(f"WITH {STATE_SQL}, g AS (SELECT id, tile, ts, CASE WHEN id % 5 > 0 THEN v END AS v FROM st) SELECT id, tile, round(coalesce(v, {SMOOTH_SQL.format('avg(v)', 10)}), 9) AS v, round({SMOOTH_SQL.format('avg(v)', 1)}, 9) AS smooth, round(v - lag(v) OVER (PARTITION BY tile ORDER BY ts, id), 9) AS step FROM g")
def smoothing(spark: SparkSession, d: str) -> DataFrame:
    """W5, W6, W8."""
    x = states(spark, d).select("id", "tile", "ts", F.when(c("id") % 5 > 0, c("v")).alias("v"))
    order = ["ts", "id"]
    s = summaries.step_difference(summaries.smooth(x, ["tile"], order, "v"), ["tile"], order, "v")
    return r(summaries.fill_gaps(s, ["tile"], order, "v").select("id", "tile", "v", "smooth", "step"), "v", "smooth", "step", places=9)


@query(f"WITH {STATE_SQL}, k AS (SELECT tile, exp, id, row_number() OVER (PARTITION BY tile, exp ORDER BY ts, id) AS n FROM st) SELECT tile, exp, id FROM k WHERE n = 2")
def second_of_group(spark: SparkSession, d: str) -> DataFrame:
    """T4, T5."""
    return summaries.nth_of_group(states(spark, d), ["tile", "exp"], ["ts", "id"], 1).select("tile", "exp", "id")


@query(f"WITH {STATE_SQL}, k AS (SELECT tile, max(v) AS value FROM st GROUP BY 1) SELECT tile, value FROM k WHERE value IS NOT NULL ORDER BY value DESC, tile LIMIT 10")
def top_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return summaries.top(states(spark, d).groupBy("tile").agg(F.max("v").alias("value")), "value", "tile")


@query(f"""WITH {RUNS_SQL}, k AS (SELECT DISTINCT tile, CAST(ts AS DATE) AS day FROM ol INTERSECT SELECT tile, CAST(ts AS DATE) FROM da) SELECT tile, day FROM k
  WHERE tile NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def common_times(spark: SparkSession, d: str) -> DataFrame:
    """U1, U2, U5."""
    k = summaries.common_keys([x.withColumn("day", F.to_date("ts")) for x in _runs(spark, d)], ["tile", "day"])
    lists = [_t(spark, d, "supplier").where("s_acctbal < 0").select(c("s_suppkey").alias("tile")), _t(spark, d, "nation").where("n_regionkey = 1").select(c("n_nationkey").cast("long").alias("tile"))]
    return summaries.without(k, lists, ["tile"])
