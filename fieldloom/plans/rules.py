"""Queries on joins by place, rules, trends of sums, regridding and station data, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compare, series, spatial, summaries
from .registry import OFA_SQL, STATE_SQL, _t, ofa_table, query, r, states

c = F.col


@query(f"""WITH {STATE_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY exp, tile, date_trunc('month', ts) ORDER BY ts, id) AS n FROM st)
  SELECT exp, tile, id, CAST(last_day(ts) AS DATE) AS month FROM k WHERE n = 1""")
def month_alignment(spark: SparkSession, d: str) -> DataFrame:
    """J2."""
    return compare.first_of_month(states(spark, d), ["exp", "tile"], ["id"]).select("exp", "tile", "id", "month")


PLACE_SQL = f"{OFA_SQL}, pl AS (SELECT *, tile * 0.25 + (id % 3) * 1e-8 AS lon, species * 0.5 - (id % 2) * 1e-8 AS lat, id * 10 + species AS ord FROM ofa), ol AS (SELECT * FROM pl WHERE NOT assim), da AS (SELECT * FROM pl WHERE assim)"


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = ofa_table(spark, d).withColumns({"lon": c("tile") * 0.25 + (c("id") % 3) * 1e-8, "lat": c("species") * 0.5 - (c("id") % 2) * 1e-8, "ord": c("id") * 10 + c("species")})
    return x.where("not assim"), x.where("assim")


@query(f"""WITH {PLACE_SQL}, k AS (SELECT ts, species, round(lon, 6) AS x, round(lat, 6) AS y, max_by(obs, ord) AS o FROM da GROUP BY 1, 2, 3, 4)
  SELECT ol.species, count(*) AS n, round(avg(o - fcst), 8) AS omf_mean FROM ol JOIN k ON ol.ts = k.ts AND ol.species = k.species AND round(ol.lon, 6) = x AND round(ol.lat, 6) = y GROUP BY 1""")
def crossmask_place(spark: SparkSession, d: str) -> DataFrame:
    """By cycle, species and the place to 6 digits."""
    ol, da = map(compare.at_place, _places(spark, d))
    both = compare.crossmask(ol, da, ["ts", "species", "rlon", "rlat"], ["ord"])
    return r(both.groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.avg(c("obs_da") - c("fcst")).alias("omf_mean")), "omf_mean", places=8)


@query(f"""WITH {PLACE_SQL}, k AS (SELECT ts, tile, species, max_by(obs, ord) AS o FROM da GROUP BY 1, 2, 3)
  SELECT ol.tile, count(*) AS n, count(o) AS n_both, round(avg(o - fcst), 8) AS omf_mean FROM ol LEFT JOIN k ON ol.ts = k.ts AND ol.tile = k.tile AND ol.species = k.species GROUP BY 1""")
def crossmask_left(spark: SparkSession, d: str) -> DataFrame:
    """By cycle, tile and species; rows without a partner stay, with a null."""
    both = compare.crossmask(*_places(spark, d), ["ts", "tile", "species"], ["ord"], "left")
    return r(both.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count("obs_da").alias("n_both"), F.avg(c("obs_da") - c("fcst")).alias("omf_mean")), "omf_mean", places=8)


@query(f"""WITH {PLACE_SQL}, k AS (SELECT ts, species, tile, lon, lat, max_by(obs, ord) AS o FROM da GROUP BY ALL)
  SELECT ol.id, ol.species, ol.tile, o AS obs_da FROM ol JOIN k ON ol.ts = k.ts AND ol.species = k.species AND ol.tile = k.tile AND ol.lon = k.lon AND ol.lat = k.lat""")
def crossmask_all(spark: SparkSession, d: str) -> DataFrame:
    """By all five keys."""
    return compare.crossmask(*_places(spark, d), ["ts", "species", "tile", "lon", "lat"], ["ord"]).select("id", "species", "tile", "obs_da")


@query(f"""WITH {OFA_SQL}, w AS (SELECT CAST(ts AS DATE) AS day, (obsvar - fcstvar) / 2 + (fcst - ana) / 100 + (id % 5 - 2) / 40.0 AS w FROM ofa)
  SELECT day, count(*) AS n, round(avg(w), 8) AS mean, round(stddev_pop(w), 6) AS std FROM w WHERE abs(w) > 0.0101 GROUP BY 1""")
def increment_snow(spark: SparkSession, d: str) -> DataFrame:
    """A43 per time, of three snow layers."""
    total = summaries.snow_total((c("obsvar") - c("fcstvar")) / 2, (c("fcst") - c("ana")) / 100, (c("id") % 5 - 2) / 40.0)
    x = ofa_table(spark, d).select(F.to_date("ts").alias("day"), total.alias("w"))
    return r(r(summaries.increment_stats(x, ["day"], "w", 0.0101), "mean", places=8), "std", places=6)


DAYS_SQL = "date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) / 3652.5"


def _decades() -> Column:
    return F.datediff("ts", F.lit("1990-01-01").cast("date")) / 3652.5


@query(f"""WITH {STATE_SQL}, g AS (SELECT tile, ts, id, CASE WHEN id % 7 > 0 THEN v - 150 END AS v FROM st), a AS (SELECT *, coalesce(v, 0) AS z FROM g), q AS (SELECT tile, ts, z, sum(z) OVER (PARTITION BY tile ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS t FROM a),
  s AS (SELECT tile, ts, v, sum(v) OVER (PARTITION BY tile ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS t FROM g WHERE v IS NOT NULL)
  SELECT tile, 'zero' AS nulls, round(regr_slope(t, {DAYS_SQL}), 3) AS slope, round(avg(z), 6) AS mean, count(z) AS n FROM q GROUP BY 1
  UNION ALL SELECT tile, 'skip', round(regr_slope(t, {DAYS_SQL}), 3), round(avg(v), 6), count(v) FROM s GROUP BY 1""")
def cumulative_trend(spark: SparkSession, d: str) -> DataFrame:
    """The trend of running sums, by both rules for nulls."""
    x = states(spark, d).withColumn("v", F.when(c("id") % 7 > 0, c("v") - 150))
    one = lambda skip: series.cumulative_trend(x, ["tile"], ["ts", "id"], _decades(), "v", skip).withColumn("nulls", F.lit("skip" if skip else "zero"))
    return r(r(one(False).unionByName(one(True)), "slope", places=3), "mean", places=6)


@query(f"""WITH {STATE_SQL}, m AS (SELECT tile, CAST(date_trunc('month', ts) AS DATE) AS ts, avg(v) AS v FROM st GROUP BY 1, 2), k AS (SELECT tile, month(ts) AS mo, avg(v) AS clim FROM m WHERE year(ts) BETWEEN 1993 AND 1997 GROUP BY 1, 2),
  a AS (SELECT m.tile, regr_slope(v - clim, {DAYS_SQL}) AS s FROM m JOIN k ON m.tile = k.tile AND month(ts) = mo GROUP BY 1),
  y AS (SELECT tile, regr_slope(v, year(ts) + (month(ts) - 0.5) / 12) AS s FROM m GROUP BY 1), i AS (SELECT tile, regr_slope(v, k) AS s FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY ts) AS k FROM m) GROUP BY 1)
  SELECT y.tile, round(a.s, 4) AS decade, round(y.s, 5) AS yearly, round(i.s, 6) AS by_index FROM y JOIN a ON a.tile = y.tile JOIN i ON i.tile = y.tile""")
def trend_forms(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies by decade, monthly means by year, and by index."""
    m = states(spark, d).groupBy("tile", F.trunc("ts", "month").alias("ts")).agg(F.avg("v").alias("v"))
    anom = series.deseasonalise(m, series.monthly_climatology(m, ["tile"], "v", 1993, 1997), ["tile"], "v")
    decade = series.ols_trend(anom, ["tile"], _decades(), "anom").select("tile", c("slope").alias("decade"))
    yearly = series.ols_trend(m, ["tile"], F.year("ts") + (F.month("ts") - 0.5) / 12, "v").select("tile", c("slope").alias("yearly"))
    index = series.index_trend(m, ["tile"], ["ts"], "v").select("tile", c("slope").alias("by_index"))
    return r(r(r(decade.join(yearly, "tile").join(index, "tile"), "decade"), "yearly", places=5), "by_index", places=6)


@query(f"""WITH {OFA_SQL}, x AS (SELECT tile, year(ts) AS yr, obs / 2 AS t, fcstvar * 50 AS u, obsvar * 200 AS rn, 0.6 AS va, 95.0 + species AS kpa FROM ofa), y AS (SELECT *, 0.6108 * exp(17.27 * t / (t + 237.3)) AS es FROM x), z AS (SELECT *, 4098 * es / (t + 237.3) ** 2 AS s, 0.000665 * kpa AS g FROM y)
  SELECT tile, CAST(yr AS INTEGER) AS yr, round(sum(greatest(0.0, (0.408 * s * rn + g * (900 / (t + 273)) * u * (es - va)) / (s + g * (1 + 0.34 * u)))), 6) AS pet FROM z GROUP BY 1, 2""")
def reference_pet(spark: SparkSession, d: str) -> DataFrame:
    """Reference evapotranspiration summed by year."""
    x = ofa_table(spark, d).withColumn("e", compare.evapotranspiration(c("obs") / 2, c("fcstvar") * 50, c("obsvar") * 200, F.lit(0.6), F.lit(95.0) + c("species")))
    return r(x.groupBy("tile", F.year("ts").alias("yr")).agg(F.sum("e").alias("pet")), "pet", places=6)


@query(f"""WITH {OFA_SQL}, v AS (SELECT tile, species, avg(CASE WHEN id % 11 > 0 THEN obs END) AS v FROM ofa GROUP BY 1, 2), w AS (SELECT s_suppkey AS tile, s_suppkey % 16 AS cell, s_suppkey % 7 + 1.0 AS w FROM supplier)
  SELECT cell, species, round(sum(w * v) / sum(w) FILTER (v IS NOT NULL), 6) AS v FROM v JOIN w USING (tile) GROUP BY 1, 2""")
def regrid_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A47 by a table of weights."""
    v = ofa_table(spark, d).groupBy("tile", "species").agg(F.avg(F.when(c("id") % 11 > 0, c("obs"))).alias("v"))
    w = _t(spark, d, "supplier").select(c("s_suppkey").alias("tile"), (c("s_suppkey") % 16).alias("cell"), (c("s_suppkey") % 7 + F.lit(1.0)).alias("w"))
    return r(spatial.regrid(v, w, "tile", "cell", "v", ["species"]), "v", places=6)


BOX_SQL = """src AS (SELECT s_suppkey AS src, s_acctbal AS v, s_suppkey % 20 * 1.0 AS x0, s_suppkey % 20 + 1.0 AS x1, floor(s_suppkey / 20) % 20 * 1.0 AS y0, floor(s_suppkey / 20) % 20 + 1.0 AS y1 FROM supplier),
  dst AS (SELECT n_nationkey AS dst, n_nationkey % 5 * 3.3 AS x0, n_nationkey % 5 * 3.3 + 3.3 AS x1, n_nationkey // 5 * 2.7 AS y0, n_nationkey // 5 * 2.7 + 2.7 AS y1 FROM nation)"""


@query(f"""WITH {BOX_SQL}, w AS (SELECT src, v, dst, greatest(0, least(src.x1, dst.x1) - greatest(src.x0, dst.x0)) * greatest(0, least(src.y1, dst.y1) - greatest(src.y0, dst.y0)) AS w FROM src, dst)
  SELECT dst, round(sum(w * v) / sum(w), 5) AS v FROM w WHERE w > 0 GROUP BY 1""")
def conservative_regrid(spark: SparkSession, d: str) -> DataFrame:
    """Areas that boxes share as weights."""
    k, n = c("s_suppkey"), c("n_nationkey")
    x, y = (k % 20) * 1.0, (F.floor(k / 20) % 20) * 1.0
    src = _t(spark, d, "supplier").select(k.alias("src"), c("s_acctbal").alias("v"), x.alias("x0"), (x + 1).alias("x1"), y.alias("y0"), (y + 1).alias("y1"))
    x, y = (n % 5) * 3.3, F.floor(n / 5) * 2.7
    dst = _t(spark, d, "nation").select(n.alias("dst"), x.alias("x0"), (x + 3.3).alias("x1"), y.alias("y0"), (y + 2.7).alias("y1"))
    return r(spatial.regrid(src.select("src", "v"), spatial.overlap_weights(src, dst, "src", "dst", 3.0), "src", "dst", "v", []), "v", places=5)


@query("""WITH o AS (SELECT s_acctbal AS v, s_suppkey % 20 * 0.5 + 0.13 AS x, floor(s_suppkey / 20) % 20 * 0.5 + 0.07 AS y FROM supplier), k AS (SELECT n_nationkey AS cell, n_nationkey % 5 * 2.0 AS cx, n_nationkey // 5 * 2.0 AS cy FROM nation),
  p AS (SELECT cell, v, 1 / ((x - cx) ** 2 + (y - cy) ** 2 + 1e-9) AS w FROM o, k WHERE (x - cx) ** 2 + (y - cy) ** 2 <= 1.44)
  SELECT cell, round(sum(w * v) / sum(w), 5) AS v FROM p GROUP BY 1""")
def scattered(spark: SparkSession, d: str) -> DataFrame:
    """J24 as re-aimed: weights by inverse squared distance."""
    k, n = c("s_suppkey"), c("n_nationkey")
    obs = _t(spark, d, "supplier").select(c("s_acctbal").alias("v"), ((k % 20) * 0.5 + 0.13).alias("x"), ((F.floor(k / 20) % 20) * 0.5 + 0.07).alias("y"))
    cells = _t(spark, d, "nation").select(n.alias("cell"), ((n % 5) * 2.0).alias("cx"), (F.floor(n / 5) * 2.0).alias("cy"))
    return r(spatial.inverse_distance(obs, cells, 1.2, ("x", "y"), ("cx", "cy"), "cell", "v"), "v", places=5)


@query("""WITH h AS (SELECT user_id % 20 AS site, CAST(ts AS DATE) AS day, value AS sm1, CASE WHEN event_id % 13 > 0 THEN value / 2 END AS sm2, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS prcp FROM events),
  g AS (SELECT site, day, avg(sm1) AS a, avg(sm2) AS b, sum(prcp) AS p FROM h GROUP BY 1, 2) SELECT site, day, round((a * 3 + b * 8) / 11, 6) AS rz, round(p, 6) AS prcp FROM g""")
def station_daily(spark: SparkSession, d: str) -> DataFrame:
    """Hours to days, then the root zone."""
    h = _t(spark, d, "events").select((c("user_id") % 20).alias("site"), "ts", c("value").alias("sm1"), F.when(c("event_id") % 13 > 0, c("value") / 2).alias("sm2"), F.when(c("event_type") != "error", c("value")).alias("prcp"))
    g = compare.station_daily(h, ["site"], ["sm1", "sm2"], ["prcp"])
    return r(g.select("site", "day", compare.root_zone(["sm1", "sm2"], [3.0, 8.0]).alias("rz"), "prcp"), "rz", "prcp", places=6)


@query("""SELECT p_partkey AS id, greatest(0.0, least(7.0, p_size * 2.0) - greatest(0.0, 3.0)) AS w1, greatest(0.0, least(28.0, p_size * 2.0) - greatest(7.0, 3.0)) AS w2, greatest(0.0, least(100.0, p_size * 2.0) - greatest(28.0, 3.0)) AS w3 FROM part""")
def layer_overlap(spark: SparkSession, d: str) -> DataFrame:
    """What layers of 0-7, 7-28 and 28-100 cm have of the depth from 3 cm down."""
    w = compare.depth_weights(F.lit(3.0), c("p_size") * F.lit(2.0), [(0.0, 7.0), (7.0, 28.0), (28.0, 100.0)])
    return _t(spark, d, "part").select(c("p_partkey").alias("id"), *[v.alias(f"w{k + 1}") for k, v in enumerate(w)])


@query("""WITH x AS (SELECT p_size % 7 AS t, CASE WHEN p_partkey % 17 > 0 THEN p_size * 1.5 END AS a, CAST(p_partkey % 30 AS DOUBLE) AS b, p_retailprice AS v FROM part),
  k AS (SELECT CASE WHEN a + b IS NULL THEN 'sparse' WHEN a + b < 10 THEN 'bare' WHEN a + b <= 20 THEN 'sparse' WHEN a > 49 THEN 'type' || t ELSE 'mixed' END AS class, v FROM x) SELECT class, count(*) AS n, round(avg(v), 6) AS mean FROM k GROUP BY 1""")
def vegetation(spark: SparkSession, d: str) -> DataFrame:
    """The rule, and the distribution by class."""
    kind = compare.vegetation_class(c("p_size") % 7, F.when(c("p_partkey") % 17 > 0, c("p_size") * 1.5), (c("p_partkey") % 30).cast("double"))
    return r(_t(spark, d, "part").withColumn("class", kind).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean")), "mean", places=6)


@query(f"""WITH {OFA_SQL}, m AS (SELECT tile, CAST(date_trunc('month', ts) AS DATE) AS month, sum(obs) AS p, sum(fcst) / 2 AS e, sum(ana) / 4 AS r, avg(price) AS s FROM ofa GROUP BY 1, 2)
  SELECT tile, month, round(p - e - r, 6) AS net, round(s - lag(s) OVER w, 6) AS change, round(sum(p - e - r) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM m WINDOW w AS (PARTITION BY tile ORDER BY month)""")
def water_balance(spark: SparkSession, d: str) -> DataFrame:
    """A42."""
    m = ofa_table(spark, d).groupBy("tile", F.trunc("ts", "month").alias("month")).agg(F.sum("obs").alias("p"), (F.sum("fcst") / 2).alias("e"), (F.sum("ana") / 4).alias("r"), F.avg("price").alias("s"))
    return r(compare.water_balance(m, ["tile"]).select("tile", "month", "net", "change", "cumulative"), "net", "change", "cumulative", places=6)


@query(f"""WITH {STATE_SQL}, k AS (SELECT tile AS site, count(*) FILTER (exp = 'F') AS a, count(*) FILTER (exp = 'O') AS b, count(*) FILTER (exp = 'P') AS p FROM st GROUP BY 1), t AS (SELECT *, ((a - (a + b + p) / 3) ** 2 + (b - (a + b + p) / 3) ** 2 + (p - (a + b + p) / 3) ** 2) / 3 AS v FROM k ORDER BY a + b + p DESC, site LIMIT 30)
  SELECT site, a, b, p FROM t ORDER BY round(sqrt(v), 9), site LIMIT 15""")
def balanced_sites(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    k = states(spark, d).groupBy(c("tile").alias("site")).agg(*[F.count_if(c("exp") == e).alias(n) for e, n in (("F", "a"), ("O", "b"), ("P", "p"))])
    return compare.balanced_sites(k, "site", ["a", "b", "p"]).select("site", "a", "b", "p")


@query(f"""WITH {OFA_SQL}, x AS (SELECT species, CASE WHEN obs * 2.5 <= 100 AND id % 3 < 1 THEN obs * 2.5 END AS a,
  CASE WHEN obs BETWEEN 5 AND 45 AND NOT greatest(CASE WHEN id % 256 = 255 THEN 0 ELSE id % 256 END, CASE WHEN species = 7 THEN 1 ELSE 0 END) = 1 THEN obs END AS g, CASE WHEN fcst + 250 >= 277.16 AND obs / 100 >= 1e-4 THEN obs / 100 END AS s FROM ofa)
  SELECT species, count(a) AS n_ascat, count(g) AS n_cygnss, count(s) AS n_station, round(avg(a), 8) AS ascat, round(avg(g), 8) AS cygnss, round(avg(s), 8) AS station FROM x GROUP BY 1""")
def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """F8, F10, F11."""
    x = ofa_table(spark, d).select(
        "species", compare.ascat_good(c("obs") * 2.5, c("id") % 3).alias("ascat"), compare.cygnss_good(c("obs"), c("fcst"), F.lit(5.0), F.lit(45.0), [c("id") % 256, F.when(c("species") == 7, 1).otherwise(0)]).alias("cygnss"),
        compare.station_good(c("obs") / 100, c("fcst") + 250).alias("station"))
    names = ("ascat", "cygnss", "station")
    return r(x.groupBy("species").agg(*[F.count(n).alias(f"n_{n}") for n in names], *[F.avg(n).alias(n) for n in names]), *names, places=8)


@query(f"""WITH {OFA_SQL} SELECT t AS threshold, species, round(max(CAST(tile % 101 AS DOUBLE) / (id % 101)), 8) AS most, count(*) AS n, count(*) FILTER (CAST(tile % 101 AS DOUBLE) / (id % 101) > 0.9) AS n_snowy
  FROM ofa, (SELECT CAST(unnest(generate_series(0, 95, 5)) AS INTEGER) AS t) WHERE id % 101 > t GROUP BY 1, 2""")
def clear_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A68 for snow."""
    x = ofa_table(spark, d).select("species", (c("tile") % 101).alias("cover"), (c("id") % 101).alias("clear"))
    return r(compare.clear_sweep(x, ["species"], "cover", "clear", list(range(0, 100, 5))), "most", places=8)


#: Three boxes that overlap in part: lon0, lon1, lat0, lat1.
REGIONS = {"west": (-180.0, 0.0, -60.0, 60.0), "north": (-90.0, 90.0, 30.0, 80.0), "point": (10.0, 10.0, 20.0, 20.0)}
REGIONS_SQL = "rg(region, w, e, s, n) AS (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in REGIONS.items()) + ")"
LL_SQL = "ll AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 361 - 180 AS DOUBLE) AS lon, CAST(c_custkey * 11 % 181 - 90 AS DOUBLE) AS lat, c_acctbal AS v FROM customer)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    return _t(spark, d, "customer").select(k.alias("id"), (k * 7 % 361 - 180).cast("double").alias("lon"), (k * 11 % 181 - 90).cast("double").alias("lat"), c("c_acctbal").alias("v"))


@query(f"WITH {LL_SQL}, {REGIONS_SQL} SELECT region, count(*) AS n, round(avg(v), 6) AS mean FROM ll JOIN rg ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY 1")
def region_clip(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    return r(spatial.clip(_points(spark, d), REGIONS, "lon", "lat").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), "mean", places=6)


E_ = 0.081819190843
Q_SQL = f"{1 - E_**2!r} * (sin(radians(lat)) / (1 - ({E_} * sin(radians(lat))) ** 2) - ln((1 - {E_} * sin(radians(lat))) / (1 + {E_} * sin(radians(lat)))) / {2 * E_!r})"


@query(f"""WITH {LL_SQL}, qs AS (SELECT id, lon + 0.3 AS lon, lat, CASE WHEN lat >= 0 THEN 1 ELSE -1 END AS side, {Q_SQL} AS q FROM ll WHERE abs(lat) > 5 AND abs(lat) < 90), xy AS (SELECT *, 6378137.0 * sqrt((SELECT {Q_SQL} FROM (SELECT 90.0 AS lat)) - side * q) AS rho FROM qs)
  SELECT id, CAST(floor(250 + side * rho * cos(radians(lon)) / 36000) AS INTEGER) AS "row", CAST(floor(250 + rho * sin(radians(lon)) / 36000) AS INTEGER) AS col FROM xy""")
def polar_grid(spark: SparkSession, d: str) -> DataFrame:
    """Rows and columns of the northern and southern grids."""
    p = _points(spark, d).where("abs(lat) > 5 and abs(lat) < 90").withColumn("lon", c("lon") + 0.3)
    (n_row, n_col), (s_row, s_col) = scalar.ease_index(c("lat"), c("lon"), "N36"), scalar.ease_index(c("lat"), c("lon"), "S36")
    north = c("lat") >= 0
    return p.select("id", F.when(north, n_row).otherwise(s_row).alias("row"), F.when(north, n_col).otherwise(s_col).alias("col"))


@query("""WITH x AS (SELECT corr(p_retailprice, p_size) AS r1, corr(p_retailprice, p_partkey % 100) AS r2, corr(p_size, p_partkey % 100) AS r12 FROM part), b AS (SELECT 'size' AS predictor, (r1 - r12 * r2) / (1 - r12 ** 2) AS beta, r1 AS r FROM x UNION ALL SELECT 'part', (r2 - r12 * r1) / (1 - r12 ** 2), r2 FROM x)
  SELECT CAST(row_number() OVER (ORDER BY abs(beta) DESC) AS INTEGER) AS place, predictor, round(beta, 8) AS beta, round(sum(beta * r) OVER (), 8) AS r2 FROM b""")
def standard_regression(spark: SparkSession, d: str) -> DataFrame:
    """A58."""
    x = _t(spark, d, "part").select(c("p_retailprice").alias("y"), c("p_size").alias("size"), (c("p_partkey") % 100).alias("part"))
    return r(compare.standard_regression(x, "y", ["size", "part"]), "beta", "r2", places=8)


@query(f"""WITH {STATE_SQL}, y AS (SELECT tile, CAST(year(ts) AS INTEGER) AS yr, avg(v) AS v FROM st WHERE exp = 'P' GROUP BY 1, 2) SELECT k.tile, CAST(a AS INTEGER) AS yr, round(v, 6) AS v FROM (SELECT DISTINCT tile FROM y) k CROSS JOIN (SELECT unnest(generate_series(1990, 2000)) AS a) LEFT JOIN y ON y.tile = k.tile AND y.yr = a""")
def year_axis(spark: SparkSession, d: str) -> DataFrame:
    """Every year for each tile."""
    y = states(spark, d).where("exp = 'P'").groupBy("tile", F.year("ts").alias("yr")).agg(F.avg("v").alias("v"))
    return r(compare.fill_axis(y, ["tile"], "yr", 1990, 2000), "v", places=6)


TILE_SQL = "tl AS (SELECT s_suppkey AS tile, s_nationkey AS nation, s_suppkey % 10 AS i, s_nationkey % 5 AS j, s_suppkey % 10 * 0.25 + 0.1 AS com_lon, s_nationkey % 5 * 0.25 + 0.1 AS com_lat FROM supplier)"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    i, j = c("s_suppkey") % 10, c("s_nationkey") % 5
    return _t(spark, d, "supplier").select(c("s_suppkey").alias("tile"), c("s_nationkey").alias("nation"), i.alias("i"), j.alias("j"), (i * 0.25 + 0.1).alias("com_lon"), (j * 0.25 + 0.1).alias("com_lat"))


@query(f"WITH {OFA_SQL}, {TILE_SQL} SELECT nation, count(*) AS n, round(avg(obs), 8) AS mean FROM ofa JOIN tl USING (tile) GROUP BY 1")
def tile_numbers(spark: SparkSession, d: str) -> DataFrame:
    """J3."""
    x = summaries.tile_lookup(ofa_table(spark, d), _tiles(spark, d), "tile")
    return r(x.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.avg("obs").alias("mean")), "mean", places=8)


@query(f"""WITH {TILE_SQL}, o AS (SELECT c_custkey AS id, c_custkey % 250 / 100.0 AS lon, c_nationkey % 5 * 0.25 + 0.03 AS lat FROM customer), p AS (SELECT *, CAST(floor(lon / 0.25) AS BIGINT) AS i, CAST(floor(lat / 0.25) AS BIGINT) AS j FROM o)
  SELECT id, tile FROM p JOIN tl USING (i, j) WHERE NOT (NOT (lon BETWEEN com_lon - 0.07 AND com_lon + 0.05 AND lat BETWEEN com_lat - 0.08 AND com_lat + 0.05) AND greatest(abs(lon - com_lon), abs(lat - com_lat)) > 0.096)""")
def cell_tiles(spark: SparkSession, d: str) -> DataFrame:
    """J18."""
    o = _t(spark, d, "customer").select(c("c_custkey").alias("id"), (c("c_custkey") % 250 / 100).alias("lon"), ((c("c_nationkey") % 5) * 0.25 + 0.03).alias("lat"))
    o = o.withColumns({"i": F.floor(c("lon") / 0.25), "j": F.floor(c("lat") / 0.25)})
    boxes = _tiles(spark, d).withColumns({"min_lon": c("com_lon") - 0.07, "max_lon": c("com_lon") + 0.05, "min_lat": c("com_lat") - 0.08, "max_lat": c("com_lat") + 0.05})
    return spatial.tile_by_cell(o, boxes, F.lit(0.096)).select("id", "tile")
