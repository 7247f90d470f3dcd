"""Queries over the calendar spine, moments in full, and month sums by streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import ofa, scaling, series
from ..sources import shared
from ..streaming import months, streams
from .registry import MONTH_SQL, OFA_SQL, _cycles, _t, ofa_table, query, r

#: Years and months of the scaling job's period; the year range of a month follows from them.
START, END = (1993, 4), (1997, 9)
SPINE_SQL = """sp AS (SELECT t, CAST(month(d) AS INTEGER) AS m, CAST(day(d) AS INTEGER) AS dd, CASE WHEN month(d) < 4 THEN 1994 ELSE 1993 END AS fy, CASE WHEN month(d) > 9 THEN 1996 ELSE 1997 END AS ly
   FROM (SELECT t, DATE '2014-01-01' + CAST((t - 1) % 365 AS INTEGER) AS d FROM (SELECT unnest(generate_series(1, {days})) AS t)))"""


@query(f"""WITH {OFA_SQL}, ce AS (SELECT tile, species, id, ts, fcst, CASE WHEN obs <> 13 THEN obs END AS obs, CAST(floor(((tile % 4) * 0.2 + 180) / 0.25) AS INTEGER) AS i, CAST(floor(((id % 2) * 0.3 + 90) / 0.25) AS INTEGER) AS j,
    date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) AS cycle FROM ofa),
  w AS (SELECT *, lead(cycle) OVER (PARTITION BY tile, species, obs ORDER BY cycle, id) AS nx FROM ce), kept AS (SELECT * FROM w WHERE obs IS NULL OR nx IS NULL OR nx - cycle > 3), {SPINE_SQL.format(days=455)},
  day AS (SELECT i, j, t, obs, fcst FROM kept JOIN sp ON month(ts) = m AND day(ts) = dd AND year(ts) BETWEEN fy AND ly), e AS (SELECT t AS last FROM sp WHERE t > 90)
  SELECT i, j, CAST((last - 37 - 1) % 365 + 1 AS INTEGER) AS doy, CAST(((last - 38) % 365 + 3) // 5 AS INTEGER) AS pentad, ((last - 38) % 365 + 3) % 5 = 0 AS stored, count(obs) AS n, round(avg(obs), 7) AS o_mean, round(stddev_pop(obs), 6) AS o_std,
    round(sum(fcst) / count(obs), 7) AS m_mean, round(sqrt(greatest(0, sum(fcst * fcst) / count(obs) - (sum(fcst) / count(obs)) ** 2)), 6) AS m_std, round(min(fcst), 7) AS m_min, round(max(fcst), 7) AS m_max
  FROM day JOIN e ON t BETWEEN last - 74 AND last GROUP BY i, j, last HAVING count(obs) >= 20""")
def scaling_calendar(spark: SparkSession, d: str) -> DataFrame:
    """A20 as published: 455 days, years by month, repeats within three cycles removed, species pooled in cells of 0.25 degrees, rows without an observation in the model's sums alone."""
    c = F.col
    x = _cycles(spark, d).withColumns({"i": F.floor(((c("tile") % 4) * 0.2 + 180) / 0.25).cast("int"), "j": F.floor(((c("id") % 2) * 0.3 + 90) / 0.25).cast("int"), "obs": F.when(c("obs") != 13, c("obs"))})
    kept = series.keep_last(x.where("obs is not null"), ["tile", "species", "obs"], "cycle", ["id"]).unionByName(x.where("obs is null"))
    return r(r(scaling.scaling_calendar(kept, ["i", "j"], START, END), "o_mean", "m_mean", "m_min", "m_max", places=7), "o_std", "m_std", places=6)


#: Polarisation and angles of the species: two angles count, 60 does not.
SPECIES = [(1, 0, [40.0]), (2, 1, [40.0]), (3, 0, [50.0, 52.5]), (4, 1, [50.0]), (5, 0, [60.0])]


@query(f"""WITH {OFA_SQL}, ki(species, pol, k) AS (VALUES (1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1)), {SPINE_SQL.format(days=485)},
  o1 AS (SELECT CAST(ts AS DATE) AS ts, tile % 5 AS tile, species, avg(obs) AS obs, avg(fcst) AS fcst FROM ofa GROUP BY ALL), day AS (SELECT tile, pol, k, t, obs, fcst FROM o1 JOIN ki USING (species) JOIN sp ON month(ts) = m AND day(ts) = dd AND year(ts) BETWEEN fy AND ly),
  e AS (SELECT t AS last FROM sp WHERE t > 120),
  s AS (SELECT tile, pol, k, last, count(*) AS n, count(*) FILTER (t BETWEEN last - 62 AND last - 32) AS ni, avg(obs) AS om, stddev_pop(obs) AS os, avg(fcst) AS mm, stddev_pop(fcst) AS ms, avg(obs) FILTER (t = last - 47) AS oc, avg(fcst) FILTER (t = last - 47) AS mc
    FROM day JOIN e ON t BETWEEN last - 94 AND last GROUP BY 1, 2, 3, 4),
  g AS (SELECT tile, (last - 48) % 365 + 1 AS doy, k, pol, oc, mc, CASE WHEN n >= 20 AND ni >= 8 THEN om END AS om, CASE WHEN n >= 20 AND ni >= 8 THEN os END AS os, CASE WHEN n >= 20 AND ni >= 8 THEN mm END AS mm, CASE WHEN n >= 20 AND ni >= 8 THEN ms END AS ms,
    CASE WHEN n >= 20 AND ni >= 8 THEN n END AS n FROM s)
  SELECT tile, CAST(doy AS INTEGER) AS doy, CAST(k AS INTEGER) AS angle, {', '.join(f"round(max({c}) FILTER (pol = {p}), 6) AS {n}_{s}" for p, s in enumerate('hv') for c, n in (('om', 'o_mean'), ('os', 'o_std'), ('mm', 'm_mean'), ('ms', 'm_std'), ('oc', 'o_centre'), ('mc', 'm_centre')))},
    CAST(max(n) FILTER (pol = 0) AS DOUBLE) AS n_h, CAST(max(n) FILTER (pol = 1) AS DOUBLE) AS n_v FROM g GROUP BY tile, doy, k
  HAVING max(coalesce(om, oc)) IS NOT NULL""")
def scaling_angles(spark: SparkSession, d: str) -> DataFrame:
    """By polarisation and angle, the centre day beside the window; the arrays as rows."""
    species = spark.createDataFrame(SPECIES, "species int, pol int, ang array<double>")
    # one observation of a species in a tile and day, as the operator asks for
    x = ofa_table(spark, d).groupBy(F.to_date("ts").alias("ts"), (F.col("tile") % 5).alias("tile"), "species").agg(F.avg("obs").alias("obs"), F.avg("fcst").alias("fcst"))
    s = scaling.scaling_angles(x, species, [40.0, 50.0], START, END)
    names = [f"{f}_{p}" for f in scaling.FIELDS for p in "hv"]
    rows = s.select("tile", "doy", F.posexplode(F.arrays_zip(*names)).alias("angle", "a")).select("tile", "doy", "angle", *[F.col(f"a.{n}").alias(n) for n in names])
    rows = rows.where(F.coalesce(*names).isNotNull())
    return r(rows, *[n for n in names if n[:2] != "n_"], places=6)


@query(f"""WITH {OFA_SQL}, v AS (SELECT tile, ts, (obs - fcst) / sqrt(obsvar + fcstvar) AS d, obs - ana AS e, obs, ana, obsvar, fcstvar FROM ofa WHERE obsvar + fcstvar > 0),
  s AS (SELECT tile, count(*) AS n, sum(d) AS s1, sum(d * d) AS s2, sum(d * d * d) AS s3, sum(e) AS t1, sum(e * e) AS t2, sum(d * e) AS de, min(e) AS lo, max(e) AS hi, avg(obsvar) AS ov, avg(fcstvar) AS fv, corr(obs, ana) AS oa, count(DISTINCT ts) AS n_times FROM v GROUP BY tile HAVING count(DISTINCT ts) >= 20)
  SELECT tile, n, n_times, round(s1 / n, 7) AS omf_mean, round((s2 - s1 * s1 / n) / (n - 1), 6) AS omf_var, round((s3 / (n - 1) - 3 * (s2 / n) * (s1 / n) + 2 * (s1 / n) ** 3) / ((s2 - s1 * s1 / n) / (n - 1)) ** 1.5, 5) AS omf_skew, round(t1 / n, 7) AS oma_mean,
    round((t2 - t1 * t1 / n) / (n - 1), 6) AS oma_var, round((de - s1 * t1 / n) / (n - 1), 6) AS cov, round(lo, 7) AS oma_min, round(hi, 7) AS oma_max, round(ov, 8) AS obsvar, round(fv, 8) AS fcstvar, round(oa, 6) AS oa_corr FROM s""")
def ofa_moments(spark: SparkSession, d: str) -> DataFrame:
    """A9 in full: normalised innovations, months' centred moments merged, ensemble variances, least count by distinct times.

    Rows are dealt by tile first: a row is much smaller than the buffers of a month's moments, of which there are nearly as many.
    """
    x = ofa_table(spark, d).where("obsvar + fcstvar > 0")
    parts = ofa.moments(x.select("tile", "ts", "obs", "fcst", "ana", "obsvar", "fcstvar").repartition("tile"), ["month", "tile"], month=True, normalise=True)
    times = x.select("tile", "ts").repartition("tile").groupBy("tile").agg(F.countDistinct("ts").alias("n_times"))
    s = ofa.moment_statistics(ofa.merge_moments(parts, ["tile"])).join(times, "tile").where("n_times >= 20")
    s = r(s, "omf_mean", "oma_mean", "oma_min", "oma_max", places=7)
    return r(r(r(s, "omf_var", "oma_var", "cov", "oa_corr", places=6), "omf_skew", places=5), "obsvar", "fcstvar", places=8)


def _drops(spark: SparkSession, x: DataFrame, late: Column) -> tuple[str, list[DataFrame]]:
    """A folder for files that arrive, and the rows that come first and those that come late."""
    return shared.folder(spark, "drops"), [x.where(~late), x.where(late)]


@query(f"""WITH {OFA_SQL}, m AS (SELECT *, {MONTH_SQL} AS month FROM ofa) SELECT month, species, count(*) AS n, round(avg(obs), 8) AS mean_obs, round(avg(obs) - avg(fcst), 8) AS omf_mean, round(stddev_pop(obs - fcst), 6) AS omf_std FROM m GROUP BY 1, 2""")
def late_months(spark: SparkSession, d: str) -> DataFrame:
    """Month sums by a stream, a third of the rows late, in a second run on the same checkpoint."""
    x = ofa_table(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    drops, parts = _drops(spark, x, F.col("id") % 3 == 0)
    store = shared.folder(spark, "months")
    for rows in parts:
        rows.write.mode("append").parquet(drops)
        stream = streams.read_stream(spark, drops, x.schema)
        stream.writeStream.foreachBatch(months.merge_months(store, ["species"])).option("checkpointLocation", f"{store}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    s = ofa.finalise(months.read_months(spark, store)).select("month", "species", "n", "mean_obs", "omf_mean", "omf_std")
    return r(r(s, "mean_obs", "omf_mean", places=8), "omf_std", places=6)


@query("""SELECT l_suppkey AS tile, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(var_samp(l_extendedprice) / 1000000, 6) AS var FROM lineitem GROUP BY 1""")
def stream_moments(spark: SparkSession, d: str) -> DataFrame:
    """Running moments by a stream of two drops with a restart between; the last state of each tile."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    x = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_extendedprice").alias("value"), F.col("l_orderkey").alias("id"))
    drops, parts = _drops(spark, x, F.col("id") % 4 == 0)
    out = shared.folder(spark, "moments")
    for rows in parts:
        rows.write.mode("append").parquet(drops)
        streams.run_to_end(streams.moments(streams.read_stream(spark, drops, x.schema), ["tile"]), out, f"{out}-checkpoint", "update")
    last = spark.read.parquet(out).groupBy("tile").agg(F.max_by(F.struct("n", "mean", "var"), "batch").alias("s")).select("tile", "s.*")
    return r(last.withColumn("var", F.col("var") / 1_000_000), "mean", "var", places=6)


LEAP_SQL = "VALUES (DATE '2006-01-01'), (DATE '2009-01-01'), (DATE '2012-07-01'), (DATE '2015-07-01'), (DATE '2017-01-01')"


@query(f"""WITH x AS (SELECT l_orderkey AS id, l_linenumber AS k, date_diff('second', TIMESTAMP '2000-01-01 00:00:00', l_shipdate + INTERVAL 20 YEAR) + l_linenumber - 1 AS s FROM lineitem),
  st AS (SELECT d, row_number() OVER (ORDER BY d) AS k, date_diff('second', TIMESTAMP '2000-01-01 00:00:00', d :: TIMESTAMP) + row_number() OVER (ORDER BY d) AS over FROM ({LEAP_SQL}) v(d))
  SELECT id, k, s, strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(s), '%Y-%m-%d %H:%M:%S') AS plain, strftime(TIMESTAMP '2000-01-01 00:00:00' + to_seconds(s - (SELECT count(*) FROM st WHERE st.over <= s)), '%Y-%m-%d %H:%M:%S') AS utc FROM x""")
def j2000_times(spark: SparkSession, d: str) -> DataFrame:
    """Elapsed seconds of every row, twenty years on, in the first seconds of its day, without and with leap seconds."""
    day = F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 20 YEARS")
    s = day.cast("long") - F.lit("2000-01-01 00:00:00").cast("timestamp").cast("long") + F.col("l_linenumber") - 1
    x = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), s.alias("s"))
    text = lambda leap: F.date_format(scalar.j2000(F.col("s"), "UT00", leap), "yyyy-MM-dd HH:mm:ss")
    return x.withColumns({"plain": text(False), "utc": text(True)})


@query("""WITH a AS (SELECT c_custkey AS site, ((c_custkey * 37 % 3600) / 10.0 - 180) :: DOUBLE AS x, (c_acctbal / 125) :: DOUBLE AS y FROM customer), e AS (SELECT 0.081819190843 :: DOUBLE AS e, 6378137.0 :: DOUBLE AS a, cos(radians(30.0)) / sqrt(1 - (0.081819190843 * sin(radians(30.0))) ** 2) AS k0, 9008.055210146 :: DOUBLE AS size),
  q AS (SELECT *, (1 - e * e) * (sin(radians(y)) / (1 - (e * sin(radians(y))) ** 2) - ln((1 - e * sin(radians(y))) / (1 + e * sin(radians(y)))) / (2 * e)) AS q, 1 - (1 - e * e) / (2 * e) * ln((1 - e) / (1 + e)) AS qp FROM a, e),
  c AS (SELECT *, CAST(greatest(0, least(1623, floor(812 - q * a / (2 * k0) / size))) AS INTEGER) AS row, CAST(greatest(0, least(3855, floor(radians(x) * a * k0 / size + 1928))) AS INTEGER) AS col FROM q),
  b AS (SELECT *, asin(greatest(-1, least(1, (811.5 - row) * size * 2 * k0 / (a * qp)))) AS b FROM c)
  SELECT site, row, col, round(degrees(b + (e ** 2 / 3 + 31 * e ** 4 / 180 + 517 * e ** 6 / 5040) * sin(2 * b) + (23 * e ** 4 / 360 + 251 * e ** 6 / 3780) * sin(4 * b) + 761 * e ** 6 / 45360 * sin(6 * b)), 8) AS lat, round(degrees((col - 1927.5) * size / (a * k0)), 8) AS lon,
    CAST(CASE WHEN floor((y + 5) / 2.5) BETWEEN 0 AND 19 THEN floor((y + 5) / 2.5) END AS INTEGER) AS cell FROM b WHERE abs(y) < 89 AND floor((y + 5) / 2.5) BETWEEN 0 AND 19""")
def ease_sql(spark: SparkSession, d: str) -> DataFrame:
    """Cells of points and their centres by the registered SQL functions."""
    scalar.register(spark)
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("site"), ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180).cast("double").alias("x"), (F.col("c_acctbal") / 125).cast("double").alias("y"))
    c = a.selectExpr("site", "y", "ease_row('M09', y) AS row", "ease_col('M09', x) AS col", "cell_index(y, -5D, 2.5D, 20) AS cell").where("abs(y) < 89 and cell is not null")
    return r(c.selectExpr("site", "row", "col", "ease_lat('M09', row) AS lat", "ease_lon('M09', col) AS lon", "cell"), "lat", "lon", places=8)


@query("""WITH a AS (SELECT c_custkey AS site, (c_acctbal / 125) :: DOUBLE AS lat, ((c_custkey * 37 % 3600) / 10.0 - 180) :: DOUBLE AS lon, (c_custkey % 1000) / 1e9 :: DOUBLE AS flux FROM customer)
  SELECT CAST(floor((lat + 90) / 5) AS INTEGER) AS band, CAST(floor(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END / 90) AS INTEGER) AS quarter, count(*) AS n, round(avg(4.0 * (lat + 90) / 90), 8) AS std_increment, round(avg(0.05 * (lat + 90) / 90), 8) AS std_fraction,
    round(avg(flux * 365.25 * 86400), 8) AS yearly FROM a WHERE lat >= -90 AND lat < 90 GROUP BY 1, 2""")
def perturbation_bands(spark: SparkSession, d: str) -> DataFrame:
    """Standard deviations of perturbations that grow with latitude, for two variables, and yearly fluxes, by band of latitude and quarter of longitude."""
    a = _t(spark, d, "customer").select((F.col("c_acctbal") / 125).cast("double").alias("lat"), ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180).cast("double").alias("lon"), ((F.col("c_custkey") % 1000) / 1e9).alias("flux"))
    cells = a.select(scalar.cell_index(F.col("lat"), -90.0, 5.0, 36).alias("band"), scalar.cell_index(scalar.wrap360(F.col("lon")), 0.0, 90.0, 4).alias("quarter"), "lat", "flux").where("band is not null")
    out = cells.groupBy("band", "quarter").agg(F.count(F.lit(1)).alias("n"), F.avg(scalar.perturbation(F.lit(4.0), F.col("lat"))).alias("std_increment"), F.avg(scalar.perturbation(F.lit(0.05), F.col("lat"))).alias("std_fraction"), F.avg(scalar.per_year(F.col("flux"))).alias("yearly"))
    return r(out, "std_increment", "std_fraction", "yearly", places=8)
