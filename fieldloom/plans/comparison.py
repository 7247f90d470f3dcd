"""Queries on pooled groups, anomalies, paired intervals, bins and shares, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, ofa, series
from . import tails
from .registry import COL_SQL, GROUPS_SQL, MONTH_SQL, OFA_SQL, PAIR_SQL, STATE_SQL, WELCH_SQL, _cells, _cycles, _pairs, _t, groups, ofa_table, query, r, states, welch_cells


@query(f"""WITH {OFA_SQL}, {GROUPS_SQL}, s AS (SELECT {MONTH_SQL} AS month, grp, tile, count(*) AS n, avg(obs) - avg(fcst) AS m, stddev_pop(obs - fcst) AS s FROM ofa JOIN g USING (species) WHERE obs IS NOT NULL GROUP BY 1, 2, 3)
  SELECT month, grp, CAST(sum(n) AS BIGINT) AS n, round(avg(m), 8) AS omf_mean, round(avg(s), 8) AS omf_std FROM s GROUP BY 1, 2""")
def omf_pooled_group(spark: SparkSession, d: str) -> DataFrame:
    """Species pooled in each tile, tiles averaged."""
    x = groups(ofa_table(spark, d)).withColumn("month", ofa.month_of(F.col("ts")))
    parts = ofa.partial_sums(x, ["month", "tile", "species", "grp"], deal=["month", "tile"])
    return r(ofa.pooled_group(parts, ["month", "grp"], "tile"), "omf_mean", "omf_std", places=8)


@query(f"""WITH {STATE_SQL}, c AS (SELECT exp, tile, month(ts) AS m, avg(v) FILTER (year(ts) BETWEEN 1993 AND 1997) AS mu, stddev_pop(v) FILTER (year(ts) BETWEEN 1993 AND 1997) AS sd FROM st GROUP BY 1, 2, 3),
  z AS (SELECT st.exp, st.tile, year(ts) AS y, avg(CASE WHEN sd > 1e-9 THEN (v - mu) / sd END) AS z FROM st JOIN c ON st.exp = c.exp AND st.tile = c.tile AND month(ts) = m GROUP BY 1, 2, 3),
  a AS (SELECT exp, tile, var_pop(z) AS z_var, count(z) AS years FROM z GROUP BY 1, 2)
  SELECT f.tile, round(f.z_var, 5) AS z_var_ol, round(o.z_var, 5) AS z_var_da, round(o.z_var - f.z_var, 5) AS difference, round(100 * (o.z_var - f.z_var) / nullif(f.z_var, 0), 3) AS percent, f.years AS years_ol, o.years AS years_da FROM a f JOIN a o ON f.tile = o.tile AND f.exp = 'F' AND o.exp = 'O'""")
def z_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Standard anomalies, their annual means, and the variances of both runs compared."""
    z = series.annual_z(states(spark, d), ["exp", "tile"], "v", 1993, 1997)
    side = lambda e, s: z.where(F.col("exp") == e).select("tile", F.col("z_var").alias(f"z_var_{s}"), F.col("years").alias(f"years_{s}"))
    both = side("F", "ol").join(side("O", "da"), "tile")
    d_ = F.col("z_var_da") - F.col("z_var_ol")
    both = both.withColumns({"difference": d_, "percent": F.try_divide(100 * d_, F.col("z_var_ol"))})
    return r(r(both, "z_var_ol", "z_var_da", "difference", places=5), "percent", places=3)


@query(f"""WITH {PAIR_SQL}, c AS (SELECT tile, month(month) AS m, avg(ol) AS co, avg(da) AS cd FROM pr GROUP BY 1, 2),
  x AS (SELECT pr.*, ol - co AS a, da - cd AS b, year(month) + (month(month) - 0.5) / 12 AS t FROM pr JOIN c ON pr.tile = c.tile AND month(month) = m),
  y AS (SELECT *, lead(a) OVER w AS a1, lead(b) OVER w AS b1 FROM x WINDOW w AS (PARTITION BY tile ORDER BY month)),
  s AS (SELECT tile, count(*) AS n, avg(da - ol) AS mean_diff, stddev_pop(a) AS so, stddev_pop(b) AS sd, avg(a * b) / nullif(sqrt(avg(a * a) * avg(b * b)), 0) AS anom_r, sqrt(avg((b - a) ** 2)) AS rmse, avg(abs(da - ol)) AS mad, regr_slope(da, t) - regr_slope(ol, t) AS trend,
   avg(b * b1) / nullif(sqrt(avg(b * b) FILTER (b1 IS NOT NULL) * avg(b1 * b1)), 0) - avg(a * a1) / nullif(sqrt(avg(a * a) FILTER (a1 IS NOT NULL) * avg(a1 * a1)), 0) AS rho FROM y GROUP BY tile)
  SELECT tile, n, round(mean_diff, 5) AS mean_diff, round(sd / so, 5) AS std_ratio, round((sd / so - 1) * 100, 4) AS amp_change, round(anom_r, 5) AS anom_r, round(rmse, 5) AS anom_rmse, round(mad / so, 5) AS norm_abs_diff, round(trend, 5) AS delta_trend, round(rho, 5) AS delta_rho1
  FROM (SELECT * REPLACE (CASE WHEN so > 1e-12 THEN so END AS so, CASE WHEN sd > 1e-12 THEN sd END AS sd) FROM s)""")
def anomaly_suite(spark: SparkSession, d: str) -> DataFrame:
    """A37."""
    s = compare.anomaly_suite(_pairs(spark, d), ["tile"])
    return r(r(s, "mean_diff", "std_ratio", "anom_r", "anom_rmse", "norm_abs_diff", "delta_trend", "delta_rho1", places=5), "amp_change", places=4)


@query(f"WITH {PAIR_SQL} SELECT CAST(month(month) AS INTEGER) AS m, count(*) AS n, round(avg(ol - da), 8) AS mean_delta, round(coalesce(stddev_samp(ol - da), 0) / sqrt(count(*)), 8) AS std_error FROM pr GROUP BY 1")
def paired_error(spark: SparkSession, d: str) -> DataFrame:
    """A27, where less is better; ``paired_interval`` has the t half-width."""
    p = _pairs(spark, d).withColumn("m", F.month("month"))
    return r(compare.paired_interval(p, ["m"], "ol", "da", up=False).drop("ci_half"), "mean_delta", "std_error", places=8)


@query(f"""WITH RECURSIVE {PAIR_SQL}, s AS (SELECT CAST(month(month) AS INTEGER) AS m, count(*) AS n, avg(da - ol) AS delta, coalesce(stddev_samp(da - ol), 0) / sqrt(count(*)) AS se FROM pr GROUP BY 1),
  fr AS (SELECT DISTINCT CAST(greatest(n - 1, 1) AS DOUBLE) AS df FROM s), {tails.t_quantiles("tq", "fr")}
  SELECT m, n, round(delta, 8) AS mean_delta, round(se, 8) AS std_error, round(t * se, 6) AS ci_half FROM s JOIN tq ON df = greatest(n - 1, 1)""")
def paired_interval(spark: SparkSession, d: str) -> DataFrame:
    """A27 with the t half-width; the SQL integrates the distribution, as DuckDB has no quantile of it."""
    s = compare.paired_interval(_pairs(spark, d).withColumn("m", F.month("month")), ["m"], "ol", "da")
    return r(r(s, "mean_delta", "std_error", places=8), "ci_half", places=6)


SCREEN_TARGETS, SCREEN_PREDICTORS = ["bias", "gain"], ["price", "tile", "species", "obsvar", "fcstvar", "doy"]
SCREEN_COLUMNS = ["obs - fcst AS bias", "abs(obs - fcst) - abs(obs - ana) AS gain", "price", "tile", "species", "obsvar", "fcstvar", "dayofyear(ts) AS doy"]
SCREEN_PAIRS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS target, '{p}' AS predictor, CAST({t} AS DOUBLE) AS y, CAST({p} AS DOUBLE) AS x FROM sc" for t in SCREEN_TARGETS for p in SCREEN_PREDICTORS)


def _corr_p(c: str) -> str:
    return tails.t_two_sided(f"{c} * sqrt((n - 2) / (1 - {c} * {c}))", "(n - 2)")


@query(f"""WITH {OFA_SQL}, sc AS (SELECT {", ".join(SCREEN_COLUMNS)} FROM ofa), u AS ({SCREEN_PAIRS_SQL}),
  k AS (SELECT *, rank() OVER (PARTITION BY target, predictor ORDER BY x) + (count(*) OVER (PARTITION BY target, predictor, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY target, predictor ORDER BY y) + (count(*) OVER (PARTITION BY target, predictor, y) - 1) / 2.0 AS ry FROM u WHERE x IS NOT NULL AND y IS NOT NULL),
  s AS (SELECT target, predictor, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM k GROUP BY 1, 2), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, predictor) AS INTEGER) AS place FROM s)
  SELECT target, predictor, place, n, round(r, 6) AS r, round(rho, 6) AS rho, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round({_corr_p("r")}, 6) AS p_r, round({_corr_p("rho")}, 6) AS p_rho FROM o WHERE place <= 3""")
def screening_top(spark: SparkSession, d: str) -> DataFrame:
    """The three predictors of each target with the largest correlations, and their p."""
    x = ofa_table(spark, d).selectExpr(*SCREEN_COLUMNS)
    return r(compare.screen_pairs(x, SCREEN_TARGETS, SCREEN_PREDICTORS, 3), "r", "rho", "slope", "intercept", "p_r", "p_rho", places=6)


SLOPES_SQL = "sl AS (SELECT p_size % 5 AS region, p_retailprice - 1400 AS a, p_size * 40.0 - 1000 AS b, (p_partkey * 7 % 100) / 1000.0 AS pa, (p_partkey * 13 % 100) / 1000.0 AS pb, p_partkey % 7 + 1.0 AS w FROM part)"


@query(f"""WITH {SLOPES_SQL}, m AS (SELECT region, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM sl GROUP BY 1)
  SELECT region, round(sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) ** 2) * sum(w * (b - mb) ** 2)), 6) AS weighted_r, round(sum(w) FILTER (pa < 0.05) / sum(w), 6) AS sig_a, round(sum(w) FILTER (pb < 0.05) / sum(w), 6) AS sig_b,
  round(coalesce(sum(w) FILTER (pa < 0.05 AND pb < 0.05), 0) / sum(w), 6) AS sig_both, round(coalesce(sum(w) FILTER (pa < 0.05 AND pb < 0.05 AND sign(a) = sign(b)), 0) / sum(w), 6) AS sig_agree, round(coalesce(sum(w) FILTER (b > a), 0) / sum(w), 6) AS above FROM sl JOIN m USING (region) GROUP BY region""")
def area_relations(spark: SparkSession, d: str) -> DataFrame:
    """The weighted correlation and the shares of area."""
    c = F.col
    x = _t(spark, d, "part").select((c("p_size") % 5).alias("region"), (c("p_retailprice") - 1400).alias("a"), (c("p_size") * 40.0 - 1000).alias("b"), (c("p_partkey") * 7 % 100 / 1000).alias("pa"), (c("p_partkey") * 13 % 100 / 1000).alias("pb"), (c("p_partkey") % 7 + F.lit(1.0)).alias("w"))
    return r(compare.area_relations(x, ["region"], "a", "b", "pa", "pb", "w"), "weighted_r", "sig_a", "sig_b", "sig_both", "sig_agree", "above", places=6)


BIN_SQL = "count(y) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, round(quantile_cont(y, 0.5), 6) AS median, round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.75), 6) AS q75"


@query(f"""WITH x AS (SELECT o_totalprice AS p, o_orderkey % 97 + CAST(0.5 AS DOUBLE) AS y FROM orders), e AS (SELECT unnest(quantile_cont(p, [0, 0.2, 0.4, 0.6, 0.8])) AS lo FROM x), f AS (SELECT DISTINCT lo FROM e)
  SELECT CAST(greatest(1, (SELECT count(*) FROM f WHERE lo < p)) AS INTEGER) AS bin, {BIN_SQL} FROM x GROUP BY 1""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """A55 by quantiles."""
    x = _t(spark, d, "orders").select(F.col("o_totalprice").alias("p"), (F.col("o_orderkey") % 97 + 0.5).alias("y"))
    return r(compare.quantile_bins(x, "p", "y", 5), "mean", "std", "median", "q25", "q75", places=6)


@query(f"""WITH x AS (SELECT l_quantity + 0.3 AS p, l_extendedprice AS y FROM lineitem WHERE l_quantity + 0.3 BETWEEN 1 AND 64)
  SELECT CAST(greatest(1, ceil(log2(p))) AS INTEGER) AS bin, {BIN_SQL} FROM x GROUP BY 1""")
def log_bins(spark: SparkSession, d: str) -> DataFrame:
    """A55 by equal ratios."""
    x = _t(spark, d, "lineitem").select((F.col("l_quantity") + 0.3).alias("p"), F.col("l_extendedprice").alias("y"))
    return r(compare.log_bins(x, "p", "y", 1.0, 64.0, 6), "mean", "std", "median", "q25", "q75", places=6)


@query(f"""WITH {OFA_SQL}, x AS (SELECT species, abs(obs - fcst) - abs(obs - ana) AS c, obs FROM ofa)
  SELECT species, count(*) AS n, round(avg(CAST(c > 0 AS INTEGER)), 6) AS improved, round(avg(CAST(c < 0 AS INTEGER)), 6) AS reduced, round(avg(CAST(abs(c) <= 0.005 AS INTEGER)), 6) AS within, round(sum(c) / sum(obs), 6) AS ratio FROM x GROUP BY 1""")
def robust_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares and ratio."""
    x = ofa_table(spark, d).withColumn("c", F.abs(F.col("obs") - F.col("fcst")) - F.abs(F.col("obs") - F.col("ana")))
    return r(compare.robust_shares(x, ["species"], "c", "obs", 0.005), "improved", "reduced", "within", "ratio", places=6)


ANOM_SQL = f"""{COL_SQL}, q AS (SELECT *, least(73, floor((dayofyear(day) - 1) / 5) + 1) AS p FROM d), k AS (SELECT species, cell, p, avg(m) AS m, avg(o) AS o, avg(c) AS c FROM q GROUP BY 1, 2, 3),
  an AS (SELECT q.species, q.cell, q.day, q.m - k.m AS m, q.o - k.o AS o, q.c - k.c AS c FROM q JOIN k ON q.species = k.species AND q.cell = k.cell AND q.p = k.p)"""


@query(f"""WITH {ANOM_SQL}, p AS (SELECT a.*, b.m AS ml, b.o AS ol FROM an a JOIN an b ON a.species = b.species AND a.cell = b.cell AND a.day = b.day + 2),
  s AS (SELECT species, count(*) AS n, avg(m) AS mm, avg(o) AS mo, avg(m * m) AS qm, avg(o * o) AS qo, avg(m * o) AS xmo, avg(m * ml) AS xm, avg(o * ol) AS xo FROM p GROUP BY 1 HAVING count(*) >= 20),
  c AS (SELECT species, n, qm - mm * mm AS cmm, qo - mo * mo AS coo, CASE WHEN xmo - mm * mo > 0 THEN xmo - mm * mo END AS cmo, CASE WHEN xm - mm * mm > 0 THEN xm - mm * mm END AS lm, CASE WHEN xo - mo * mo > 0 THEN xo - mo * mo END AS lo FROM s)
  SELECT species, n, round(CASE WHEN cmo * sqrt(lm / lo) / cmm > 1 THEN 1.0 ELSE cmo * sqrt(lm / lo) / cmm END, 4) AS r2_mod_ivd, round(CASE WHEN cmo / coo / sqrt(lm / lo) > 1 THEN 1.0 ELSE cmo / coo / sqrt(lm / lo) END, 4) AS r2_obs_ivd, round(cmo / sqrt(cmm * coo), 4) AS r FROM c""")
def iv_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """A22 on anomalies from the pentad climatology."""
    a = series.pentad_anomalies(_cells(spark, d), ["species", "cell"], "day", ["m", "o", "c"])
    p = series.day_lag_join(a, ["species", "cell"], "day", 2, ["m", "o"])
    return r(series.instrumental(p, ["species"], 20).select("species", "n", "r2_mod_ivd", "r2_obs_ivd", "r"), "r2_mod_ivd", "r2_obs_ivd", "r")


@query(f"""WITH {ANOM_SQL}, s AS (SELECT species, count(*) AS n, var_pop(m) AS aa, var_pop(o) AS bb, covar_pop(m, o) AS ab, covar_pop(m, c) AS ac, covar_pop(o, c) AS bc FROM an GROUP BY 1 HAVING count(*) >= 20)
  SELECT species, n, round(CASE WHEN ab * ac / bc / aa >= 0.001 THEN least(1.0, ab * ac / bc / aa) END, 5) AS r2_a, round(CASE WHEN ab * bc / ac / bb >= 0.001 THEN least(1.0, ab * bc / ac / bb) END, 5) AS r2_b, round(aa - ab * ac / bc, 5) AS err_a, round(bb - ab * bc / ac, 5) AS err_b FROM s""")
def tc_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """A23 on anomalies from the pentad climatology."""
    a = series.pentad_anomalies(_cells(spark, d), ["species", "cell"], "day", ["m", "o", "c"])
    x = a.select("species", F.col("m").alias("a"), F.col("o").alias("b"), "c")
    return r(series.triple(x, ["species"], 20).select("species", "n", "r2_a", "r2_b", "err_a", "err_b"), "r2_a", "r2_b", "err_a", "err_b", places=5)


CELL_SQL = """ce AS (SELECT *, CAST(floor(((tile % 4) * 0.2 + 180) / 0.25) AS INTEGER) AS i, CAST(floor(((id % 2) * 0.3 + 90) / 0.25) AS INTEGER) AS j FROM ofa)"""
NDOY61_SQL = "dayofyear(ts) - CASE WHEN dayofyear(last_day(make_date(CAST(year(ts) AS INTEGER), 12, 1))) = 366 AND dayofyear(ts) >= 61 THEN 1 ELSE 0 END"


@query(f"""WITH {OFA_SQL}, {CELL_SQL}, w AS (SELECT *, date_diff('day', DATE '1990-01-01', CAST(ts AS DATE)) AS cycle, id * 10 + species AS rid, lead(date_diff('day', DATE '1990-01-01', CAST(ts AS DATE))) OVER (PARTITION BY tile, species, obs ORDER BY ts, id) AS nx FROM ce),
  k AS (SELECT * FROM w WHERE (nx IS NULL OR nx - cycle > 3) AND year(ts) BETWEEN 1993 AND 1997 AND NOT (month(ts) = 2 AND day(ts) = 29)), p AS (SELECT i, j, {NDOY61_SQL} AS d, obs, fcst FROM k), c AS (SELECT k, 5 * k - 2 AS doy FROM (SELECT unnest(generate_series(1, 73)) AS k))
  SELECT i, j, CAST(k AS INTEGER) AS pentad, count(*) AS n, round(avg(obs), 6) AS o_mean, round(stddev_pop(obs), 5) AS o_std, round(avg(fcst), 6) AS m_mean, round(stddev_pop(fcst), 5) AS m_std, round(min(fcst), 6) AS m_min, round(max(fcst), 6) AS m_max
  FROM p JOIN c ON (d - doy + 37 + 730) % 365 < 75 GROUP BY 1, 2, 3 HAVING count(*) >= 20""")
def scaling_cells(spark: SparkSession, d: str) -> DataFrame:
    """A20 by cells of 0.25 degrees, species pooled, repeats within three cycles removed first (W9), years given."""
    c = F.col
    x = _cycles(spark, d).withColumns({"i": F.floor(((c("tile") % 4) * 0.2 + 180) / 0.25).cast("int"), "j": F.floor(((c("id") % 2) * 0.3 + 90) / 0.25).cast("int")})
    x = series.keep_last(x, ["tile", "species", "obs"], "cycle", ["id"]).where(F.year("ts").between(1993, 1997))
    return r(r(series.scaling_windows(x, ["i", "j"]), "o_mean", "m_mean", "m_min", "m_max", places=6), "o_std", "m_std", places=5)


@query(f"WITH {WELCH_SQL} SELECT tile % 2 AS region, count(*) AS n_cells, round(avg(CAST(t_p < 0.05 AS INTEGER)), 6) AS share_t_p, round(avg(CAST(f_p < 0.05 AS INTEGER)), 6) AS share_f_p FROM we GROUP BY 1")
def significance_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of tiles whose means and variances differ."""
    cells = welch_cells(spark, d).withColumn("region", F.col("tile") % 2)
    return r(compare.significant_shares(cells, ["region"], ["t_p", "f_p"]), "share_t_p", "share_f_p", places=6)
