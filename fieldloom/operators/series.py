"""Climatologies, anomalies, windows, trends and skill."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist, trend
from ..functions.scalar import pearson


def monthly_climatology(x: DataFrame, keys: list[str], value: str, first: int, last: int) -> DataFrame:
    """A16."""
    return x.where(F.year("ts").between(first, last)).groupBy(*keys, F.month("ts").alias("month")).agg(F.avg(value).alias("clim"), F.count(value).alias("n"))


def deseasonalise(x: DataFrame, clim: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minus the climatology of the calendar month."""
    return x.withColumn("month", F.month("ts")).join(clim.select(*keys, "month", "clim"), [*keys, "month"]).withColumn("anom", F.col(value) - F.col("clim"))


def standard_anomalies(x: DataFrame, keys: list[str], value: str, first: int, last: int) -> DataFrame:
    """(value - mean) / std (population) of the calendar month in the years ``first`` to ``last``; null where the std is 0."""
    inside = F.when(F.year("ts").between(first, last), F.col(value))
    clim = x.groupBy(*keys, F.month("ts").alias("_m")).agg(F.avg(inside).alias("_mean"), F.stddev_pop(inside).alias("_std"))
    return x.withColumn("_m", F.month("ts")).join(clim, [*keys, "_m"]).withColumn("z", F.when(F.col("_std") > 1e-9, (F.col(value) - F.col("_mean")) / F.col("_std"))).drop("_m", "_mean", "_std")


def annual_z(x: DataFrame, keys: list[str], value: str, first: int, last: int) -> DataFrame:
    """The variance (population) of annual means of standard anomalies, and how many years it has."""
    z = standard_anomalies(x, keys, value, first, last).groupBy(*keys, F.year("ts").alias("_y")).agg(F.avg("z").alias("_z"))
    return z.groupBy(*keys).agg(F.var_pop("_z").alias("z_var"), F.count("_z").alias("years"))


def pentad_anomalies(x: DataFrame, keys: list[str], day: str, columns: list[str]) -> DataFrame:
    """Minus the mean of the pentad of the year."""
    p = x.withColumn("_p", F.least(F.lit(73), F.floor((F.dayofyear(day) - 1) / 5) + 1))
    clim = p.groupBy(*keys, "_p").agg(*[F.avg(c).alias(f"_c_{c}") for c in columns])
    return p.join(clim, [*keys, "_p"]).withColumns({c: F.col(c) - F.col(f"_c_{c}") for c in columns}).drop("_p", *[f"_c_{c}" for c in columns])


def cyclic_doy(x: DataFrame, keys: list[str], value: str, half: int = 15, days: int = 366, zero_fill: bool = False) -> DataFrame:
    """Daily means by day of year, then a centred mean that wraps at the year's end.

    The edge days are copied to the other side, so that one range frame does it.
    """
    day = x.groupBy(*keys, F.dayofyear("ts").alias("doy")).agg(F.avg(value).alias("v"))
    copies = F.explode(F.array(F.lit(-days), F.lit(0), F.lit(days)))
    ring = day.withColumn("turn", copies).withColumn("at", F.col("doy") + F.col("turn")).where(F.col("at").between(1 - half, days + half))
    w = Window.partitionBy(*keys).orderBy("at").rangeBetween(-half, half)
    total = F.sum("v").over(w)
    mean = total / (2 * half + 1) if zero_fill else F.avg("v").over(w)
    return ring.withColumn("clim", mean).where("turn = 0").select(*keys, "doy", "clim")


def pooled_clim(x: DataFrame, keys: list[str], value: str, least: int, half: int = 15) -> DataFrame:
    """Every observation counts for its 31 days on a circle of 365; kept on days 3, 8, ..., 363."""
    doy = F.dayofyear("ts") - F.when((F.dayofyear(F.last_day(F.concat(F.year("ts"), F.lit("-12-01")).cast("date"))) == 366) & (F.dayofyear("ts") >= 60), 1).otherwise(0)
    part = x.where(F.col(value).isNotNull()).groupBy(*keys, doy.alias("d")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    near = part.withColumn("k", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("doy", F.pmod(F.col("d") - 1 + F.col("k"), F.lit(365)) + 1).where("(doy - 3) % 5 = 0")
    return near.groupBy(*keys, "doy").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where(F.col("n") >= least).select(*keys, "doy", (F.col("s") / F.col("n")).alias("clim"), "n")


def scaling_windows(x: DataFrame, keys: list[str], width: int = 75, least: int = 20) -> DataFrame:
    """For each pentad, means, stds (population) and extremes over the ``width`` days, of all years, that end half a width after it.

    Daily partial sums are dealt to the at most width / 5 + 1 windows that hold
    them, then summed: one hash aggregation, no day spine and no sort.
    """
    d = x.where("fcst is not null and obs is not null and not (month(ts) = 2 and day(ts) = 29)")
    leap = F.dayofyear(F.last_day(F.concat(F.year("ts"), F.lit("-12-01")).cast("date"))) == 366
    doy = F.dayofyear("ts") - F.when(leap & (F.dayofyear("ts") >= 61), 1).otherwise(0)
    part = d.groupBy(*keys, doy.alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("obs").alias("so"), F.sum(F.col("obs") ** 2).alias("qo"), F.sum("fcst").alias("sm"), F.sum(F.col("fcst") ** 2).alias("qm"), F.min("fcst").alias("lo"), F.max("fcst").alias("hi"))
    half = width // 2
    # the window of centre c covers days c - half .. c - half + width - 1, on a circle
    near = part.withColumn("k", F.explode(F.sequence(F.lit(half - width + 1), F.lit(half)))).withColumn("doy", F.pmod(F.col("d") - 1 + F.col("k"), F.lit(365)) + 1).where("(doy + 2) % 5 = 0")
    s = near.groupBy(*keys, ((F.col("doy") + 2) / 5).cast("int").alias("pentad")).agg(*[F.sum(c).alias(c) for c in ("n", "so", "qo", "sm", "qm")], F.min("lo").alias("m_min"), F.max("hi").alias("m_max")).where(F.col("n") >= least)
    std = lambda q, m: F.sqrt(F.greatest(F.lit(0.0), F.col(q) / F.col("n") - F.pow(F.col(m) / F.col("n"), 2)))
    return s.select(*keys, "pentad", "n", (F.col("so") / F.col("n")).alias("o_mean"), std("qo", "so").alias("o_std"), (F.col("sm") / F.col("n")).alias("m_mean"), std("qm", "sm").alias("m_std"), "m_min", "m_max")


def keep_last(x: DataFrame, keys: list[str], cycle: str, order: list[str], reach: int = 3) -> DataFrame:
    """A row is dropped if the same key comes again within ``reach`` cycles."""
    w = Window.partitionBy(*keys).orderBy(cycle, *order)
    return x.withColumn("_next", F.lead(cycle).over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col(cycle) > reach)).drop("_next")


def running_sum(x: DataFrame, keys: list[str], order: list[str], value: str, name: str = "total") -> DataFrame:
    """W1; a null counts as 0."""
    return x.withColumn(name, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def lag_pairs(x: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The correlation of consecutive retained rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return x.where(F.col(value).isNotNull()).withColumn("_before", F.lag(value).over(w)).groupBy(*keys).agg(pearson("_before", value).alias("lag1"), F.count("_before").alias("n"))


def day_lag_join(x: DataFrame, keys: list[str], day: str, lag: int, columns: list[str]) -> DataFrame:
    """Each day with the day ``lag`` days before; a gap in dates is a gap here."""
    earlier = x.select(*keys, F.date_add(day, lag).alias(day), *[F.col(c).alias(f"{c}_lag") for c in columns])
    return x.join(earlier, [*keys, day])


def instrumental(pairs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """IVd and IVs skill from anomalies (m, o) and those a lag before (m_lag, o_lag)."""
    col = F.col
    s = pairs.where("m is not null and o is not null and m_lag is not null and o_lag is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("m").alias("mm"), F.avg("o").alias("mo"), F.avg(col("m") ** 2).alias("qm"), F.avg(col("o") ** 2).alias("qo"), F.avg(col("m") * col("o")).alias("xmo"),
        F.avg(col("m") * col("m_lag")).alias("xm"), F.avg(col("o") * col("o_lag")).alias("xo"), F.avg(col("m") * col("o_lag")).alias("xml")).where(col("n") >= least)
    pos = lambda c: F.when(c > 0, c)
    s = s.withColumns({"cmm": pos(col("qm") - col("mm") ** 2), "coo": pos(col("qo") - col("mo") ** 2), "cmo": pos(col("xmo") - col("mm") * col("mo")), "lm": pos(col("xm") - col("mm") ** 2), "lo": pos(col("xo") - col("mo") ** 2), "lmo": pos(col("xml") - col("mm") * col("mo"))})
    s = s.withColumns({"s_ivd": F.sqrt(F.try_divide(col("lm"), col("lo"))), "s_ivs": F.try_divide(col("lmo"), col("lo"))})
    out = {}
    top = lambda c: F.when(c > 1, 1.0).otherwise(c)  # noqa: E731  (least() would turn a null into 1)
    for k in ("ivd", "ivs"):
        out[f"r2_mod_{k}"] = top(F.try_divide(col("cmo") * col(f"s_{k}"), col("cmm")))
        out[f"r2_obs_{k}"] = top(F.try_divide(F.try_divide(col("cmo"), col("coo")), col(f"s_{k}")))
    return s.withColumns(out).withColumn("r", F.try_divide(col("cmo"), F.sqrt(col("cmm") * col("coo")))).select(*keys, "n", *out, "r")


def triple(x: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Triple collocation of columns a, b, c: skill, error variances and fractional errors."""
    ok = x.where("a is not null and b is not null and c is not null").groupBy(*keys)
    s = ok.agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(p, q).alias(p + q) for p, q in ("aa", "bb", "cc", "ab", "ac", "bc")]).where(F.col("n") >= least)
    out = {}
    for p, (u, v, w) in {"a": ("ab", "ac", "bc"), "b": ("ab", "bc", "ac"), "c": ("ac", "bc", "ab")}.items():
        signal = F.try_divide(F.col(u) * F.col(v), F.col(w))
        r2 = F.try_divide(signal, F.col(p * 2))
        out[f"r2_{p}"] = F.when(r2 >= 0.001, F.least(F.lit(1.0), r2))
        out[f"err_{p}"] = F.col(p * 2) - signal
        out[f"sig_{p}"] = F.when(signal > 1e-12, signal)
    s = s.withColumns(out)
    kept = F.array_sort(F.filter(F.array("sig_a", "sig_b", "sig_c"), lambda z: z.isNotNull()))
    s = s.withColumn("kept", kept)
    mid = F.expr("CASE size(kept) WHEN 3 THEN kept[1] WHEN 2 THEN (kept[0] + kept[1]) / 2 WHEN 1 THEN kept[0] END")
    s = s.withColumn("signal", F.when(F.try_divide(F.array_max("kept"), F.array_min("kept")) <= 50, mid))
    return s.withColumns({f"fmse_{p}": F.when(F.try_divide(F.col(f"err_{p}"), F.col("signal")) >= 0, F.try_divide(F.col(f"err_{p}"), F.col("signal"))) for p in "abc"}).select(*keys, "n", *[f"{k}_{p}" for k in ("r2", "err", "fmse") for p in "abc"])


def ols_trend(x: DataFrame, keys: list[str], t: Column, value: str) -> DataFrame:
    """Slope by time; pairs with a null play no part."""
    return x.groupBy(*keys).agg(F.regr_slope(F.col(value), t).alias("slope"), F.count(value).alias("n"))


def index_trend(x: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Slope by the running number of a series' values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return ols_trend(x.where(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)), keys, F.col("_k"), value)


def cumulative_trend(x: DataFrame, keys: list[str], order: list[str], t: Column, value: str, skip: bool = False) -> DataFrame:
    """Slope of the running sum and the mean increment; a null counts as 0, or (``skip``) its row as none."""
    rows = x.where(F.col(value).isNotNull()) if skip else x.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    run = running_sum(rows, keys, order, value, "_total")
    return run.groupBy(*keys).agg(F.regr_slope(F.col("_total"), t).alias("slope"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def theil_sen_pairs(x: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """A30 for short series: the median of all slopes, by a self-join within the series."""
    a = x.where(F.col(value).isNotNull()).select(*keys, F.col(t).alias("t1"), F.col(value).alias("y1"))
    b = x.where(F.col(value).isNotNull()).select(*keys, F.col(t).alias("t2"), F.col(value).alias("y2"))
    p = a.join(b, keys).where("t1 < t2").select(*keys, ((F.col("y2") - F.col("y1")) / (F.col("t2") - F.col("t1"))).alias("slope"), F.signum(F.col("y2") - F.col("y1")).alias("sign"))
    return p.groupBy(*keys).agg(F.percentile("slope", F.lit(0.5)).alias("slope"), F.sum("sign").alias("s"), F.count(F.lit(1)).alias("pairs"))


def theil_sen_mk(x: DataFrame, key: str, t: str, value: str, least: int = 10) -> DataFrame:
    """Per series the median of pairwise slopes per decade and the Mann-Kendall p with ties; one shuffle on the series.

    The pairs are never formed: a series of n values takes n log^2 n steps and memory in proportion to n.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        own = g.dropna()
        n, out = len(own), {key: g[key].iloc[0], "slope_decade": None, "p": None, "n": len(own)}
        if n >= least:
            slope, s = trend.slope_and_s(own[t].to_numpy(float), own[value].to_numpy(float))
            ties = np.unique(own[value].to_numpy(float), return_counts=True)[1].astype(float)
            var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
            z = (s - np.sign(s)) / np.sqrt(var) if var > 0 else 0.0
            out["slope_decade"], out["p"] = None if slope is None else slope * 10, float(2 * (1 - dist.normal_cdf(abs(z))))
        return pd.DataFrame([out])

    kind = dict(x.dtypes)[key]
    return x.select(key, t, value).groupBy(key).applyInPandas(one, f"{key} {kind}, slope_decade double, p double, n long")


def validation(x: DataFrame, keys: list[str], order: list[str], least: int = 20, level: float = 0.95, port: bool = False) -> DataFrame:
    """R, bias, MSE and ubMSE of (obs, model) with intervals at the effective sample size. A series that never moves has no R, and counts whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = x.where("obs is not null and model is not null").withColumns({"ob": F.lag("obs").over(w), "mb": F.lag("model").over(w), "d": F.col("obs") - F.col("model")})
    s = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("obs", "model").alias("r"), pearson("obs", "ob").alias("rx"), pearson("model", "mb").alias("ry"), F.avg("d").alias("bias"), F.avg(F.col("d") ** 2).alias("mse"), F.stddev_samp("d").alias("sd"), F.stddev_samp(F.col("d") ** 2).alias("sd2")).where(F.col("n") > least)
    both = F.col("rx") * F.col("ry")
    own = both if port else F.col("rx") ** 2
    eff = lambda c: F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.try_divide(F.col("n") * (1 - c), 1 + c)))).cast("int")
    s = s.withColumns({"n_r": eff(both), "n_b": eff(own), "ubmse": F.col("mse") - F.col("bias") ** 2})
    z = float(dist.normal_quantile((1 + level) / 2))

    def factors(df: pd.Series) -> pd.DataFrame:
        """t and both chi-square quantiles; null below two degrees."""
        v = df.to_numpy(float)
        ok = v > 1
        free = np.where(ok, v - 1, 1)
        cut = lambda q: pd.Series(q).where(ok)
        return pd.DataFrame({"t": cut(dist.t_quantile((1 + level) / 2, free)), "up": cut(dist.chi2_quantile((1 + level) / 2, free)), "lo": cut(dist.chi2_quantile((1 - level) / 2, free))})

    # the factors of each effective size, once
    sizes = s.select("n_b").distinct().withColumn("_f", F.pandas_udf(factors, "t double, up double, lo double")("n_b"))
    s = s.join(sizes, "n_b")
    half = F.when(F.col("n_r") > 3, z / F.sqrt(F.greatest(F.lit(1), F.col("n_r") - 3)))
    r = F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1 + 1e-12), F.least(F.lit(1 - 1e-12), F.col("r"))))
    fisher = F.atanh(r)
    root = F.sqrt(F.greatest(F.lit(1), F.col("n_b")))
    free = (F.col("n_b") - 1) * F.col("ubmse")
    return s.withColumns({
        "r_lo": F.tanh(fisher - half), "r_up": F.tanh(fisher + half), "bias_half": F.col("_f.t") * F.col("sd") / root, "mse_half": F.col("_f.t") * F.col("sd2") / root,
        "ubmse_lo": F.try_divide(free, F.col("_f.up")), "ubmse_up": F.try_divide(free, F.col("_f.lo")),
    }).drop("sd", "sd2", "rx", "ry", "_f")


def sparse_tiles(x: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """the series with at least ceil(share x times) values, by a semi join."""
    need = x.select(F.ceil(F.countDistinct("ts") * share).alias("need"))
    good = x.groupBy(*keys).agg(F.count(value).alias("have")).join(F.broadcast(need)).where("have >= need").select(*keys)
    return x.join(good, keys, "left_semi")


def variance_parts(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population variance of daily values, within months, of monthly means and of annual means."""
    month, year = F.trunc("ts", "month"), F.year("ts")
    daily = x.groupBy(*keys).agg(F.var_pop(value).alias("var_daily"), F.count(value).alias("n"))
    m = x.groupBy(*keys, month.alias("m")).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("within")).groupBy(*keys).agg(F.avg("within").alias("var_within"), F.var_pop("mean").alias("var_monthly"))
    y = x.groupBy(*keys, year.alias("y")).agg(F.avg(value).alias("mean")).groupBy(*keys).agg(F.var_pop("mean").alias("var_annual"))
    return daily.join(m, keys).join(y, keys)


