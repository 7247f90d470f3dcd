"""Observation-space statistics from mergeable sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import pearson

SUMMED = ("obs", "obsvar", "fcst", "fcstvar", "ana", "anavar")
CROSS = (("obs", "fcst"), ("obs", "ana"), ("fcst", "ana"))


def clean(x: Column, fill: float = -9999.0, huge: float = 1e10) -> Column:
    """fills, huge and non-finite values become null."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= huge) | (F.abs(x - fill) < 0.01), None).otherwise(x)


def assimilated(ofa: DataFrame, params: DataFrame) -> DataFrame:
    """of species that are assimilated only the assimilated rows; params (species, assimilates) is a small dimension, and is broadcast: a few species would be a few tasks that sort all rows."""
    return ofa.join(F.broadcast(params), "species").where(~F.col("assimilates") | F.col("assim"))


def month_of(ts: Column) -> Column:
    """A month runs from 03:00 on its first day to 00:00 of the next month, inclusive."""
    return F.trunc(ts - F.expr("INTERVAL 3 HOURS"), "month")


def partial_sums(ofa: DataFrame, keys: list[str], deal: list[str] | None = None) -> DataFrame:
    """A1: n, sums, squares and cross sums.

    One partial and final hash aggregation; or, where groups are nearly as many as rows, the rows are dealt by some of the keys first, so that
    no task holds more groups than its share of them, and the few columns of a row travel in place of its many sums.
    """
    have = [c for c in SUMMED if c in ofa.columns]
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s_{c}") for c in have] + [F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in have]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"x_{a}_{b}") for a, b in CROSS]
    x = ofa.where("obs is not null")
    x = x.select(*keys, *[c for c in have if c not in keys]).repartition(*deal) if deal else x
    return x.groupBy(*keys).agg(*sums)


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A2: partial sums add up, whatever they were summed over."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c == "n" or c[:2] in ("s_", "q_", "x_")])


def finalise(sums: DataFrame) -> DataFrame:
    """A3: means, O-F and O-A mean and std (population), normalised mean and std."""
    mean = lambda c: F.try_divide(F.col(f"s_{c}"), F.col("n"))
    var = lambda c: F.try_divide(F.col(f"q_{c}"), F.col("n")) - mean(c) * mean(c)

    def spread(a: str, b: str) -> Column:
        cov = F.try_divide(F.col(f"x_{a}_{b}"), F.col("n")) - mean(a) * mean(b)
        v = var(a) + var(b) - 2 * cov
        # what is left of the cancelled squares below their rounding noise is nothing
        return F.sqrt(F.when(v > 1e-13 * (F.try_divide(F.col(f"q_{a}") + F.col(f"q_{b}"), F.col("n"))), v).when(v.isNotNull(), 0.0))

    noise = mean("obsvar") + mean("fcstvar")
    return sums.withColumns({
        "omf_mean": mean("obs") - mean("fcst"), "omf_std": spread("obs", "fcst"), "oma_mean": mean("obs") - mean("ana"), "oma_std": spread("obs", "ana"),
        "norm_mean": F.try_divide(mean("obs") - mean("fcst"), F.sqrt(noise)), "norm_std": F.try_divide(spread("obs", "fcst"), F.sqrt(noise)),
        "mean_obs": mean("obs"), "mean_fcst": mean("fcst"), "mean_ana": mean("ana"),
    })


def weighted(stats: DataFrame, keys: list[str], columns: list[str], least: int = 20, legacy: bool = False) -> DataFrame:
    """A4: means weighted by counts; groups below the least count have no weight (``legacy``: their counts stay in the divisor)."""
    ok = F.col("n") >= least
    n = F.sum(F.col("n") if legacy else F.when(ok, F.col("n")).otherwise(0))
    return stats.groupBy(*keys).agg(*[F.try_divide(F.sum(F.when(ok, F.col(c) * F.col("n"))), n).alias(c) for c in columns], F.sum("n").alias("n"))


def pooled_group(parts: DataFrame, keys: list[str], tile: str) -> DataFrame:
    """The partial sums of a group's species pooled for each tile, finalised, then the plain mean over tiles."""
    stats = finalise(merge(parts, [*keys, tile]))
    return stats.groupBy(*keys).agg(F.sum("n").alias("n"), F.avg("omf_mean").alias("omf_mean"), F.avg("omf_std").alias("omf_std"))


def daily_series(ofa: DataFrame, keys: list[str]) -> DataFrame:
    """A7."""
    omf, oma = F.col("obs") - F.col("fcst"), F.col("obs") - F.col("ana")
    return ofa.where("obs is not null and fcst is not null and ana is not null").groupBy(F.to_date("ts").alias("day"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("obs").alias("mean_obs"), F.avg("fcst").alias("mean_fcst"), F.avg("ana").alias("mean_ana"), F.avg(omf).alias("omf_mean"), F.avg(oma).alias("oma_mean"),
        F.max(F.abs(omf)).alias("omf_max"), F.stddev_pop(omf).alias("omf_std"), F.stddev_pop(oma).alias("oma_std"))


def joint_coverage(ofa: DataFrame, a: str, b: str) -> DataFrame:
    """Per day the (hour, tile) pairs that both sensors saw."""
    seen = ofa.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "tile").agg(F.bool_or(F.col("sensor") == a).alias("a"), F.bool_or(F.col("sensor") == b).alias("b"))
    return seen.groupBy("day").agg(F.count_if(F.col("a") & F.col("b")).alias("n_both"))


def extended(ofa: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Means, sample variance, the third-moment skew, sample covariance, extremes, times."""
    v = ofa.where("obs is not null").select(*keys, "ts", (F.col("obs") - F.col("fcst")).alias("d"), (F.col("obs") - F.col("ana")).alias("e"), "obs", "ana")
    s = v.groupBy(*keys).agg(F.count("d").alias("n"), F.sum("d").alias("s1"), F.sum(F.col("d") ** 2).alias("s2"), F.sum(F.col("d") ** 3).alias("s3"), F.covar_samp("d", "e").alias("cov"), F.min("e").alias("oma_min"), F.max("e").alias("oma_max"), pearson("obs", "ana").alias("oa_corr"), F.countDistinct("ts").alias("n_times"))
    m = F.col("s1") / F.col("n")
    var = F.try_divide(F.col("s2") - F.col("n") * m * m, F.col("n") - 1)
    s = s.where(F.col("n") >= least).withColumns({"mean": m, "var": var})
    skew = F.try_divide(F.col("s3") / (F.col("n") - 1) - 3 * (F.col("s2") / F.col("n")) * F.col("mean") + 2 * F.col("mean") ** 3, F.pow(F.greatest(F.lit(0.0), F.col("var")), 1.5))
    return s.withColumn("skew", skew).drop("s1", "s2", "s3")


def moments(ofa: DataFrame, keys: list[str], month: bool = False, normalise: bool = False, hour: int | None = None) -> DataFrame:
    """Centred moments of O-F (to the third order) and O-A (to the second), their co-moment, O-A's extremes, and those of obs and ana.

    Rows need obs, fcst and ana. ``normalise`` divides O-F by the root of the ensemble variances (rows without a positive one play no part), ``hour`` takes the rows of an hour of the day, ``month`` adds the month as a key.
    Centred sums come from Spark's own central moments, which merge partial results without cancelling, so means much larger than spreads do no harm.
    """
    noise = F.col("obsvar") + F.col("fcstvar")
    x = ofa.where("obs is not null and fcst is not null and ana is not null")
    x = x.where(noise > 0) if normalise else x
    x = x.where(F.hour("ts") == hour) if hour is not None else x
    x = x.withColumn("month", month_of(F.col("ts"))) if month else x
    omf = F.col("obs") - F.col("fcst")
    x = x.withColumns({"_d": omf / F.sqrt(noise) if normalise else omf, "_e": F.col("obs") - F.col("ana")})
    var_pop = lambda c: F.var_pop(c) * F.count(F.lit(1))
    co = lambda a, b: F.covar_pop(a, b) * F.count(F.lit(1))
    third = F.when(F.var_pop("_d") > 0, F.skewness("_d") * F.pow(F.var_pop("_d"), 1.5) * F.count(F.lit(1))).otherwise(0.0)
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_d").alias("m_d"), F.avg("_e").alias("m_e"), F.avg("obs").alias("m_o"), F.avg("ana").alias("m_a"), F.avg("obsvar").alias("m_ov"), F.avg("fcstvar").alias("m_fv"),
        var_pop("_d").alias("dd"), var_pop("_e").alias("ee"), co("_d", "_e").alias("de"), var_pop("obs").alias("oo"), var_pop("ana").alias("aa"), co("obs", "ana").alias("oa"), third.alias("ddd"), F.min("_e").alias("oma_min"), F.max("_e").alias("oma_max"))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the union of what the parts cover: means first, then every part's sums about the new mean."""
    w = Window.partitionBy(*keys)
    means = ("m_d", "m_e", "m_o", "m_a", "m_ov", "m_fv")
    x = parts.withColumns({f"_{c}": F.col(c) - F.sum(F.col(c) * F.col("n")).over(w) / F.sum("n").over(w) for c in means})  # each part's distance from the mean of all
    n, d = F.col("n"), F.col("_m_d")
    moved = {a + b: F.col(a + b) + n * F.col(f"_m_{a}") * F.col(f"_m_{b}") for a, b in ("dd", "ee", "de", "oo", "aa", "oa")}
    moved["ddd"] = F.col("ddd") + 3 * d * F.col("dd") + n * d * d * d
    sums = [F.sum(v).alias(k) for k, v in moved.items()]
    return x.groupBy(*keys).agg(F.sum("n").alias("n"), *[(F.sum(F.col(c) * n) / F.sum("n")).alias(c) for c in means], *sums, F.min("oma_min").alias("oma_min"), F.max("oma_max").alias("oma_max"))


def moment_statistics(m: DataFrame, least: int = 1) -> DataFrame:
    """Means, sample variances, the published third-moment skew, sample covariance, extremes, ensemble variances and the correlation of obs and ana.

    The published skew is (S3 / (n - 1) - 3 m S2 / n + 2 m^3) / var^1.5 of raw sums, which is (M3 + 3 m M2 / n + m^3) / (n - 1) / var^1.5 of centred ones.
    """
    n, mean = F.col("n"), F.col("m_d")
    var = F.try_divide(F.col("dd"), n - 1)
    skew = F.try_divide((F.col("ddd") + 3 * mean * F.col("dd") / n + mean * mean * mean) / F.nullif(n - 1, F.lit(0)), F.pow(var, 1.5))
    return m.where(n >= least).select(
        *[c for c in m.columns if c not in {"n", "m_d", "m_e", "m_o", "m_a", "m_ov", "m_fv", "dd", "ee", "de", "oo", "aa", "oa", "ddd", "oma_min", "oma_max"}], "n", mean.alias("omf_mean"), var.alias("omf_var"), skew.alias("omf_skew"),
        F.col("m_e").alias("oma_mean"), F.try_divide(F.col("ee"), n - 1).alias("oma_var"), F.try_divide(F.col("de"), n - 1).alias("cov"), "oma_min", "oma_max", F.col("m_ov").alias("obsvar"), F.col("m_fv").alias("fcstvar"),
        F.try_divide(F.col("oa"), F.sqrt(F.col("oo") * F.col("aa"))).alias("oa_corr"))


def histogram(ofa: DataFrame, keys: list[str], low: float, step: float, bins: int) -> DataFrame:
    """A10: fixed bins; the first and the last hold what lies outside."""
    k = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("obs") - F.col("fcst") - low) / step))).cast("int")
    return ofa.where("obs is not null and fcst is not null").groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def frozen_mask(x: Column, tsoil: Column, frozen: Column, warm: float = 275.15, most: float = 0.01, missing_masks: bool = False) -> Column:
    """null where the soil is frozen or snow lies; a missing mask value masks only if asked."""
    cold = F.coalesce(tsoil < warm, F.lit(missing_masks)) | F.coalesce(frozen > most, F.lit(missing_masks))
    return F.when(~cold, x)
