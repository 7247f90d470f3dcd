"""Masks and validity filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import column_percentiles
from .series import monthly_climatology

# fixed values: what counts as a material increment
MATERIAL = {"sfmc": 0.0002, "catdef": 0.001, "snow": 0.001}
MATERIAL_OTHER = 0.0001


def finite(c: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def snowy_months(x: DataFrame, keys: list[str], value: str, first: int = 2001, last: int = 2020, least: float = 0.5) -> DataFrame:
    """rows of the calendar months whose mean over the years exceeds ``least``."""
    snowy = monthly_climatology(x, keys, value, first, last).where(F.col("clim") > least).select(*keys, "month")
    return x.withColumn("month", F.month("ts")).join(snowy, [*keys, "month"], "left_semi")


def propagate(x: DataFrame, masked: DataFrame, keys: list[str], value: str, columns: list[str]) -> DataFrame:
    """columns become null where ``value`` of the other table is null or has no row; its keys are unique."""
    seen = masked.where(finite(F.col(value))).select(*keys).withColumn("_seen", F.lit(True))
    return x.join(seen, keys, "left").withColumns({c: F.when(F.col("_seen"), F.col(c)) for c in columns}).drop("_seen")


def season(month: Column) -> Column:
    """F12."""
    return F.when(month.between(5, 9), "summer").when(month.isNotNull(), "winter")


def material(x: Column, kind: str) -> Column:
    """an increment larger than the limit of its kind."""
    return F.abs(x) > MATERIAL.get(kind, MATERIAL_OTHER)


def always_warm(x: DataFrame, keys: list[str], value: str, daily: str = "max", above: float = 10.0) -> DataFrame:
    """F16: the keys whose lowest daily max (or mean, min) lies above the limit."""
    per_day = {"max": F.max, "min": F.min, "mean": F.avg}[daily]
    days = x.groupBy(*keys, F.to_date("ts").alias("day")).agg(per_day(value).alias("v"))
    return days.groupBy(*keys).agg(F.min("v").alias("coldest")).where(F.col("coldest") > above)


def significant(p: Column, alpha: float = 0.05) -> Column:
    """false for a missing p."""
    return F.coalesce(finite(p) & (p < alpha), F.lit(False))


def enough(x: Column, n: Column, least: int = 20) -> Column:
    """null below the least count."""
    return F.when(n >= least, x)


def common_valid(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], least: int) -> DataFrame:
    """keys that have enough rows and finite statistics in both tables; columns get the suffixes _a and _b."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        ok = F.col("n") >= least
        for c in columns:
            ok = ok & finite(F.col(c))
        return df.where(ok).select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in ("n", *columns)])

    return side(a, "a").join(side(b, "b"), keys)


def complete(x: DataFrame, keys: list[str], axis: str, columns: list[str]) -> DataFrame:
    """rows of the keys that have every column finite at every value of the axis (tiles over times, or days over tiles)."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(F.col(c))
    whole = x.agg(F.countDistinct(axis).alias("_all"))
    good = x.groupBy(*keys).agg(F.bool_and(ok).alias("_ok"), F.countDistinct(axis).alias("_have")).where("_ok")
    # one row, so the broadcast is bounded
    return x.join(good.join(F.broadcast(whole)).where("_have = _all").select(*keys), keys, "left_semi")


def combine(wet: Column, below: Column) -> Column:
    """the wet mask wins, else the mask below the surface."""
    return F.when(wet == 1, 1).otherwise(below)


def percent_change(x: DataFrame, base: str, value: str, eps: float | None = None, tiny: float = 1e-8, share: float = 0.1, name: str = "percent") -> DataFrame:
    """percent change where the baseline exceeds ``eps``, or else max(tiny, its percentile ``share``)."""
    change = 100 * (F.col(value) - F.col(base)) / F.col(base)
    if eps is not None:
        return x.withColumn(name, F.when(F.col(base) > eps, change))
    floor = max(tiny, column_percentiles(x, base, [share])[0] or 0.0)
    return x.withColumn(name, F.when(F.col(base) > floor, change))


def cap(x: DataFrame, value: str, most: float = 500.0) -> DataFrame:
    """null above the cap, and ``capped`` says which."""
    over = F.coalesce(F.col(value) > most, F.lit(False))
    return x.withColumn("capped", over).withColumn(value, F.when(~F.col("capped"), F.col(value)))
