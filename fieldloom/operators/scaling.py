"""Scaling statistics over a calendar spine.

The spine holds the days of a common year and, again, its first months, so that a trailing window can run over the
year's end: 455 rows for a window of 75 days. Each row says which years its month has. Rows meet the spine by month, day and a range of years, become daily sums,
and every window over the spine is the difference of two running sums: a day's sums enter with the first window that holds it and leave with the first that doesn't. So
a window costs the same whatever its width; extremes alone take a range frame. 29 February is on no spine.
"""

from __future__ import annotations

import calendar
import math
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .summaries import require_unique

YEAR = 365


def calendar_spine(spark: SparkSession, start: tuple[int, int], end: tuple[int, int], width: int) -> DataFrame:
    """t, month, day, first_year, last_year: a year and ceil(width / 30) months more.

    ``start`` and ``end`` are (year, month): a month before the starting one has its first year a year later, one after the ending one its last year a year earlier.
    """
    extra = sum(calendar.monthrange(2014, m)[1] for m in range(1, math.ceil(width / 30) + 1))
    day = F.expr(f"date_add(DATE '2014-01-01', CAST((t - 1) % {YEAR} AS INT))")
    days = spark.range(1, YEAR + extra + 1, numPartitions=1).select(F.col("id").cast("int").alias("t")).select("t", F.month(day).alias("month"), F.dayofmonth(day).alias("day"))
    return days.withColumns({"first_year": F.lit(start[0]) + (F.col("month") < start[1]).cast("int"), "last_year": F.lit(end[0]) - (F.col("month") > end[1]).cast("int")})


def daily_sums(x: DataFrame, spine: DataFrame, keys: list[str], sums: list[Column], ts: str = "ts") -> DataFrame:
    """Sums of the rows of each key and day of the spine."""
    days = spine.select("t", F.col("month").alias("_m"), F.col("day").alias("_d"), "first_year", "last_year")
    on = (F.month(ts) == F.col("_m")) & (F.dayofmonth(ts) == F.col("_d")) & F.year(ts).between(F.col("first_year"), F.col("last_year"))
    return x.join(F.broadcast(days), on).groupBy(*keys, "t").agg(*sums)  # a spine has 365 rows and one for each day of the width's months


def windows(daily: DataFrame, keys: list[str], days: int, width: int, sums: dict[str, tuple[str, int, int]], extremes: dict[str, Column] | None = None) -> DataFrame:
    """Sums over every window that ends on one of the spine's last 365 days; ``doy``, 1 to 365, is the day half a width before the end.

    ``sums``: name -> (column of ``daily``, first and last day of the frame, counted from the end). ``extremes``: aggregates of the whole width.
    """
    frames = dict.fromkeys((low, high) for _, low, high in sums.values())
    events = []
    for low, high in frames:
        own = [(n, c) for n, (c, a, z) in sums.items() if (a, z) == (low, high)]
        for at, sign in ((F.col("t") - high, 1), (F.col("t") - low + 1, -1)):
            events.append(F.struct(at.alias("at"), *[(sign * F.col(dict(own)[n]) if n in dict(own) else F.lit(None).cast("double")).cast("double").alias(n) for n in sums]))
    moves = daily.select(*keys, F.explode(F.array(*events)).alias("_e")).select(*keys, "_e.*").where(F.col("at") <= days)
    ends = daily.select(*keys).distinct().withColumn("at", F.explode(F.sequence(F.lit(days - YEAR + 1), F.lit(days)))).withColumn("_end", F.lit(True))
    both = moves.unionByName(ends, allowMissingColumns=True)
    over = Window.partitionBy(*keys).orderBy("at")
    if extremes:
        both = both.unionByName(daily.withColumnRenamed("t", "at").drop(*sums), allowMissingColumns=True)
    out = both.withColumns({n: F.coalesce(F.sum(n).over(over), F.lit(0.0)) for n in sums} | {n: c.over(over.rangeBetween(1 - width, 0)) for n, c in (extremes or {}).items()})
    return out.where("_end").withColumn("doy", F.pmod(F.col("at") - width // 2 - 1, F.lit(YEAR)) + 1)


def _mean_std(total: str, squares: str, n: str) -> tuple[Column, Column]:
    mean = F.try_divide(F.col(total), F.col(n))
    return mean, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(squares), F.col(n)) - mean * mean))


def scaling_calendar(x: DataFrame, keys: list[str], start: tuple[int, int], end: tuple[int, int], width: int = 75, least: int = 20) -> DataFrame:
    """A20 for every day: means and stds (population) of observation and model, count and the model's extremes over the ``width`` days that end half a width later.

    Counted are the observations; model sums take every row with a forecast and divide by that count, as published. ``pentad`` is that of the day, and ``stored`` says whether the day stands for it.
    """
    spine = calendar_spine(x.sparkSession, start, end, width)
    o, m = F.col("obs"), F.col("fcst")
    sums = [F.count(o).alias("_n"), F.sum(o).alias("_so"), F.sum(o * o).alias("_qo"), F.sum(m).alias("_sm"), F.sum(m * m).alias("_qm"), F.min(m).alias("_lo"), F.max(m).alias("_hi")]
    daily = daily_sums(x.where("fcst is not null"), spine, keys, sums)

    whole = {c[1:]: (c, 1 - width, 0) for c in ("_n", "_so", "_qo", "_sm", "_qm")}
    s = windows(daily, keys, spine.count(), width, whole, {"m_min": F.min("_lo"), "m_max": F.max("_hi")}).withColumn("n", F.round("n").cast("long")).where(F.col("n") >= least)
    (o_mean, o_std), (m_mean, m_std) = _mean_std("so", "qo", "n"), _mean_std("sm", "qm", "n")
    day = F.col("doy") + 2
    return s.select(*keys, "doy", F.floor(day / 5).cast("int").alias("pentad"), (day % 5 == 0).alias("stored"), "n", o_mean.alias("o_mean"), o_std.alias("o_std"), m_mean.alias("m_mean"), m_std.alias("m_std"), "m_min", "m_max")


FIELDS = ("o_mean", "o_std", "m_mean", "m_std", "n", "o_centre", "m_centre")


def scaling_angles(x: DataFrame, species: DataFrame, angles: list[float], start: tuple[int, int], end: tuple[int, int], width: int = 95, inner: int = 31, least: int = 20) -> DataFrame:
    """For each tile and day the statistics by polarisation (0: h, 1: v) as arrays over ``angles``; null where an angle has too few rows.

    ``species`` (species, pol, ang) tells the angles of a species, of which the first counts; species of other angles play no part. A window needs ``least`` rows, and more than
    least / 2.5 in its ``inner`` days if it has any; the centre day's means stand beside it. The query fails if a species comes twice in a tile and time.
    """
    place = F.array_position(F.array(*[F.lit(float(a)) for a in angles]), F.get("ang", F.lit(0)).cast("double"))
    kinds = species.select("species", F.col("pol").cast("int").alias("pol"), (place - 1).cast("int").alias("k")).where("k >= 0")
    rows = require_unique(x.where("fcst is not null"), ["ts", "species", "tile"]).where("obs is not null").join(kinds, "species")
    spine = calendar_spine(x.sparkSession, start, end, width)
    o, m, keys = F.col("obs"), F.col("fcst"), ["tile", "pol", "k"]
    daily = daily_sums(rows, spine, keys, [F.count(F.lit(1)).alias("_n"), F.sum(o).alias("_so"), F.sum(o * o).alias("_qo"), F.sum(m).alias("_sm"), F.sum(m * m).alias("_qm")])
    half = width // 2

    sums = {c[1:]: (c, 1 - width, 0) for c in ("_n", "_so", "_qo", "_sm", "_qm")} | {"n_inner": ("_n", -half - inner // 2, -half + inner // 2)} | {f"{c[1:]}_day": (c, -half, -half) for c in ("_n", "_so", "_sm")}
    s = windows(daily, keys, spine.count(), width, sums).withColumns({c: F.round(c) for c in ("n", "n_inner", "n_day")})
    enough = (F.col("n") >= least) & ((F.col("n_inner") >= least / 2.5) if inner else F.lit(True))
    values = [*_mean_std("so", "qo", "n"), *_mean_std("sm", "qm", "n"), F.col("n")]
    one = [F.when(enough, v).alias(f) for v, f in zip(values, FIELDS)] + [F.try_divide(F.col("so_day"), F.col("n_day")).alias("o_centre"), F.try_divide(F.col("sm_day"), F.col("n_day")).alias("m_centre")]
    s = s.select(*keys, "doy", *one).where(F.coalesce(*FIELDS).isNotNull())
    packed = s.groupBy("tile", "doy").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("pol", "k").alias("at"), F.struct(*FIELDS).alias("v")))).alias("by"))  # at most two rows for each angle
    side = lambda pol: F.transform(F.sequence(F.lit(0), F.lit(len(angles) - 1)), lambda k: F.try_element_at("by", F.struct(F.lit(pol).alias("pol"), k.alias("k"))))
    both = packed.select("tile", "doy", side(0).alias("h"), side(1).alias("v"))
    return both.select("tile", "doy", *[F.col(f"{p}.{f}").alias(f"{f}_{p}") for p in "hv" for f in FIELDS])
