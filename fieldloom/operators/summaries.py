"""Summaries, lookups, smoothing and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .compare import consecutive, cycle_before
from .masks import MATERIAL_OTHER
from .quantiles import group_percentiles


# lookups and joins


def tile_lookup(x: DataFrame, tiles: DataFrame, number: str = "tilenum") -> DataFrame:
    """The tile row of a 1-based number; Spark broadcasts the tiles if its own size check allows."""
    return x.join(tiles, number)


def seen_by_both(x: DataFrame, key: str, sensor: str, a: str, b: str) -> DataFrame:
    """The rows whose key both sensors saw."""
    both = x.where(F.col(sensor).isin(a, b)).groupBy(key).agg(F.bool_or(F.col(sensor) == a).alias("a"), F.bool_or(F.col(sensor) == b).alias("b")).where("a and b").select(key)
    return x.join(both, key, "left_semi")


def in_every_source(x: DataFrame, keys: list[str], source: str, names: list[str], value: str) -> DataFrame:
    """Keys that all sources hold, one column each: one shuffle instead of a chain of joins."""
    wide = x.where(F.col(value).isNotNull()).groupBy(*keys).agg(*[F.avg(F.when(F.col(source) == n, F.col(value))).alias(n) for n in names])
    return wide.dropna(subset=names)


def lookup(x: DataFrame, climatology: DataFrame, keys: list[str]) -> DataFrame:
    """The climatology of a row's (tile, month), (tile, doy) or (cell, pentad)."""
    return x.join(climatology, keys)


def nearest_index(x: Column, first: float, step: float, count: int) -> Column:
    """The nearest point of a regular axis, of two equally near ones the lower index."""
    k = F.ceil((x - first) / step - 0.5).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), k))


def rounded_join(a: DataFrame, b: DataFrame, lon: str, lat: str, places: int = 3) -> DataFrame:
    """Left join on rounded coordinates."""
    key = lambda df: df.withColumns({"_x": F.round(F.col(lon), places), "_y": F.round(F.col(lat), places)})
    return key(a).join(key(b).drop(lon, lat), ["_x", "_y"], "left").drop("_x", "_y")


def station_time(ts: Column, kind: str) -> Column:
    """The key that a station's time shares with the model's."""
    if kind == "daily":
        return F.date_trunc("day", ts)
    if kind == "exact":
        return ts
    return F.date_trunc("day", ts) + F.make_dt_interval(hours=(F.floor(F.hour(ts) / 3) * 3).cast("int"))


def triplicates(x: DataFrame, keys: list[str], cycle: str, value: str, row: str) -> DataFrame:
    """Rows that repeat the cycle before and are repeated in the next."""
    p = consecutive(x, keys, cycle, value, row)
    later = p.select(F.col("first_row").alias(row), F.col(row).alias("next_row")).groupBy(row).agg(F.min("next_row").alias("next_row"))
    return p.join(later, row).select("first_row", row, "next_row", cycle)


# observation audits


def tile_profile(ofa: DataFrame, keys: list[str], order: list[str], first: list[str], high: float = 0.9) -> DataFrame:
    """Extremes, counts, the mean, and the first row's coordinates."""
    at = F.struct(*order)
    return ofa.where("obs is not null").groupBy(*keys).agg(F.max("obs").alias("max_obs"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("obs") > high).alias("n_high"), F.avg("obs").alias("mean_obs"), *[F.min_by(c, at).alias(f"first_{c}") for c in first])


def tile_sums(ofa: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums and squares of O, F, A, O-F and O-A in one hash aggregation."""
    v = {"o": F.col("obs"), "f": F.col("fcst"), "a": F.col("ana"), "omf": F.col("obs") - F.col("fcst"), "oma": F.col("obs") - F.col("ana")}
    return ofa.where("obs is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{k}") for k, c in v.items()], *[F.sum(c * c).alias(f"q_{k}") for k, c in v.items()])


def duplicate_keys(x: DataFrame, cycle: str, keys: list[str]) -> DataFrame:
    """Rows minus distinct keys of each cycle."""
    return x.groupBy(cycle, *keys).agg(F.count(F.lit(1)).alias("c")).groupBy(cycle).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("n_duplicate"))


def duplicate_report(x: DataFrame, keys: list[str], cycle: str, value: str, other: str, row: str, tolerance: float = 1e-6) -> DataFrame:
    """Per cycle, the rows that repeat the cycle before, their share of both cycles, and how their ``other`` value differs from that of their first match (of equal row ids the smallest value)."""
    p = cycle_before(x.select(*keys, cycle, value, other, row), keys, cycle, value, F.min(F.struct(F.col(row).alias("_r"), F.col(other).alias("_o"))), tolerance)
    one = written(p.groupBy(row, cycle).agg((F.min(other) - F.min("_first")["_o"]).alias("d")), "repeats")
    stats = one.groupBy(cycle).agg(F.count(F.lit(1)).alias("n_dup"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.avg((F.abs("d") > 1e-3).cast("int")).alias("share_large"))
    # both measures in one pass, as two kinds of rows
    both = one.select(cycle, F.posexplode(F.array("d", F.abs("d"))).alias("_kind", "_d"))
    p = group_percentiles(both, [cycle, "_kind"], "_d", [0.5, 0.95])
    p = p.groupBy(cycle).agg(F.max(F.when(F.col("_kind") == 0, F.get("p", F.lit(0)))).alias("median"), F.max(F.when(F.col("_kind") == 1, F.get("p", F.lit(1)))).alias("p95_abs"))
    stats = stats.join(p, cycle, "left")
    n = x.groupBy(cycle).agg(F.count(F.lit(1)).alias("n_now"))
    before = n.select((F.col(cycle) + 1).alias(cycle), F.col("n_now").alias("n_before"))
    out = stats.join(n, cycle).join(before, cycle)
    return out.withColumns({"share_now": F.col("n_dup") / F.col("n_now"), "share_before": F.col("n_dup") / F.col("n_before")}).drop("n_now", "n_before")


def require_unique(x: DataFrame, keys: list[str]) -> DataFrame:
    """A21's check: the query fails if a key comes twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return x.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"repeated key {keys}")).cast("boolean"))).drop("_n")


# climatologies and windows


def station_anomaly(x: DataFrame, keys: list[str], value: str, least: int = 150, half: int = 15) -> DataFrame:
    """Minus the mean of all values within ``half`` days of the day of year, on a circle of 365; day 366 counts as 365; null below the least count."""
    v = x.withColumn("doy", F.least(F.lit(365), F.dayofyear("ts")))
    part = v.where(F.col(value).isNotNull()).groupBy(*keys, F.col("doy").alias("_d")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    near = part.withColumn("_k", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("doy", F.pmod(F.col("_d") - 1 + F.col("_k"), F.lit(365)) + 1)
    clim = near.groupBy(*keys, "doy").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).where(F.col("_n") >= least).select(*keys, "doy", (F.col("_s") / F.col("_n")).alias("clim"))
    return v.join(clim, [*keys, "doy"], "left").withColumn("anom", F.col(value) - F.col("clim"))


def scaling_inner(x: DataFrame, keys: list[str], width: int = 95, inner: int = 31, least: int = 20) -> DataFrame:
    """Scaling windows that also need more than least / 2.5 rows in the inner days; keys hold polarisation and angle."""
    d = x.where("fcst is not null and obs is not null and not (month(ts) = 2 and day(ts) = 29)")
    leap = F.dayofyear(F.last_day(F.concat(F.year("ts"), F.lit("-12-01")).cast("date"))) == 366
    doy = F.dayofyear("ts") - F.when(leap & (F.dayofyear("ts") >= 61), 1).otherwise(0)
    part = d.groupBy(*keys, doy.alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.sum("obs").alias("so"), F.sum(F.col("obs") ** 2).alias("qo"), F.sum("fcst").alias("sm"), F.sum(F.col("fcst") ** 2).alias("qm"))
    half = width // 2
    near = part.withColumn("_k", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("doy", F.pmod(F.col("_d") - 1 + F.col("_k"), F.lit(365)) + 1).where("(doy + 2) % 5 = 0")
    s = near.groupBy(*keys, ((F.col("doy") + 2) / 5).cast("int").alias("pentad")).agg(
        *[F.sum(c).alias(c) for c in ("n", "so", "qo", "sm", "qm")], F.sum(F.when(F.abs("_k") <= inner // 2, F.col("n")).otherwise(0)).alias("n_inner")).where((F.col("n") >= least) & (F.col("n_inner") > least / 2.5))
    std = lambda q, m: F.sqrt(F.greatest(F.lit(0.0), F.col(q) / F.col("n") - F.pow(F.col(m) / F.col("n"), 2)))
    return s.select(*keys, "pentad", "n", "n_inner", (F.col("so") / F.col("n")).alias("o_mean"), std("qo", "so").alias("o_std"), (F.col("sm") / F.col("n")).alias("m_mean"), std("qm", "sm").alias("m_std"))


def smooth(x: DataFrame, keys: list[str], order: list[str], value: str, half: int = 1, name: str = "smooth") -> DataFrame:
    """The centred mean of rows, nulls left out."""
    return x.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)))


def fill_gaps(x: DataFrame, keys: list[str], order: list[str], value: str, half: int = 10) -> DataFrame:
    """A null takes the centred mean."""
    return x.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half))))


def step_difference(x: DataFrame, keys: list[str], order: list[str], value: str, name: str = "step") -> DataFrame:
    """W8."""
    return x.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def minus_group_mean(x: DataFrame, keys: list[str], value: str, name: str = "anom") -> DataFrame:
    """By an aggregate and a join, so that the mean of a hot group is combined before the shuffle."""
    means = x.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return x.join(means, keys).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


# summaries


def network_summary(x: DataFrame, keys: list[str], value: str, low: str, up: str) -> DataFrame:
    """Over sites: mean, std, count, and the limits' means over the root of the count."""
    n = F.count(value)
    return x.where(F.col(value).isNotNull()).groupBy(*keys).agg(n.alias("n_sites"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), (F.avg(low) / F.sqrt(n)).alias("ci_lo"), (F.avg(up) / F.sqrt(n)).alias("ci_up"))


def annual_summary(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample std of annual means."""
    year = x.groupBy(*keys, F.year("ts").alias("year")).agg(F.avg(value).alias("v"))
    return year.groupBy(*keys).agg(F.count("v").alias("n_years"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def standard_error(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A39."""
    return x.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("se"))


def area_series(x: DataFrame, keys: list[str], value: str, area: str) -> DataFrame:
    """Weighted by the area of what isn't null."""
    has = F.when(F.col(value).isNotNull(), F.col(area))
    return x.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(area)), F.sum(has)).alias(value))


def increment_total(surface: Column, root: Column, deficit: Column) -> Column:
    """The water that an increment adds."""
    return surface + root - deficit


def snow_total(*layers: Column) -> Column:
    """The snow that an increment adds to its layers; null if one is."""
    return sum(layers[1:], layers[0])


def increment_stats(x: DataFrame, keys: list[str], value: str, limit: float = MATERIAL_OTHER) -> DataFrame:
    """Mean, population std and count of material increments, per tile or per time."""
    return x.where(F.abs(F.col(value)) > limit).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def monthly_increments(x: DataFrame, keys: list[str], value: str, limit: float = 0.001) -> DataFrame:
    """The sum of all, and count and mean of those above the limit."""
    big = F.when(F.abs(F.col(value)) > limit, F.col(value))
    return x.groupBy(*keys, F.trunc("ts", "month").alias("month")).agg(F.sum(value).alias("total"), F.count(big).alias("n_material"), F.avg(big).alias("mean_material"))


def state_summary(x: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and population std of every state, per tile or per time."""
    return x.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns])


def coverage(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct days with a value, the first and the last."""
    day = x.where(F.col(value).isNotNull()).select(*keys, F.to_date("ts").alias("day")).distinct()
    return day.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def count_shares(counts: DataFrame, keys: list[str], n: str, limits: tuple[int, ...] = (6, 11, 21)) -> DataFrame:
    """The share of cells below each count."""
    return counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), *[F.avg((F.col(n) < k).cast("int")).alias(f"below_{k}") for k in limits])


def qc_loss(x: DataFrame, keys: list[str], slices: list[str], value: str, bad: Column) -> DataFrame:
    """The share of values that a flag removes in each slice, averaged over slices."""
    has = F.col(value).isNotNull()
    part = x.groupBy(*keys, *slices).agg(F.try_divide(F.count_if(has & F.coalesce(bad, F.lit(False))), F.count_if(has)).alias("loss"))
    return part.groupBy(*keys).agg(F.count("loss").alias("n_slices"), F.avg("loss").alias("loss"))


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """B - a and its percentage, null for a = 0."""
    p = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return p.select(*keys, (F.col("_b") - F.col("_a")).alias("diff"), F.when(F.col("_a") != 0, 100 * (F.col("_b") - F.col("_a")) / F.col("_a")).alias("percent"))


def skill_root(r2: Column, observed: Column) -> Column:
    """R from its square; null below 0.1 and where the observed R is null."""
    r = F.sqrt(r2)
    return F.when((r >= 0.1) & observed.isNotNull(), r)


def distributions(x: DataFrame, dataset: str, value: str, bins: int = 50) -> DataFrame:
    """Counts and cumulative shares of every dataset over the same equal bins of the whole range."""
    edges = x.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    k = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins), F.floor((F.col(value) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) + 1)).otherwise(1).cast("int")
    counts = x.where(F.col(value).isNotNull()).join(F.broadcast(edges)).groupBy(dataset, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(dataset)  # at most ``bins`` rows
    return counts.withColumn("cumulative", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w))


def monthly_anomaly(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Monthly means minus their mean."""
    m = x.groupBy(*keys, F.trunc("ts", "month").alias("month")).agg(F.avg(value).alias("mean"))
    return minus_group_mean(m, keys, "mean").select(*keys, "month", "mean", "anom")


def day_mean(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Daily means; negative values count as missing."""
    v = F.when(F.col(value) >= 0, F.col(value))
    return x.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.avg(v).alias(value), F.count(v).alias("n"))


def place(a: DataFrame, b: DataFrame, tiles: DataFrame, tile: str, value: str) -> DataFrame:
    """Both values at the tile's cell (i, j), null where either is."""
    p = a.select(tile, F.col(value).alias("a")).join(b.select(tile, F.col(value).alias("b")), tile, "full").join(tiles.select(tile, "i", "j"), tile)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return p.select("i", "j", tile, F.when(both, F.col("a")).alias("a"), F.when(both, F.col("b")).alias("b"))


def cumulative_millions(x: DataFrame, keys: list[str], order: list[str], count: str) -> DataFrame:
    """Running sums of counts in millions; a null counts as 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("millions", F.sum(F.coalesce(F.col(count), F.lit(0))).over(w) / 1e6)


def innovation_profile(ofa: DataFrame, keys: list[str]) -> DataFrame:
    """Means of O and F; mean, largest size and population std of O-F, O-A and A-F."""
    v = {"omf": F.col("obs") - F.col("fcst"), "oma": F.col("obs") - F.col("ana"), "amf": F.col("ana") - F.col("fcst")}
    extra = [f(c).alias(f"{p}_{k}") for k, c in v.items() for p, f in (("mean", F.avg), ("max", lambda c: F.max(F.abs(c))), ("std", F.stddev_pop))]
    return ofa.where("obs is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("obs").alias("mean_o"), F.avg("fcst").alias("mean_f"), *extra)


# selection and sets


def top(x: DataFrame, value: str, tie: str, k: int = 10) -> DataFrame:
    """A top-k report of non-null values."""
    return x.where(F.col(value).isNotNull()).orderBy(F.desc(value), tie).limit(k)


def ordered(x: DataFrame, *order: str) -> DataFrame:
    """T3."""
    return x.orderBy(*order)


def nth_of_group(x: DataFrame, keys: list[str], order: list[str], n: int = 0) -> DataFrame:
    """T4, T5: row ``n`` (from 0) of each group."""
    return x.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == n + 1).drop("_n")


def common_keys(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct keys that all tables hold."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*keys) for t in tables]).distinct()


def without(x: DataFrame, lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows in none of the exclusion lists."""
    union = reduce(lambda a, b: a.unionByName(b), [t.select(*keys) for t in lists]).distinct()
    return x.join(union, keys, "left_anti")
