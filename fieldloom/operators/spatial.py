"""Spatial joins and regridding.

Nearest and radius joins are equi-joins on grid buckets: the one side is copied
to the buckets around it, so no plan holds a nested loop or a cross join. Both sides
come as distinct places, so rows that share one cost a row, not a square; the result
of a place is joined back to its rows. These joins are merged, not broadcast: Spark's
guess of a side's size knows nothing of the copies, and a broadcast is built on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import haversine


def _near(left: DataFrame, right: DataFrame, radius: float, lx: str, ly: str, rx: str, ry: str) -> DataFrame:
    """Pairs whose buckets of side ``radius`` are neighbours."""
    around = F.sequence(F.lit(-1), F.lit(1))
    a = left.withColumns({"_bx": F.floor(F.col(lx) / radius), "_by": F.floor(F.col(ly) / radius)})
    b = right.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    b = b.withColumns({"_bx": F.floor(F.col(rx) / radius) + F.col("_dx"), "_by": F.floor(F.col(ry) / radius) + F.col("_dy")}).drop("_dx", "_dy")
    return a.hint("merge").join(b, ["_bx", "_by"]).drop("_bx", "_by")


def _back(left: DataFrame, key: str, xy: tuple[str, str], places: DataFrame) -> DataFrame:
    """The key of every row of ``left`` with what was found for its place."""
    return left.select(key, *xy).hint("merge").join(places, list(xy))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """All pairs within ``radius`` (degrees), with the squared distance d2."""
    pairs = _near(left, right, radius, *left_xy, *right_xy)
    d2 = (F.col(left_xy[0]) - F.col(right_xy[0])) ** 2 + (F.col(left_xy[1]) - F.col(right_xy[1])) ** 2
    return pairs.withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def nearest(left: DataFrame, right: DataFrame, key: str, tile: str, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """For each key the nearest tile within ``radius``; ties go to the lowest tile."""
    p = radius_pairs(left.select(*left_xy).distinct(), right.groupBy(*right_xy).agg(F.min(tile).alias(tile)), radius, left_xy, right_xy)
    best = p.groupBy(*left_xy).agg(F.min(F.struct("d2", tile)).alias("b"))
    return _back(left, key, left_xy, best).groupBy(key).agg(F.min("b").alias("b")).select(key, F.col(f"b.{tile}").alias(tile), F.sqrt("b.d2").alias("distance"))


def _earth_cells(lat: Column, lon: Column, side: float, reach: float = 0.0) -> Column:
    """The cells of ``side`` (of the unit sphere's space) that lie within ``reach`` of a point along each axis: one, or at most eight."""
    la, lo = F.radians(lat), F.radians(lon)
    axes = [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]
    near = [F.array_distinct(F.array(F.floor((x - reach) / side), F.floor((x + reach) / side))) for x in axes]
    return F.flatten(F.transform(near[0], lambda i: F.flatten(F.transform(near[1], lambda j: F.transform(near[2], lambda k: F.array(i, j, k))))))


def nearest_km(left: DataFrame, right: DataFrame, key: str, tile: str, km: float, left_ll: tuple[str, str], right_ll: tuple[str, str], radius: float = 6371.0) -> DataFrame:
    """Nearest on the sphere within ``km``, at any latitude: buckets are cells of space, so neither poles nor the date line are special."""
    chord = 2 * math.sin(min(math.pi, km / radius) / 2) * (1 + 1e-9) + 1e-12
    a = left.select(*left_ll).distinct().withColumn("_cell", F.element_at(_earth_cells(F.col(left_ll[0]), F.col(left_ll[1]), 2 * chord), 1))
    b = right.groupBy(*right_ll).agg(F.min(tile).alias(tile)).withColumn("_cell", F.explode(_earth_cells(F.col(right_ll[0]), F.col(right_ll[1]), 2 * chord, chord)))
    p = a.hint("merge").join(b, "_cell").drop("_cell")
    p = p.withColumn("km", haversine(F.col(left_ll[0]), F.col(left_ll[1]), F.col(right_ll[0]), F.col(right_ll[1]), radius)).where(F.col("km") <= km)
    best = p.groupBy(*left_ll).agg(F.min(F.struct("km", tile)).alias("b"))
    return _back(left, key, left_ll, best).groupBy(key).agg(F.min("b").alias("b")).select(key, F.col(f"b.{tile}").alias(tile), F.col("b.km").alias("km"))


def _sums(obs: DataFrame, xy: tuple[str, str], value: str) -> DataFrame:
    """What each place holds: the count and sum of its values."""
    return obs.groupBy(*xy).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))


def pool(obs: DataFrame, cells: DataFrame, radius: float, obs_xy: tuple[str, str], cell_xy: tuple[str, str], key: str, value: str) -> DataFrame:
    """Each cell takes every observation within the radius."""
    p = radius_pairs(cells.select(*cell_xy).distinct(), _sums(obs, obs_xy, value), radius, cell_xy, obs_xy)
    places = p.groupBy(*cell_xy).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    return _back(cells, key, cell_xy, places).groupBy(key).agg(F.sum("_n").alias("n"), F.try_divide(F.sum("_s"), F.sum("_n")).alias("mean"))


def inverse_distance(obs: DataFrame, cells: DataFrame, radius: float, obs_xy: tuple[str, str], cell_xy: tuple[str, str], key: str, value: str) -> DataFrame:
    """J24, re-aimed: inverse-distance weights instead of natural neighbours; the numbers differ."""
    w = 1 / (F.col("d2") + 1e-9)
    p = radius_pairs(cells.select(*cell_xy).distinct(), _sums(obs.where(F.col(value).isNotNull()), obs_xy, value), radius, cell_xy, obs_xy)
    places = p.groupBy(*cell_xy).agg(F.sum(w * F.col("_s")).alias("_s"), F.sum(w * F.col("_n")).alias("_w"))
    return _back(cells, key, cell_xy, places).groupBy(key).agg((F.sum("_s") / F.sum("_w")).alias(value))


def overlap_weights(src: DataFrame, dst: DataFrame, src_id: str, dst_id: str, side: float) -> DataFrame:
    """Areas shared by boxes (x0, x1, y0, y1), found by the buckets of ``side`` that they cover."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        out = df
        for a in "xy":
            out = out.withColumn(f"_b{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / side), F.ceil(F.col(f"{a}1") / side) - 1)))
        return out.select(p, "_bx", "_by", *[F.col(c).alias(f"{p}_{c}") for c in ("x0", "x1", "y0", "y1")])

    both = spread(src, src_id).join(spread(dst, dst_id), ["_bx", "_by"])
    part = lambda a: F.greatest(F.lit(0.0), F.least(F.col(f"{src_id}_{a}1"), F.col(f"{dst_id}_{a}1")) - F.greatest(F.col(f"{src_id}_{a}0"), F.col(f"{dst_id}_{a}0")))
    return both.withColumn("w", part("x") * part("y")).where("w > 0").groupBy(src_id, dst_id).agg(F.max("w").alias("w"))


def regrid(values: DataFrame, weights: DataFrame, src_id: str, dst_id: str, value: str, keys: list[str]) -> DataFrame:
    """Weighted means over what isn't null."""
    ok = F.col(value).isNotNull()
    return values.join(weights, src_id).groupBy(dst_id, *keys).agg(F.try_divide(F.sum(F.when(ok, F.col("w") * F.col(value))), F.sum(F.when(ok, F.col("w")))).alias(value))


def coarsen(cells: DataFrame, block: int, counts: list[str], means: list[str]) -> DataFrame:
    """Blocks of cells; counts add up, other values are averaged over what isn't null."""
    return cells.groupBy(F.floor(F.col("j") / block).alias("j"), F.floor(F.col("i") / block).alias("i")).agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in means])


def bin_points(points: DataFrame, x: str, y: str, x0: float, y0: float, d: float, value: str) -> DataFrame:
    """A49."""
    return points.groupBy(F.floor((F.col(x) - x0) / d).alias("i"), F.floor((F.col(y) - y0) / d).alias("j")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def modal(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value; of ties the smallest."""
    return x.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("b")).select(*keys, F.col(f"b.{value}").alias(value), (-F.col("b.m")).alias("n"))


def clip(x: DataFrame, regions: dict[str, tuple[float, float, float, float]], lon: str, lat: str) -> DataFrame:
    """a row for each of the named boxes (lon0, lon1, lat0, lat1) that holds the point, edges included; the few boxes are part of the expression."""
    hits = [F.when(F.col(lon).between(w, e) & F.col(lat).between(s, n), F.lit(name)) for name, (w, e, s, n) in regions.items()]
    return x.withColumn("region", F.explode(F.array_compact(F.array(*hits))))


def tile_by_cell(obs: DataFrame, tiles: DataFrame, limit: Column, tile: str = "tile", pack: int = 512, rows: int = 32) -> DataFrame:
    """By cell; a pair goes if the observation is outside the tile's box and farther than the limit. Rows of ``obs`` with ``tile``.

    The pairs are as many as a cell's observations times its tiles. Tiles of one cell and box come in packs of ``pack``, which are broadcast (one
    value a tile); observations of a cell come in slices of at most some 16 * ``pack`` rows and 16 * ``pack`` ** 2 pairs, and a task holds neighbouring
    slices. A pack meets ``rows`` observations, is judged once for each, and unpacked last: one short list of tiles follows row after row, from
    few cells in a task, and a columnar file of the pairs takes a fraction of a byte for each.
    """
    cell, box = ["i", "j"], ["min_lon", "max_lon", "min_lat", "max_lat", "com_lon", "com_lat"]
    own, tasks = [c for c in obs.columns if c not in cell], int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = tiles.select(F.struct(*cell, *box).alias("_at"), tile)
    lots = t.join(t.groupBy("_at").agg(F.ceil(F.count(F.lit(1)) / (8 * pack)).alias("_lots")), "_at").groupBy("_at", F.pmod(F.xxhash64(tile), "_lots").alias("_lot")).agg(F.collect_list(tile).alias("_of"))
    packs = lots.where(F.size("_of") > 0).select("_at.*", F.explode(_cut("_of", pack)).alias("_tiles"))
    pairs = F.col("_n") * F.greatest("_m", F.lit(pack))
    counts = obs.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).join(tiles.groupBy(*cell).agg(F.count(F.lit(1)).alias("_m")), cell).select(*cell, F.ceil(pairs / (16 * pack * pack)).alias("_slices"))
    slices = obs.join(F.broadcast(counts), cell).groupBy(*cell, F.pmod(F.xxhash64(*own), "_slices").alias("_slice")).agg(F.collect_list(F.struct(*own)).alias("_of"))
    p = slices.repartitionByRange(tasks, *cell, "_slice").select(*cell, F.explode(_cut("_of", rows)).alias("_rows")).join(F.broadcast(packs), cell)
    # generated code holds all that comes of a row it reads; ``coalesce`` ends a stage of it, so that row is one pack with its observations, not a slice with all packs
    p = p.coalesce(tasks).select("*", F.explode("_rows").alias("_row")).select(*cell, "_row.*", F.struct(*box).alias("_at"), "_tiles")
    outside = ~(F.col("lon").between(F.col("_at.min_lon"), F.col("_at.max_lon")) & F.col("lat").between(F.col("_at.min_lat"), F.col("_at.max_lat")))
    p = p.where(~(outside & (F.greatest(F.abs(F.col("lon") - F.col("_at.com_lon")), F.abs(F.col("lat") - F.col("_at.com_lat"))) > limit)))
    return p.select(*obs.columns, F.explode("_tiles").alias(tile))


def _cut(values: str, size: int) -> Column:
    """An array that isn't empty as an array of parts of ``size``, the last one with the rest."""
    return F.transform(F.sequence(F.lit(1), F.size(values), F.lit(size)), lambda k: F.slice(values, k, size))
