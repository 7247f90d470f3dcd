"""Scalar functions as column expressions: calendar, grid, units."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def pentad(d: Column) -> Column:
    """Pentad of the year; 29 February belongs to the pentad of the 28th."""
    doy, leap = F.dayofyear(d), F.dayofyear(F.last_day(F.concat(F.year(d), F.lit("-12-01")).cast("date"))) == 366
    return (F.floor((doy - F.when(leap & (doy >= 59), 2).otherwise(1)) / 5) + 1).cast("int")


def pentad_plain(doy: Column) -> Column:
    return (F.floor((doy - 1) / 5) + 1).cast("int")


def pentad_scaling(doy: Column) -> Column:
    return F.floor((doy + 2) / 5).cast("int")


def normal_doy(d: Column) -> Column:
    """Day of a year of 365 days; 29 February counts as the 28th."""
    doy = F.dayofyear(d)
    leap = F.dayofyear(F.last_day(F.concat(F.year(d), F.lit("-12-01")).cast("date"))) == 366
    return (doy - F.when(leap & (doy >= 60), 1).otherwise(0)).cast("int")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def days_since_1950(d: Column) -> Column:
    return F.datediff(d, F.lit("1950-01-01").cast("date"))


# fixed values: what second 0 is called, and the days before whose begin UTC has had a leap second
J2000_EPOCHS = {"TT12": "2000-01-01 12:00:00", "UT12": "2000-01-01 11:58:55", "UT00": "2000-01-01 00:00:00"}
LEAP_DAYS = ("2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01")


def _seconds(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


def j2000(seconds: Column, epoch: str = "TT12", leap: bool = False) -> Column:
    """Elapsed seconds since 2000 as a timestamp. ``leap``: the leap seconds since then are elapsed seconds without a place in
    the calendar; such a second reads as the first of the day that follows."""
    zero = _seconds(J2000_EPOCHS[epoch])
    if not leap:
        return F.timestamp_seconds(seconds + zero)
    # the k-th leap second is over when the elapsed seconds reach the day's begin and k more
    past = sum(((seconds >= _seconds(d) - zero + k).cast("int") for k, d in enumerate(LEAP_DAYS, 1)), F.lit(0))
    return F.timestamp_seconds(seconds + zero - past)


def pearson(x: str | Column, y: str | Column) -> Column:
    """The correlation of the pairs without a null, as an aggregate; null where a side is constant, for which ``corr`` fails in ANSI mode."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def wrap360(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def cell_index(x: Column, low: float, step: float, count: int) -> Column:
    """0-based index on a regular axis, null outside."""
    k = F.floor((x - low) / step).cast("int")
    return F.when(k.between(0, count - 1), k)


def fraction(percent: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100))


def kelvin(celsius: Column) -> Column:
    return celsius + 273.15


def bit(x: Column, k: int) -> Column:
    """Bit k, counted from 1."""
    return F.getbit(x, F.lit(k - 1))


def per_year(per_second: Column) -> Column:
    return per_second * (365.25 * 86400)


def snow_increment(x: Column, y: Column) -> Column:
    up, down = 5 * (x - y / 0.6), -5 * y * (1 - x / 0.55)
    return F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.when(y < 0.6 * x, up).when(x < 0.55, down).otherwise(0.0)))


def perturbation(value: Column, lat: Column) -> Column:
    return value * (lat + 90) / 90


# fixed values of EASE-Grid 2.0: ellipsoid and the global cylindrical grids (cell size in m, columns, rows)
_A, _E, _PHI1 = 6378137.0, 0.081819190843, math.radians(30.0)
EASE_GRIDS = {"M36": (36032.220840584, 964, 406), "M09": (9008.055210146, 3856, 1624), "M03": (3002.6850700487, 11568, 4872), "M01": (1000.89502334956, 34704, 14616)}


# the polar grids, north (N) and south (S): cell size in m, cells along each side
EASE_POLAR = {"36": (36000.0, 500), "09": (9000.0, 2000), "03": (3000.0, 6000), "01": (1000.0, 18000)}


def _k0() -> float:
    return math.cos(_PHI1) / math.sqrt(1 - (_E * math.sin(_PHI1)) ** 2)


def _q(sin_phi: Column) -> Column:
    es = sin_phi * _E
    return (1 - _E**2) * (sin_phi / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * _E))


def _qp() -> float:
    """q of the pole."""
    return 1 - (1 - _E**2) / (2 * _E) * math.log((1 - _E) / (1 + _E))


def _latitude(beta: Column) -> Column:
    """The latitude, in radians, of an authalic one, by its series."""
    e2, e4, e6 = _E**2, _E**4, _E**6
    return beta + F.sin(2 * beta) * (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) + F.sin(4 * beta) * (23 * e4 / 360 + 251 * e6 / 3780) + F.sin(6 * beta) * (761 * e6 / 45360)


def _polar_index(lat: Column, lon: Column, grid: str) -> tuple[Column, Column]:
    size, cells = EASE_POLAR[grid[1:]]
    side = 1 if grid[0] == "N" else -1
    rho = F.sqrt(F.greatest(F.lit(0.0), F.lit(_qp()) - side * _q(F.sin(F.radians(lat))))) * _A
    x, y = rho * F.sin(F.radians(lon)), rho * F.cos(F.radians(lon)) * -side
    row, col = F.floor(F.lit(cells / 2) - y / size).cast("int"), F.floor(x / size + cells / 2).cast("int")
    inside = row.between(0, cells - 1) & col.between(0, cells - 1)
    return F.when(inside, row), F.when(inside, col)


def _polar_center(row: Column, col: Column, grid: str) -> tuple[Column, Column]:
    size, cells = EASE_POLAR[grid[1:]]
    side = 1 if grid[0] == "N" else -1
    x, y = (col - (cells - 1) / 2) * size, (F.lit((cells - 1) / 2) - row) * size
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - (x * x + y * y) / (_A**2 * _qp())))) * side
    return F.degrees(_latitude(beta)), F.degrees(F.atan2(x, y * -side))


def ease_index(lat: Column, lon: Column, grid: str) -> tuple[Column, Column]:
    """0-based (row, column) of a grid: global cylindrical (M36) or polar (N36, S36), the latter null outside it."""
    if grid[0] in "NS":
        return _polar_index(lat, lon, grid)
    size, cols, rows = EASE_GRIDS[grid]
    x = F.radians(lon) * (_A * _k0())
    y = _q(F.sin(F.radians(lat))) * (_A / (2 * _k0()))
    col = F.floor(x / size + cols / 2).cast("int")
    row = F.floor(F.lit(rows / 2) - y / size).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(rows - 1), row)), F.greatest(F.lit(0), F.least(F.lit(cols - 1), col))


def ease_center(row: Column, col: Column, grid: str) -> tuple[Column, Column]:
    """(lat, lon) of the cell's centre, by the authalic series."""
    if grid[0] in "NS":
        return _polar_center(row, col, grid)
    size, cols, rows = EASE_GRIDS[grid]
    x, y = (col - (cols - 1) / 2) * size, (F.lit((rows - 1) / 2) - row) * size
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * (2 * _k0() / (_A * _qp())))))
    return F.degrees(_latitude(beta)), F.degrees(x / (_A * _k0()))


def _by_grid(pick) -> str:
    """SQL that picks a number by the grid's name."""
    return "CASE grid " + " ".join(f"WHEN '{g}' THEN {pick(*v)}" for g, v in EASE_GRIDS.items()) + " END"


def register(spark: SparkSession) -> None:
    """SQL functions that Catalyst inlines (G5): the calendar, cells, distances and the global cylindrical grids, whose ``grid`` is M36, M09, M03 or M01."""
    size, cols, rows = (_by_grid(lambda *v, k=k: repr(v[k])) for k in range(3))
    e2 = _E**2
    q = f"({1 - e2!r}D * (sin(radians(lat)) / (1 - pow({_E!r}D * sin(radians(lat)), 2)) - ln((1 - {_E!r}D * sin(radians(lat))) / (1 + {_E!r}D * sin(radians(lat)))) / {2 * _E!r}D))"
    b = f"asin(greatest(-1D, least(1D, (({rows} - 1) / 2 - y) * {size} * {2 * _k0() / (_A * _qp())!r}D)))"
    series = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]
    leap = "dayofyear(make_date(year(d), 12, 31)) = 366"
    for text in (
        "pentad_plain(doy INT) RETURNS INT RETURN CAST(floor((doy - 1) / 5) + 1 AS INT)",
        "pentad_scaling(doy INT) RETURNS INT RETURN CAST(floor((doy + 2) / 5) AS INT)",
        f"pentad(d DATE) RETURNS INT RETURN CAST(floor((dayofyear(d) - CASE WHEN {leap} AND dayofyear(d) >= 59 THEN 2 ELSE 1 END) / 5) + 1 AS INT)",
        f"normal_doy(d DATE) RETURNS INT RETURN dayofyear(d) - CASE WHEN {leap} AND dayofyear(d) >= 60 THEN 1 ELSE 0 END",
        "wrap360(lon DOUBLE) RETURNS DOUBLE RETURN pmod(lon, 360.0D)",
        "cell_index(x DOUBLE, low DOUBLE, step DOUBLE, cells INT) RETURNS INT RETURN CASE WHEN floor((x - low) / step) BETWEEN 0 AND cells - 1 THEN CAST(floor((x - low) / step) AS INT) END",
        "haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN 2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
        f"ease_row(grid STRING, lat DOUBLE) RETURNS INT RETURN CAST(greatest(0, least({rows} - 1, floor({rows} / 2 - {q} * {_A / (2 * _k0())!r}D / {size}))) AS INT)",
        f"ease_col(grid STRING, lon DOUBLE) RETURNS INT RETURN CAST(greatest(0, least({cols} - 1, floor(radians(lon) * {_A * _k0()!r}D / {size} + {cols} / 2))) AS INT)",
        f"ease_lat(grid STRING, y DOUBLE) RETURNS DOUBLE RETURN degrees({b} + {' + '.join(f'sin({2 * k} * {b}) * {c!r}D' for k, c in enumerate(series, 1))})",
        f"ease_lon(grid STRING, x DOUBLE) RETURNS DOUBLE RETURN degrees((x - ({cols} - 1) / 2) * {size} / {_A * _k0()!r}D)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
