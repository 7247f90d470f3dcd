"""Sources and sinks: binary records, state tables, logs, partial statistics, manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare

# fixed values: the record layout of an observation file
STAMP = ("year", "month", "day", "hour", "minute", "second", "dofyr", "pentad")
FIELDS = (("assim", "i4"), ("species", "i4"), ("tilenum", "i4"), ("lon", "f4"), ("lat", "f4"), ("obs", "f4"), ("obsvar", "f4"), ("fcst", "f4"), ("fcstvar", "f4"), ("ana", "f4"), ("anavar", "f4"))
TILE_FIELDS = (("tile_id", "i4"), ("typ", "i4"), ("pfaf", "i4"), ("com_lon", "f4"), ("com_lat", "f4"), ("min_lon", "f4"), ("max_lon", "f4"), ("min_lat", "f4"), ("max_lat", "f4"), ("i_indg", "i4"), ("j_indg", "i4"), ("frac_cell", "f4"), ("frac_pfaf", "f4"), ("area", "f4"), ("elev", "f4"))


def _records(content: bytes) -> Iterator[tuple[str, bytes]]:
    """The marked records of a sequential file and their byte order, which the first mark tells."""
    order = next((o for o in "<>" if 0 < np.frombuffer(content[:4], f"{o}i4")[0] < len(content)), "<")
    at = 0
    while at + 8 <= len(content):
        size = int(np.frombuffer(content, f"{order}i4", 1, at)[0])
        yield order, content[at + 4 : at + 4 + size]
        at += size + 8


def decode_observations(content: bytes) -> pd.DataFrame:
    """One file's observations; an empty file has none."""
    parts = list(_records(content))
    if not parts:
        return pd.DataFrame(columns=["ts", *[n for n, _ in FIELDS]])
    order, head = parts[0]
    n, *stamp = np.frombuffer(head, f"{order}i4").tolist()
    out = {name: np.frombuffer(raw, f"{order}{kind}").astype(kind) for (name, kind), (_, raw) in zip(FIELDS, parts[1:])}
    frame = pd.DataFrame(out)
    s = dict(zip(STAMP, stamp))
    frame.insert(0, "ts", pd.Timestamp(s["year"], s["month"], s["day"], s["hour"], s["minute"], s["second"]))
    return frame.iloc[:n]


def read_observations(spark: SparkSession, path: str, glob: str = "*.bin") -> DataFrame:
    """Binary files -> rows, a file at a time in the tasks; fills become null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield decode_observations(content)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("content")
    rows = files.mapInPandas(run, "ts timestamp, " + ", ".join(f"{n} {'int' if k == 'i4' else 'float'}" for n, k in FIELDS))
    fill = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c) + 9999) < 0.01), None).otherwise(F.col(c).cast("double"))
    return rows.withColumns({c: fill(c) for c, k in FIELDS if k == "f4"}).withColumn("assim", F.col("assim") != 0)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """One count, then a marked array for each field."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                (order, head), *parts = _records(content)
                n = int(np.frombuffer(head, f"{order}i4")[0])
                out = {name: np.frombuffer(raw, f"{order}{kind}").astype(kind)[:n] for (name, kind), (_, raw) in zip(TILE_FIELDS, parts)}
                yield pd.DataFrame({"tilenum": np.arange(1, n + 1, dtype="i4"), **out})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "tilenum int, " + ", ".join(f"{n} {'int' if k == 'i4' else 'float'}" for n, k in TILE_FIELDS))


# fixed values: the layout of a tile-grid record after its 40 characters of grid type, and the lines of a species in the metadata file
GRID_FIELDS = (("ind_base", "i4"), ("i_dir", "i4"), ("j_dir", "i4"), ("n_lon", "i4"), ("n_lat", "i4"), ("i_offg", "i4"), ("j_offg", "i4"), ("ll_lon", "f4"), ("ll_lat", "f4"), ("ur_lon", "f4"), ("ur_lat", "f4"), ("dlon", "f4"), ("dlat", "f4"))
SPECIES_TEXT = ("descr", "FOV_units", "assim", "scale", "getinnov", "varname", "units", "path", "name", "maskpath", "maskname", "scalepath", "scalename", "flistpath", "flistname", "zeromean", "coarsen_pert")
SPECIES_FIELDS = ("descr", "species", "orbit", "pol", "N_ang", "ang", "freq", "FOV", "FOV_units", "assim", "scale", "getinnov", "RTM_ID", "bias_Npar", "bias_trel", "bias_tcut", "nodata", "varname", "units", "path", "name", "maskpath", "maskname", "scalepath", "scalename", "flistpath", "flistname", "errstd", "std_normal_max", "zeromean", "coarsen_pert", "xcorr", "ycorr", "adapt")


def read_tile_grids(spark: SparkSession, path: str) -> DataFrame:
    """S3: the global and the domain grid of each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                for kind, (order, raw) in zip(("global", "domain"), _records(content)):
                    row = {"kind": kind, "gridtype": raw[:40].decode("ascii").strip("\0 ")}
                    for at, (name, form) in enumerate(GRID_FIELDS):
                        row[name] = np.frombuffer(raw, f"{order}{form}", 1, 40 + 4 * at)[0]
                    yield pd.DataFrame([row])

    schema = "kind string, gridtype string, " + ", ".join(f"{n} {'int' if k == 'i4' else 'float'}" for n, k in GRID_FIELDS)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """A count, then a line for each field of each species; text may be quoted, ``ang`` holds any number of angles."""
    lines = F.split(F.rtrim("value"), r"\r?\n")
    width = len(SPECIES_FIELDS)
    rows = spark.read.text(path, wholetext=True).select(lines.alias("l")).select("l", F.explode(F.expr("sequence(0, CAST(trim(l[0]) AS INT) - 1)")).alias("k"))
    text = lambda i: F.trim(F.get("l", 1 + F.col("k") * width + i))

    def field(i: int, name: str) -> Column:
        if name in SPECIES_TEXT:
            return F.btrim(text(i), F.lit('"')).alias(name)
        if name == "ang":
            return F.split(text(i), r"\s+").cast("array<double>").alias(name)
        return text(i).cast("double").cast("int" if name in ("species", "N_ang") else "double").alias(name)

    return rows.where("size(l) > 1").select(*[field(i, n) for i, n in enumerate(SPECIES_FIELDS)])


def scan_snow_cover(pixels: DataFrame, west: float, east: float, south: float, north: float) -> DataFrame:
    """Good pixels of a box with their snow fraction; the box prunes before the quality rule."""
    box = require(pixels, ["lon", "lat", "snow_cover", "clear_index", "snow_spatial_qa"]).where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    return box.withColumn("scf", compare.snow_fraction(F.col("snow_cover"), F.col("clear_index"), F.col("snow_spatial_qa"))).where("scf is not null")


def scan_slice(x: DataFrame, hour: int, nodata: float = -9999.0) -> DataFrame:
    """The quarter of the day that belongs to an analysis hour of 3, 9, 15 or 21, without fills."""
    if hour not in (3, 9, 15, 21):
        raise ValueError(f"no slice for hour {hour}")
    return x.where((F.col("slice") == (hour - 3) // 6) & F.col("sm").isNotNull() & ~F.isnan("sm") & (F.abs(F.col("sm") - nodata) >= 0.01))


def scan_swath(x: DataFrame) -> DataFrame:
    """Good soil moisture of a day and cell, the mean of the orbits that have it."""
    good = compare.smap_good(require(x, ["sm", "retrieval_qual_flag", "surface_flag", "surface_status", "tb_qual_h", "tb_qual_v"]))
    return x.groupBy("day", "cell").agg(F.avg(good).alias("sm"))


def scan_footprints(x: DataFrame) -> DataFrame:
    """Footprints whose processing flag is clear."""
    return require(x, ["lat", "lon", "ssom", "tpcx", "domo", "smpf", "smcf", "alfr", "iwfr", "snoc", "flsf"]).where("smpf = 0")


def scan_stations(x: DataFrame) -> DataFrame:
    """Stations, of the network SCAN only those inside its box."""
    inside = (F.col("lat") > 25) & (F.col("lat") <= 45) & (F.col("lon") >= -130) & (F.col("lon") < -60)
    return x.where((F.col("network") != "SCAN") | inside)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The required-column check at the door."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def scan_states(spark: SparkSession, path: str, columns: list[str], start: str, end: str) -> DataFrame:
    """Wanted columns of a Parquet state table, cut to a period before anything is read."""
    return require(spark.read.parquet(path), [*columns, "ts"]).select("ts", *columns).where(F.col("ts").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def scan_state_files(spark: SparkSession, path: str, columns: list[str], start: str, end: str, key: str = "tile", places: tuple[str, ...] = ("lat", "lon"), pattern: str = r"\.(\d{8})_") -> DataFrame:
    """S5 for raw files, a day's state in each: only those whose name has a date from ``start`` to ``end`` are opened. The places come from the first of them alone.

    Only names reach the driver. A file without a date in its name isn't read; no file in the period is an error.
    """
    first, last = start.replace("-", ""), end.replace("-", "")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    dated = sorted((m[1], name) for name in names if (m := re.search(pattern, name.rsplit("/", 1)[1])) and first <= m[1] <= last)
    if not dated:
        raise ValueError(f"no state file from {start} to {end}")
    days = spark.read.parquet(*[name for _, name in dated])
    found = spark.read.parquet(dated[0][1]).select(key, *places)
    return require(days, [key, *columns]).select(date_of_file(pattern).alias("day"), key, *columns).join(found, key, "left")


def date_of_file(pattern: str = r"\.(\d{8})_", form: str = "yyyyMMdd"):
    """X11: the date in a file's name."""
    return F.to_date(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1), form)


def increments(soil: DataFrame, snow: DataFrame) -> DataFrame:
    """Analysis minus forecast, and the snow layers' sum, joined in full."""
    layers = sum((F.coalesce(F.col(f"wesnn{k}_incr"), F.lit(0.0)) for k in (1, 2, 3)), F.lit(0.0))
    a = soil.select("ts", "tile", (F.col("sfmc_ana") - F.col("sfmc_fcst")).alias("sfmc_incr"), (F.col("rzmc_ana") - F.col("rzmc_fcst")).alias("rzmc_incr"))
    return a.join(snow.select("ts", "tile", layers.alias("snow_incr")), ["ts", "tile"], "full")


def scan_log(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Numbers in log lines, and their mean by the caller."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", pattern, 1).alias("x")).where("x <> ''").select(F.col("x").cast("double").alias("value"))


def fixed_columns(spark: SparkSession, path: str, last: int = 8) -> DataFrame:
    """The last fields of lines parted by blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.slice(parts, -last, last).alias("fields"))


def observation_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files, each with three header lines; a file is complete only if its last line is EOF."""
    lines = F.transform(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n"), F.trim)
    files = spark.read.text(path, wholetext=True).select(lines.alias("l"))
    if not files.where(F.element_at("l", -1) != "EOF").isEmpty():
        raise ValueError("a log is not complete")
    rows = files.select(F.explode(F.expr("slice(l, 4, greatest(0, size(l) - 4))")).alias("value"))
    return rows.select(F.from_csv("value", schema).alias("r")).select("r.*")


def merge_years(parts: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Appended tables; of repeated steps the first."""
    out = parts[0].withColumn("_part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(k)))
    w = Window.partitionBy(*keys).orderBy("_part", *order)
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_part")


def write_partials(parts: DataFrame, path: str, by: list[str]) -> None:
    """Partial sums by month; only the months that are written are replaced."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def missing_months(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no output yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def write_series(x: DataFrame, path: str, by: list[str], files: int) -> None:
    """Zstd Parquet, sorted by tile and time inside files."""
    x.repartition(files, *by, "tile").sortWithinPartitions("tile", "ts").write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_report(x: DataFrame, path: str, group: list[str], order: list[str], most: int = 10_000) -> None:
    """CSV, with a cap on the rows of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r").write.mode("overwrite").option("header", True).csv(path)


def gridded_statistics(cells: DataFrame, start: str, end: str, fill: float = -999.0) -> DataFrame:
    """Cell rows with fills, days since 1950, and the extremes over all pentads."""
    days = lambda d: F.datediff(F.lit(d).cast("date"), F.lit("1950-01-01").cast("date"))
    extremes = cells.groupBy("cell").agg(F.min("m_min").alias("m_min"), F.max("m_max").alias("m_max"))
    out = cells.drop("m_min", "m_max").join(extremes, "cell")
    return out.na.fill(fill, [c for c, t in out.dtypes if t == "double"]).withColumns({"start_day": days(start), "end_day": days(end)})
