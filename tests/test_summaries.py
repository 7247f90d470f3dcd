"""Masks, summaries and the smaller scans: edge rows against values worked out by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import masks, summaries
from fieldloom.sources import ingest


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_masks_on_edge_rows(spark):
    x = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, 0.01), (5, 0.05)], "id int, p double")
    assert values(x.where(masks.significant(F.col("p"))), "id") == [(4,)]
    assert values(x.where(masks.finite(F.col("p"))), "id") == [(4,), (5,)]
    months = spark.createDataFrame([(4,), (5,), (9,), (10,), (None,)], "m int").select(masks.season(F.col("m")).alias("s"))
    assert [r["s"] for r in months.collect()] == ["winter", "summer", "summer", "winter", None]
    k = spark.createDataFrame([(1, 7), (0, 7), (None, 8)], "w int, s int").select(masks.combine(F.col("w"), F.col("s")).alias("m"))
    assert [r["m"] for r in k.collect()] == [1, 7, 8]
    at = spark.createDataFrame([(0.0002,), (0.00021,), (None,)], "v double").select(masks.material(F.col("v"), "sfmc").alias("m"))
    assert [r["m"] for r in at.collect()] == [False, True, None]


def test_complete_needs_every_time(spark):
    rows = [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (3, 1, 1.0), (3, 2, float("nan"))]
    x = spark.createDataFrame(rows, "tile int, t int, v double")
    assert values(masks.complete(x, ["tile"], "t", ["v"]), "tile", "t") == [(1, 1), (1, 2)]
    assert masks.complete(x.limit(0), ["tile"], "t", ["v"]).count() == 0


def test_percent_change_and_cap(spark):
    x = spark.createDataFrame([(0.0, 1.0), (1.0, 7.0), (2.0, 3.0), (None, 1.0)], "a double, b double")
    p = masks.percent_change(x, "a", "b", eps=0.5)
    assert values(masks.cap(p, "percent"), "percent", "capped") == [(50.0, False), (None, False), (None, False), (None, True)]
    assert values(masks.percent_change(x, "a", "b", share=0.0), "percent") == [(50.0,), (600.0,), (None,), (None,)]


def test_propagate_and_common(spark):
    inc = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "tile int, inc double")
    sm = spark.createDataFrame([(1, 0.2), (2, None)], "tile int, sm double")
    assert values(masks.propagate(inc, sm, ["tile"], "sm", ["inc"]), "tile", "inc") == [(1, 5.0), (2, None), (3, None)]
    a = spark.createDataFrame([(1, 20, 1.0), (2, 19, 1.0), (3, 30, None)], "tile int, n int, m double")
    assert values(masks.common_valid(a, a, ["tile"], ["m"], 20), "tile", "m_a", "n_b") == [(1, 1.0, 20)]


def test_nearest_index_ties_and_ends(spark):
    x = spark.createDataFrame([(-99.0,), (0.5,), (0.51,), (1.0,), (99.0,)], "v double").select(summaries.nearest_index(F.col("v"), 0.0, 1.0, 4).alias("k"))
    assert [r["k"] for r in x.collect()] == [0, 0, 1, 1, 3]


def test_triplicates(spark):
    x = spark.createDataFrame([(1, 1, 5.0, 10), (1, 2, 5.0, 11), (1, 3, 5.0, 12), (2, 1, 5.0, 13), (2, 2, 5.0, 14)], "k int, cycle int, v double, id int")
    assert values(summaries.triplicates(x, ["k"], "cycle", "v", "id"), "first_row", "id", "next_row", "cycle") == [(10, 11, 12, 2)]


def test_unique_keys(spark):
    x = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    assert summaries.require_unique(x, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        summaries.require_unique(x, ["v"]).collect()


def test_station_anomaly_wraps_the_year(spark):
    x = spark.createDataFrame([(1, "2003-12-31", 2.0), (1, "2004-01-01", 4.0), (1, "2004-12-31", 6.0), (1, "2003-07-01", 9.0)], "s int, d string, v double").withColumn("ts", F.col("d").cast("timestamp"))
    got = {r["d"]: r["anom"] for r in summaries.station_anomaly(x, ["s"], "v", 3).collect()}
    assert got == {"2003-12-31": -2.0, "2004-01-01": 0.0, "2004-12-31": 2.0, "2003-07-01": None}


def test_smoothing_and_steps(spark):
    x = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, 5.0), (1, 4, 6.0)], "k int, t int, v double")
    assert values(summaries.smooth(x, ["k"], ["t"], "v"), "t", "smooth") == [(1, 1.0), (2, 3.0), (3, 5.5), (4, 5.5)]
    assert values(summaries.fill_gaps(x, ["k"], ["t"], "v"), "t", "v") == [(1, 1.0), (2, 4.0), (3, 5.0), (4, 6.0)]
    assert values(summaries.step_difference(x, ["k"], ["t"], "v"), "t", "step") == [(1, None), (2, None), (3, None), (4, 1.0)]


def test_distribution_of_one_value_and_no_rows(spark):
    x = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", None)], "d string, v double")
    assert values(summaries.distributions(x, "d", "v"), "d", "bin", "n", "cumulative") == [("a", 1, 2, 1.0)]
    assert summaries.distributions(x.where("v > 9"), "d", "v").count() == 0


def test_differences_and_sets(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 3.0), (4, 1.0)], "k int, v double")
    assert values(summaries.difference(a, b, ["k"], "v"), "k", "diff", "percent") == [(1, 1.0, None), (2, 1.0, 50.0)]
    assert values(summaries.common_keys([a, b], ["k"]), "k") == [(1,), (2,)]
    assert values(summaries.without(b, [a, b.where("k = 4")], ["k"]), "k") == []
    r2 = spark.createDataFrame([(0.25, 0.4), (0.009, 0.4), (0.25, None)], "r2 double, o double").select(summaries.skill_root(F.col("r2"), F.col("o")).alias("r"))
    assert [r["r"] for r in r2.collect()] == [0.5, None, None]


def test_tile_grids(spark, tmp_path):
    def record(name):
        raw = name.ljust(40, b"\0") + struct.pack("<7i6f", 1, 1, -1, 964, 406, 0, 0, -180, -85, 180, 85, 0.5, 0.25)
        return struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(raw))

    (tmp_path / "g.bin").write_bytes(record(b"EASEv2_M36") + record(b"EASEv2_M09"))
    got = values(ingest.read_tile_grids(spark, str(tmp_path)), "kind", "gridtype", "j_dir", "n_lon", "dlat")
    assert got == [("domain", "EASEv2_M09", -1, 964, 0.25), ("global", "EASEv2_M36", -1, 964, 0.25)]


def test_species_metadata(spark, tmp_path):
    def species(k, angles):
        text = {n: f'"{n} {k}"' for n in ingest.SPECIES_TEXT} | {"assim": "T", "maskpath": '""'}
        return [{"species": f" {k}.0", "N_ang": str(len(angles)), "ang": " ".join(map(str, angles))}.get(n) or text.get(n, "1.5") for n in ingest.SPECIES_FIELDS]

    (tmp_path / "p.txt").write_text("\n".join(["  2", *species(1, [40.0]), *species(2, [32.5, 40.0])]) + "\n")
    got = values(ingest.read_species(spark, str(tmp_path)), "species", "descr", "assim", "maskpath", "ang", "adapt")
    assert got == [(1, "descr 1", "T", "", [40.0], 1.5), (2, "descr 2", "T", "", [32.5, 40.0], 1.5)]


def test_small_scans(spark):
    snow = spark.createDataFrame([(0.0, 0.0, 50, 100, 0), (9.0, 0.0, 50, 100, 0), (0.0, 0.0, 50, 20, 0), (0.0, 0.0, 101, 100, 0)], "lon double, lat double, snow_cover int, clear_index int, snow_spatial_qa int")
    assert values(ingest.scan_snow_cover(snow, -1, 1, -1, 1), "scf") == [(0.5,)]
    slices = spark.createDataFrame([(0, 0.1), (1, 0.2), (1, -9999.0), (1, None)], "slice int, sm double")
    assert values(ingest.scan_slice(slices, 9), "sm") == [(0.2,)]
    with pytest.raises(ValueError):
        ingest.scan_slice(slices, 4)
    swath = spark.createDataFrame([(1, 1, 0.2, 0, 0, 0, 0, 0), (1, 1, 0.4, 0, 0, 0, 0, 0), (1, 2, 0.4, 4, 0, 0, 0, 0)], "day int, cell int, sm double, retrieval_qual_flag int, surface_flag int, surface_status int, tb_qual_h int, tb_qual_v int")
    assert [(c, pytest.approx(v) if v else v) for c, v in values(ingest.scan_swath(swath), "cell", "sm")] == [(1, 0.3), (2, None)]
    stations = spark.createDataFrame([("SCAN", 25.0, -100.0), ("SCAN", 45.0, -130.0), ("SCAN", 40.0, -60.0), ("USCRN", 60.0, -150.0)], "network string, lat double, lon double")
    assert values(ingest.scan_stations(stations), "network", "lat") == [("SCAN", 45.0), ("USCRN", 60.0)]
