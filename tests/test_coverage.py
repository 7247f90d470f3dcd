"""Sources, sinks, streams and small rules that no registered query runs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalar
from fieldloom.operators import compare, quantiles, series, spatial
from fieldloom.sources import ingest
from fieldloom.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(hour, day=1):
    return dt.datetime(2020, 1, day, hour)


def test_observation_log_of_two_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.csv").write_text(f"a\nb\nc\n{k},2.5\n{k + 10},3.5\nEOF\n")
    assert sorted(map(tuple, ingest.observation_log(spark, str(tmp_path), "id int, v double").collect())) == [(1, 2.5), (2, 2.5), (11, 3.5), (12, 3.5)]
    (tmp_path / "3.csv").write_text("a\nb\nc\n1,2\nEOF\n5,6\n")
    with pytest.raises(ValueError):
        ingest.observation_log(spark, str(tmp_path), "id int, v double")


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.log").write_text("took 1.5 s\nnothing\ntook 2.5 s\n\n")
    assert [r["value"] for r in ingest.scan_log(spark, str(tmp_path), r"took ([\d.]+) s").collect()] == [1.5, 2.5]
    assert [r["fields"] for r in ingest.fixed_columns(spark, str(tmp_path), 2).collect()][::2] == [["1.5", "s"], ["2.5", "s"]]


def test_merge_years_keeps_the_first(spark):
    a, b = (spark.createDataFrame(rows, "t int, v int") for rows in ([(1, 10), (2, 20)], [(2, 21), (3, 30)]))
    assert sorted(map(tuple, ingest.merge_years([a, b], ["t"], ["v"]).collect())) == [(1, 10), (2, 20), (3, 30)]


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([(1, at(0), 2020, 5.0), (2, at(3), 2020, 6.0), (1, at(6), 2021, 7.0)], "tile int, ts timestamp, year int, v double")
    ingest.write_series(x, str(tmp_path / "s"), ["year"], 2)
    assert ingest.scan_states(spark, str(tmp_path / "s"), ["tile", "v"], "2020-01-01 00:00:00", "2020-01-01 03:00:00").count() == 2
    ingest.write_report(x, str(tmp_path / "r"), ["tile"], ["ts"], 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    cells = spark.createDataFrame([(1, 1, 2.0, 3.0, None), (1, 2, 1.0, 9.0, 4.0)], "cell int, pentad int, m_min double, m_max double, o_mean double")
    got = ingest.gridded_statistics(cells, "1950-01-03", "1950-01-05").collect()
    assert {(r["m_min"], r["m_max"], r["start_day"], r["end_day"]) for r in got} == {(1.0, 9.0, 2, 4)} and {r["o_mean"] for r in got} == {-999.0, 4.0}


def test_increments_join_in_full(spark):
    soil = spark.createDataFrame([(at(0), 1, 2.0, 1.5, 4.0, 3.0)], "ts timestamp, tile int, sfmc_ana double, sfmc_fcst double, rzmc_ana double, rzmc_fcst double")
    snow = spark.createDataFrame([(at(0), 2, 1.0, None, 0.5)], "ts timestamp, tile int, wesnn1_incr double, wesnn2_incr double, wesnn3_incr double")
    got = {r["tile"]: r for r in ingest.increments(soil, snow).collect()}
    assert got[1]["sfmc_incr"] == 0.5 and got[1]["snow_incr"] is None and got[2]["snow_incr"] == 1.5


def test_quality_rules(spark):
    lit = F.lit
    assert one(spark, compare.ascat_good(lit(50.0), lit(0))) == 50.0 and one(spark, compare.ascat_good(lit(50.0), lit(1))) is None and one(spark, compare.ascat_good(lit(101.0), lit(0))) is None
    assert one(spark, compare.cygnss_good(lit(0.2), lit(0.01), lit(0.0), lit(0.5), [lit(255)])) == 0.2 and one(spark, compare.cygnss_good(lit(0.2), lit(0.01), lit(0.0), lit(0.5), [lit(1)])) is None
    assert one(spark, compare.station_good(lit(0.2), lit(280.0))) == 0.2 and one(spark, compare.station_good(lit(0.2), lit(270.0))) is None
    assert one(spark, compare.vegetation_class(lit(3), lit(60.0), lit(10.0))) == "type3" and one(spark, compare.vegetation_class(lit(3), lit(4.0), lit(1.0))) == "bare"


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalar.wrap360(lit(-10.0))) == 350.0 and one(spark, scalar.kelvin(lit(0.0))) == pytest.approx(273.15)
    assert one(spark, scalar.fraction(lit(150.0))) == 1.0 and one(spark, scalar.fraction(lit(25.0))) == 0.25
    assert [one(spark, scalar.bit(lit(5), k)) for k in (1, 2, 3)] in ([1, 0, 1], [0, 1, 0])
    assert one(spark, scalar.add_seconds(lit(at(23)), lit(7200))) == at(1, 2)


def test_hydrology(spark):
    x = spark.createDataFrame([(1, 1, 5.0, 2.0, 1.0, 10.0), (1, 2, 3.0, 2.0, 2.0, 12.0)], "tile int, month int, p double, e double, r double, s double")
    got = sorted(compare.water_balance(x, ["tile"]).collect(), key=lambda r: r["month"])
    assert [(r["net"], r["change"], r["cumulative"]) for r in got] == [(2.0, None, 2.0), (-1.0, 2.0, 1.0)]
    assert [one(spark, c) for c in compare.depth_weights(F.lit(0.05), F.lit(0.4), [(0.0, 0.1), (0.1, 1.0)])] == pytest.approx([0.05, 0.3])
    assert one(spark, compare.evapotranspiration(F.lit(20.0), F.lit(2.0), F.lit(15.0), F.lit(1.2), F.lit(101.3))) == pytest.approx(5.3, abs=0.6)


def test_selection_and_sets(spark):
    c = spark.createDataFrame([(k, k, 10 - k) for k in range(10)], "site int, a int, b int")
    assert [r["site"] for r in compare.balanced_sites(c, "site", ["a", "b"], most=10, best=2).collect()] == [5, 4]
    a, b = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert sorted(r["x"] for r in compare.symmetric_difference(a, b).collect()) == [1, 3]
    gaps = spark.createDataFrame([(1, 1, 5.0), (1, 3, 6.0)], "k int, t int, v double")
    assert [r["v"] for r in compare.fill_axis(gaps, ["k"], "t", 1, 3).orderBy("t").collect()] == [5.0, None, 6.0]
    m = spark.createDataFrame([(1, at(3, 5), 1.0), (1, at(1, 2), 2.0)], "k int, ts timestamp, v double")
    assert [(r["v"], r["month"]) for r in compare.first_of_month(m, ["k"], ["v"]).collect()] == [(2.0, dt.date(2020, 1, 31))]


def test_ranks_and_percentiles_of_whole_columns(spark):
    x = spark.range(3000).selectExpr("'g' AS k", "CAST(id * 7919 % 1000 AS DOUBLE) AS v", "id")
    a = {r["id"]: r["r"] for r in compare.whole_rank(x, ["k"], "v", "r", parts=8).collect()}
    b = {r["id"]: r["r"] for r in compare.average_rank(x, ["k"], "v", "r").collect()}
    assert a == b
    values = sorted(r["v"] for r in x.collect())
    for most in (50, 50_000):
        got = quantiles.column_percentiles(x, "v", [0.0, 0.01, 0.5, 0.999, 1.0], small=most)
        want = [values[int(p)] + (p - int(p)) * (values[min(2999, int(p) + 1)] - values[int(p)]) for p in (q * 2999 for q in (0.0, 0.01, 0.5, 0.999, 1.0))]
        assert got == pytest.approx(want)
    assert quantiles.column_percentiles(x.where("false"), "v", [0.5]) == [None]


def test_nearest_at_the_poles_and_the_date_line(spark):
    a = spark.createDataFrame([(1, 89.9, 10.0), (2, 0.0, 179.95), (3, -89.95, -170.0)], "site int, lat double, lon double")
    b = spark.createDataFrame([(1, 89.9, -170.0), (2, 0.0, -179.95), (3, -89.9, 20.0), (4, 45.0, 0.0)], "tile int, la double, lo double")
    got = {r["site"]: (r["tile"], round(r["km"], 2)) for r in spatial.nearest_km(a, b, "site", "tile", 50.0, ("lat", "lon"), ("la", "lo")).collect()}
    assert got == {1: (1, round(0.2 * math.pi / 180 * 6371, 2)), 2: (2, round(0.1 * math.pi / 180 * 6371, 2)), 3: (3, pytest.approx(16.6, abs=0.3))}


def test_repeats_cost_no_square(spark):
    x = spark.range(4000).selectExpr("1 AS k", "id % 2 AS cycle", "5.0D AS v", "id AS row")
    p = compare.cycle_before(x, ["k"], "cycle", "v", F.min("row"), 1e-6)
    assert p.count() == 2000 and compare.consecutive(x, ["k"], "cycle", "v", "row").agg(F.max("first_row")).first()[0] == 0


def test_paired_interval(spark):
    x = spark.createDataFrame([("m", 1.0, 1.5), ("m", 2.0, 2.3), ("m", 3.0, None), ("m", 1.0, 1.1), ("s", 1.0, 2.0)], "k string, a double, b double")
    got = {r["k"]: r for r in compare.paired_interval(x, ["k"], "a", "b").collect()}
    assert got["m"]["n"] == 3 and got["m"]["mean_delta"] == pytest.approx(0.3) and got["m"]["ci_half"] == pytest.approx(4.302653 * 0.2 / math.sqrt(3), rel=1e-5)
    assert got["s"]["ci_half"] == 0


def _stream(spark, tmp_path, batch):
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    return streams.read_stream(spark, str(tmp_path / "in"), batch.schema)


def _run(spark, tmp_path, x, mode="append"):
    streams.run_to_end(x, str(tmp_path / "out"), str(tmp_path / "check"), mode)
    return spark.read.schema(x.schema).parquet(str(tmp_path / "out"))


def _events(spark):
    rows = [(k % 3, at(h, d), float(k), k) for k, (d, h) in enumerate((d, h) for d in range(1, 6) for h in (0, 3, 6, 21))] + [(9, at(0, 28), 0.0, 999)]
    return spark.createDataFrame(rows, "tile int, ts timestamp, value double, id long")


def test_tumbling_stream_equals_batch(spark, tmp_path):
    batch = _events(spark)
    got = _run(spark, tmp_path, streams.tumbling(_stream(spark, tmp_path, batch), ["tile"]))
    want = batch.where("tile < 9").groupBy("tile", F.to_date("ts").alias("day")).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    got = got.where("tile < 9").select("tile", F.to_date("window.start").alias("day"), "n", "s", "q")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_session_stream(spark, tmp_path):
    got = _run(spark, tmp_path, streams.sessions(_stream(spark, tmp_path, _events(spark).withColumn("tile", F.when(F.col("tile") < 9, 1).otherwise(9))), ["tile"], gap="5 hours"))
    assert sorted(r["n"] for r in got.where("tile = 1").collect()) == [1, 3, 4, 4, 4, 4]


def test_lookup_and_first_of_repeats_stream(spark, tmp_path):
    x = _stream(spark, tmp_path, _events(spark))
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "tile int, name string")
    got = _run(spark, tmp_path, streams.lookup(x, names, "tile"))
    assert got.count() == _events(spark).where("tile < 2").count()


def test_cross_mask_stream_equals_batch(spark, tmp_path):
    batch = _events(spark)
    x = _stream(spark, tmp_path, batch)
    other = streams.read_stream(spark, str(tmp_path / "in"), batch.schema)
    got = _run(spark, tmp_path, streams.cross_mask(x, other, ["tile"]))
    a, b = batch.select("tile", "ts", "value"), batch.select(F.col("tile").alias("t"), F.col("ts").alias("ts_da"), F.col("value").alias("value_da"))
    want = a.join(b, (a["tile"] == b["t"]) & (F.abs(F.col("ts").cast("long") - F.col("ts_da").cast("long")) <= 3 * 3600)).drop("t")
    assert sorted(map(str, got.select("tile", "ts", "ts_da", "value", "value_da").collect())) == sorted(map(str, want.select("tile", "ts", "ts_da", "value", "value_da").collect()))


def test_polar_grids_go_there_and_back(spark):
    x = spark.createDataFrame([(a, b) for a in (10, 60, 250, 251, 400) for b in (20, 249, 333)], "row int, col int")
    for grid, sign in (("N36", 1), ("S36", -1)):
        lat, lon = scalar.ease_center(F.col("row"), F.col("col"), grid)
        y = x.withColumns({"lat": lat, "lon": lon})
        row, col = scalar.ease_index(F.col("lat"), F.col("lon"), grid)
        got = y.withColumns({"r": row, "c": col}).where(F.col("lat") * sign > 0).collect()
        assert got and all((g["row"], g["col"]) == (g["r"], g["c"]) for g in got)
    far = scalar.ease_index(F.lit(-80.0), F.lit(0.0), "N36")
    assert spark.range(1).select(*far).first() == (None, None)


def test_station_days_without_values(spark):
    x = spark.createDataFrame([(1, at(5, 1), 0.2, None), (1, at(6, 1), 0.4, None), (1, at(5, 2), None, 2.0)], "k int, ts timestamp, sm double, p double")
    rows = lambda legacy: [(round(r["sm"], 9) if r["sm"] is not None else None, r["p"]) for r in compare.station_daily(x, ["k"], ["sm"], ["p"], legacy).orderBy("day").collect()]
    assert rows(False) == [(0.3, None), (None, 2.0)]
    assert rows(True) == [(0.3, 0.0), (None, 2.0)]


def test_clip_keeps_edges_and_overlaps(spark):
    x = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0), (9.0, 9.0), (None, 1.0)], "lon double, lat double")
    got = spatial.clip(x, {"a": (0.0, 5.0, 0.0, 5.0), "b": (5.0, 6.0, 5.0, 6.0)}, "lon", "lat").orderBy("lon", "region")
    assert [(r["lon"], r["region"]) for r in got.collect()] == [(0.0, "a"), (5.0, "a"), (5.0, "b")]


def test_left_cross_mask_and_cumulative_trend(spark):
    ol = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, fcst double")
    da = spark.createDataFrame([(1, 5.0, 1), (1, 6.0, 2)], "k int, obs double, o int")
    assert [tuple(r) for r in compare.crossmask(ol, da, ["k"], ["o"], "left").orderBy("k").collect()] == [(1, 1.0, 6.0), (2, 2.0, None)]
    x = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 2.0)], "k string, t int, v double")
    one = lambda skip: tuple(series.cumulative_trend(x, ["k"], ["t"], F.col("t"), "v", skip).first())
    assert one(False) == ("a", 1.0, 4 / 3, 3)
    assert one(True) == ("a", 1.0, 2.0, 2)
