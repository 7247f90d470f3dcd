"""Unit and property tests: edge rows, closed forms, plans, sources, streams."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dist, scalar
from fieldloom.operators import compare, ofa, series, spatial
from fieldloom.sources import ingest
from fieldloom.streaming import streams


def test_closed_forms():
    assert dist.t_two_sided(1.0, 1.0) == pytest.approx(0.5, abs=1e-12)
    assert dist.t_quantile(0.975, 1e7) == pytest.approx(dist.normal_quantile(0.975), abs=1e-6)
    p = np.array([0.1, 0.5, 0.9])
    assert dist.chi2_quantile(p, np.full(3, 2.0)) == pytest.approx(-2 * np.log(1 - p), rel=1e-9)
    assert dist.f_two_sided(4.0, 1.0, 9.0) == pytest.approx(2 * min(dist.t_two_sided(2.0, 9.0), 1 - dist.t_two_sided(2.0, 9.0)), rel=1e-9)
    assert np.isfinite(dist.chi2_quantile(np.array([0.975]), np.array([5000.0]))).all()


def test_ease_round_trip(spark):
    x = spark.range(400).select((F.col("id") % 20).cast("int").alias("r0"), (F.col("id") * 2).cast("int").alias("c0")).withColumn("r0", F.col("r0") * 20)
    lat, lon = scalar.ease_center(F.col("r0"), F.col("c0"), "M36")
    row, col = scalar.ease_index(F.col("lat"), F.col("lon"), "M36")
    got = x.withColumns({"lat": lat, "lon": lon}).withColumns({"r1": row, "c1": col})
    assert got.where("r0 <> r1 or c0 <> c1").count() == 0
    first = spark.range(1).select(*scalar.ease_center(F.lit(0), F.lit(0), "M36")).first()
    assert first[0] == pytest.approx(83.63197, abs=1e-4) and first[1] == pytest.approx(-179.8133, abs=1e-4)


def test_merge_of_parts_is_the_whole(spark):
    x = spark.createDataFrame([(k % 3, float(k), k + 0.5, k - 0.5, 0.1, 0.2, k % 2) for k in range(50)], "tile int, obs double, fcst double, ana double, obsvar double, fcstvar double, part int")
    whole = ofa.finalise(ofa.partial_sums(x, ["tile"])).orderBy("tile").toPandas()
    parts = ofa.finalise(ofa.merge(ofa.partial_sums(x, ["part", "tile"]), ["tile"])).orderBy("tile").toPandas()
    assert np.allclose(whole["omf_std"], parts["omf_std"]) and (whole["n"] == parts["n"]).all()


def test_nulls_and_fills(spark):
    x = spark.createDataFrame([(-9999.0,), (1e15,), (float("nan"),), (None,), (1.5,)], "v double").select(ofa.clean(F.col("v")).alias("v"))
    assert [r["v"] for r in x.collect()] == [None, None, None, None, 1.5]
    m = spark.createDataFrame([(1.0, 270.0, 0.0), (1.0, None, None), (1.0, 280.0, 0.5)], "v double, t double, f double")
    assert [r[0] for r in m.select(ofa.frozen_mask(F.col("v"), F.col("t"), F.col("f"))).collect()] == [None, 1.0, None]


def test_keep_last_chain(spark):
    x = spark.createDataFrame([(1, 1, 1), (1, 4, 2), (1, 8, 3), (2, 1, 4)], "k int, cycle int, id int")
    once = series.keep_last(x, ["k"], "cycle", ["id"])
    assert sorted(r["id"] for r in once.collect()) == [2, 3, 4]
    assert series.keep_last(once, ["k"], "cycle", ["id"]).count() == 3


def test_theil_sen_line_and_outliers(spark):
    rows = [(1, float(t), 2.0 * t) for t in range(40)] + [(2, float(t), 2.0 * t + (1000 if t % 5 == 0 else 0)) for t in range(40)]
    got = {r["tile"]: r for r in series.theil_sen_mk(spark.createDataFrame(rows, "tile int, t double, v double"), "tile", "t", "v").collect()}
    assert got[1]["slope_decade"] == pytest.approx(20) and got[1]["p"] < 1e-6
    assert got[2]["slope_decade"] == pytest.approx(20, rel=0.1)


def test_cyclic_smoothing_keeps_the_mean(spark):
    x = spark.createDataFrame([(1,)], "tile int").select("tile", F.explode(F.sequence(F.lit("2004-01-01").cast("date"), F.lit("2004-12-31").cast("date"))).alias("d"))
    x = x.select("tile", F.col("d").cast("timestamp").alias("ts"), F.dayofyear("d").cast("double").alias("v"))
    got = series.cyclic_doy(x, ["tile"], "v").toPandas()
    assert len(got) == 366 and got["clim"].mean() == pytest.approx(183.5)


def test_no_nested_loop_in_spatial_joins(spark):
    a = spark.range(10).select(F.col("id").alias("site"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    b = spark.range(10).select(F.col("id").alias("tile"), F.rand(3).alias("u"), F.rand(4).alias("v"))
    plan = spatial.nearest(a, b, "site", "tile", 0.3, ("x", "y"), ("u", "v"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tie_goes_to_the_lowest_tile(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "site int, x double, y double")
    b = spark.createDataFrame([(7, 0.1, 0.0), (3, -0.1, 0.0)], "tile int, u double, v double")
    assert spatial.nearest(a, b, "site", "tile", 0.1, ("x", "y"), ("u", "v")).first()["tile"] == 3


def test_overlap_weights(spark):
    src = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 1.0, 2.0, 0.0, 1.0)], "s int, x0 double, x1 double, y0 double, y1 double")
    dst = spark.createDataFrame([(9, 0.5, 1.75, 0.0, 1.0)], "d int, x0 double, x1 double, y0 double, y1 double")
    w = {r["s"]: r["w"] for r in spatial.overlap_weights(src, dst, "s", "d", 0.5).collect()}
    assert w == {1: pytest.approx(0.5), 2: pytest.approx(0.75)}


def test_standard_betas(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=500), rng.normal(size=500)
    x = spark.createDataFrame([(float(p), float(q), float(3 * p - q)) for p, q in zip(a, b)], "a double, b double, y double")
    assert [n for n, _ in compare.standard_betas(x, "y", ["a", "b"])] == ["a", "b"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary_observations(spark, tmp_path, order):
    def record(raw: bytes) -> bytes:
        mark = struct.pack(f"{order}i", len(raw))
        return mark + raw + mark

    n = 3
    raw = record(struct.pack(f"{order}9i", n, 2015, 4, 1, 3, 0, 0, 91, 19))
    for _, kind in ingest.FIELDS:
        values = [1, 0, 1] if kind == "i4" else [0.5, -9999.0, 2.5]
        raw += record(np.array(values).astype(f"{order}{kind}").tobytes())
    (tmp_path / "a.bin").write_bytes(raw)
    got = ingest.read_observations(spark, str(tmp_path)).toPandas()
    assert got["obs"].isna().tolist() == [False, True, False] and got["assim"].tolist() == [True, False, True]


def test_partials_are_replaced_by_month(spark, tmp_path):
    p = str(tmp_path / "parts")
    one = spark.createDataFrame([("2001-01", 1, 5.0), ("2001-02", 1, 6.0)], "month string, tile int, s double")
    ingest.write_partials(one, p, ["month"])
    ingest.write_partials(spark.createDataFrame([("2001-02", 1, 9.0)], "month string, tile int, s double"), p, ["month"])
    assert sorted(r["s"] for r in spark.read.parquet(p).collect()) == [5.0, 9.0]
    wanted = spark.createDataFrame([("2001-02",), ("2001-03",)], "month string")
    assert [r[0] for r in ingest.missing_months(wanted, spark.read.schema("s double, tile int, month string").parquet(p), ["month"]).collect()] == ["2001-03"]


def test_stream_equals_batch(spark, tmp_path):
    from conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    s = streams.tumbling(streams.read_stream(spark, str(tmp_path / "in"), events.schema), ["event_type"], late="0 seconds")
    s.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = streams.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    key = lambda df: sorted((str(r["window"][0]), r["event_type"], r["n"], round(r["s"], 6)) for r in df.collect())
    assert key(spark.table("daily")) == key(batch)


def test_entry_and_scalar_functions(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    scalar.register(spark)
    assert spark.sql("SELECT haversine_km(0.0D, 0.0D, 0.0D, 1.0D)").first()[0] == pytest.approx(math.pi * 6371 / 180, rel=1e-9)
