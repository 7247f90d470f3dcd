"""What must not grow faster than the input: plans and results on copies."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fieldloom.operators import compare, ofa, quantiles, spatial
from fieldloom.plans import registry


@pytest.fixture
def large(spark):
    """Plans as for large tables: nothing is broadcast for its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd():
    """Sites and tiles that share places; keys repeat, a place is missing, ties abound."""
    rng = np.random.default_rng(3)
    a = pd.DataFrame({"site": np.arange(300) % 290, "x": rng.integers(0, 20, 300) * 0.5, "y": rng.integers(0, 20, 300) * 0.5})
    b = pd.DataFrame({"tile": rng.permutation(200), "u": rng.integers(0, 15, 200) * 0.7, "v": rng.integers(0, 15, 200) * 0.7, "val": rng.integers(0, 9, 200) * 1.0})
    b.loc[::7, "val"] = np.nan
    a.loc[5, "x"] = np.nan
    return a, b


def stored(spark, path, frame):
    """A small file, which Spark would broadcast."""
    df = spark.createDataFrame(frame)
    df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_nearest_by_place(spark, tmp_path):
    a, b = crowd()
    df = spatial.nearest(stored(spark, tmp_path / "a", a), stored(spark, tmp_path / "b", b), "site", "tile", 0.6, ("x", "y"), ("u", "v"))
    assert "Broadcast" not in plan(df)
    p = a.merge(b, how="cross")
    p["d2"] = (p.x - p.u) ** 2 + (p.y - p.v) ** 2
    want = p[p.d2 <= 0.36].sort_values(["site", "d2", "tile"]).groupby("site").first()
    assert {r["site"]: (r["tile"], round(r["distance"], 9)) for r in df.collect()} == {k: (r.tile, round(r.d2**0.5, 9)) for k, r in want.iterrows()}


def test_nearest_km_by_place(spark, tmp_path):
    a, b = crowd()
    df = spatial.nearest_km(stored(spark, tmp_path / "a", a), stored(spark, tmp_path / "b", b), "site", "tile", 60.0, ("y", "x"), ("v", "u"))
    assert "Broadcast" not in plan(df)
    p = a.merge(b, how="cross")
    la, lo, ma, mo = (np.radians(p[c]) for c in ("y", "x", "v", "u"))
    p["km"] = 2 * 6371 * np.arcsin(np.sqrt(np.sin((ma - la) / 2) ** 2 + np.cos(la) * np.cos(ma) * np.sin((mo - lo) / 2) ** 2))
    least = p[p.km <= 60].groupby("site").km.min()
    got = {r["site"]: (r["tile"], r["km"]) for r in df.collect()}
    assert set(got) == set(least.index) and all(abs(got[k][1] - v) < 1e-6 for k, v in least.items())
    near = p[p.km <= p.site.map(least) + 1e-6].groupby("site").tile.min()  # of copies of a place the lowest tile
    same = p.groupby(["u", "v"]).tile.min()
    first = {r.tile: same[(r.u, r.v)] for r in b.itertuples()}
    assert all(first[got[k][0]] == got[k][0] for k in near.index)


def test_pool_by_place(spark, tmp_path):
    a, b = crowd()
    obs, cells = stored(spark, tmp_path / "b", b), stored(spark, tmp_path / "a", a)
    p = a.merge(b, how="cross")
    p["d2"] = (p.x - p.u) ** 2 + (p.y - p.v) ** 2
    p = p[p.d2 <= 1]
    df = spatial.pool(obs, cells, 1.0, ("u", "v"), ("x", "y"), "site", "val")
    assert "Broadcast" not in plan(df)
    want = p.groupby("site").val.agg(["count", "mean"])
    got = {r["site"]: (r["n"], r["mean"]) for r in df.collect()}
    assert set(got) == set(want.index)
    for k, w in want.iterrows():
        assert got[k][0] == w["count"] and (got[k][1] is None if w["count"] == 0 else abs(got[k][1] - w["mean"]) < 1e-9)
    df = spatial.inverse_distance(obs, cells, 1.0, ("u", "v"), ("x", "y"), "site", "val")
    assert "Broadcast" not in plan(df)
    p = p.dropna(subset="val").assign(w=lambda q: 1 / (q.d2 + 1e-9))
    want = (p.w * p.val).groupby(p.site).sum() / p.w.groupby(p.site).sum()
    got = {r["site"]: r["val"] for r in df.collect()}
    assert set(got) == set(want.index) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_few_species_are_not_sorted(spark, large):
    assert "SortMergeJoin" not in plan(registry.QUERIES["omf_stats"](spark, SF))


def test_dealt_sums(spark):
    x = registry.ofa_table(spark, SF).withColumn("month", ofa.month_of(F.col("ts")))
    keys = ["month", "tile", "species"]
    plain, dealt = (ofa.partial_sums(x, keys, deal=d).orderBy(*keys).toPandas() for d in (None, ["month", "tile"]))
    assert list(plain.columns) == list(dealt.columns)
    pd.testing.assert_frame_equal(plain, dealt)


def test_bins_are_not_sorted(spark, large, tmp_path):
    x = stored(spark, tmp_path / "x", pd.DataFrame({"p": np.arange(1, 3001) % 60 + 0.5, "y": np.arange(3000) * 7 % 3000 * 1.0}))
    x = x.withColumn("bin", F.floor(F.log2("p")))
    one = plan(quantiles.group_percentiles(x, ["bin"], "y", [0.25, 0.5], small=20, few=True))
    assert "SortMergeJoin" not in one
    whole = quantiles.group_percentiles(x, [], "y", [0.25, 0.5], small=20)
    assert "SortMergeJoin" not in plan(whole) and whole.first()["p"] == [749.75, 1499.5]
    got = compare.log_bins(x, "p", "y", 1.0, 64.0, 6)
    assert plan(got).count("SortMergeJoin") == 1  # of the few rows of statistics and percentiles
    v = x.toPandas()
    v = v[v.p >= 1].assign(b=lambda q: np.maximum(1, np.ceil(np.log2(q.p))))
    want = v.groupby("b").y.median()
    assert {r["bin"]: r["median"] for r in got.collect()} == {int(k): m for k, m in want.items()}


def test_moments_travel_as_rows(spark, large):
    sent = [line for line in plan(registry.QUERIES["ofa_moments"](spark, SF)).splitlines() if "Exchange" in line]
    assert len(sent) == 2 and all("REPARTITION_BY_COL" in line for line in sent)


def test_cells_are_unpacked_last(spark, tmp_path):
    tiles = pd.DataFrame({"tile": np.arange(60), "i": np.arange(60) % 3, "j": 0, "com_lon": np.arange(60) % 3 + 0.5, "com_lat": 0.5}).assign(min_lon=lambda t: t.com_lon - 0.2, max_lon=lambda t: t.com_lon + 0.3, min_lat=0.2, max_lat=0.8)
    obs = pd.DataFrame({"id": np.arange(500), "lon": np.arange(500) % 40 / 10, "lat": np.arange(500) % 7 / 7}).assign(i=lambda o: np.floor(o.lon).astype(int), j=0)
    df = spatial.tile_by_cell(stored(spark, tmp_path / "o", obs), stored(spark, tmp_path / "t", tiles), F.lit(0.35), pack=4)
    assert df.rdd.getNumPartitions() == 4 and "Generate explode" in plan(df)
    p = obs.merge(tiles, on=["i", "j"])
    inside = p.lon.between(p.min_lon, p.max_lon) & p.lat.between(p.min_lat, p.max_lat)
    p = p[inside | (np.maximum(abs(p.lon - p.com_lon), abs(p.lat - p.com_lat)) <= 0.35)]
    assert sorted((r["id"], r["tile"]) for r in df.select("id", "tile").collect()) == sorted(zip(p.id, p.tile))


@pytest.mark.parametrize("few", [0, 1000])
def test_screening_ranks_columns_once(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(compare, "FEW_RANKS", few)
    rng = np.random.default_rng(5)
    v = pd.DataFrame({"a": rng.integers(0, 40, 900) * 0.5, "b": rng.normal(size=900), "p": rng.integers(0, 7, 900) * 1.0, "q": rng.normal(size=900), "w": rng.normal(size=900), "k": 3.0})
    v["q"] += v.a
    v.loc[::9, "w"] = np.nan
    x = stored(spark, tmp_path / "x", v)
    df = compare.screen_pairs(x, ["a", "b"], ["p", "q", "w", "k"])
    got = {(r["target"], r["predictor"]): r for r in df.collect()}
    assert len(got) == 8
    for (t, p), r in got.items():
        z = v[[t, p]].dropna()
        assert r["n"] == len(z)
        if p == "k":
            assert r["r"] is None and r["rho"] is None and r["slope"] is None
            continue
        slope, cut = np.polyfit(z[p], z[t], 1)
        want = z[t].corr(z[p]), z[t].rank().corr(z[p].rank()), slope, cut
        assert np.allclose([r["r"], r["rho"], r["slope"], r["intercept"]], want, atol=1e-9)
    # two complete targets on three complete predictors are unpivoted by predictor, not by pair
    assert "stack(6" not in plan(compare.screen_pairs(x, ["a", "b"], ["p", "q", "k"]))
    assert compare.screening(x, "a", ["p", "w"]).count() == 2


def test_pairs_of_cells_are_written_small(spark, tmp_path):
    n = np.arange(12_000)
    tiles = pd.DataFrame({"tile": n * 7919 % 100003, "i": 0, "j": 0, "com_lon": 0.5, "com_lat": 0.5, "min_lon": 0.0, "max_lon": 1.0, "min_lat": 0.0, "max_lat": 1.0})
    obs = pd.DataFrame({"id": np.arange(120) * 104729 % 1000003, "lon": 0.5, "lat": 0.5, "i": 0, "j": 0})
    spatial.tile_by_cell(stored(spark, tmp_path / "o", obs), stored(spark, tmp_path / "t", tiles), F.lit(0.35)).select("id", "tile").write.parquet(str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).distinct().count() == 1_440_000
    assert sum(f.stat().st_size for f in (tmp_path / "p").glob("*.parquet")) < 0.5 * 1_440_000


def test_cells_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    tiles = pd.DataFrame({"tile": rng.integers(0, 150, 200) * 1.0, "i": rng.integers(0, 3, 200) * 1.0, "j": 0, "com_lon": rng.integers(0, 12, 200) / 4, "com_lat": 0.5}).assign(min_lon=lambda t: t.com_lon - 0.1, max_lon=lambda t: t.com_lon + 0.2, min_lat=0.2, max_lat=0.8)
    tiles.loc[::9, "tile"], tiles.loc[::11, "i"], tiles.loc[::13, "min_lon"] = np.nan, np.nan, np.nan
    obs = pd.DataFrame({"id": np.arange(400) % 390, "lon": rng.integers(0, 40, 400) / 10, "lat": rng.integers(0, 9, 400) / 9}).assign(i=lambda o: np.where(np.arange(400) < 250, 1.0, np.floor(o.lon)), j=0)
    obs.loc[::10, "i"], obs.loc[::17, "lon"] = np.nan, np.nan
    obs = pd.concat([obs, obs[:40]])  # the same rows again
    o, t = stored(spark, tmp_path / "o", obs), stored(spark, tmp_path / "t", tiles)
    got = [spatial.tile_by_cell(o, t, F.lit(0.35), pack=k, rows=m).select("id", "i", "lon", "tile") for k, m in ((4, 3), (512, 32))]
    outside = "not (lon between min_lon and max_lon and lat between min_lat and max_lat) and greatest(abs(lon - com_lon), abs(lat - com_lat)) > 0.35"
    want = o.join(t.where("tile is not null"), ["i", "j"]).where(f"not ({outside})").select("id", "i", "lon", "tile")
    assert want.count() > 3000 and all(g.exceptAll(want).isEmpty() and want.exceptAll(g).isEmpty() for g in got)
    assert spatial.tile_by_cell(o.limit(0), t, F.lit(0.35)).isEmpty() and spatial.tile_by_cell(o, t.limit(0), F.lit(0.35)).isEmpty()
    assert spatial.tile_by_cell(o, t.withColumn("tile", F.lit(None).cast("double")), F.lit(0.35)).isEmpty()


def test_a_cell_with_every_row_is_shared(spark, tmp_path):
    tiles = pd.DataFrame({"tile": np.arange(40), "i": 0, "j": 0, "com_lon": 0.5, "com_lat": 0.5, "min_lon": 0.0, "max_lon": 1.0, "min_lat": 0.0, "max_lat": 1.0})
    obs = pd.DataFrame({"id": np.arange(2000), "lon": 0.5, "lat": 0.5, "i": 0, "j": 0})
    df = spatial.tile_by_cell(stored(spark, tmp_path / "o", obs), stored(spark, tmp_path / "t", tiles), F.lit(0.35), pack=8)
    shares = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 4 and sum(shares) == 80_000 and max(shares) < 30_000
