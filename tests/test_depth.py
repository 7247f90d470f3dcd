"""Calendar windows, exact group quantiles, centred moments, long trends, raw state files and small functions, against plain Python."""

import datetime as dt
import math
import random
import statistics
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom.functions import dist, scalar, trend
from fieldloom.operators import compare, ofa, quantiles, scaling, series, summaries
from fieldloom.plans import tails
from fieldloom.sources import ingest

RND = random.Random(11)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# windows over the calendar


def _states(n=1500, species=(1,)):
    day = dt.datetime(2001, 1, 1)
    rows = []
    for _ in range(n):
        at = day + dt.timedelta(days=RND.randrange(4 * 365 + 1))
        rows.append((at, RND.choice(species), RND.choice([1, 2]), None if RND.random() < 0.1 else RND.gauss(5, 1), None if RND.random() < 0.1 else RND.gauss(4, 2)))
    return rows


def _last_days(width, start, end):
    """(doy, [(month, day, first year, last year) of the window]) for the spine's last 365 ends."""
    common = [dt.date(2014, 1, 1) + dt.timedelta(days=k) for k in range(365)]
    extra = sum((common[-1].replace(month=m % 12 + 1, day=1) - dt.timedelta(days=1)).day for m in range(1, math.ceil(width / 30) + 1))
    spine = [(d.month, d.day, start[0] + (d.month < start[1]), end[0] - (d.month > end[1])) for d in common + common[:extra]]
    return [((t - 1 - width // 2) % 365 + 1, spine[t - width : t]) for t in range(len(spine) - 364, len(spine) + 1)]


@pytest.mark.parametrize("width", [75, 31])
def test_scaling_calendar(spark, width):
    rows, start, end = _states(), (2001, 5), (2003, 8)
    got = {(r["tile"], r["doy"]): r for r in scaling.scaling_calendar(spark.createDataFrame(rows, "ts timestamp, species int, tile int, obs double, fcst double"), ["tile"], start, end, width, 20).collect()}
    seen = 0
    for doy, days in _last_days(width, start, end):
        ok = {(m, d): (a, b) for m, d, a, b in days}
        for tile in (1, 2):
            v = [(o, f) for ts, _, k, o, f in rows if k == tile and f is not None and (ts.month, ts.day) in ok and ok[ts.month, ts.day][0] <= ts.year <= ok[ts.month, ts.day][1]]
            o, f = [x for x, _ in v if x is not None], [y for _, y in v]
            r = got.get((tile, doy))
            assert (r is not None) == (len(o) >= 20)
            if r is not None:
                seen += 1
                assert (r["n"], r["pentad"], r["stored"]) == (len(o), (doy + 2) // 5, (doy + 2) % 5 == 0)
                m = sum(f) / len(o)
                want = [statistics.fmean(o), statistics.pstdev(o), m, math.sqrt(max(0, sum(x * x for x in f) / len(o) - m * m)), min(f), max(f)]
                assert [r[c] for c in ("o_mean", "o_std", "m_mean", "m_std", "m_min", "m_max")] == pytest.approx(want, rel=1e-9)
    assert seen > 300 and len(got) == seen


def test_scaling_calendar_equals_the_circle_where_years_are_one(spark):
    x = spark.createDataFrame([r for r in _states() if r[3] is not None and r[4] is not None], "ts timestamp, species int, tile int, obs double, fcst double")
    a = {(r["tile"], r["pentad"]): r for r in scaling.scaling_calendar(x, ["tile"], (2001, 1), (2004, 12)).where("stored").collect()}
    b = {(r["tile"], r["pentad"]): r for r in series.scaling_windows(x, ["tile"]).collect()}
    assert a.keys() == b.keys() and len(a) == 146
    assert all(a[k]["n"] == b[k]["n"] and a[k]["o_std"] == pytest.approx(b[k]["o_std"]) and a[k]["m_max"] == b[k]["m_max"] for k in a)


def test_scaling_angles(spark):
    rows = list({(r[0], r[1], r[2]): r for r in _states(4000, (1, 2, 3, 4))}.values())
    x = spark.createDataFrame(rows, "ts timestamp, species int, tile int, obs double, fcst double")
    kinds = [(1, 0, [40.0, 41.0]), (2, 1, [40.0]), (3, 1, [55.0]), (4, 0, [99.0])]
    species = spark.createDataFrame(kinds, "species int, pol int, ang array<double>")
    start, end, width = (2001, 3), (2004, 10), 95
    got = {(r["tile"], r["doy"]): r for r in scaling.scaling_angles(x, species, [40.0, 55.0], start, end, width).collect()}
    by = defaultdict(list)
    for ts, s, tile, o, f in rows:
        if o is not None and f is not None:
            by[tile, s, ts.month, ts.day].append((ts.year, o, f))
    seen = 0
    for doy, days in _last_days(width, start, end):
        values = lambda tile, s, part: [(o, f) for m, d, a, b in part for y, o, f in by[tile, s, m, d] if a <= y <= b]
        for tile in (1, 2):
            for s, side, k in ((1, "h", 0), (2, "v", 0), (3, "v", 1)):
                v, core, centre = values(tile, s, days), values(tile, s, days[width // 2 - 15 : width // 2 + 16]), values(tile, s, days[width // 2 : width // 2 + 1])
                r = got[tile, doy]
                good = len(v) >= 20 and len(core) >= 8
                assert (r[f"n_{side}"][k] is not None) == good
                if good:
                    seen += 1
                    assert r[f"n_{side}"][k] == len(v)
                    assert [r[f"{c}_{side}"][k] for c in ("o_mean", "o_std", "m_mean", "m_std")] == pytest.approx([f([p[q] for p in v]) for q in (0, 1) for f in (statistics.fmean, statistics.pstdev)], rel=1e-8)
                assert r[f"o_centre_{side}"][k] == (pytest.approx(statistics.fmean([p[0] for p in centre])) if centre else None)
            assert got[tile, doy]["n_h"][1] is None
    assert seen > 1000
    with pytest.raises(PySparkException):
        scaling.scaling_angles(x.unionByName(x.where("species = 1 and fcst is not null").orderBy("ts").limit(1)), species, [40.0], start, end).collect()


# quantiles


def _percentile(v, q):
    v = sorted(v)
    at = q * (len(v) - 1)
    return v[int(at)] + (at - int(at)) * (v[min(len(v) - 1, int(at) + 1)] - v[int(at)])


@pytest.mark.parametrize("small", [20, 50, 10_000])
def test_group_percentiles(spark, small):
    rows = [(None if g == 3 else g, RND.choice([RND.gauss(0, 1), 0.0, float(RND.randrange(5))])) for g in range(4) for _ in range((1, 30, 900, 2500)[g])] + [(9, None)]
    rows += [(5, 7.0)] * 800 + [(5, 8.0)]  # one value for nearly all
    x = spark.createDataFrame(rows, "g int, v double")
    shares = [0.5, 0.0, 0.05, 0.25, 0.999, 1.0]
    got = {r["g"]: (r["n"], r["p"]) for r in quantiles.group_percentiles(x.repartition(5), ["g"], "v", shares, small).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    assert got.keys() == by.keys() == {0, 1, 2, None, 5}
    for g, v in by.items():
        assert got[g][0] == len(v) and got[g][1] == pytest.approx([_percentile(v, q) for q in shares])
    assert quantiles.group_percentiles(x.where("false"), ["g"], "v", shares).collect() == []


def test_percentiles_read_the_rows_twice(spark):
    x = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    plans = [quantiles.group_percentiles(x, ["g"], "v", shares)._jdf.queryExecution().optimizedPlan().toString() for shares in ([0.5], [0.05, 0.25, 0.5, 0.75, 0.95])]
    assert [p.count("Range (") for p in plans] == [2, 2]


def test_weighted_median(spark):
    rows = [(RND.choice([None, 1, 2]), RND.choice([None, RND.gauss(0, 1), 1.0]), float(RND.randrange(-1, 5))) for _ in range(2000)] + [(7, 1.0, 0.0), (8, 5.0, 2.0)]
    x = spark.createDataFrame(rows, "g int, v double, w double")
    want = {}
    for g in (None, 1, 2, 8):
        v = sorted((b, c) for a, b, c in rows if a == g and b is not None and c > 0)
        total, run = sum(c for _, c in v), 0.0
        for b, c in v:
            run += c
            if run >= 0.5 * total:
                want[g] = b
                break
    for parts in (4, 256):
        assert {r["g"]: r["wmedian"] for r in quantiles.weighted_median(x, ["g"], "v", "w", parts).collect()} == want
    assert {r["g"] for r in compare.area_summary(x, ["g"], "v", "w").collect()} == want.keys()


# moments


def test_moments_with_a_large_mean(spark):
    """A mean of 1e6 and a spread of 1: raw power sums would hold nothing of the skew."""
    rows = [(dt.datetime(2001, 1 + k % 9, 5, 3 * (k % 8)), k % 2, 1e6 + RND.expovariate(1), 0.0, 1e6 - RND.gauss(0, 1), 0.5, 0.5) for k in range(3000)] + [(None, 0, None, 1.0, 1.0, 1.0, 1.0)]
    x = spark.createDataFrame(rows, "ts timestamp, tile int, obs double, fcst double, ana double, obsvar double, fcstvar double")
    parts = ofa.moments(x, ["month", "tile"], month=True, normalise=True)
    got = {r["tile"]: r for r in ofa.moment_statistics(ofa.merge_moments(parts, ["tile"])).collect()}
    whole = {r["tile"]: r for r in ofa.moment_statistics(ofa.moments(x, ["tile"], normalise=True)).collect()}
    for tile in (0, 1):
        d = [o - f for _, t, o, f, *_ in rows if t == tile and o is not None]
        mean = sum(v - 1e6 for v in d) / len(d)
        n, c = len(d), [v - 1e6 - mean for v in d]
        m2, m3, m = sum(v * v for v in c), sum(v**3 for v in c), mean + 1e6
        for r in (got[tile], whole[tile]):
            assert r["n"] == n and r["omf_mean"] - 1e6 == pytest.approx(mean, abs=1e-8) and r["omf_var"] == pytest.approx(m2 / (n - 1), rel=1e-8)
            assert r["omf_skew"] == pytest.approx((m3 + 3 * m * m2 / n + m**3) / (n - 1) / (m2 / (n - 1)) ** 1.5, rel=1e-8)
            assert r["obsvar"] == 0.5 and -1 <= r["oa_corr"] <= 1
    centred = ofa.moments(x.withColumns({"fcst": F.lit(1e6), "ana": F.col("obs")}), ["tile"]).orderBy("tile").collect()
    for tile in (0, 1):  # the third moment itself survives
        c = [o - 1e6 for _, t, o, *_ in rows if t == tile and o is not None]
        mean = sum(c) / len(c)
        assert centred[tile]["ddd"] == pytest.approx(sum((v - mean) ** 3 for v in c), rel=1e-7)
    assert sum(r["n"] for r in ofa.moments(x, ["tile"], hour=6).collect()) == sum(k % 8 == 2 for k in range(3000))
    alone = ofa.moment_statistics(ofa.moments(x.limit(1), ["tile"])).first()
    assert alone["n"] == 1 and alone["omf_var"] is None and alone["omf_skew"] is None


# trends


def _pairs_form(t, y):
    i, j = np.triu_indices(len(t), 1)
    dt_, dy = t[j] - t[i], y[j] - y[i]
    ok = dt_ != 0
    return (float(np.median(dy[ok] / dt_[ok])) if ok.any() else None), int((np.sign(dy[ok]) * np.sign(dt_[ok])).sum())


@pytest.mark.parametrize("short", [0, 300])
def test_slopes_without_pairs(monkeypatch, short):
    monkeypatch.setattr(trend, "SHORT", short)
    rng = np.random.default_rng(5)
    for k in range(150):
        n = int(rng.integers(1, 90))
        t = rng.integers(0, 6 if k % 3 else n, n).astype(float) if k % 2 else np.arange(n) / 12.0
        y = rng.integers(0, 3, n).astype(float) if k % 5 == 0 else rng.normal(0, 10.0 ** rng.integers(-6, 6), n)
        (a, s), (b, z) = trend.slope_and_s(t, y), _pairs_form(t, y)
        assert s == z and (a == b if b is None else a == pytest.approx(b, rel=1e-9, abs=1e-300))


def test_daily_series_of_25_years():
    rng = np.random.default_rng(1)
    t = np.arange(9131) / 365.25
    y = np.sin(6.28 * t) + 0.01 * t + rng.normal(0, 0.3, len(t))
    tracemalloc.start()
    slope, s = trend.slope_and_s(t, y)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
    part = slice(0, 1500)
    assert trend.slope_and_s(t[part], y[part]) == (pytest.approx(_pairs_form(t[part], y[part])[0], rel=1e-12), _pairs_form(t[part], y[part])[1])
    assert trend.falling(y - slope * t) == pytest.approx(len(t) * (len(t) - 1) / 4, abs=1) and s > 0


# sources and small functions


def test_state_files_are_pruned_by_name(spark, tmp_path):
    for day in range(1, 6):
        spark.createDataFrame([(k, 10.0 * day + k, 45.0 + k, float(k)) for k in range(3)], "tile int, sm double, lat double, lon double").coalesce(1).write.parquet(str(tmp_path / "raw" / f"d{day}"))
    files = tmp_path / "states"
    files.mkdir()
    for day in range(1, 6):
        (part,) = (tmp_path / "raw" / f"d{day}").glob("part-*.parquet")
        part.rename(files / f"run.2020010{day}_0000z.parquet")
    for name in ("run.20191231_0000z.parquet", "run.20200106_0000z.parquet", "readme.parquet"):  # would fail if they were opened
        (files / name).write_bytes(b"no parquet")
    x = ingest.scan_state_files(spark, str(files), ["sm"], "2020-01-02", "2020-01-04")
    assert sorted({f.rsplit(".", 2)[1][:8] for f in x.inputFiles()}) == ["20200102", "20200103", "20200104"]
    got = sorted((r["day"].day, r["tile"], r["sm"], r["lat"]) for r in x.collect())
    assert got == [(d, k, 10.0 * d + k, 45.0 + k) for d in (2, 3, 4) for k in range(3)]
    with pytest.raises(ValueError):
        ingest.scan_state_files(spark, str(files), ["sm"], "2021-01-01", "2021-01-02")


def _record(raw):
    return np.array([len(raw)], "<i4").tobytes() + raw + np.array([len(raw)], "<i4").tobytes()


def test_tile_file(spark, tmp_path):
    fields = [np.arange(2, dtype=f"<{kind}") + 10 * k for k, (_, kind) in enumerate(ingest.TILE_FIELDS)]
    (tmp_path / "t.bin").write_bytes(b"".join(map(_record, [np.array([2], "<i4").tobytes(), *[f.tobytes() for f in fields]])))
    got = ingest.read_tiles(spark, str(tmp_path / "t.bin")).orderBy("tilenum").collect()
    assert [(r["tilenum"], r["tile_id"], r["com_lon"], r["elev"]) for r in got] == [(1, 0, 30.0, 140.0), (2, 1, 31.0, 141.0)]


def test_footprints_and_order(spark):
    names = ["lat", "lon", "ssom", "tpcx", "domo", "smpf", "smcf", "alfr", "iwfr", "snoc", "flsf"]
    x = spark.createDataFrame([tuple(float(k == 5 and bad) for k in range(11)) for bad in (0, 1)], ", ".join(f"{n} double" for n in names))
    assert ingest.scan_footprints(x).count() == 1
    with pytest.raises(ValueError):
        ingest.scan_footprints(x.drop("snoc"))
    y = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "tile int, t int")
    assert [tuple(r) for r in summaries.ordered(y, ["tile", "t"]).collect()] == [(1, 1), (1, 2), (2, 1)]


def test_scalars_that_no_query_runs(spark):
    lit = F.lit
    assert [one(spark, scalar.cell_index(lit(v), -5.0, 2.5, 4)) for v in (-5.0, -2.51, 4.99, 5.0, -5.01)] == [0, 0, 3, None, None]
    assert one(spark, scalar.per_year(lit(2.0))) == pytest.approx(2 * 365.25 * 86400)
    assert [one(spark, scalar.perturbation(lit(4.0), lit(v))) for v in (-90.0, 0.0, 90.0)] == [0.0, 4.0, 8.0]


def test_leap_seconds(spark):
    """Both sides of every step: the leap second itself reads as the first of the next day."""
    zero = dt.datetime(2000, 1, 1)
    for k, day in enumerate(scalar.LEAP_DAYS, 1):
        step = int((dt.datetime.fromisoformat(day) - zero).total_seconds()) + k - 1
        got = [one(spark, scalar.j2000(F.lit(step + s), "UT00", leap=True)) for s in (-1, 0, 1, 2)]
        midnight = dt.datetime.fromisoformat(day)
        assert got == [midnight + dt.timedelta(seconds=s) for s in (-1, 0, 0, 1)]
    assert one(spark, scalar.j2000(F.lit(0))) == dt.datetime(2000, 1, 1, 12) and one(spark, scalar.j2000(F.lit(5), "UT12")) == dt.datetime(2000, 1, 1, 11, 59)


def test_sql_functions_equal_the_columns(spark):
    scalar.register(spark)
    x = spark.createDataFrame([(lat, lon) for lat in (-89.0, -30.2, 0.0, 12.3, 84.9) for lon in (-180.0, -0.1, 0.0, 77.7, 179.9)], "lat double, lon double")
    for grid in scalar.EASE_GRIDS:
        row, col = scalar.ease_index(F.col("lat"), F.col("lon"), grid)
        y = x.withColumns({"r": row, "c": col})
        la, lo = scalar.ease_center(F.col("r"), F.col("c"), grid)
        for g in y.withColumns({"la": la, "lo": lo}).selectExpr("*", f"ease_row('{grid}', lat) AS r2", f"ease_col('{grid}', lon) AS c2", f"ease_lat('{grid}', r) AS la2", f"ease_lon('{grid}', c) AS lo2").collect():
            assert (g["r"], g["c"]) == (g["r2"], g["c2"]) and (g["la2"], g["lo2"]) == pytest.approx((g["la"], g["lo"]), abs=1e-9)
    d = F.col("d")
    for g in spark.sql("SELECT explode(sequence(DATE '2019-12-30', DATE '2021-01-02')) AS d").select(scalar.pentad(d).alias("p"), scalar.normal_doy(d).alias("n"), F.expr("pentad(d)").alias("p2"), F.expr("normal_doy(d)").alias("n2")).collect():
        assert (g["p"], g["n"]) == (g["p2"], g["n2"])


def test_p_of_a_correlation(spark):
    x = spark.createDataFrame([("a", 0.5, 20), ("b", 0.0, 30), ("c", -0.9, 5)], "predictor string, r double, n int")
    got = {r["predictor"]: r["p"] for r in compare.with_p(x).collect()}
    assert got == pytest.approx({"a": 0.024769558, "b": 1.0, "c": 0.037386074}, abs=1e-6)


def test_tails_by_integration_and_by_fractions_agree():
    """The SQL of the oracles integrates densities; the library sums continued fractions."""
    con = duckdb.connect()
    con.sql("CREATE TABLE d AS SELECT unnest([1, 2, 3, 5, 29, 100, 700]) :: DOUBLE AS df")
    got = con.sql(f"WITH RECURSIVE {tails.t_quantiles('tq', 'd')}, {tails.chi2_quantiles('lo', 'd', 0.025)}, {tails.chi2_quantiles('up', 'd', 0.975)} SELECT df, t, lo.x AS lo, up.x AS up FROM tq JOIN lo USING (df) JOIN up USING (df)").df()
    assert np.allclose(got["t"], dist.t_quantile(0.975, got["df"]), atol=1e-8)
    assert np.allclose(got["lo"], dist.chi2_quantile(0.025, got["df"]), atol=1e-6) and np.allclose(got["up"], dist.chi2_quantile(0.975, got["df"]), atol=1e-6)
    con.sql("CREATE TABLE e AS SELECT t, df FROM (SELECT unnest([0.05, 0.3, 1.0, 2.0, 4.5, 20.0]) AS t), d")
    got = con.sql(f"SELECT t, df, {tails.t_two_sided('t', 'df')} AS p, {tails.f_two_sided('t', 'df + 1', '300.0')} AS f, {tails.normal_two_sided('-t')} AS z FROM e").df()
    assert np.allclose(got["p"], dist.t_two_sided(got["t"], got["df"]), atol=1e-9)
    assert np.allclose(got["f"], dist.f_two_sided(got["t"], got["df"] + 1, 300.0), atol=1e-8)
    assert np.allclose(got["z"], 2 * (1 - dist.normal_cdf(got["t"])), atol=1e-9)


def test_screening_of_all_pairs_skips_gaps_and_keeps_the_best(spark):
    rows = [(float(i), float(i * i % 7), 2.0 * i + i % 2, None if i % 5 == 0 else float(-i), float("nan") if i == 3 else 1.0) for i in range(20)]
    x = spark.createDataFrame(rows, "t double, u double, a double, b double, c double")
    got = {(r["target"], r["predictor"]): r for r in compare.screen_pairs(x, ["t", "u"], ["a", "b", "c"]).collect()}
    assert {k: r["n"] for k, r in got.items() if k[0] == "t"} == {("t", "a"): 20, ("t", "b"): 16, ("t", "c"): 19}
    assert got["t", "b"]["r"] == pytest.approx(-1) and got["t", "b"]["place"] == 1 and got["t", "b"]["p_r"] == pytest.approx(0, abs=1e-12)
    assert got["t", "c"]["r"] is None and got["t", "c"]["p_r"] is None and got["t", "c"]["place"] == 3  # a constant has no correlation
    best = compare.screen_pairs(x, ["t", "u"], ["a", "b", "c"], best=1).collect()
    assert sorted((r["target"], r["place"]) for r in best) == [("t", 1), ("u", 1)]
    assert compare.screen_pairs(x.limit(0), ["t"], ["a", "b"]).count() == 0


def test_constant_series_have_no_correlation_and_stop_no_job(spark):
    """A frozen or bare site: one side never moves."""
    rows = [("flat", i, 1.0, float(i % 3), 1.0) for i in range(40)] + [("good", i, float(i * i % 11), float(i * i % 11) + i % 2, 1.0) for i in range(40)]
    x = spark.createDataFrame(rows, "site string, t int, obs double, model double, w double")
    got = {v["site"]: v for v in series.validation(x, ["site"], ["t"]).collect()}
    assert got["flat"]["r"] is None and got["flat"]["r_lo"] is None and got["flat"]["bias"] is not None
    assert got["good"]["r"] == pytest.approx(np.corrcoef([v[2] for v in rows[40:]], [v[3] for v in rows[40:]])[0, 1])
    assert {v["predictor"]: v["r"] for v in compare.screening(x.where("site = 'flat'"), "model", ["obs", "t"]).collect()}["obs"] is None
    pair = spark.createDataFrame([(None, 1.0), (2.0, None), (3.0, 1.0)], "a double, b double").agg(scalar.pearson("a", "b").alias("r")).first()["r"]
    assert pair is None
