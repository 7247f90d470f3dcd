"""Stateful streams and the merging sink: several batches, restarts, late and replayed rows, against the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import ofa, series
from fieldloom.streaming import months, streams

RND = random.Random(3)
DAY0 = dt.datetime(2020, 1, 1)


def drop(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def hours(h):
    return DAY0 + dt.timedelta(hours=h)


OFA = "ts timestamp, tile long, obs double, fcst double, ana double"


def observations(n, month, k=0):
    return [(dt.datetime(2020, month, RND.randrange(2, 28), 3 * RND.randrange(8)), RND.randrange(3), RND.gauss(5, 1), RND.gauss(5, 1), RND.gauss(5, 1)) for _ in range(n)]


def sums(x):
    return sorted((r["month"], r["tile"], r["n"], round(r["s_obs"], 6), round(r["q_obs"], 6), round(r["x_obs_fcst"], 6)) for r in x.collect())


def test_late_rows_leave_the_month_as_one_batch_would(spark, tmp_path):
    batches = [observations(100, 1), observations(40, 2) + observations(1, 1), [(None, 1, 1.0, 1.0, 1.0), (DAY0, 1, None, 1.0, 1.0)], observations(30, 3) + observations(5, 1) + observations(5, 2)]
    path, schema = str(tmp_path / "store"), OFA
    for k, rows in enumerate(batches):  # every drop by a new query on the old checkpoint: a restart
        drop(spark, tmp_path / "in", rows, schema, k)
        sink = months.merge_months(path, ["tile"])
        source(spark, tmp_path / "in", schema).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("month", ofa.month_of(F.col("ts"))).where("month is not null")
    want = sums(ofa.partial_sums(whole, ["month", "tile"]))
    assert sums(months.read_months(spark, path)) == want
    # a replay of any batch changes nothing
    for k in (0, 3):
        months.merge_months(path, ["tile"])(spark.createDataFrame(batches[k], schema), k)
    assert sums(months.read_months(spark, path)) == want
    done = months.manifest(spark, path)
    assert done.agg(F.sum("n_rows")).first()[0] == 181 and done.agg(F.sum("n_late")).first()[0] == 0


def test_a_batch_without_its_entry_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first, second = (spark.createDataFrame(observations(20, 1), OFA) for _ in range(2))
    months.merge_months(path, ["tile"])(first, 0)
    before = sums(months.read_months(spark, path))
    with monkeypatch.context() as m:  # the driver is lost between the parts and the entry
        m.setattr(months.F, "lit", lambda v: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            months.merge_months(path, ["tile"])(second, 1)
    assert sums(months.read_months(spark, path)) == before
    months.merge_months(path, ["tile"])(second, 1)
    whole = first.unionByName(second).withColumn("month", ofa.month_of(F.col("ts")))
    assert sums(months.read_months(spark, path)) == sums(ofa.partial_sums(whole, ["month", "tile"]))


def test_closed_months_report_what_they_refuse(spark, tmp_path):
    path = str(tmp_path / "store")
    assert months.read_months(spark, path) is None
    batches = [observations(50, 1) + observations(10, 3), observations(7, 1) + observations(3, 2), observations(9, 6) + observations(2, 3)]
    for k, rows in enumerate(batches):
        months.merge_months(path, ["tile"], keep_open=1)(spark.createDataFrame(rows, OFA), k)
    late = {(r["batch"], r["month"].month): r["n_late"] for r in months.manifest(spark, path).where("n_late > 0").collect()}
    assert late == {(0, 1): 50, (1, 1): 7, (2, 3): 2}
    got = {r["month"].month: r["n"] for r in months.read_months(spark, path).groupBy("month").agg(F.sum("n").alias("n")).collect()}
    assert got == {2: 3, 3: 10, 6: 9}
    for _ in range(2):  # the second time there is nothing left to merge
        months.reopen(spark, path, ["tile"])
    whole = spark.createDataFrame([r for b in batches for r in b], OFA).withColumn("month", ofa.month_of(F.col("ts")))
    assert sums(months.read_months(spark, path)) == sums(ofa.partial_sums(whole, ["month", "tile"]))


CHAIN = "tile long, ts timestamp, id long, note string"


def chains():
    rows, k = [], 0
    for tile in range(6):
        t = 0.0
        for _ in range(25):
            t += RND.choice([0.0, 1.0, 3.0, 8.9, 9.0, 9.1, 12.0, 30.0])
            k += 1
            rows.append((tile, hours(t), k, f"n{k}"))
    return sorted(rows, key=lambda r: r[1])


def test_keep_last_over_batches_and_restarts(spark, tmp_path):
    rows = chains()
    # out of order by up to six hours
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=RND.uniform(0, 6)))
    third = len(order) // 3 + 1
    flush = [(99, hours(5000), 9999, "end")]
    for k, part in enumerate([order[:third], order[third : 2 * third], order[2 * third :], flush, [(99, hours(6000), 10000, "end")]]):
        drop(spark, tmp_path / "in", part, CHAIN, k)
        x = streams.keep_last(source(spark, tmp_path / "in", CHAIN), ["tile"], ["id"], late="7 hours")
        streams.run_to_end(x, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(CHAIN).parquet(str(tmp_path / "out")).where("tile < 99")
    batch = spark.createDataFrame(rows, CHAIN).withColumn("cycle", F.col("ts").cast("double"))
    want = series.keep_last(batch, ["tile"], "cycle", ["id"], reach=9 * 3600).drop("cycle")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 20 < got.count() < 130


def test_running_moments_over_restarts(spark, tmp_path):
    """Values near 1e9 with a spread of 1, where sums of squares would hold nothing but noise."""
    schema = "tile long, value double"
    rows = [(RND.randrange(3), 1e9 + RND.gauss(0, 1)) for _ in range(600)] + [(7, None), (8, 4.0)]
    RND.shuffle(rows)
    for k in range(3):
        drop(spark, tmp_path / "in", rows[k::3], schema, k)
        streams.run_to_end(streams.moments(source(spark, tmp_path / "in", schema), ["tile"]), str(tmp_path / "out"), str(tmp_path / "check"), "update")
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("tile").agg(F.max_by(F.struct("n", "mean", "var"), "batch").alias("r"))
    got = {r["tile"]: r["r"] for r in last.collect()}
    for tile in range(3):
        v = [x for t, x in rows if t == tile]
        mean = sum(x - 1e9 for x in v) / len(v)
        var = sum((x - 1e9 - mean) ** 2 for x in v) / (len(v) - 1)
        assert got[tile]["n"] == len(v) and got[tile]["mean"] - 1e9 == pytest.approx(mean, abs=1e-5) and got[tile]["var"] == pytest.approx(var, rel=1e-6)
    assert tuple(got[7]) == (0, None, None) and tuple(got[8]) == (1, 4.0, None)


def test_sliding_windows(spark, tmp_path):
    rows = [(1, hours(12 * k), float(k)) for k in range(10)] + [(9, hours(9999), 0.0)]
    schema = "tile long, ts timestamp, value double"
    drop(spark, tmp_path / "in", rows, schema, 0)
    x = streams.tumbling(source(spark, tmp_path / "in", schema), ["tile"], width="2 days", step="1 day")
    streams.run_to_end(x, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {r["start"]: (r["n"], r["s"]) for r in spark.read.schema(x.schema).parquet(str(tmp_path / "out")).where("tile = 1").select("window.start", "n", "s").collect()}
    want = {hours(24 * d): [v for _, t, v in rows[:10] if hours(24 * d) <= t < hours(24 * d + 48)] for d in range(-1, 5)}
    assert got == {k: (len(v), sum(v)) for k, v in want.items() if v}
