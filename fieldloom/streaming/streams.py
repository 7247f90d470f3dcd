"""Structured Streaming forms of the incremental patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet") -> DataFrame:
    """Parquet drops as a stream; the checkpoint says what has been read."""
    x = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return x.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in x.columns else x


def tumbling(x: DataFrame, keys: list[str], width: str = "1 day", late: str = "1 day", step: str | None = None) -> DataFrame:
    """Partial sums by (sliding) window."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return x.withWatermark("ts", late).groupBy(w, *keys).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))


def sessions(x: DataFrame, keys: list[str], gap: str = "9 hours", late: str = "1 day") -> DataFrame:
    """R3."""
    return x.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def keep_first(x: DataFrame, keys: list[str], late: str = "9 hours") -> DataFrame:
    """The built-in, which keeps the first."""
    return x.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _values(frames: Iterator[pd.DataFrame], zone: str) -> list[tuple]:
    """The rows of some frames as plain values; times get the session's zone."""

    def plain(v):
        if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
            return None
        return v.tz_localize(zone).to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v

    return [tuple(map(plain, row)) for f in frames for row in f.itertuples(index=False, name=None)]


class KeepLast(StatefulProcessor):
    """Of rows of one key that follow each other within the reach, the last stays.

    A row leaves as soon as the watermark says that none can follow it within the reach, and is forgotten as soon as one does
    and no earlier row can come any more; rows may come in any order within the watermark's delay. The state of a key is the rows
    of the delay and the reach.
    """

    def __init__(self, names: list[str], schema: str, ts: str, order: list[str], reach_ms: int, zone: str):
        self.names, self.schema, self.at, self.by, self.reach, self.zone = names, schema, names.index(ts), [names.index(o) for o in order], reach_ms, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def _ms(self, row: tuple) -> int:
        t = row[self.at]
        t = pd.Timestamp(t) if t.tzinfo else pd.Timestamp(t).tz_localize(self.zone)
        return t.value // 1_000_000

    def _settle(self, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        rows.sort(key=lambda row: (self._ms(row), *[(row[k] is not None, row[k]) for k in self.by]))
        times = [self._ms(row) for row in rows]
        done, kept, wait = [], [], []
        for k, (row, t) in enumerate(zip(rows, times)):
            followed = k + 1 < len(rows) and times[k + 1] - t <= self.reach
            if not followed and t + self.reach < watermark:
                done.append(row)
            elif not followed or t >= watermark:  # a row that is followed still parts those before it
                kept.append(row)
                wait.append(t + self.reach + 1 if not followed else t + 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if kept:
            self.held.put(kept)
            self.handle.registerTimer(max(min(wait), watermark + 1))
        else:
            self.held.clear()
        frame = pd.DataFrame(done, columns=self.names)
        for c in frame.columns[frame.dtypes.map(lambda t: isinstance(t, pd.DatetimeTZDtype))]:
            frame[c] = frame[c].dt.tz_convert(self.zone).dt.tz_localize(None)
        yield frame

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        yield from self._settle(held + _values(rows, self.zone), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield from self._settle([tuple(r) for r in self.held.get()], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def keep_last(x: DataFrame, keys: list[str], order: list[str], ts: str = "ts", reach_hours: float = 9, late: str = "1 hour") -> DataFrame:
    """The last of every chain of repeats, with all columns of ``x``; needs the RocksDB state store. Rows without a time take no part."""
    zone = x.sparkSession.conf.get("spark.sql.session.timeZone")
    rows = x.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    machine = KeepLast(x.columns, x.schema.toDDL(), ts, order, int(reach_hours * 3_600_000), zone)
    return rows.groupBy(*keys).transformWithStateInPandas(machine, x.schema, "Append", "EventTime")


class Moments(StatefulProcessor):
    """Count, mean and squared deviations of each key, merged with those of every new batch, so that nothing large cancels."""

    def __init__(self, names: list[str], value: str):
        self.names, self.value = names, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
        for frame in rows:
            v = frame[self.value].dropna().to_numpy(float)
            if len(v):
                own, count = v.mean(), n + len(v)
                m2 += ((v - own) ** 2).sum() + (own - mean) ** 2 * n * len(v) / count
                mean += (own - mean) * len(v) / count
                n = count
        self.sums.update((int(n), float(mean), float(m2)))
        yield pd.DataFrame([(*key, n, mean if n else None, m2 / (n - 1) if n > 1 else None)], columns=self.names)

    def close(self) -> None:
        pass


def moments(x: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Running count, mean and sample variance of each key that a batch touches, in update mode; needs the RocksDB state store."""
    names = [*keys, "n", "mean", "var"]
    schema = ", ".join([f"`{k}` {dict(x.dtypes)[k]}" for k in keys] + ["n long", "mean double", "var double"])
    return x.select(*keys, F.col(value).cast("double").alias(value)).groupBy(*keys).transformWithStateInPandas(Moments(names, value), schema, "Update", "None")


def lookup(x: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The stream with a static dimension; Spark broadcasts it if it is small enough."""
    return x.join(dimension, key)


def cross_mask(ol: DataFrame, da: DataFrame, keys: list[str], hours: int = 3, late: str = "6 hours") -> DataFrame:
    """Two streams, inner on the keys, times at most ``hours`` apart."""
    a = ol.withWatermark("ts", late)
    b = da.select(*keys, F.col("ts").alias("ts_da"), F.col("value").alias("value_da")).withWatermark("ts_da", late)
    near = [a[k] == b[k] for k in keys] + [a["ts"] >= b["ts_da"] - F.expr(f"INTERVAL {hours} HOURS"), a["ts"] <= b["ts_da"] + F.expr(f"INTERVAL {hours} HOURS")]
    on = near[0]
    for c in near[1:]:
        on = on & c
    return a.join(b, on).select(*[a[k] for k in keys], a["ts"], "ts_da", a["value"], "value_da")


def run_to_end(x: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, then stop; in update mode each batch's rows are appended with their ``batch``."""
    if mode == "update":
        sink = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")
        x.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
        return
    x.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
