"""Sharding by sampled splitters (operator 8).

Records are ordered by a 64-bit key: 40 bits of a hash of the text, so that equal
texts are neighbours, then 24 bits of a hash of identifier and row, so that even one
group of copies, or of repeated rows, can be cut anywhere. A size-weighted sample of the keys gives
quantile boundaries, and every record falls into one of the ranges between them. A
range with too many bytes or rows is subdivided by quantiles of a sample drawn inside it,
again and again until none is overfull. Inside ranges, running sums of bytes and rows give every
record its exact place in the whole order, and the place gives shard and slot.

Law ``bytes``: the shards' sizes differ by about one record.
A null text has size 1. Ties in the key are ordered by identifier and row. Repeated rows
are records of their own. One very long text is one record and is never cut. An empty table gives an empty result. Other
columns of the input play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Ranges for each shard at least, most rows and bytes that a range is meant to hold, and keys drawn for each range: the driver
#: sees 32 numbers for each million rows or 512 MB, whichever are more.
RANGES, ROWS, BYTES, DRAWN = 64, 1_000_000, 512 << 20, 32
#: A range is overfull beyond so many times its even share.
OVER = 2


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    """The boundaries of ``parts`` ranges of sorted keys."""
    return np.unique(keys[np.linspace(0, len(keys), parts + 1).astype(int)[1:-1]]) if len(keys) else np.zeros(0, np.int64)


def _range_of(cuts: np.ndarray):
    def run(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    return F.pandas_udf(run, "int")


def _number_of(weight: np.ndarray):
    def run(place: pd.Series) -> pd.Series:
        return pd.Series(weight[place.to_numpy()])

    return F.pandas_udf(run, "double")


def shard_by_splitters(docs: DataFrame, shards: int = 8, ranges: int = RANGES, drawn: int = DRAWN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("row"))
    key = F.col("th").bitwiseAND(F.lit(-(1 << 24))) + F.xxhash64("doc_id", "row").bitwiseAND(F.lit((1 << 24) - 1))
    rows = keep(rows.withColumn("key", key).drop("th"), "rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not total["rows"]:
        return _shape(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0)}))
    fine = max(shards * ranges, -(-total["rows"] // ROWS), -(-total["bytes"] // BYTES))
    luck = F.xxhash64(F.lit("draw"), "key", "row").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    # a record is drawn with a probability in proportion to its size
    sample = np.sort(np.array([r[0] for r in rows.where(luck < F.col("size") * (fine * drawn / total["bytes"])).select("key").collect()], np.int64))
    cuts = _quantiles(sample, fine)
    while True:
        ranged = rows.withColumn("range", _range_of(cuts)("key"))
        load = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # one row for each range
        parts = {r["range"]: int(max(r["n"] * fine / total["rows"], r["b"] * fine / total["bytes"])) for r in load if r["lo"] < r["hi"] and r["n"] > 1 and max(r["n"] * fine / total["rows"], r["b"] * fine / total["bytes"]) > OVER}
        parts = {k: max(2, n) for k, n in parts.items()}
        if not parts:
            break
        # inside overfull ranges every record has the same chance; a record larger than a range's share is alone in the end
        weight = np.zeros(len(cuts) + 1)
        for r in load:
            if r["range"] in parts:
                weight[r["range"]] = parts[r["range"]] * drawn / r["n"]
        again = F.xxhash64(F.lit(len(cuts)), "key", "row").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        drawn_keys: dict[int, list[int]] = {}
        for r in ranged.where(again < _number_of(weight)("range")).select("range", "key").collect():
            drawn_keys.setdefault(r["range"], []).append(r["key"])
        ends = {r["range"]: (r["lo"], r["hi"]) for r in load}
        more = [_quantiles(np.sort(np.array(keys, np.int64)), parts[k]) for k, keys in drawn_keys.items()]
        # a key just above the least makes sure that every overfull range gets smaller
        more += [np.array([ends[k][0] + 1, ends[k][1]], np.int64) for k in parts]
        cuts = np.unique(np.concatenate([cuts, *more]))
    order = Window.partitionBy("range").orderBy("key", "doc_id", "row")
    rows = keep(ranged.withColumns({"bytes_to": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "rows_to": F.row_number().over(order)}), "placed")
    ahead, b, n = [], 0, 0
    for r in sorted(load, key=lambda r: r["range"]):
        ahead.append((r["range"], b, n))
        b, n = b + r["b"], n + r["n"]
    ahead = spark.createDataFrame(ahead, "range int, bytes_ahead long, rows_ahead long")  # one row for each range
    # the middle of a record decides, so that no shard is off by more than one record
    middle = F.col("bytes_ahead") + F.col("bytes_to") - F.expr("size div 2") - 1
    rows = rows.join(F.broadcast(ahead), "range").withColumns({
        "shard": F.least(F.lit(shards - 1), F.floor(middle.cast("double") * shards / total["bytes"])).cast("int"),
        "place": F.col("rows_ahead") + F.col("rows_to") - 1,
    })
    starts = rows.groupBy("shard").agg(F.min("place").alias("start"))
    return _shape(rows.join(F.broadcast(starts), "shard").withColumn("slot", F.col("place") - F.col("start")))


def _shape(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_splitters(table(spark, sf_dir, "documents"))
