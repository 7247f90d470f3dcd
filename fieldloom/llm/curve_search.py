"""Approximate nearest neighbours by shifted space-filling curves (operator 7).

Every vector is projected and shifted at random for each of several curves, and
its place on a Hilbert curve is its key. Quantiles of a key sample cut every curve into
ranges of about ``rows`` vectors; a query meets its own range and the ``reach``
ranges on either side, of every curve. Ranges with many equal keys are dealt
over several blocks by identifier. Each meeting is one matrix product and gives
its best k; these merge, and are ranked by the inner product in double precision
of the original vectors.

``reach`` is measured: for a bounded sample of queries (``probes``) the exact
neighbours are found among all rows, and reach is the least that holds at least
``recall`` of them. Every row is indexed. On vectors without structure, near
neighbours are nowhere near each other on a curve, and reach grows with the data.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do vectors of another length than the commonest. Null identifiers take no part.
Ties go to the smaller vec_id. With fewer than k candidates all are returned. Rows of one vec_id are folded into one before
anything else, that of the least vector (component by component), as a query and as a candidate. An empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

CURVES, DIMS, BITS, ROWS = 6, 8, 4, 1500
PROBES, RECALL, SAMPLE = 60, 0.955, 20_000
MOST = 50_000  # rows of a block


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points on the Hilbert curve, by Gray codes of rotated cubes."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """Projections, scales and shifts, fitted on a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bits, self.center = bits, sample.mean(axis=0)
        d = sample.shape[1]
        self.maps, self.low, self.scale, self.shift = [], [], [], []
        for _ in range(curves):
            m = np.linalg.qr(rng.normal(size=(d, d)))[0][:, : min(dims, d)]
            y = (sample - self.center) @ m
            low, high = y.min(axis=0), y.max(axis=0)
            self.maps.append(m)
            self.low.append(low)
            self.scale.append(0.5 / np.maximum(high - low, 1e-12))
            self.shift.append(rng.uniform(0, 0.5, m.shape[1]))

    def keys(self, x: np.ndarray, c: int) -> np.ndarray:
        y = ((x - self.center) @ self.maps[c] - self.low[c]) * self.scale[c] + self.shift[c]
        return hilbert(np.clip(np.floor(y * (1 << self.bits)), 0, (1 << self.bits) - 1), self.bits)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows (not itself): places of queries, ids, exact scores."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    out: list[list[np.ndarray]] = [[], [], []]
    longest = np.linalg.norm(rows, axis=1).max(initial=0.0)
    for lo in range(0, len(queries), 256):
        scores = queries[lo : lo + 256] @ rows.T
        scores[query_ids[lo : lo + 256, None] == ids[None, :]] = -np.inf
        floor = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(scores), -np.inf)
        # what rounding can hide from the matrix product grows with the norms
        floor = floor - 1e-15 * (rows.shape[1] + 8) * np.linalg.norm(queries[lo : lo + 256], axis=1) * longest
        for i in range(len(scores)):
            near = np.flatnonzero((scores[i] >= floor[i]) & (scores[i] > -np.inf))
            exact = (rows[near] * queries[lo + i]).sum(axis=1)  # the same sum for the same vectors, wherever they are
            top = np.argsort(-exact, kind="stable")[:k]
            out[0].append(np.full(len(top), lo + i))
            out[1].append(ids[near][top])
            out[2].append(exact[top])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and vector (doubles) of the rows that take part, and the vectors' length."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(fine)
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common["d"] if common else 0
    return v.where(F.size("v") == d), d


def search(vectors: DataFrame, is_query, k: int = 20, curves: int = CURVES, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where ``is_query`` holds of vec_id."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    usable_rows, d = usable(vectors)
    base = keep(usable_rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    total = base.count()
    if not total:
        return spark.createDataFrame([], schema)
    fraction = min(1.0, SAMPLE / total)
    luck = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = _matrix(base.where(luck <= fraction * 1.05).select("v").limit(2 * SAMPLE).toArrow().column("v"), d)
    if not len(sample):
        sample = _matrix(base.select("v").limit(SAMPLE).toArrow().column("v"), d)
    fitted = Curves(sample, curves, DIMS, BITS)
    ranges = max(8, total // rows)
    cuts = [np.quantile(fitted.keys(sample, c), np.linspace(0, 1, ranges + 1)[1:-1], method="lower") for c in range(curves)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), d)
                for c in range(curves):
                    r = np.searchsorted(cuts[c], fitted.keys(x, c), side="right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.full(len(r), c, np.int32)), pa.array(r), batch.column("v")], ["vec_id", "curve", "range", "v"])

    placed = keep(base.mapInArrow(place, "vec_id long, curve int, range int, v array<double>"), "placed")
    def brute(queries: np.ndarray, ids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q, i, s = best(queries, ids, _matrix(batch.column("v"), d), batch.column("vec_id").to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q.astype(int)]), pa.array(i.astype(np.int64)), pa.array(s)], ["query_id", "vec_id", "score"])

        return run

    # reach, by the exact neighbours of a few queries
    probe = base.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toArrow()
    reach = 0
    if probe.num_rows:
        ids = probe.column("vec_id").to_numpy()
        exact = base.mapInArrow(brute(_matrix(probe.column("v"), d), ids), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        exact = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        spot = placed.select("vec_id", "curve", "range")
        own = spot.where(F.col("vec_id").isin(ids.tolist())).select(F.col("vec_id").alias("query_id"), "curve", F.col("range").alias("at"))
        apart = exact.join(F.broadcast(own), "query_id").join(spot, ["vec_id", "curve"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("range") - F.col("at"))).alias("apart"))
        apart = np.sort([r["apart"] for r in apart.select("apart").collect()])  # at most probes * k numbers
        reach = int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) if len(apart) else 0
    # ranges are joined by `reach`, so that a query meets three blocks of each curve, however far its neighbours lie
    wide = max(1, reach)
    placed = placed.withColumn("range", F.floor(F.col("range") / wide).cast("int"))
    load = placed.groupBy("curve", "range").agg(F.count(F.lit(1)).alias("n"))
    blocks = keep(load.select("curve", "range", F.ceil(F.col("n") / min(2 * rows * wide, MOST)).cast("int").alias("blocks")), "blocks")
    rows_ = placed.join(blocks, ["curve", "range"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("curve", "range", "block", "vec_id", "v")
    asked = placed.where(is_query).select("curve", F.explode(F.sequence(F.col("range") - min(1, reach), F.col("range") + min(1, reach))).alias("range"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.join(blocks, ["curve", "range"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select(F.col("curve").alias("c"), F.col("range").alias("r"), F.col("block").alias("b"), "query_id", "q")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        ids = queries.column("query_id").to_numpy()
        q, i, s = best(_matrix(queries.column("q"), d), ids, _matrix(rows.column("v"), d), rows.column("vec_id").to_numpy(), k)
        return pa.table([pa.array(ids[q.astype(int)]), pa.array(i.astype(np.int64)), pa.array(s)], ["query_id", "vec_id", "score"])

    found = rows_.groupBy("curve", "range", "block").cogroup(asked.groupBy("c", "r", "b")).applyInArrow(meet, "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
