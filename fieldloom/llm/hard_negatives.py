"""Hard-negative mining by exact integer scores (operator 12).

Vectors become 64-bit integers and are dealt by a hash of their identifier to strips of bounded size: strips of
anchors and strips of candidates. Every strip of anchors meets every strip of candidates once, in a cell of the
grid, and no cell grows with the table. In a cell the scores come from Strassen's recursive
multiplication of zero-padded tiles, in integer additions and multiplications that lose nothing.

Two rounds run over the grid. The first keeps each anchor's best same-label rows (positive heaps); the second, which knows the positives'
scores, keeps for each positive the best different-label rows inside its window (window heaps). Heaps of
two cells merge into the heap of both, so the order and number of cells play no part; Spark merges
those of all cells by a rank that is cut before the shuffle.

Rows without an identifier, a label or a vector, or with a null or non-finite component, take no part. Of rows with one identifier one takes part: that of
the least label, then the least integer vector; extra columns play no part. A shorter vector counts as padded with zeros. Scores fit 64 bits if the
squared length of every integer vector does in 62; a longer vector takes no part. Ties go to the smaller vec_id. An empty table, an anchor without positives and
a positive without negatives give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

#: Rows of a strip of anchors and of candidates; rows of a tile of each; a side of a product that is multiplied directly.
ANCHORS, CANDIDATES, TILE, LEAF = 4096, 16384, (256, 1024), 32
_LOW = np.iinfo(np.int64).min


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of 64-bit integers by Strassen's seven products of halves; both are padded with zeros to a size that halves evenly."""
    if 0 in (*a.shape, *b.shape):
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    levels = 0
    while min(*a.shape, b.shape[1]) >> levels > leaf:
        levels += 1
    step = 1 << levels
    up = lambda n: -(-n // step) * step
    padded = [np.zeros((up(x.shape[0]), up(x.shape[1])), np.int64) for x in (a, b)]
    padded[0][: a.shape[0], : a.shape[1]], padded[1][: b.shape[0], : b.shape[1]] = a, b
    return _strassen(*padded, levels)[: a.shape[0], : b.shape[1]]


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _strassen(a11 + a22, b11 + b22, levels - 1)
    p2 = _strassen(a21 + a22, b11, levels - 1)
    p3 = _strassen(a11, b12 - b22, levels - 1)
    p4 = _strassen(a22, b21 - b11, levels - 1)
    p5 = _strassen(a11 + a12, b22, levels - 1)
    p6 = _strassen(a21 - a11, b11 + b12, levels - 1)
    p7 = _strassen(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best ``size`` (score, id) of each of ``n`` owners: higher scores first, then smaller ids."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.owner, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The score that a new entry must exceed; ids come in rising order, so that a tie never displaces.
        self.bar = np.full(n, _LOW)

    def merge(self, owner: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        owner, score, id = np.concatenate([self.owner, owner]), np.concatenate([self.score, score]), np.concatenate([self.id, id])
        order = np.lexsort((id, -score, owner))
        owner, score, id = owner[order], score[order], id[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < self.size
        self.owner, self.score, self.id = owner[kept], score[kept], id[kept]
        full = place == self.size - 1
        self.bar[owner[full]] = score[full]


def best(a: np.ndarray, c: np.ndarray, heaps: Heaps, ids: np.ndarray, allowed, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Heaps:
    """Offer the scores of all pairs of anchors a and candidates c, tile by tile, to the heaps.

    ``allowed(rows, columns)`` says which pairs count. With windows (``low``, ``high``: rows of anchors, columns of windows) the heap of
    window w of anchor i is number i * windows + w.
    """
    windows = 1 if low is None else low.shape[1]
    for i in range(0, len(a), TILE[0]):
        rows = slice(i, min(len(a), i + TILE[0]))
        for j in range(0, len(c), TILE[1]):
            columns = slice(j, min(len(c), j + TILE[1]))
            score = product(a[rows], c[columns].T)
            ok = allowed(rows, columns)
            for w in range(windows):
                owner = np.arange(rows.start, rows.stop) * windows + w
                fits = ok & (score > heaps.bar[owner][:, None])
                if low is not None:
                    fits &= (score >= low[rows, w][:, None]) & (score <= high[rows, w][:, None])
                at, of = np.nonzero(fits)
                if len(at):
                    heaps.merge(owner[at], score[at, of], ids[columns][of])
    return heaps


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, padded with zeros."""
    lists = column.combine_chunks()
    first = lists.offsets.to_numpy()
    length = np.diff(first)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), length)
    out[row, np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], length)] = lists.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]
    return out


def quantised(rows: DataFrame, id: str, vector: str, label: Column) -> DataFrame:
    """vec_id, label and v, the vector as integers floor(256 x); a row for each identifier."""
    x = rows.select(F.col(id).alias("vec_id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x")).where("vec_id is not null and label is not null and x is not null")
    fine = "forall(x, y -> y is not null and not isnan(y) and abs(y) < 1e16) and aggregate(x, 0D, (s, y) -> s + pow(floor(256 * y), 2)) < pow(2D, 62)"
    x = x.where(fine).select("vec_id", F.struct("label", F.expr("transform(x, y -> floor(256 * y))").alias("v")).alias("r"))
    return x.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _top(rows: DataFrame, keys: list[str], score: str, id: str, most: int, rank: str) -> DataFrame:
    """Heaps of all cells merged: Spark cuts the ranks before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), id)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= most)


def mine(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 5, near: tuple[int, int] = (1, 5)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``label`` may be an expression.

    Negatives score from p - floor(p * near) to p, p being the positive's score; ``near`` is the share of p as a fraction
    (1/5: at least 80 of 100 of it).
    """
    x = keep(quantised(rows, id, vector, F.col(label) if isinstance(label, str) else label), "vectors")
    chosen = F.expr(anchors)
    n, n_anchors, width = x.agg(F.count(F.lit(1)), F.count_if(chosen), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    strips, ours = -(-n // CANDIDATES) or 1, -(-n_anchors // ANCHORS) or 1
    part = lambda seed, k: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(k))
    candidates = x.withColumns({"i": F.explode(F.sequence(F.lit(0), F.lit(ours - 1))), "j": part(1, strips).cast("int")}).select("i", "j", F.col("vec_id").alias("c_id"), F.col("label").alias("c_label"), F.col("v").alias("c_v"))
    anchor = x.where(chosen).withColumns({"i": part(2, ours).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))})

    def sides(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        right = right.sort_by("c_id")
        return left["vec_id"].to_numpy(), left["label"].to_numpy(), matrix(left["v"], width), right["c_id"].to_numpy(), right["c_label"].to_numpy(), matrix(right["c_v"], width)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        a_id, a_label, a, c_id, c_label, c = sides(left, right)
        same = lambda r, k: (a_label[r][:, None] == c_label[k]) & (a_id[r][:, None] != c_id[k])
        h = best(a, c, Heaps(len(a), positives), c_id, same)
        return pa.table({"anchor_id": a_id[h.owner], "positive_id": h.id, "positive_score": h.score})

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        a_id, a_label, a, c_id, c_label, c = sides(left, right)
        other = lambda r, k: a_label[r][:, None] != c_label[k]
        ids, scores = (left[k].to_pylist() for k in ("positive_id", "positive_score"))
        # an anchor of fewer positives has empty windows
        high, pos, low = np.full((len(a), positives), _LOW), np.zeros((len(a), positives), np.int64), np.full((len(a), positives), 1 << 62)
        for k, (i, s) in enumerate(zip(ids, scores)):
            pos[k, : len(i)], high[k, : len(i)] = i, s
        some = high > _LOW
        low[some] = high[some] - high[some] // near[1] * near[0] - high[some] % near[1] * near[0] // near[1]
        h = best(a, c, Heaps(len(a) * positives, negatives), c_id, other, low, high)
        row, w = h.owner // positives, h.owner % positives
        return pa.table({"anchor_id": a_id[row], "positive_id": pos[row, w], "positive_score": high[row, w], "negative_id": h.id, "negative_score": h.score})

    meet = lambda left, run, schema: left.groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(run, schema)
    p = _top(meet(anchor, first, "anchor_id long, positive_id long, positive_score long"), ["anchor_id"], "positive_score", "positive_id", positives, "place")
    # at most ``positives`` rows of each anchor
    known = p.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    known = keep(known.select("vec_id", F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score")), "positives")
    q = meet(anchor.join(known, "vec_id"), second, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _top(q, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives, "rank").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label=label)


ORACLE = """
WITH x AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, c.v)]) AS BIGINT) AS score
    FROM x a JOIN x c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
