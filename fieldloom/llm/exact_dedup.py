"""Exact dedup by a log-structured merge index of text digests (operator 9).

Inside every reading task a memtable of bounded bytes takes the rows of a batch; when it is
full, and at the end, it is flushed as a sorted run of (digest, row) to Parquet, with a Bloom filter on the
digest. ``lookup`` finds single digests in the runs by these filters. Compaction merges
all runs with one partial and final aggregation, keeping for each digest the row
that stays (of rows alike the smallest identifier).

Hits are verified byte for byte. A memtable compares the texts under one digest
itself and passes on each different text once, so that a large group of copies
sends one text for each memtable; where a digest comes out of several memtables, the
least and the greatest text under it must be the same. If they aren't, the rows of the digest are
grouped by the texts themselves.

Nulls count as empty texts, and empty texts equal each other. Of rows that are
the same in everything, one stays. A null doc_id comes after all others. An
empty table gives an empty result. Other columns of the input play no part, whatever their names.
Very long texts are read whole; a memtable holds at most one that exceeds its bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, folded, keep, strings, table

#: Bytes of digests and texts that a memtable holds.
MEMTABLE = 32 << 20
_BLANK_BYTES = BLANKS.encode()


def _digest(normal: bytes) -> bytes:
    return hashlib.sha256(normal).digest()


def _normal(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in strings(batch.column("text")):
        yield (text.as_buffer().to_pybytes()).translate(None, _BLANK_BYTES)


def _sorted_runs(bound: int):
    """Rows -> (digest, doc_id, points, row), sorted by digest inside every memtable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.Table:
            return pa.Table.from_batches(held).sort_by("digest").combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            digests = pa.array([_digest(x) for x in _normal(batch)], pa.binary())
            held.append(pa.RecordBatch.from_arrays([digests, *(batch.column(c) for c in ("doc_id", "points", "row"))], ["digest", "doc_id", "points", "row"]))
            size += 64 * batch.num_rows
            if size > bound:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _texts_once(bound: int):
    """Rows -> (digest, normal): each different text under a digest once for each memtable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[bytes]] = {}
        size = 0
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for normal in _normal(batch):
                digest = _digest(normal)
                texts = known.setdefault(digest, [])
                if normal in texts:
                    continue
                texts.append(normal)
                out.append((digest, normal))
                size += len(normal) + 100
                if size > bound:
                    known, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["digest", "normal"])

    return run


class MergeIndex:
    """Runs of (digest, row) in the shared folder, merged when asked.

    ``flush`` may be called once for each arriving batch; ``compact`` folds all
    runs into one level that holds a row for each distinct text.
    """

    def __init__(self, spark: SparkSession, memtable: int = MEMTABLE):
        self.spark, self.memtable, self.runs, self.docs = spark, memtable, [], []

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write the sorted runs of a batch; they hold no text."""
        kind = dict(docs.dtypes)["doc_id"]
        rows = docs.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), (F.monotonically_increasing_id() + (len(self.runs) << 56)).alias("row"))
        run = rows.mapInArrow(_sorted_runs(self.memtable), f"digest binary, doc_id {kind}, points long, row long")
        run = keep(run, "run", **{"parquet.bloom.filter.enabled#digest": "true"})
        self.runs.append(run)
        self.docs.append(docs.select("doc_id", "text"))
        return run

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """The rows of a few digests; Parquet's filters tell which parts of the runs can hold them."""
        return self.all_runs().where(F.col("digest").isin([bytearray(d) for d in digests]))

    def all_runs(self) -> DataFrame:
        out = self.runs[0]
        for run in self.runs[1:]:
            out = out.unionByName(run)
        return out

    def all_docs(self) -> DataFrame:
        out = self.docs[0]
        for more in self.docs[1:]:
            out = out.unionByName(more)
        return out

    def all_texts(self) -> DataFrame:
        """digest, normal text, doc_id and points of every row; for the few digests that need it."""
        normal = F.translate(F.coalesce("text", F.lit("")), BLANKS, "")
        return self.all_docs().select(F.unhex(F.sha2(normal, 256)).alias("digest"), normal.alias("normal"), "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))

    def compact(self) -> DataFrame:
        """digest -> the row that stays (most code points, then smallest doc_id) and the group's size."""
        first = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
        level = self.all_runs().groupBy("digest").agg(first.alias("best"), F.count(F.lit(1)).alias("group_size"))
        level = level.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
        return keep(level, "level", **{"parquet.bloom.filter.enabled#digest": "true"})

    def false_hits(self, level: DataFrame) -> DataFrame:
        """The digests that stand for unlike texts: byte verification of every hit."""
        hits = level.where("group_size > 1").select("digest")
        once = self.all_docs().mapInArrow(_texts_once(self.memtable), "digest binary, normal binary")
        seen = once.join(hits, "digest").groupBy("digest")
        return seen.agg(F.min("normal").alias("a"), F.max("normal").alias("b")).where("a <> b").select("digest")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = MergeIndex(docs.sparkSession)
    index.flush(docs)
    return verdicts(index)


def verdicts(index: MergeIndex) -> DataFrame:
    """The rows of all runs of an index, as ``exact_dedup`` returns them."""
    level = index.compact()
    wrong = keep(index.false_hits(level), "wrong")
    rows = index.all_runs().join(level, "digest")
    out = rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if wrong.isEmpty():
        return out
    # a digest with unlike texts: its rows, few, are grouped by the texts themselves
    odd = index.all_texts().join(wrong, "digest").withColumn("row", F.monotonically_increasing_id())
    odd = keep(odd, "odd")
    first = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    groups = odd.groupBy("normal").agg(first.alias("best"), F.count(F.lit(1)).alias("group_size"))
    odd = odd.join(groups, "normal").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    right = rows.join(wrong, "digest", "left_anti")
    return right.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")).unionByName(odd)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns: of equal texts the one that stays."""
    index = MergeIndex(docs.sparkSession)
    runs = index.flush(docs)
    level = index.compact()
    wrong = keep(index.false_hits(level), "wrong")
    points = runs.select("row", F.col("points").alias("_points"))
    stay = level.join(points, level["keep_row"] == points["row"]).select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_id"), "_points")
    own = F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), BLANKS, ""), 256))  # the same digest as the runs'
    rows = folded(docs).withColumns({"_own": own, "_size": F.length(F.coalesce("text", F.lit(""))).cast("long")})
    right = rows if wrong.isEmpty() else rows.join(wrong, rows["_own"] == wrong["digest"], "left_anti")
    same = (F.col("_own") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_points"))
    out = right.join(stay, same, "left_semi").dropDuplicates(["_own", "doc_id", "_size"])
    if not wrong.isEmpty():  # unlike texts under one digest: the texts themselves are the keys
        odd = rows.join(wrong, rows["_own"] == wrong["digest"], "left_semi").withColumn("_normal", F.translate(F.coalesce("text", F.lit("")), BLANKS, ""))
        order = Window.partitionBy("_normal").orderBy(F.desc("_size"), F.col("doc_id").isNull(), "doc_id")
        out = out.unionByName(odd.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_normal", "_place"))
    return out.select("_all.*")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
