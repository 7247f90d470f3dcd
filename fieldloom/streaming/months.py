"""Month statistics that take late rows: an idempotent merging sink.

A batch's rows become partial sums, which are merged with those stored for the same months and written as a new version of these
months; then one manifest entry names the version. A reader takes of each month the latest version that
the manifest has, so a batch counts wholly or not at all: what a lost driver left without an entry is not seen and
is written anew, and a batch that is replayed after its entry was written changes nothing. Batches are told apart by Spark's batch numbers: one
store belongs to one checkpoint.

    <path>/parts/version=7/month=2020-01-01/...   partial sums of whole months
    <path>/late/version=7/...                     partial sums of rows that came after their month was closed
    <path>/manifest/version=7/...                 the batch, and a row for each month that it touched or refused

Rows without a month or an observation take no part. With ``keep_open`` = k the newest month seen so far and the k before it take rows; what comes
for older ones is counted in the manifest and kept in ``late``, and ``reopen`` merges it in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ofa

MANIFEST = "month date, n_rows long, n_late long, batch long, reopened long, version long"


def _read(spark: SparkSession, path: str, form: str, schema: str | None = None) -> DataFrame | None:
    """A table of the store; None if no batch has written it."""
    try:
        r = spark.read.format(form)
        return (r.schema(schema) if schema else r).load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """month, n_rows merged, n_late refused, batch, version: what each batch did; ``reopened``: the last version whose late rows an entry merged."""
    found = _read(spark, f"{path}/manifest", "json", MANIFEST)
    return spark.createDataFrame([], MANIFEST) if found is None else found


def read_months(spark: SparkSession, path: str) -> DataFrame | None:
    """The current partial sums of all months."""
    parts = _read(spark, f"{path}/parts", "parquet")
    if parts is None:
        return None
    current = manifest(spark, path).where("n_rows > 0").groupBy("month").agg(F.max("version").alias("version"))
    parts = parts.withColumns({"month": F.col("month").cast("date"), "version": F.col("version").cast("long")})
    return parts.join(current, ["month", "version"]).drop("version")


def _replace(spark: SparkSession, path: str, keys: list[str], new: DataFrame, late: DataFrame | None, batch: int | None = None, reopened: int | None = None) -> None:
    """Write the months of ``new`` merged with what is stored, and what is late, then the manifest's entry."""
    version = (manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    stored = read_months(spark, path)
    both = new if stored is None else new.unionByName(stored.join(new.select("month").distinct(), "month", "left_semi"))
    ofa.merge(both, ["month", *keys]).write.mode("overwrite").partitionBy("month").parquet(f"{path}/parts/version={version}")
    n = lambda x, name: x.groupBy("month").agg(F.sum("n").alias(name))
    done = n(new, "n_rows").withColumn("n_late", F.lit(0).cast("long"))
    if late is not None:
        late.write.mode("overwrite").parquet(f"{path}/late/version={version}")
        done = done.drop("n_late").join(n(late, "n_late"), "month", "full").na.fill(0)
    # one small file, so that the entry appears at once
    done.withColumns({"batch": F.lit(batch), "reopened": F.lit(reopened)}).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={version}")


def merge_months(path: str, keys: list[str], partial: Callable[[DataFrame, list[str]], DataFrame] = ofa.partial_sums, keep_open: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink. ``partial(rows, keys)`` makes partial sums that ``ofa.merge`` can add; rows have ``ts``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = manifest(spark, path)
        if not seen.where(F.col("batch") == number).isEmpty():
            return
        rows = batch.withColumn("month", ofa.month_of(F.col("ts"))).where("month is not null")
        parts = partial(rows, ["month", *keys]).persist()  # a row for each key and month
        try:
            late = None
            if keep_open is not None:
                newest = parts.select("month").unionByName(seen.select("month")).agg(F.max("month")).first()[0]
                closed = F.col("month") < F.add_months(F.lit(newest).cast("date"), -keep_open)
                late, parts = parts.where(closed), parts.where(~closed)
            _replace(spark, path, keys, parts, late, number)
        finally:
            parts.unpersist()

    return write


def reopen(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Merge what came late into its months, each once, while no stream writes."""
    late = _read(spark, f"{path}/late", "parquet")
    if late is None:
        return
    done = manifest(spark, path)
    taken, newest = done.agg(F.coalesce(F.max("reopened"), F.lit(0)), F.max("version")).first()
    late = late.where(F.col("version") > taken).drop("version")
    if not late.isEmpty():
        _replace(spark, path, keys, ofa.merge(late, ["month", *keys]), None, reopened=newest)
