"""Exact percentiles of groups of any size, and weighted medians, without a buffer of a group's values.

A sketch brackets each rank of each group. One more scan counts the rows between the brackets and the distinct values inside
them, all ranks of all groups together; a running sum over these few rows gives every value's rank. Groups of at most ``small`` rows are
their own bracket. So the rows are read twice whatever the ranks, and what is sorted for a group is the part of it
inside brackets, about 8 / ``small`` of its rows for each rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that is taken whole; also the accuracy of the sketches.
SMALL = 10_000


def _group(keys: list[str]) -> Column:
    """The group as one value, so that joins find groups whose keys are null, too."""
    return F.struct(*keys) if keys else F.struct(F.lit(1).alias("all"))


def group_percentiles(x: DataFrame, keys: list[str], value: str | Column, shares: list[float], small: int = SMALL, few: bool = False) -> DataFrame:
    """keys, n, p: the interpolated percentiles of each group, an array in the order of ``shares``. Nulls play no part; a group without values has no row.

    ``few``: there are few groups (bins, species), whose brackets are broadcast, as a join by group would sort every row in as many tasks.
    """
    v = x.select(_group(keys).alias("_g"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null")
    order = sorted(set(shares))
    edges = [min(1.0, max(0.0, s + side * 4 / small)) for side in (-1, 1) for s in order]
    sketch = v.groupBy("_g").agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx("_v", F.lit(edges), small).alias("_cut"))
    cut = lambda k: F.when(F.col("_rows") > small, F.get("_cut", F.lit(k)))
    bounds = sketch.select("_g", *[cut(k).alias(f"_lo{k}") for k in range(len(order))], *[cut(k + len(order)).alias(f"_hi{k}") for k in range(len(order))])
    inside = F.col("_lo0").isNull()
    passed = F.lit(0)  # brackets that lie below a value
    for k in range(len(order)):
        inside = inside | F.col("_v").between(F.col(f"_lo{k}"), F.col(f"_hi{k}"))
        passed = passed + F.coalesce((F.col("_hi" + str(k)) < F.col("_v")).cast("int"), F.lit(0))
    some = v.join(F.broadcast(bounds) if few or not keys else bounds, "_g").select("_g", passed.alias("_after"), F.when(inside, F.col("_v")).alias("_v"))
    some = some.groupBy("_g", "_after", "_v").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g").orderBy("_after", F.asc_nulls_first("_v"))  # what lies outside comes before the bracket that it is below
    ranked = some.withColumns({"_end": F.sum("_n").over(w), "n": F.sum("_n").over(Window.partitionBy("_g"))})
    holds = lambda r: (F.col("_end") - F.col("_n") <= r) & (r < F.col("_end"))
    aggs = []
    for k, share in enumerate(order):
        at = F.lit(share) * (F.col("n") - 1)
        aggs += [F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias(f"_a{k}"), F.max(F.when(holds(F.least(F.floor(at) + 1, F.col("n") - 1)), F.col("_v"))).alias(f"_z{k}")]
    ends = ranked.groupBy("_g", "n").agg(*aggs)

    def p(share: float) -> Column:
        k, at = order.index(share), F.lit(share) * (F.col("n") - 1)
        return F.col(f"_a{k}") + (at - F.floor(at)) * (F.col(f"_z{k}") - F.col(f"_a{k}"))

    return ends.select(*[F.col(f"_g.{k}") for k in keys], "n", F.array(*[p(s) for s in shares]).alias("p"))


def with_percentiles(stats: DataFrame, x: DataFrame, keys: list[str], value: str | Column, names: dict[str, float], few: bool = False) -> DataFrame:
    """Statistics of groups with exact percentiles beside them, null where a group has no values."""
    p = group_percentiles(x, keys, value, list(names.values()), few=few)
    p = p.select(_group(keys).alias("_g"), *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(names)])
    return stats.withColumn("_g", _group(keys)).join(p, "_g", "left").drop("_g")


def column_percentiles(x: DataFrame, value: str, shares: list[float], small: int = SMALL) -> list[float | None]:
    """The same of a whole column."""
    row = group_percentiles(x, [], value, shares, small).first()
    return list(row["p"]) if row else [None] * len(shares)


def weighted_median(x: DataFrame, keys: list[str], value: str, weight: str, parts: int = 256) -> DataFrame:
    """keys, wmedian: the least value up to which a group has half of its weight. Only positive weights and present values count.

    Sketched cuts part a group; the weights of its parts tell which one holds the half, and only the values of that part are summed in order.
    """
    v = x.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(_group(keys).alias("_g"), F.col(value).alias("_v"), F.col(weight).alias("_w"))
    cuts = v.groupBy("_g").agg(F.percentile_approx("_v", F.lit([k / parts for k in range(1, parts)]), 4 * parts).alias("_cuts"))
    placed = v.join(cuts, "_g").select("_g", "_v", "_w", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part"))
    sums = placed.groupBy("_g", "_part").agg(F.sum("_w").alias("_all"))  # at most ``parts`` rows of each group
    end, total = F.sum("_all").over(Window.partitionBy("_g").orderBy("_part")), F.sum("_all").over(Window.partitionBy("_g"))
    sums = sums.withColumns({"_end": end, "_total": total}).where("_end >= 0.5 * _total")
    half = sums.groupBy("_g").agg(F.min(F.struct("_part", (F.col("_end") - F.col("_all")).alias("_before"), "_total")).alias("_h")).select("_g", F.col("_h._part").alias("_part"), F.col("_h._before").alias("_before"), F.col("_h._total").alias("_total"))
    inside = placed.groupBy("_g", "_part", "_v").agg(F.sum("_w").alias("_w")).join(half, ["_g", "_part"])
    run = F.col("_before") + F.sum("_w").over(Window.partitionBy("_g").orderBy("_v"))
    found = inside.withColumn("_run", run).where("_run >= 0.5 * _total").groupBy("_g").agg(F.min("_v").alias("wmedian"))
    return found.select(*[F.col(f"_g.{k}") for k in keys], "wmedian")
