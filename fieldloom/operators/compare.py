"""Comparison, summaries, selection, hydrology."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.scalar import bit, pearson
from .quantiles import column_percentiles, weighted_median, with_percentiles


def align(a: DataFrame, b: DataFrame, keys: list[str], value: str, names: tuple[str, str] = ("ol", "da")) -> DataFrame:
    """Inner on the keys."""
    return a.select(*keys, F.col(value).alias(names[0])).join(b.select(*keys, F.col(value).alias(names[1])), keys)


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """J1's exactness: keys of one side alone; empty if the join is exact."""
    return a.select(*keys).join(b, keys, "left_anti").withColumn("side", F.lit("a")).unionByName(b.select(*keys).join(a, keys, "left_anti").withColumn("side", F.lit("b")))


def first_of_month(x: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of repeated months the first, stamped with the month's last day."""
    month = F.trunc("ts", "month")
    w = Window.partitionBy(*keys, month).orderBy("ts", *order)
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("month", F.last_day("ts")).drop("_r")


def at_place(x: DataFrame, lon: str = "lon", lat: str = "lat", places: int = 6) -> DataFrame:
    """J4's place: coordinates rounded into ``rlon`` and ``rlat``."""
    return x.withColumns({"rlon": F.round(lon, places), "rlat": F.round(lat, places)})


def crossmask(ol: DataFrame, da: DataFrame, keys: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """Control rows that the other run has too, with its (rescaled) observation; of repeated keys its last. ``left`` keeps the others with a null."""
    last = da.groupBy(*keys).agg(F.max_by("obs", F.struct(*order)).alias("obs_da"))
    return ol.join(last, keys, how)


def within(value: Column, tolerance: float, spread: bool = False) -> Column:
    """The bucket of a value, or (``spread``) the one or two buckets that values within the tolerance of it can have."""
    side = 4 * tolerance
    return F.array_distinct(F.array(F.floor((value - 1.01 * tolerance) / side), F.floor((value + 1.01 * tolerance) / side))) if spread else F.floor(value / side)


def cycle_before(x: DataFrame, keys: list[str], cycle: str, value: str, first: Column, tolerance: float) -> DataFrame:
    """J20's candidates: rows of ``x`` with ``_first`` of each value of the cycle before that lies within the tolerance.

    The cycle before comes as one row for each value and is joined by buckets of the
    value, so a common value costs one row for each that repeats it, not a square.
    """
    a = x.groupBy(*keys, (F.col(cycle) + 1).alias(cycle), F.col(value).alias("_v")).agg(first.alias("_first")).withColumn("_at", F.explode(within(F.col("_v"), tolerance, spread=True)))
    p = x.withColumn("_at", within(F.col(value), tolerance)).join(a, [*keys, cycle, "_at"])
    return p.where(F.abs(F.col(value) - F.col("_v")) <= tolerance).drop("_at", "_v")


def consecutive(x: DataFrame, keys: list[str], cycle: str, value: str, row: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows that repeat the value of the same key in the cycle before; the first match for each."""
    p = cycle_before(x.select(*keys, cycle, value, row), keys, cycle, value, F.min(row), tolerance)
    return p.groupBy(row, cycle).agg(F.min("_first").alias("first_row"))


def fill_axis(x: DataFrame, keys: list[str], axis: str, low: int, high: int) -> DataFrame:
    """Every step of the axis for each key."""
    spine = x.select(*keys).distinct().withColumn(axis, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return spine.join(x, [*keys, axis], "left")


def smap_good(x: DataFrame) -> Column:
    """F7."""
    bad = (bit(F.col("retrieval_qual_flag"), 3) != 0) | (F.col("surface_status") != 0) | (bit(F.col("tb_qual_h"), 1) != 0) | (bit(F.col("tb_qual_v"), 1) != 0)
    for k in (9, 6, 7):
        bad = bad | (bit(F.col("surface_flag"), k) != 0)
    return F.when(~F.coalesce(bad, F.lit(True)) & (F.col("sm") >= 0), F.col("sm"))


def ascat_good(sm: Column, flag: Column) -> Column:
    """F8."""
    return F.when((sm <= 100) & (F.coalesce(flag, F.lit(0)) < 1), sm)


def snow_fraction(cover: Column, clear: Column, qa: Column) -> Column:
    """F9."""
    return F.when((cover <= 100) & (clear > 20) & (qa <= 2), F.try_divide(cover, clear))


def cygnss_good(sm: Column, sigma: Column, low: Column, high: Column, flags: list[Column]) -> Column:
    """255 counts as no flag."""
    bad = F.greatest(*[F.when(f == 255, 0).otherwise(F.coalesce(f, F.lit(0))) for f in flags], F.lit(0)) == 1
    return F.when(sm.between(low, high) & sigma.isNotNull() & ~F.isnan(sigma) & ~bad, sm)


def station_good(sm: Column, kelvin: Column) -> Column:
    """F11."""
    return F.when((kelvin >= 277.16) & (sm >= 1e-4), sm)


def percentile_clip(x: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """null outside the percentiles."""
    lo, hi = column_percentiles(x, value, [low, high])
    return x.withColumn(value, F.when(F.col(value).between(F.lit(lo), F.lit(hi)), F.col(value)))


def experiment_difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """OL against DA for each key."""
    ol, da = F.col("ol"), F.col("da")
    s = pairs.where("ol is not null and da is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(da - ol).alias("mean_diff"), F.avg(F.abs(da - ol)).alias("abs_diff"), F.stddev_pop("ol").alias("std_ol"), F.stddev_pop("da").alias("std_da"), F.max("ol").alias("h1"), F.min("ol").alias("l1"), F.max("da").alias("h2"), F.min("da").alias("l2"), pearson("ol", "da").alias("r"), F.sqrt(F.avg((da - ol) ** 2)).alias("rmse"))
    amp = lambda p: F.col(f"h{p}") - F.col(f"l{p}")
    return s.select(*keys, "n", "mean_diff", "abs_diff", F.try_divide(F.col("std_da"), F.col("std_ol")).alias("std_ratio"), F.try_divide(100 * (amp(2) - amp(1)), amp(1)).alias("amp_change"), "r", "rmse")


def anomaly_suite(pairs: DataFrame, keys: list[str], first: int = 0, last: int = 9999) -> DataFrame:
    """OL against DA by anomalies from each run's own monthly climatology of the years ``first`` to ``last``.

    ``pairs``: keys, month (a date), ol, da, both present. Correlations are uncentred, lag-1 pairs are consecutive rows, slopes
    are by year. Measures with a zero divisor are null.
    """
    base = F.year("month").between(first, last)
    clim = pairs.groupBy(*keys, F.month("month").alias("_m")).agg(F.avg(F.when(base, F.col("ol"))).alias("_co"), F.avg(F.when(base, F.col("da"))).alias("_cd"))
    w = Window.partitionBy(*keys).orderBy("month")
    x = pairs.withColumn("_m", F.month("month")).join(clim, [*keys, "_m"]).withColumns({"a": F.col("ol") - F.col("_co"), "b": F.col("da") - F.col("_cd"), "t": F.year("month") + (F.month("month") - 0.5) / 12})
    x = x.withColumns({"a1": F.lead("a").over(w), "b1": F.lead("b").over(w)})

    def uncentred(p: str, q: str) -> Column:
        both = F.col(p).isNotNull() & F.col(q).isNotNull()
        mean = lambda c: F.avg(F.when(both, c))
        return F.try_divide(mean(F.col(p) * F.col(q)), F.sqrt(mean(F.col(p) ** 2) * mean(F.col(q) ** 2)))

    positive = lambda c: F.when(c > 1e-12, c)
    s = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("da") - F.col("ol")).alias("mean_diff"), positive(F.stddev_pop("a")).alias("so"), positive(F.stddev_pop("b")).alias("sd"), uncentred("a", "b").alias("anom_r"),
        F.sqrt(F.avg((F.col("b") - F.col("a")) ** 2)).alias("anom_rmse"), F.avg(F.abs(F.col("da") - F.col("ol"))).alias("mad"), (F.regr_slope("da", "t") - F.regr_slope("ol", "t")).alias("delta_trend"), (uncentred("b", "b1") - uncentred("a", "a1")).alias("delta_rho1"))
    ratio = F.try_divide(F.col("sd"), F.col("so"))
    return s.select(*keys, "n", "mean_diff", ratio.alias("std_ratio"), ((ratio - 1) * 100).alias("amp_change"), "anom_r", "anom_rmse", F.try_divide(F.col("mad"), F.col("so")).alias("norm_abs_diff"), "delta_trend", "delta_rho1")


def reference_skill(x: DataFrame, keys: list[str], reference: str, value: str, least: int) -> DataFrame:
    """Plain and anomaly correlation and the anomalies' RMSE, the climatology being that of the group."""
    w = Window.partitionBy(*keys, F.month("ts"))
    c = x.withColumns({"ao": F.col(reference) - F.avg(reference).over(w), "af": F.col(value) - F.avg(value).over(w)})
    s = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(reference, value).alias("r"), F.try_divide(F.sum(F.col("ao") * F.col("af")), F.sqrt(F.sum(F.col("ao") ** 2) * F.sum(F.col("af") ** 2))).alias("anomaly_r"), F.sqrt(F.avg((F.col("ao") - F.col("af")) ** 2)).alias("anomaly_rmse"))
    return s.where(F.col("n") >= least)


def paired_interval(x: DataFrame, keys: list[str], a: str, b: str, up: bool = True, alpha: float = 0.05) -> DataFrame:
    """Mean of b - a over paired sites (a - b where less is better), its standard error, and the half-width of its t interval."""
    d = (F.col(b) - F.col(a)) * (1 if up else -1)
    s = x.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), (F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("std_error"))
    factor = F.pandas_udf(lambda df: pd.Series(dist.t_quantile(1 - alpha / 2, df.to_numpy(float))), "double")
    # the factor of each number of sites, once
    factors = s.select("n").distinct().withColumn("_t", factor(F.greatest(F.col("n") - 1, F.lit(1)).cast("double")))
    return s.join(factors, "n").withColumn("ci_half", F.col("_t") * F.col("std_error")).drop("_t")


def significant_shares(stats: DataFrame, keys: list[str], p: list[str], alpha: float = 0.05) -> DataFrame:
    """Of the cells of a group with a p, the share below alpha, for each p."""
    out = [F.avg(F.when(F.col(c).isNotNull(), (F.col(c) < alpha).cast("int"))).alias(f"share_{c}") for c in p]
    return stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), *out)


def area_relations(x: DataFrame, keys: list[str], a: str, b: str, p_a: str, p_b: str, weight: str, alpha: float = 0.05) -> DataFrame:
    """Weighted Pearson of a and b, and what share of the area is significant in a, in b, in both, in both with one sign, and has b > a.

    The shares divide by the area of all rows, with or without values, as published.
    """
    ok = x.where(F.col(weight) > 0)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    w = F.when(both, F.col(weight))
    mean = lambda c: F.try_divide(F.sum(w * c), F.sum(w))
    sig = {c: F.coalesce(F.col(p) < alpha, F.lit(False)) for c, p in ((a, p_a), (b, p_b))}
    share = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col(weight)).otherwise(0.0)) / F.sum(weight)
    s = ok.groupBy(*keys).agg(
        mean(F.col(a)).alias("ma"), mean(F.col(b)).alias("mb"), mean(F.col(a) * F.col(b)).alias("mab"), mean(F.col(a) ** 2).alias("maa"), mean(F.col(b) ** 2).alias("mbb"), share(sig[a]).alias("sig_a"), share(sig[b]).alias("sig_b"), share(sig[a] & sig[b]).alias("sig_both"),
        share(sig[a] & sig[b] & (F.signum(a) == F.signum(b))).alias("sig_agree"), share(F.col(b) > F.col(a)).alias("above"))
    va, vb = F.col("maa") - F.col("ma") ** 2, F.col("mbb") - F.col("mb") ** 2
    return s.select(*keys, F.try_divide(F.col("mab") - F.col("ma") * F.col("mb"), F.sqrt(F.greatest(F.lit(0.0), va) * F.greatest(F.lit(0.0), vb))).alias("weighted_r"), "sig_a", "sig_b", "sig_both", "sig_agree", "above")


def bins_by_edges(x: DataFrame, by: str, value: str, edges: list[float]) -> DataFrame:
    """The distribution of a value by bins (lower edge, upper edge], the first closed on both sides; repeated edges count once."""
    cuts = sorted({e for e in edges if e is not None})
    if len(cuts) < 2:
        cuts = (cuts or [0.0]) * 2
    k = F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(float(e)) for e in cuts[:-1]]), lambda e: e < F.col(by))))
    return _distribution(x.where(F.col(by).between(cuts[0], cuts[-1])).withColumn("bin", k), value, F.stddev_samp)


def _distribution(x: DataFrame, value: str, std) -> DataFrame:
    """Of each bin the count, mean, std, median and quartiles."""
    stats = x.groupBy("bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), std(value).alias("std"))
    return with_percentiles(stats, x, ["bin"], value, {"median": 0.5, "q25": 0.25, "q75": 0.75}, few=True)


def quantile_bins(x: DataFrame, by: str, value: str, q: int = 5) -> DataFrame:
    """Bins of equally many rows."""
    return bins_by_edges(x, by, value, column_percentiles(x, by, [k / q for k in range(q + 1)]))


def log_bins(x: DataFrame, by: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Bins of equal ratio from low to high; values that aren't positive are in none."""
    return bins_by_edges(x.where(F.col(by) > 0), by, value, [low * (high / low) ** (k / bins) for k in range(bins + 1)])


def robust_shares(x: DataFrame, keys: list[str], change: str, base: str, tolerance: float = 0.01) -> DataFrame:
    """Shares of rows that improve (change > 0), lose (< 0) or stay within the tolerance, and the ratio of the summed change to the base."""
    c = F.col(change)
    return x.where(c.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((c > 0).cast("int")).alias("improved"), F.avg((c < 0).cast("int")).alias("reduced"), F.avg((F.abs(c) <= tolerance).cast("int")).alias("within"), F.try_divide(F.sum(c), F.sum(base)).alias("ratio"))


def hotspots(stats: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Three top lists, labelled and stacked."""
    lists = [("mean_diff", F.desc(F.abs("mean_diff"))), ("low_r", F.asc("r")), ("amp_change", F.desc(F.abs("amp_change")))]
    out = None
    for name, order in lists:
        col = {"low_r": "r"}.get(name, name)
        part = stats.where(F.col(col).isNotNull()).orderBy(order, key).limit(k).select(F.lit(name).alias("list"), key, F.col(col).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def robust(x: DataFrame, keys: list[str], value: str, few: bool = False) -> DataFrame:
    """A54; ``few`` if there are few groups."""
    stats = x.groupBy(*keys).agg(F.count(value).alias("n"), F.avg((F.col(value) > 0).cast("int")).alias("positive"))
    out = with_percentiles(stats, x, keys, value, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p05": 0.05, "p95": 0.95}, few)
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def binned(x: DataFrame, by: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Equal bins, the last closed on both sides."""
    k = F.least(F.lit(bins), F.floor((F.col(by) - low) / ((high - low) / bins)) + 1).cast("int")
    return _distribution(x.where(F.col(by).between(low, high)).withColumn("bin", k), value, F.stddev_pop)


def vegetation_class(primary: Column, p_frac: Column, s_frac: Column) -> Column:
    """A56."""
    total = p_frac + s_frac
    return F.when(total.isNull(), "sparse").when(total < 10, "bare").when(total <= 20, "sparse").when(p_frac > 49, F.concat(F.lit("type"), primary.cast("string"))).otherwise("mixed")


def average_rank(x: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ties share their mean rank."""
    tie = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return x.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (tie - 1) / 2)


def whole_rank(x: DataFrame, keys: list[str], value: str, name: str, parts: int = 64) -> DataFrame:
    """W11 over few and large groups: mean ranks of the distinct values, from counts.

    Values are cut at approximate quantiles into ``parts`` of each group; running counts inside the parts and
    sums of the parts before give the ranks, so that no task sorts a whole group.
    """
    counts = x.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    shares = [k / parts for k in range(1, parts)]
    cuts = x.groupBy(*keys).agg(F.percentile_approx(value, F.lit(shares), 10_000).alias("_cuts"))  # a row for each group
    counts = counts.join(cuts, keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    ahead = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_all"))
    ahead = ahead.withColumn("_ahead", F.sum("_all").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_all")).drop("_all")  # at most ``parts`` rows of each group
    run = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value))
    ranks = counts.withColumn("_run", run).join(ahead, [*keys, "_part"])
    ranks = ranks.select(*keys, value, (F.col("_ahead") + F.col("_run") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return x.join(ranks, [*keys, value])


#: Distinct values of a target up to which the table of its ranks is broadcast.
FEW_RANKS = 200_000


def _centred_ranks(counts: DataFrame, keys: list[str], value: str, parts: int = 64) -> DataFrame:
    """W11 from distinct values and their counts ``_n``: ``_rank``, the mean rank less the mean of all ranks of its group, of which there are few.

    As in ``whole_rank``, values are cut into ``parts``, so that no task sorts a whole group.
    """
    shares = [k / parts for k in range(1, parts)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, F.lit(shares), 1_000).alias("_cuts"), F.sum("_n").alias("_rows"))
    counts = counts.join(F.broadcast(cuts), keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    ahead = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_all"))
    ahead = ahead.withColumn("_ahead", F.sum("_all").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_all")).drop("_all")  # at most ``parts`` rows of each group
    run = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value))
    ranks = counts.withColumn("_run", run).join(F.broadcast(ahead), [*keys, "_part"])
    return ranks.withColumn("_rank", F.col("_ahead") + F.col("_run") - F.col("_n") + (F.col("_n") - F.col("_rows")) / 2).drop("_part", "_run", "_ahead", "_rows")


def _screen(x: DataFrame, targets: list[str], predictors: list[str], few: set[str]) -> DataFrame:
    """Every target on every predictor, all of whose values are present.

    Only the targets' ranks are put beside the rows. A predictor's rows are then summed by value, which gives both its ranks and what they meet.
    """
    ts, ps = {t: f"_t{k}" for k, t in enumerate(targets)}, {p: f"_p{k}" for k, p in enumerate(predictors)}
    x = x.select(*[F.col(c).cast("double").alias(n) for names in (ts, ps) for c, n in names.items()])
    ranked = x
    for t, c in sorted(ts.items(), key=lambda i: i[0] in few):  # joins that shuffle come before rows are wider
        ranks = _centred_ranks(x.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0)), ["_g"], c).select(c, F.col("_rank").alias(f"_r{c}"))
        ranked = ranked.join(F.broadcast(ranks) if t in few else ranks, c)
    long = ranked.selectExpr(f"stack({len(ps)}, {', '.join(f'{k}, {c}' for k, c in enumerate(ps.values()))}) AS (_p, _x)", *[f"_r{c}" for c in ts.values()])
    values = _centred_ranks(long.groupBy("_p", "_x").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_r{c}").alias(f"_s{c}") for c in ts.values()]), ["_p"], "_x")
    met = values.groupBy("_p").agg(F.sum(F.col("_n") * F.col("_rank") ** 2).alias("_xx"), F.array(*[F.sum(F.col("_rank") * F.col(f"_s{c}")) for c in ts.values()]).alias("_xy"))
    whole = ranked.agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{a}{c}") for c in [*ts.values(), *ps.values()] for a, f in (("m", F.avg), ("v", F.var_pop))],
        *[F.covar_pop(t, p).alias(f"c{t}{p}") for t in ts.values() for p in ps.values()], *[F.sum(F.col(f"_r{t}") ** 2).alias(f"q{t}") for t in ts.values()])
    c = F.col
    rows = []
    for k, (t, tc) in enumerate(ts.items()):
        for j, (p, pc) in enumerate(ps.items()):
            slope = F.try_divide(c(f"c{tc}{pc}"), c(f"v{pc}"))
            r = F.try_divide(c(f"c{tc}{pc}"), F.sqrt(f"v{pc}") * F.sqrt(f"v{tc}"))
            rows.append(F.struct(F.lit(t).alias("target"), F.lit(p).alias("predictor"), c("n"), r.alias("r"), slope.alias("slope"), (c(f"m{tc}") - slope * c(f"m{pc}")).alias("intercept"), c(f"q{tc}").alias("_yy"), F.lit(k).alias("_k"), F.lit(j).alias("_p")))
    pairs = whole.where("n > 0").select(F.inline(F.array(*rows)))
    rho = F.try_divide(F.get("_xy", "_k"), F.sqrt("_xx") * F.sqrt("_yy"))
    return pairs.join(F.broadcast(met), "_p").select("target", "predictor", "n", "r", rho.alias("rho"), "slope", "intercept")


def _screen_all(x: DataFrame, targets: list[str], predictors: list[str]) -> DataFrame:
    """A57 of every pair over the rows in which both are present; the complete columns in one go, other pairs each by itself."""
    names = list(dict.fromkeys([*targets, *predictors]))
    ok = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names}
    row = x.agg(*[F.count_if(~ok[c]).alias(f"b{k}") for k, c in enumerate(names)], *[F.approx_count_distinct(F.col(t).cast("double")).alias(f"d{k}") for k, t in enumerate(targets)]).first()
    complete = {c for k, c in enumerate(names) if row[f"b{k}"] == 0}
    few = {t for k, t in enumerate(targets) if row[f"d{k}"] <= FEW_RANKS}
    ts, ps = [t for t in targets if t in complete], [p for p in predictors if p in complete]
    parts = [_screen(x, ts, ps, few)] if ts and ps else []
    parts += [_screen(x.where(ok[t] & ok[p]), [t], [p], few) for t in targets for p in predictors if not {t, p} <= complete]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def screening(x: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """Correlation, rank correlation and line of the target on each predictor."""
    return _screen_all(x, [target], predictors).drop("target")


def with_p(stats: DataFrame, r: str = "r", n: str = "n", name: str = "p") -> DataFrame:
    """The two-sided p of a correlation of n pairs; null below three."""

    @F.pandas_udf("double")
    def p(r_: pd.Series, n_: pd.Series) -> pd.Series:
        rr, df = r_.to_numpy(float), np.maximum(n_.to_numpy(float) - 2, 1)
        return pd.Series(dist.t_two_sided(rr * np.sqrt(df / np.maximum(1e-300, 1 - rr * rr)), df))

    return stats.withColumn(name, F.when(F.col(r).isNotNull() & (F.col(n) > 2), p(r, n)))


def screen_pairs(x: DataFrame, targets: list[str], predictors: list[str], best: int | None = None) -> DataFrame:
    """Every target against every predictor, with the p of both correlations; place 1 has the largest abs(r) of its target.

    Work grows with columns, not with pairs, where columns are complete; ``best`` keeps the first places.
    """
    stats = _screen_all(x, targets, predictors)
    stats = stats.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.abs("r")), "predictor")))
    stats = stats if best is None else stats.where(F.col("place") <= best)
    return with_p(with_p(stats, "r", "n", "p_r"), "rho", "n", "p_rho")


def standard_betas(x: DataFrame, target: str, predictors: list[str]) -> list[tuple[str, float]]:
    """Standardised regression from one pass of pairwise correlations; only a k x k system is solved on the driver."""
    names = [*predictors, target]
    row = x.dropna(subset=names).agg(*[pearson(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]).first()
    k = len(names)
    c = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0  # a constant is related to nothing
    beta = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
    return sorted(zip(predictors, map(float, beta)), key=lambda p: -abs(p[1]))


def standard_regression(x: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """A row for each predictor with its beta, the largest first, and the R2 of the whole."""
    betas = standard_betas(x, target, predictors)
    used = x.dropna(subset=[*predictors, target])
    r = used.agg(*[pearson(p, target).alias(p) for p, _ in betas]).first()
    r2 = sum(b * (r[p] or 0.0) for p, b in betas)
    return x.sparkSession.createDataFrame([(k + 1, p, b, r2) for k, (p, b) in enumerate(betas)], "place int, predictor string, beta double, r2 double")


def area_summary(x: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean, weighted median (first value with half of the weight), weighted share above 0."""
    ok = x.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    stats = ok.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("wmean"), (F.sum(F.when(F.col(value) > 0, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("share_positive"))
    median = weighted_median(ok, keys, value, weight)
    return stats.withColumn("_g", F.struct(*keys)).join(median.select(F.struct(*keys).alias("_g"), "wmedian"), "_g").drop("_g")


def threshold_sweep(x: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """The same statistics for every threshold in one job; the table of thresholds is a literal list."""
    t = x.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds]))).where(F.abs(F.col(value)) > F.col("threshold"))
    return t.groupBy("threshold", *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def clear_sweep(x: DataFrame, keys: list[str], cover: str, clear: str, thresholds: list[int], snowy: float = 0.9) -> DataFrame:
    """A68 for snow: for every least clear index the largest corrected cover, how many values there are, and how many exceed ``snowy``."""
    t = x.withColumn("threshold", F.explode(F.array(*[F.lit(int(v)) for v in thresholds]))).where(F.col(clear) > F.col("threshold"))
    t = t.withColumn("_f", F.try_divide(F.col(cover), F.col(clear)))
    return t.groupBy("threshold", *keys).agg(F.max("_f").alias("most"), F.count("_f").alias("n"), F.count_if(F.col("_f") > snowy).alias("n_snowy"))


def welch(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Welch t and two-sided F between two tables of (n, mean, std)."""
    p = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("n", "mean", "std")]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("n", "mean", "std")]), keys).where("a_n > 2 and b_n > 2 and a_std > 0 and b_std > 0")
    va, vb = F.col("a_std") ** 2 / F.col("a_n"), F.col("b_std") ** 2 / F.col("b_n")
    p = p.withColumns({"t": (F.col("a_mean") - F.col("b_mean")) / F.sqrt(va + vb), "df": (va + vb) ** 2 / (va**2 / (F.col("a_n") - 1) + vb**2 / (F.col("b_n") - 1)), "f": F.col("a_std") ** 2 / F.col("b_std") ** 2})
    t_p = F.pandas_udf(lambda t, df: pd.Series(dist.t_two_sided(t, df)), "double")
    f_p = F.pandas_udf(lambda f, m, n: pd.Series(dist.f_two_sided(f, m - 1, n - 1)), "double")
    return p.withColumns({"t_p": t_p("t", "df"), "f_p": f_p("f", F.col("a_n").cast("double"), F.col("b_n").cast("double"))})


def paired(x: DataFrame, keys: list[str], site: str, a: str, b: str) -> DataFrame:
    """Mean and std of b - a over sites."""
    return x.groupBy(*keys).agg(F.avg(F.col(b) - F.col(a)).alias("mean_delta"), F.stddev_samp(F.col(b) - F.col(a)).alias("std_delta"), F.countDistinct(site).alias("n_sites"))


def evapotranspiration(tair_c: Column, wind: Column, rn: Column, vapour: Column, kpa: Column) -> Column:
    """FAO-56 Penman-Monteith, mm a day; rn in MJ / m2 / day, vapour pressure in kPa."""
    es = 0.6108 * F.exp(17.27 * tair_c / (tair_c + 237.3))
    slope, gamma = 4098 * es / (tair_c + 237.3) ** 2, 0.000665 * kpa
    return F.greatest(F.lit(0.0), (0.408 * slope * rn + gamma * (900 / (tair_c + 273)) * wind * (es - vapour)) / (slope + gamma * (1 + 0.34 * wind)))


def aridity(x: DataFrame, keys: list[str]) -> DataFrame:
    """Indices from annual P, PET and mean T; ratios only where the divisor exceeds 1e-3."""
    over = lambda a, b: F.when(b > 1e-3, a / b)
    p, e, t = F.col("p"), F.col("pet"), F.col("t")
    return x.groupBy(*keys).agg(F.avg(over(p, e)).alias("ai"), F.avg(over(e, p)).alias("phi"), F.avg(over(p - e, e)).alias("cmi"), F.avg(over(p, t + 10)).alias("martonne"))


def water_balance(x: DataFrame, keys: list[str]) -> DataFrame:
    """Residual and storage change; the first change is null."""
    w = Window.partitionBy(*keys).orderBy("month")
    return x.withColumns({"net": F.col("p") - F.col("e") - F.col("r"), "change": F.col("s") - F.lag("s").over(w)}).withColumn("cumulative", F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def depth_weights(top: Column, bottom: Column, layers: list[tuple[float, float]]) -> list[Column]:
    """What each layer has of the depth from top to bottom."""
    return [F.greatest(F.lit(0.0), F.least(F.lit(b), bottom) - F.greatest(F.lit(a), top)) for a, b in layers]


def root_zone(values: list[str], depths: list[float]) -> Column:
    """Depth-weighted mean, null if any layer is."""
    total = F.lit(0.0)
    for c, d in zip(values, depths, strict=True):
        total = total + F.col(c) * d
    return total / sum(depths)


def station_daily(x: DataFrame, keys: list[str], means: list[str], sums: list[str], legacy: bool = False) -> DataFrame:
    """Hours to days: means of states, sums of fluxes; the sum of a day without values is null (``legacy``: 0)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) if legacy else F.sum(c)
    return x.groupBy(*keys, F.to_date("ts").alias("day")).agg(*[F.avg(c).alias(c) for c in means], *[total(c).alias(c) for c in sums])


def balanced_sites(counts: DataFrame, site: str, periods: list[str], most: int = 30, best: int = 15) -> DataFrame:
    """The sites with most days, of these the ones whose periods are most alike."""
    mean = sum((F.col(p) for p in periods), F.lit(0)) / len(periods)
    var = sum(((F.col(p) - mean) ** 2 for p in periods), F.lit(0.0)) / len(periods)
    top = counts.withColumns({"total": sum((F.col(p) for p in periods), F.lit(0)), "spread": F.sqrt(var)}).orderBy(F.desc("total"), site).limit(most)
    return top.orderBy("spread", site).limit(best)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
