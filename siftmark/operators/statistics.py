"""Summaries of experiments: rates with intervals, sweeps, regrets, effects, timings."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats


def rates(rows: DataFrame, group: str, stratum: str, success: Column) -> DataFrame:
    """(group, stratum, k, n, rate, low, high): a row each stratum and, with stratum null, one for the whole group."""
    g = rows.withColumn("_s", success.cast("int")).groupingSets([[F.col(group), F.col(stratum)], [F.col(group)]], group, stratum).agg(F.sum("_s").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select(group, stratum, "k", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def shares(rows: DataFrame, group: str, cls: str) -> DataFrame:
    """(group, class, n, share): counts first, so the window runs over classes, not rows."""
    g = rows.groupBy(group, cls).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def weighted_rate(rows: DataFrame, stratum: str, success: Column, sizes: DataFrame) -> DataFrame:
    """One row: the rate weighted by sizes (stratum, size), and its bounds if all or none of the unknown succeed.

    success: true, false or null (unknown)."""
    g = rows.withColumn("_s", success).groupBy(stratum).agg(F.count_if("_s").alias("k"), F.count_if(F.col("_s").isNull()).alias("u"), F.count("*").alias("n")).join(sizes, stratum)
    total = F.sum("size")
    part = lambda x: F.round(F.sum(x / F.col("n") * F.col("size")) / total, 6)
    known = F.col("n") - F.col("u")
    point = F.round(F.sum(F.when(known > 0, F.col("k") / known).otherwise(0.0) * F.col("size")) / total, 6)
    return g.agg(point.alias("point"), part(F.col("k")).alias("low"), part(F.col("k") + F.col("u")).alias("high"), total.alias("population"))


def line(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, slope, intercept, r2): least squares; slope 0 where x is constant, r2 1 where y is."""
    g = rows.groupBy(*keys).agg(F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.min(x) == F.max(x)).alias("cx"), (F.min(y) == F.max(y)).alias("cy"))
    slope = F.when(F.col("cx"), 0.0).otherwise(F.try_divide("xy", "xx"))
    r2 = F.when(F.col("cy"), 1.0).when(F.col("cx"), 0.0).otherwise(F.try_divide(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy")))
    return g.select(*keys, F.round(slope, 6).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), 6).alias("intercept"), F.round(r2, 6).alias("r2"))


def steady(rows: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """(key, n, first, last, low, high): all but the first observation of each series."""
    w = Window.partitionBy(key).orderBy(order)
    g = rows.withColumn("_r", F.row_number().over(w)).where("_r > 1")
    return g.groupBy(key).agg(F.count("*").alias("n"), F.min_by(value, "_r").alias("first"), F.max_by(value, "_r").alias("last"), F.min(value).alias("low"), F.max(value).alias("high"))


def two_way(cells: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """One row: sums of squares of the factors and of their interaction, in percent too; null for an incomplete grid."""
    by = lambda *k: F.avg(y).over(Window.partitionBy(*k))
    m = cells.agg(F.avg(y).alias("m"), F.count_distinct(a).alias("na"), F.count_distinct(b).alias("nb"), F.count("*").alias("n"))
    x = cells.select(a, b, y, by(a).alias("ma"), by(b).alias("mb")).join(F.broadcast(m))
    c = F.col
    g = x.agg(
        F.sum((c("ma") - c("m")) ** 2).alias("ssa"), F.sum((c("mb") - c("m")) ** 2).alias("ssb"), F.sum((c(y) - c("ma") - c("mb") + c("m")) ** 2).alias("ssab"),
        F.sum((c(y) - c("m")) ** 2).alias("sst"), (F.first("n") == F.first("na") * F.first("nb")).alias("whole"),
    )
    return g.select("whole", *[F.round(F.when(c("whole"), 100 * c(k) / c("sst")), 4).alias(f"{k}_pct") for k in ("ssa", "ssb", "ssab")])


def regret(cells: DataFrame, setting: str, doc: str, y: str) -> DataFrame:
    """(setting, mean, worst): distance to each document's best; only settings that were tried on every document."""
    docs = cells.agg(F.count_distinct(doc).alias("docs"))
    best = cells.groupBy(doc).agg(F.min(y).alias("best"))
    x = cells.join(best, doc).groupBy(setting).agg(F.count_distinct(doc).alias("n"), F.round(F.avg(F.col(y) - F.col("best")), 6).alias("mean"), F.round(F.max(F.col(y) - F.col("best")), 6).alias("worst"))
    return x.join(F.broadcast(docs), x["n"] == docs["docs"]).select(setting, "mean", "worst")


def sweep(rows: DataFrame, cls: str, legit: str, drift: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, false and caught, two-sided, upper, lower): what each candidate would flag. The candidates are few and
    become aggregates of one pass, so no row is multiplied."""
    good, d = F.col(cls) == legit, F.col(drift)
    aggs = []
    for i, t in enumerate(thresholds):
        for kind, hit in (("both", F.abs(d) > t), ("up", d > t), ("down", d < -t)):
            aggs += [F.count_if(good & hit).alias(f"{i}_{kind}_false"), F.count_if(~good & hit).alias(f"{i}_{kind}_caught")]
    one = rows.agg(*aggs, F.count_if(~good & (d > 0)).alias("all_up"), F.count_if(~good & (d < 0)).alias("all_down"))
    names = [f"{k}_{w}" for k in ("both", "up", "down") for w in ("false", "caught")]
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{i}_{n}").alias(n) for n in names]) for i, t in enumerate(thresholds)])
    out = one.select("all_up", "all_down", F.explode(each).alias("x")).select("x.*", "all_up", "all_down")
    return out.withColumn("plateau_up", (F.col("up_false") == 0) & (F.col("up_caught") == F.col("all_up"))).withColumn("plateau_down", (F.col("down_false") == 0) & (F.col("down_caught") == F.col("all_down"))).drop("all_up", "all_down")


def gap(rows: DataFrame, cls: str, legit: str, drift: str) -> DataFrame:
    """One row: the largest legitimate drift, the smallest other one, and whether a two-sided threshold parts them."""
    good, d = F.col(cls) == legit, F.abs(F.col(drift))
    g = rows.agg(F.max(F.when(good, d)).alias("legit_max"), F.min(F.when(~good, d)).alias("other_min"))
    return g.select(F.round("legit_max", 6).alias("legit_max"), F.round("other_min", 6).alias("other_min"), F.when(F.col("legit_max") < F.col("other_min"), "hueco").otherwise("sin umbral").alias("verdict"))


def worst_cases(rows: DataFrame, group: str, drift: str, row: Sequence[str]) -> DataFrame:
    """(group, high, high_row, low, low_row): the extreme drifts and the row of each; ties to the smallest row."""
    s = F.struct(*[F.col(c) for c in row])
    hi = F.min(F.struct((-F.col(drift)).alias("d"), s.alias("r")))
    lo = F.min(F.struct(F.col(drift).alias("d"), s.alias("r")))
    text = lambda x: F.concat_ws("-", *[x["r"][c].cast("string") for c in row])
    g = rows.groupBy(group).agg(hi.alias("hi"), lo.alias("lo"))
    return g.select(group, F.round(-F.col("hi.d"), 6).alias("high"), text(F.col("hi")).alias("high_row"), F.round(F.col("lo.d"), 6).alias("low"), text(F.col("lo")).alias("low_row"))


def change_summary(rows: DataFrame, before: str, after: str, keys: Sequence[str]) -> DataFrame:
    """How a metric moved, overall and by keys (null: all): counts at 0.01, 0.5, 2 and 6.3, median, mean, extremes."""
    x = rows.withColumn("_d", F.round(F.col(after) - F.col(before), 6))
    size = F.abs("_d")
    sets = [[F.col(k) for k in keys], []]
    g = x.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.count("*").alias("n"), F.count_if(size < 0.01).alias("iguales"), *[F.count_if(size >= t).alias(a) for t, a in ((0.5, "m05"), (2.0, "m2"), (6.3, "m63"))], F.median("_d").alias("mediana"), F.avg("_d").alias("media"), F.min("_d").alias("min"), F.max("_d").alias("max"), F.max(size).alias("max_abs"))
    return g.withColumns({c: F.round(c, 5) for c in ("mediana", "media", "min", "max", "max_abs")})


def timings(rows: DataFrame, key: str, order: Column, ms: str) -> DataFrame:
    """(key, n, median, p90, min, max, drift, dirty). p90 is the exclusive definition, at rank 0.9 (n + 1); drift is the
    median of the second half over that of the first; more than 20 % of it marks the series as dirty."""
    w, by = Window.partitionBy(key), Window.partitionBy(key).orderBy(ms, order)
    x = rows.withColumn("_n", F.count("*").over(w)).withColumn("_v", F.row_number().over(by)).withColumn("_t", F.row_number().over(w.orderBy(order)))
    at = 0.9 * (F.col("_n") + 1)
    lo, hi = F.greatest(F.lit(1), F.least(F.floor(at), F.col("_n"))), F.least(F.floor(at) + 1, F.col("_n"))
    half = F.floor(F.col("_n") / 2)
    g = x.groupBy(key).agg(
        F.first("_n").alias("n"), F.median(ms).alias("median"), F.max(F.when(F.col("_v") == lo, F.col(ms))).alias("a"), F.max(F.when(F.col("_v") == hi, F.col(ms))).alias("b"), F.first(at - F.floor(at)).alias("f"),
        F.min(ms).alias("min"), F.max(ms).alias("max"), F.median(F.when(F.col("_t") <= half, F.col(ms))).alias("h1"), F.median(F.when(F.col("_t") > half, F.col(ms))).alias("h2"),
    )
    drift = F.try_divide("h2", "h1")
    return g.select(key, "n", F.round("median", 5).alias("median"), F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"), 5).alias("p90"), "min", "max", F.round(drift, 5).alias("drift"), (F.abs(drift - 1) > 0.2).alias("dirty"))


def stable_positions(heads: DataFrame, group: str, head: str, n: int) -> DataFrame:
    """(group, samples, stable, prefix): positions of the first n characters that are equal in all samples, cut to the
    shortest one, and how long the common beginning is. Counts distinct characters a position, not pairs of samples."""
    x = heads.select(group, F.length(head).alias("_l"), F.posexplode(F.filter(F.split(F.substring(head, 1, n), ""), lambda c: c != "")).alias("pos", "c"))
    least = heads.groupBy(group).agg(F.least(F.lit(n), F.min(F.length(head))).alias("shortest"), F.count("*").alias("samples"))
    p = x.groupBy(group, "pos").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).join(least, group).where(F.col("pos") < F.col("shortest"))
    g = p.groupBy(group).agg(F.first("samples").alias("samples"), F.count_if(F.col("lo") == F.col("hi")).alias("stable"), F.coalesce(F.min(F.when(F.col("lo") != F.col("hi"), F.col("pos"))), F.first("shortest")).cast("int").alias("prefix"))
    return g


def crossing(points: DataFrame, key: str, x: str, y: str, level: float) -> DataFrame:
    """(key, at): where a measured curve first crosses a level, by interpolation between the two points around it."""
    w = Window.partitionBy(key).orderBy(x)
    p = points.withColumn("_x", F.lead(x).over(w)).withColumn("_y", F.lead(y).over(w))
    p = p.where((F.col(y) < level) & (F.col("_y") >= level))
    return p.groupBy(key).agg(F.round(F.min(F.col(x) + (F.col("_x") - F.col(x)) * (level - F.col(y)) / (F.col("_y") - F.col(y))), 5).alias("at"))


def monotone(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(x)
    return points.withColumn("_b", F.lag(y).over(w)).groupBy(key).agg(F.bool_and(F.col("_b").isNull() | (F.col(y) >= F.col("_b"))).alias("monotone"))


def argmins(cells: DataFrame, key: str, item: str, y: str, digits: int = 4) -> DataFrame:
    """(key, item, y): all ties at each key's minimum, of rounded values."""
    w = Window.partitionBy(key).orderBy("_y")
    return cells.withColumn("_y", F.round(y, digits)).withColumn("_r", F.rank().over(w)).where("_r = 1").select(key, item, F.col("_y").alias(y))


def cheapest(cells: DataFrame, key: str, cost: str, tie: Sequence[str], k: int, special: Column) -> DataFrame:
    """The k cheapest of each key, and the cheapest special one if it isn't among them."""
    w = Window.partitionBy(key).orderBy(cost, *tie)
    x = cells.withColumn("_special", special).withColumn("rank", F.row_number().over(w)).withColumn("_sr", F.row_number().over(Window.partitionBy(key, "_special").orderBy(cost, *tie)))
    return x.where((F.col("rank") <= k) | (F.col("_special") & (F.col("_sr") == 1))).drop("_special", "_sr")


def processed_before(log: DataFrame, engine: str, order: Sequence[Column], size: str, processed: Column, recycled: Column) -> DataFrame:
    """log with `resident`: the largest size already processed since the engine's last recycling."""
    w = Window.partitionBy(engine).orderBy(*order)
    x = log.withColumn("_epoch", F.sum(recycled.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = Window.partitionBy(engine, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("resident", F.max(F.when(processed, F.col(size))).over(e)).drop("_epoch")


def stratified(rows: DataFrame, stratum: str, identity: str, target: int, least: int, seed: str, parts: int = 64) -> DataFrame:
    """A sample: of each stratum max(least, its share of target), as far as it goes, by a keyed hash of the identity.

    Its size is the feature: target rows, more where small strata are filled up. Each of `parts` parts of a stratum gives as many rows as
    the whole may, and only those meet."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"))  # one row
    quota = F.greatest(F.lit(least), F.round(F.lit(target) * F.col("_n") / F.col("_all")))
    order = [F.md5(F.concat(F.lit(seed), F.col(identity).cast("string"))), F.col(identity)]
    part = F.pmod(F.xxhash64(identity), F.lit(parts))
    x = rows.join(sizes.join(F.broadcast(total)), stratum)
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, part).orderBy(*order))).where(F.col("_r") <= quota)
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= quota).drop("_n", "_all", "_r")


def _inversions(b: np.ndarray, w: np.ndarray) -> int:
    """Summed products of weights of pairs that stand in one order and whose b is in the other: b of rows in the order of a, ties
    of a in the order of b. Counted by merges of runs that double in length."""
    n, total, size = len(b), 0, 1
    at = np.arange(n)
    while size < n:
        pair, right = at // (2 * size), (at // size) % 2
        order = np.lexsort((right, b, pair))
        left = np.where(right[order] == 0, w[order], 0)
        seen = np.cumsum(left)
        ends = np.append(np.flatnonzero(np.diff(pair[order])), n - 1)
        before = np.append(0, seen[ends])  # of the pairs before
        more = before[pair[order] + 1] - seen  # weight on the left with a greater b
        total += int(np.sum((more * w[order])[right[order] == 1]))
        size *= 2
    return total


def rank_changes(cells: DataFrame, family: str, a: str, b: str) -> DataFrame:
    """(family, pares, inversiones, deshechos, hechos, cambia) between two metrics: pairs, pairs in opposite order, ties of a that b
    breaks, ties of b that a doesn't have, and whether the items with the least value are others.

    Items of equal values are summed first. What is tied follows from counts; inversions are counted by merging, in n log n, so
    no pair is made. A family's distinct pairs of values meet in one task.
    """
    c = cells.select(family, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where("_a is not null and _b is not null").groupBy(family, "_a", "_b").agg(F.count("*").alias("_n"))

    def count(rows: pa.Table) -> pa.Table:
        x, y, w = (rows[k].to_numpy() for k in ("_a", "_b", "_n"))
        tied = lambda v: int(sum(n * (n - 1) // 2 for n in np.bincount(np.unique(v, return_inverse=True)[1], w).astype(np.int64).tolist()))
        order = np.lexsort((y, x))
        both, n = int(np.sum(w * (w - 1) // 2)), int(w.sum())
        win = (x == x.min()) != (y == y.min())
        out = [n * (n - 1) // 2, _inversions(y[order], w[order].astype(np.int64)), tied(x) - both, tied(y) - both]
        return pa.table({family: rows[family].slice(0, 1), **{k: pa.array([v], pa.int64()) for k, v in zip(("pares", "inversiones", "deshechos", "hechos"), out)}, "cambia": pa.array([bool(win.any())])})

    kind = dict(cells.dtypes)[family]
    return c.groupBy(family).applyInArrow(count, f"{family} {kind}, pares long, inversiones long, deshechos long, hechos long, cambia boolean")


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """How many of the first characters of two texts agree, `most` at most."""
    n = F.least(F.length(a), F.length(b), F.lit(most))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, 1) == F.substring(b, i, 1))
    return F.when(n < 1, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)).cast("int")


def best_evidence(heads: DataFrame, kind: str, engine: str, head: str, most: int = 64) -> DataFrame:
    """(kind, engine, samples, prefix): for each format the engine whose files share the longest beginning, and that beginning. The
    beginning that all share is what the least and the greatest of them share, so nothing is sorted or gathered."""
    g = heads.groupBy(kind, engine).agg(F.min(head).alias("_lo"), F.max(head).alias("_hi"), F.count("*").alias("samples"))
    g = g.withColumn("_n", common_prefix(F.col("_lo"), F.col("_hi"), most)).withColumn("prefix", F.expr("left(_lo, _n)"))
    return g.groupBy(kind).agg(F.min_by(F.struct(engine, "samples", "prefix"), F.struct((-F.col("_n")).alias("n"), F.col(engine))).alias("_e")).select(kind, f"_e.{engine}", "_e.samples", "_e.prefix")


def shared_prefixes(evidence: DataFrame, kind: str, least: int = 2) -> DataFrame:
    """(prefix, kinds, under): beginnings of `least` characters or more; the formats that have just this one, and the longest other such
    beginning that this one begins with (null if none): the edges of the trie that beginnings make."""
    p = evidence.where(F.length("prefix") >= least).groupBy("prefix").agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
    shorter = p.select(F.col("prefix").alias("_own"), F.explode(F.when(F.length("prefix") > least, F.transform(F.sequence(F.lit(least), F.length("prefix") - 1), lambda i: F.substring("prefix", F.lit(1), i))).otherwise(F.array().cast("array<string>"))).alias("prefix"))
    under = shorter.join(p.select("prefix"), "prefix").groupBy(F.col("_own").alias("prefix")).agg(F.max_by("prefix", F.length("prefix")).alias("under"))
    return p.join(under, "prefix", "left")
