"""Mixing of sources to target weights by temperature.

A source's weight is its share of the tokens raised to an exponent from 0 (all alike) to 1 (as they come),
normalised. The exponent is bisected: the flattest mixture whose entropy is no more than a target, or that repeats
no source more often than a limit. Each source then gets weight times the budget of tokens, and its rows are dealt
out in an order of its own: one keyed permutation after another, cut where the budget is spent. Blocks of the mixed
stream each hold the sources' tokens in proportion to the weights, permuted. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, free_names, join_small, uniform63

FULL = float(1 << 60)
STEPS = 40


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that tells a null source from any other."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source.cast("string")))


def weights(sizes: DataFrame, budget: int | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """(key, n_docs, n_tokens, exponent, weight, quota, epochs) of each source of sizes (key, n_docs, n_tokens).

    One row for each source: of the rows of a source only sums get here. Bisection sees how many sources have each size,
    so ten million hosts of few pages are some thousand numbers. budget: tokens of the mixture, by default
    as many as there are. target_entropy is in nats. With both limits, the larger exponent holds. If even the
    exponent 1 breaks max_repeats (a budget of more than that many times the input), the exponent is 1. Sources
    without tokens are left out. quota: whole tokens; epochs: how many whole permutations it takes.
    """
    some = sizes.where("n_tokens > 0")
    alike = some.groupBy("n_tokens").agg(F.count("*").alias("times"))
    whole = alike.agg(F.sum(F.col("n_tokens") * F.col("times")).alias("all_tokens"), F.sort_array(F.collect_list(F.struct(F.col("n_tokens").cast("double").alias("t"), F.col("times").cast("double").alias("times")))).alias("t"))
    whole = whole.withColumn("budget", F.lit(budget).cast("double") if budget else F.col("all_tokens").cast("double"))
    whole = whole.withColumn("p", F.transform("t", lambda x: F.struct((x["t"] / F.col("all_tokens")).alias("share"), x["times"].alias("times"))))

    def total(a: Column) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x["share"], a) * x["times"])

    def fits(a: Column) -> Column:
        ok = F.lit(True)
        if max_repeats is not None:
            most = F.array_max(F.transform("p", lambda x: F.pow(x["share"], a) / (x["share"] * F.col("all_tokens"))))
            ok = ok & (most * F.col("budget") / total(a) <= F.lit(float(max_repeats)))
        if target_entropy is not None:
            log = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x["share"], a) * a * F.log(x["share"]) * x["times"])
            ok = ok & (F.log(total(a)) - log / total(a) <= F.lit(float(target_entropy)))
        return ok

    none, kind = F.lit(0.0), T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    start = F.struct(none.alias("lo"), F.when(fits(none), none).otherwise(F.lit(1.0)).alias("hi")).cast(kind)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        good = fits(mid)
        return F.struct(F.when(good, s["lo"]).otherwise(mid).alias("lo"), F.when(good, mid).otherwise(s["hi"]).alias("hi")).cast(kind)

    found = whole.select("all_tokens", "budget", "p", F.round(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)["hi"], 9).alias("exponent"))
    found = found.select("all_tokens", "budget", "exponent", total(F.col("exponent")).alias("total"))
    out = some.join(F.broadcast(found)).withColumn("share", F.pow(F.col("n_tokens") / F.col("all_tokens"), F.col("exponent")) / F.col("total"))
    out = out.withColumn("quota", F.floor(F.round(F.col("share") * F.col("budget"), 3)).cast("long"))  # of the share as it is: small sources keep theirs
    return out.select("key", "n_docs", "n_tokens", "exponent", F.round("share", 9).alias("weight"), "quota", F.floor(F.col("quota") / F.col("n_tokens")).cast("int").alias("epochs"))


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _row(docs: DataFrame) -> Column:
    """What tells rows apart that share a doc_id, or have none: they have places of their own in the permutation."""
    return uniform63(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _place(row: Column, epoch: Column, seed: int) -> Column:
    return uniform63(F.lit(str(seed)), epoch.cast("string"), row.cast("string"))


def stream(rows: DataFrame, plan: DataFrame, seed: int = 0, block_tokens: int = 100_000, run: int = 2000) -> DataFrame:
    """(doc_id, key, epoch, n_tokens, h, before, mix_block) of what is taken of rows (doc_id, row, key, n_tokens).

    A source's stream is its permutation of epoch 0, then that of epoch 1, and so on, ended by its quota.
    before: tokens of the source ahead of the row, summed in two steps: over runs of about `run` rows of the
    permutation, then within the run, so that no source, however large, comes together in one task.
    """
    blocks = plan.agg(F.greatest(F.lit(1), F.ceil(F.sum("quota") / block_tokens)).cast("long").alias("n_blocks"))
    taken = join_small(rows, plan.select("key", "n_docs", F.col("n_tokens").alias("of_source"), "quota", "epochs").join(F.broadcast(blocks)), "key")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).withColumn("h", _place(F.col("row"), F.col("epoch"), seed))
    taken = taken.withColumn("run", F.floor(F.col("h") / F.lit(FULL) * F.ceil(F.col("n_docs") / run)).cast("long"))
    sums = taken.groupBy("key", "epoch", "run").agg(F.sum("n_tokens").alias("in_run"), F.first("of_source").alias("of_source"))
    ahead = Window.partitionBy("key", "epoch").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "epoch", "run", (F.coalesce(F.sum("in_run").over(ahead), F.lit(0)) + F.col("epoch") * F.col("of_source")).alias("base"))
    within = Window.partitionBy("key", "epoch", "run").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = taken.withColumn("upto", F.sum("n_tokens").over(within)).join(sums, ["key", "epoch", "run"])
    placed = placed.withColumn("before", F.col("base") + F.col("upto") - F.col("n_tokens")).where("before + n_tokens <= quota")
    block = F.least(F.floor(F.col("before") / (F.col("quota") / F.col("n_blocks"))), F.col("n_blocks") - 1).cast("long")
    return placed.select("doc_id", "key", "epoch", "n_tokens", "h", "before", block.alias("mix_block"))


def _narrow(docs: DataFrame, tokens: Column | None) -> DataFrame:
    return cut(docs.select("doc_id", _row(docs).alias("row"), source_key(F.col("source")).alias("key"), (word_count(F.col("text")) if tokens is None else tokens).alias("n_tokens")))


def mix(docs: DataFrame, budget: int | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None, tokens: Column | None = None, seed: int = 0, block_tokens: int = 100_000) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, mix_block, place) of the mixed stream of docs (doc_id, source, text).

    place: order within the block, from 1, by a keyed hash; ties in it by source, epoch and doc_id. Rows with a
    null source are a source of their own. Rows without words weigh nothing and ride along where they fall;
    a source without any words is left out. Rows of equal doc_id and text have one place in the permutation, and
    count each. A null doc_id is allowed. An empty table gives none. tokens: a column of token counts in place of the words of text.
    """
    rows = _narrow(docs, tokens)
    plan = cut(weights(_sizes(rows), budget, max_repeats, target_entropy))
    out = stream(rows, plan, seed, block_tokens)
    place = Window.partitionBy("mix_block").orderBy(uniform63(F.lit("place"), F.col("h").cast("string")), "key", "epoch", "doc_id", "n_tokens")
    source = F.when(F.col("key") == "n", F.lit(None)).otherwise(F.expr("substring(key, 2)"))
    return out.withColumn("place", F.row_number().over(place)).select("doc_id", source.alias("source"), "epoch", "n_tokens", "mix_block", "place")


def mixed_documents(docs: DataFrame, budget: int | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of docs, as often as mix() takes them: all columns, in no order.

    A row's epochs follow from its hash and its source's cut alone, so texts aren't shuffled; but for equal rows at the
    very cut, of which not all fit: those are counted off. Other columns don't matter, whatever their names.
    """
    rows = _narrow(docs, None)
    plan = cut(weights(_sizes(rows), budget, max_repeats, target_entropy))
    last = stream(rows, plan, seed).join(F.broadcast(plan.select("key", "epochs")) if plan.count() <= 100_000 else plan.select("key", "epochs"), "key").where("epoch = epochs")
    ends = last.groupBy("key", "h").agg(F.count("*").alias("fit")).groupBy("key").agg(F.max(F.struct("h", "fit")).alias("end"))
    ends = cut(plan.select("key", "epochs").join(ends.select("key", "end.h", "end.fit"), "key", "left"))
    tied = join_small(rows, ends, "key").where(_place(F.col("row"), F.col("epochs"), seed) == F.col("h")).groupBy("key").agg(F.count("*").alias("tied"))
    ends = cut(ends.join(tied, "key", "left"))

    key, epochs, at, fit, of, h, no, time = free_names(docs.columns, "_key", "_epochs", "_cut", "_fit", "_tied", "_h", "_no", "_time")
    small = ends.select(F.col("key").alias(key), F.col("epochs").alias(epochs), F.col("h").alias(at), F.col("fit").alias(fit), F.col("tied").alias(of))
    out = join_small(docs.withColumn(key, source_key(F.col("source"))), small, key).withColumn(h, _place(_row(docs), F.col(epochs), seed))

    def times(rows: DataFrame, more: Column) -> DataFrame:
        return rows.withColumn(time, F.explode(F.array_repeat(F.lit(1), F.col(epochs) + F.when(more, 1).otherwise(0)))).select(docs.columns)

    if not ends.where("fit < tied").limit(1).count():
        return times(out, F.col(h) <= F.col(at))
    part = F.coalesce((F.col(h) == F.col(at)) & (F.col(fit) < F.col(of)), F.lit(False))
    counted = out.where(part).withColumn(no, F.row_number().over(Window.partitionBy(key).orderBy(h)))
    return times(out.where(~part), F.col(h) <= F.col(at)).unionByName(times(counted, F.col(no) <= F.col(fit)))
