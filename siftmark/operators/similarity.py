"""Joins by likeness and containment: token Jaccard, subsumption, mentions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def jaccard_pairs(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(a, b, jaccard) of pairs of sets (key, array) with at least the given Jaccard likeness.

    Equal sets are one node, so copies don't make pairs of their own; call expand_equal() for them. Candidates come from
    a prefix of each set's rarest tokens: two sets that are alike share one of the first size - ceil(least * size) + 1 in
    a global order, so frequent tokens, which would pair everything, hardly ever join. Counts are read off the arrays.
    """
    one = sets.select(F.array_sort(F.array_distinct(items)).alias("s"), key).where(F.size("s") > 0).groupBy("s").agg(F.min(key).alias("id"))
    tok = one.select("id", F.explode("s").alias("t"))
    freq = tok.groupBy("t").agg(F.count("*").alias("f"))
    ranked = tok.join(freq, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
    keep = F.size("o") - F.ceil(F.lit(least) * F.size("o")) + 1
    prefix = ranked.select("id", F.size("o").alias("n"), F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("x")).select("id", "n", F.col("x.t").alias("t"))
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "t")
    near = prefix.withColumnsRenamed({"id": "a", "n": "na"}).join(other, "t").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))).select("a", "b").distinct()
    sa, sb = one.select(F.col("id").alias("a"), F.col("s").alias("sa")), one.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    j = common / (F.size("sa") + F.size("sb") - common)
    return near.join(sa, "a").join(sb, "b").withColumn("jaccard", F.round(j, 6)).where(F.col("jaccard") >= least).select("a", "b", "jaccard")


def equal_groups(sets: DataFrame, key: str, items: str) -> DataFrame:
    """(id, n): for each distinct set its smallest key and how many rows have it."""
    return sets.groupBy(F.array_sort(F.array_distinct(items)).alias("s")).agg(F.min(key).alias("id"), F.count("*").alias("n")).where(F.size("s") > 0).select("id", "n")


def membership(sets: DataFrame, key: str, items: Sequence[str]) -> DataFrame:
    """(key, id): each row's class, named by the smallest key of the rows whose sets in all of `items` are equal: what the pairs of
    classes of jaccard_pairs() and subsumes() are to be read with. Rows of a class meet by a join, not in a group."""
    named = {c: F.array_sort(F.array_distinct(c)) for c in items}
    x = sets.select(key, F.xxhash64(*named.values()).alias("_h"), *[v.alias(c) for c, v in named.items()])
    least = x.groupBy("_h", *items).agg(F.min(key).alias("id"))
    return x.join(least, ["_h", *items]).select(key, "id")


FREE = 10  # properties that a set doesn't require, up to which all its parts are written out


def subsumes(props: DataFrame, key: str, names: str, required: str, free: int = FREE) -> DataFrame:
    """(a, b): a's properties are a proper part of b's, and b requires nothing that a lacks. Rows with equal signatures are
    one class, named by the smallest key.

    A part of b that holds what b requires is named by which of b's other properties it has: up to `free` of those all such parts
    are written out and meet the classes that are equal to them, so work follows the parts and not the pairs. Larger b's are
    tried with the classes whose rarest property they hold; a bit for each property's hash passes over most of them.
    """
    one = props.select(key, F.array_sort(F.array_distinct(names)).alias("p"), F.array_sort(F.array_distinct(required)).alias("q")).where(F.size("p") > 0).groupBy("p", "q").agg(F.min(key).alias("id"))
    one = cut(one.select("id", "p", "q", F.array_except("p", "q").alias("rest"), (F.size(F.array_except("q", "p")) == 0).alias("holds")))
    sized = one.where("holds").select(F.col("id").alias("b"), F.col("p").alias("pb"), F.col("q").alias("qb"), "rest")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    bits = lambda of: F.transform(of, lambda t: bit(F.pmod(F.xxhash64(t), F.lit(64))))
    mark = lambda of: F.aggregate(bits(of), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    m = F.explode(F.sequence(F.lit(0).cast("long"), bit(F.size("rest")) - 2))
    parts = sized.where((F.size("rest") <= free) & (F.size("rest") > 0)).select("b", "qb", "rest", m.alias("m"))
    some = F.filter("rest", lambda _, i: F.col("m").bitwiseAND(bit(i)) != 0)
    parts = parts.select("b", F.array_sort(F.concat("qb", some)).alias("p"))
    few = one.select(F.col("id").alias("a"), "p").join(parts, "p").select("a", "b")

    large = sized.where(F.size("rest") > free)
    tok = one.select("id", F.explode("p").alias("t"))
    rare = tok.join(tok.groupBy("t").agg(F.count("*").alias("f")), "t").groupBy("id").agg(F.min_by("t", F.struct("f", "t")).alias("t"))
    a = one.join(rare, "id").select(F.col("id").alias("a"), F.col("p").alias("pa"), mark(F.col("p")).alias("ma"), "t")
    b = large.select("b", "pb", "qb", mark(F.col("pb")).alias("mb"), mark(F.col("qb")).alias("mq"), F.explode("pb").alias("t"))
    near = a.join(b, "t").where((F.col("ma").bitwiseAND(F.bitwise_not("mb")) == 0) & (F.col("mq").bitwiseAND(F.bitwise_not("ma")) == 0))
    many = near.where((F.size("pa") < F.size("pb")) & (F.size(F.array_except("pa", "pb")) == 0) & (F.size(F.array_except("qb", "pa")) == 0)).select("a", "b")
    return few.unionByName(many)


def longest_mention(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name): the longest of the names that the text mentions as a run of whole words; ties to the first in order.

    Names are looked up by hash among the text's words and word pairs: no text meets every name.
    """
    w = F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+")
    runs = F.array_distinct(F.concat(w, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.array_join(F.slice(w, i, 2), " "))))
    x = texts.select(key, F.explode(runs).alias("_run")).join(names.select(F.col(name).alias("_name"), F.lower(name).alias("_run")).distinct(), "_run")
    return x.groupBy(key).agg(F.min_by("_name", F.struct(-F.length("_name"), F.col("_name"))).alias(name))


def ratchet(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estado) of known debt against current findings: heredado, NUEVO or ARREGLADO."""
    both = known.distinct().withColumn("_k", F.lit(True)).join(found.distinct().withColumn("_f", F.lit(True)), keys, "full_outer")
    return both.select(*keys, F.when(F.col("_k").isNull(), "NUEVO").when(F.col("_f").isNull(), "ARREGLADO").otherwise("heredado").alias("estado"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], status: str) -> DataFrame:
    """(keys, cambio) cell by cell, both directions, cells of one run included."""
    both = a.withColumnRenamed(status, "_a").join(b.withColumnRenamed(status, "_b"), keys, "full_outer")
    x, y = F.col("_a"), F.col("_b")
    change = F.when(x.isNull(), "solo segunda").when(y.isNull(), "solo primera").when((x == "fallo") & (y != "fallo"), "fallo resuelto").when((x != "fallo") & (y == "fallo"), "fallo nuevo").when((x == "aviso") & (y != "aviso"), "aviso resuelto").when((x != "aviso") & (y == "aviso"), "aviso nuevo").when(x != y, "cambia").otherwise("igual")
    return both.select(*keys, change.alias("cambio"))


def first_substantive(tools: Column, diagnostics: list[str]) -> Column:
    return F.element_at(F.filter(tools, lambda t: ~t.isin(*diagnostics)), 1)
