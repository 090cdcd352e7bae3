"""Near twins by their texts: pairs whose matching blocks make up most of both, as difflib finds them.

Equal texts are one node. Texts are dealt out in blocks by the logarithm of their length; a pair of blocks meets in a task
only if their lengths allow the ratio. There two bounds that can't be wrong come first, of all pairs at once: the letters that both
have, and the longest common subsequence; matching blocks are looked for in what is left. Only pairs that reach the ratio are emitted.
"""

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut, join_small

STEP = 1.1  # between classes of length
BLOCK = 512  # texts of a block, about
BINS = 64  # that letters are counted in


def ratio(a: str, b: str) -> float:
    """2 M / (len(a) + len(b)), M the characters of the matching blocks; 1 for two empty texts."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        same = rows & at.get(c, 0)
        rows = ((rows + same) | (rows - same)) & full
    return len(a) - rows.bit_count()


def _letters(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BINS), np.int32)
    for i, x in enumerate(texts):
        np.add.at(out[i], np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, 1)
    return out


def twins_of(a: list[str], b: list[str], least: float, same: bool) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of the pairs of a and b (i < j if they are the same list) whose ratio is `least` or more."""
    x, y = _letters(a), _letters(b)
    n, m = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    need = least * (n[:, None] + m) / 2 - 1e-9
    both = np.zeros(need.shape, np.int32)
    for k in range(BINS):
        both += np.minimum(x[:, k][:, None], y[:, k])
    ok = both >= need
    if same:
        ok &= np.arange(len(a))[:, None] < np.arange(len(b))
    for i, j in zip(*(v.tolist() for v in np.nonzero(ok))):
        if common_subsequence(a[i], b[j]) >= need[i, j] and (r := ratio(a[i], b[j])) >= least:
            yield i, j, r


def string_twins(rows: DataFrame, key: str, text: Column, least: float = 0.70, block: int = BLOCK) -> DataFrame:
    """(a, b, ratio) of pairs of distinct texts, named by their smallest keys, a before b, whose ratio is `least` or more. Null texts count
    as empty. Membership: equal texts have one smallest key."""
    nodes = cut(rows.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("t")).groupBy("t").agg(F.min("id").alias("id")))
    kind = dict(nodes.dtypes)["id"]
    size = F.when(F.length("t") == 0, -1).otherwise(F.floor(F.log(F.length("t")) / math.log(STEP))).cast("int")
    nodes = nodes.withColumn("c", size)
    classes = nodes.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    blocks = cut(classes.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "parts"))
    reach = math.ceil(math.log((2 - least) / least) / math.log(STEP)) + 1
    other = blocks.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
    near = blocks.withColumn("c2", F.explode(F.sequence(F.col("c") - reach, F.col("c") + reach))).join(other, "c2").where((F.col("c") != -1) == (F.col("c2") != -1))
    first, second = F.least(F.struct("c", "p"), F.struct(F.col("c2").alias("c"), F.col("p2").alias("p"))), F.greatest(F.struct("c", "p"), F.struct(F.col("c2").alias("c"), F.col("p2").alias("p")))
    near = near.select("c", "p", first.alias("i"), second.alias("j")).distinct()
    dealt = join_small(nodes, classes, "c").withColumn("p", F.pmod(F.xxhash64("t"), "parts").cast("int"))
    dealt = join_small(dealt, near, ["c", "p"]).select("id", "t", "i", "j", (F.col("i.c") * 1_000_000 + F.col("i.p") == F.col("c") * 1_000_000 + F.col("p")).alias("left"))

    def meet(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id")
        same = not (~tile["left"]).any()
        a = tile[tile["left"]]
        b = a if same else tile[~tile["left"]]
        found = list(twins_of(a["t"].tolist(), b["t"].tolist(), least, same))
        x, y = a["id"].tolist(), b["id"].tolist()
        out = [(x[i], y[j], r) if x[i] < y[j] else (y[j], x[i], ratio(b["t"].iat[j], a["t"].iat[i])) for i, j, r in found]
        return pd.DataFrame([r for r in out if r[2] >= least], columns=["a", "b", "ratio"])

    return dealt.groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, ratio double")


def twin_report(rows: DataFrame, key: str, name: Column, description: Column, params: Column, least: float = 0.70) -> DataFrame:
    """One row: pairs of rows whose names, descriptions (also at 0.85) or both are alike, whose parameters are the same, and the
    share of rows that have a twin by description, and by both. Counts are of all pairs of rows; equal texts are counted, not paired."""
    x = cut(rows.select(F.col(key).alias("id"), F.coalesce(name, F.lit("")).alias("n"), F.coalesce(description, F.lit("")).alias("d"), F.array_join(F.array_sort(F.array_distinct(params)), ",").alias("p")))
    kinds = x.groupBy("n", "d", "p").agg(F.count("*").alias("w"))
    two = lambda w: (w * (w - 1) / 2).cast("long")

    def alike(column: str, at: float) -> DataFrame:
        """(x, y) of texts of a column that are alike, both ways, each with itself."""
        ids = x.groupBy(column).agg(F.min("id").alias("id"))
        t = cut(string_twins(x, "id", F.col(column), at).select("a", "b").join(ids.select(F.col("id").alias("a"), F.col(column).alias("x")), "a").join(ids.select(F.col("id").alias("b"), F.col(column).alias("y")), "b").select("x", "y"))
        own = ids.select(F.col(column).alias("x"), F.col(column).alias("y"))
        return t.union(t.select("y", "x")).union(own)

    def pairs(column: str, at: float, name: str) -> DataFrame:
        w = kinds.groupBy(column).agg(F.sum("w").alias("w"))
        t = alike(column, at).join(w.withColumnsRenamed({column: "x", "w": "wx"}), "x").join(w.withColumnsRenamed({column: "y", "w": "wy"}), "y")
        return t.agg(F.sum(F.when(F.col("x") == F.col("y"), two(F.col("wx"))).when(F.col("x") < F.col("y"), F.col("wx") * F.col("wy")).otherwise(0)).alias(name))

    names, descriptions = cut(alike("n", least)), cut(alike("d", least))
    by = kinds.groupBy("n", "d").agg(F.sum("w").alias("w"))
    k = by.select(F.col("n").alias("x"), F.col("d").alias("dx"), F.col("w").alias("wx")).join(names, "x").join(by.select(F.col("n").alias("y"), F.col("d").alias("dy"), F.col("w").alias("wy")), "y")
    k = cut(k.join(descriptions.select(F.col("x").alias("dx"), F.col("y").alias("dy")), ["dx", "dy"], "left_semi"))
    same = (F.col("x") == F.col("y")) & (F.col("dx") == F.col("dy"))
    both = k.agg(F.sum(F.when(same, two(F.col("wx"))).when((F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("dx") < F.col("dy"))), F.col("wx") * F.col("wy")).otherwise(0)).alias("confusable"))
    with_both = k.groupBy("x", "dx").agg(F.max("wx").alias("w"), F.max(F.when(same, F.col("wx") > 1).otherwise(True)).alias("t")).agg(F.sum(F.when(F.col("t"), F.col("w")).otherwise(0)).alias("n_both"))
    d = kinds.groupBy("d").agg(F.sum("w").alias("w"))
    with_d = descriptions.groupBy("x").agg(F.count("*").alias("k")).join(d.withColumnRenamed("d", "x"), "x").agg(F.sum(F.when((F.col("k") > 1) | (F.col("w") > 1), F.col("w")).otherwise(0)).alias("n_desc"))
    params_ = kinds.groupBy("p").agg(F.sum("w").alias("w")).agg(F.sum(two(F.col("w"))).alias("same_params"))
    whole = x.agg(F.count("*").alias("rows"))
    out = whole
    for one in (pairs("n", least, "by_name"), pairs("d", least, "by_description"), pairs("d", 0.85, "by_description_85"), params_, both, with_d, with_both):  # a row each
        out = out.join(F.broadcast(one))
    share = lambda n: F.round(F.coalesce(F.col(n), F.lit(0)) / F.col("rows"), 6)
    return out.select("rows", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("by_name", "by_description", "by_description_85", "same_params", "confusable")], share("n_desc").alias("share_by_description"), share("n_both").alias("share_by_both"))
