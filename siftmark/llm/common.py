"""What several operators of this subpackage share: Arrow batches, names, connected components; and the shared folder of the library."""

from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut, join_small, new_shared_path, remove, shared_dir, written

__all__ = ["Codes", "connected_components", "cut", "free_names", "join_small", "new_shared_path", "remove", "shared_dir", "texts", "uniform63", "written"]

HUB = 100_000  # neighbours from which a node's edges aren't gathered by the node


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """names, each lengthened until none of `taken` is equal to it but for case."""
    taken, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def uniform63(*parts: Column) -> Column:
    """A reproducible number from 0 to 2**60 - 1 from the parts' text; DuckDB computes the same from md5()."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class Codes(dict):
    """Numbers words in the order in which they come: list(map(codes.__getitem__, words))."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n

    def newest(self, n: int) -> list:
        """The n words that came last, in order, without walking through the others."""
        return list(islice(reversed(self), n))[::-1]


def _with_least(edges: DataFrame, of: DataFrame, hub: int | None) -> DataFrame:
    """edges (a, b) with m, the least b that `of` (a, m, degree) has for a.

    Nodes of `hub` neighbours or more are broadcast, so that their edges stay where they are; the others meet their
    least by a shuffle.
    """
    of_a = of.select("a", "m")
    if hub is None:
        return edges.join(of_a, "a")
    hubs = of.where(F.col("degree") >= hub).select("a", "m")
    return edges.join(F.broadcast(hubs), "a").unionByName(edges.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(of_a, "a"))


def connected_components(edges: DataFrame, most_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, root) of each node of edges (a, b of one type): root is the smallest node that can be reached.

    Alternates the large-star and small-star steps: each round makes every node's neighbours point to the
    smallest one, so even long chains need a logarithmic number of rounds. The minima are taken by groupBy,
    which adds up before the shuffle; nodes of `hub` neighbours or more, and of a hundred-thousandth of all edges at
    least, are so few that they are broadcast, and their edges aren't gathered. It ends when every node points to a
    root. Each round is a table in the shared folder, removed once the next one stands. No edges give no rows.
    """
    spark = edges.sparkSession

    def state(e: DataFrame) -> tuple[int, bool, int]:
        """(edges, whether all of them lead to roots, the most neighbours of a node)"""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        n, bad, most = nodes.agg(F.sum("up"), F.max(((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0))).cast("int")), F.max(F.col("up") + F.col("down"))).first()
        return n or 0, not bad, most or 0

    def stars(e: DataFrame, hub: int | None) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, least, hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a > b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = _with_least(down, least, hub).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    e, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        n, settled, most = state(e)
        if settled:
            break
        at = max(hub, n // 50_000)
        e, newer = written(stars(e, at if most >= at else None), "edges")
        remove(spark, path)
        path = newer
    else:
        raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
