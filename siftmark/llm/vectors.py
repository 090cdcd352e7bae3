"""Groups of vectors whose cosine is high, by counting collisions of one-dimensional projections.

Vectors of length one are projected on many random directions. Those that are close lie within a window of each other in
nearly all projections; strangers do in few. A pair counts its collisions in query-centred windows, and those that
reach a count, calibrated so that a pair right at the limit does in all but one of ten thousand cases, are verified by their cosine.
So that no vector meets all others, tables of cells bring together what shares the coarse places in several sorted
projections; how many follows from the number of vectors, and how many tables from the same recall.
"""

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, join_small
from .hamming import runs

LEAST = 0.98
LOST = 1e-4  # of pairs at the limit, by the tables and by the count each
WINDOW = 2.0  # half a window, and
CELL = 8.0  # a cell, in distances of a pair at the limit
COUNTED = 32  # projections whose collisions are counted
FILLED = 512  # vectors of a cell, about, if they lie evenly
MOST = 1024  # vectors of a cell that one task takes; fuller cells are dealt out as pairs of chunks from the start


def _normal_within(x: float) -> float:
    return math.erf(x / math.sqrt(2))


class Plan(NamedTuple):
    """What decides which pairs are verified."""

    distance: float  # of a pair at the limit
    width: int  # projections of a table
    tables: int
    count: int  # collisions from which a pair is verified


def plan(n: int, least: float = LEAST, lost: float = LOST) -> Plan:
    """For n vectors in the fullest group. Projections of a pair at distance d differ by a normal deviate of that spread."""
    d = math.sqrt(2 - 2 * least)
    steps = np.linspace(0, CELL, 4001)
    density = np.exp(-(steps**2) / 2) * math.sqrt(2 / math.pi)
    together = float(np.sum(density * (1 - steps / CELL)) * (steps[1] - steps[0]))  # a pair at the limit shares a cell
    grid = np.arange(-40, 41) * CELL * d
    cell = lambda at: np.array([(math.erf((x + at + CELL * d) / math.sqrt(2)) - math.erf((x + at) / math.sqrt(2))) / 2 for x in grid])
    stranger = float(np.mean([np.sum(cell(at) ** 2) for at in np.linspace(0, CELL * d, 9)[:-1]]))  # two random vectors do
    width = max(1, math.ceil(math.log(max(n / FILLED, 1)) / -math.log(min(stranger, 0.99))))
    tables = max(1, math.ceil(math.log(lost) / math.log(1 - together**width)))
    hit, tail, count = _normal_within(WINDOW), 0.0, 0
    while count <= COUNTED and (tail := tail + math.comb(COUNTED, count) * hit**count * (1 - hit) ** (COUNTED - count)) <= lost:
        count += 1
    return Plan(d, width, tables, count)


@functools.lru_cache(8)
def directions(dim: int, n: int) -> np.ndarray:
    """(dim, n) random directions, the same wherever they are asked for."""
    return np.random.default_rng([42, dim, n]).standard_normal((dim, n))


def unit(batch: pa.Array) -> list[np.ndarray | None]:
    """Each vector at length one in double precision; None for null, zero or empty ones and for null or non-finite components."""
    out = []
    for v in batch.to_pylist():
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        most = np.abs(x).max(initial=0)
        out.append(x / most / np.linalg.norm(x / most) if np.isfinite(x).all() and most > 0 else None)
    return out


def _cells(p: Plan):
    """Of (node, grp, weight, embedding): (node, grp, weight, unit, cells: a number for each table); rows without a
    direction are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = unit(batch.column(3))
            ok = [i for i, x in enumerate(found) if x is not None]
            cells = np.zeros((len(ok), p.tables), np.int64)
            for dim in {len(found[i]) for i in ok}:
                at = [k for k, i in enumerate(ok) if len(found[i]) == dim]
                places = np.stack([found[ok[k]] for k in at]) @ directions(dim, p.width * p.tables) / (CELL * p.distance)
                places = np.floor(places + np.random.default_rng([43, dim]).random(places.shape[1])).astype(np.int64).reshape(len(at), p.tables, p.width)
                key = np.full((len(at), p.tables), dim, np.int64)
                for k in range(p.width):
                    key = (key ^ (key >> 29)) * np.int64(-7046029254386353131) + places[:, :, k]
                cells[at] = key
            take = pa.array(ok, pa.int64())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array([found[i].tolist() for i in ok], pa.list_(pa.float64())), pa.array(cells.tolist(), pa.list_(pa.int64()))], names=["node", "grp", "weight", "unit", "cells"])

    return work


def close_pairs(x: np.ndarray, y: np.ndarray, p: Plan, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) with a cosine of `least` or more, among those whose windows collide often enough."""
    of = directions(x.shape[1] + 1, COUNTED)[:-1]  # not those of the tables
    a, b = (x @ of).astype(np.float32), (y @ of).astype(np.float32)
    half = np.float32(WINDOW * p.distance)
    first = 12
    misses = np.zeros((len(x), len(y)), np.uint8)
    for k in range(first):
        at = np.argsort(b[:, k])  # windows are stretches of the sorted projection
        lo, hi = np.searchsorted(b[at, k], a[:, k] - half), np.searchsorted(b[at, k], a[:, k] + half, "right")
        place = np.empty(len(at), np.int32)
        place[at] = np.arange(len(at))
        misses += (place < lo[:, None]) | (place >= hi[:, None])
    i, j = np.nonzero(misses <= COUNTED - p.count)
    n = misses[i, j]
    for k in range(first, COUNTED):
        n = n + (np.abs(a[i, k] - b[j, k]) > half)
        ok = n <= COUNTED - p.count
        i, j, n = i[ok], j[ok], n[ok]
    ok = np.concatenate([np.einsum("nd,nd->n", x[i[s : s + 65536]], y[j[s : s + 65536]]) >= least for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    return i[ok], j[ok]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Which of the edges (a, b) between n things make a spanning forest."""
    parent, out = list(range(n)), []

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(k)
    return out


LINKS = "kind int, a long, b long, n long"  # kind 0: node a has n links more; 1: an edge (a, b) of a spanning forest


def _links(rows: pa.Table, table: int, p: Plan, least: float, part: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Links within a cell of `table` whose ends share no cell of an earlier table; across two chunks, if `part` says so."""
    node, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
    x = np.stack(rows["unit"].to_numpy())
    cells = np.stack(rows["cells"].to_numpy())[:, :table]
    a, b = (np.arange(len(node)),) * 2 if part is None else (np.flatnonzero(part == part[0]), np.flatnonzero(part != part[0]))
    if not len(b):
        return
    i, j = close_pairs(x[a], x[b], p, least)
    i, j = a[i], b[j]
    ok = (i < j) if part is None else np.ones(len(i), bool)
    i, j = i[ok], j[ok]
    for k in range(table):
        ok = cells[i, k] != cells[j, k]
        i, j = i[ok], j[ok]
    if len(i):
        n = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
        at, edges = np.flatnonzero(n), _forest(i, j, len(node))
        zero = np.zeros(len(at), np.int64)
        yield pa.record_batch([zero.astype(np.int32), node[at], zero, n[at].astype(np.int64)], names=["kind", "a", "b", "n"])
        yield pa.record_batch([np.ones(len(edges), np.int32), node[i[edges]], node[j[edges]], np.zeros(len(edges), np.int64)], names=["kind", "a", "b", "n"])


def _in_cells(p: Plan, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, _, _ in runs(batches, lambda t: [t[c].to_numpy() for c in ("grp", "tab", "cell")]):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                if e - s > 1:
                    yield from _links(part := rows.slice(s, e - s), part["tab"][0].as_py(), p, least)

    return work


def _in_tiles(p: Plan, least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, _, _ in runs(batches, lambda t: [t[c].to_numpy() for c in ("grp", "tab", "cell", "i", "j")]):
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                tile = rows.slice(s, e - s)
                yield from _links(tile, tile["tab"][0].as_py(), p, least, tile["part"].to_numpy() if tile["i"][0] != tile["j"][0] else None)

    return work


def near_duplicates(vectors: DataFrame, least: float = LEAST, lost: float = LOST, most: int = MOST) -> DataFrame:
    """(vec_id, n_links long, component_id long, kept) of every row of vectors (vec_id, embedding, label).

    Rows of equal labels, not null, and equal length link if their cosine, in double precision, is `least` or more; n_links counts
    the other rows that a row links with. component_id is the smallest vec_id that links reach, the row's own included,
    and null if nothing reached has one; kept: whether it is the row's own. Vectors that are null, zero or empty, or hold
    null or non-finite components, link with nothing. Equal vectors of a label are one node, repeated rows and ids included. At
    most about 2 * `lost` of the links right at the limit are missed, fewer of closer ones; none below it is taken.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    key = F.xxhash64("label", "embedding").alias("h")
    rows = rows.select("*", key)
    taking = rows.where("label is not null and size(embedding) > 0")
    nodes = cut(taking.groupBy("h", "label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()))
    fullest = nodes.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 1
    p = plan(fullest, least, lost)
    units = cut(nodes.select("node", F.xxhash64("label").alias("grp"), "weight", "embedding").mapInArrow(_cells(p), "node long, grp long, weight long, unit array<double>, cells array<long>"))
    order = ["grp", "tab", "cell"]
    cells = units.select("grp", F.posexplode("cells").alias("tab", "cell"))
    full = cells.groupBy(*order).count().where(F.col("count") > most).select(*order, F.ceil(F.col("count") / most).alias("chunks"))
    dealt = join_small(units.select("node", "grp", "weight", "unit", "cells", F.posexplode("cells").alias("tab", "cell")), full, order, "left")
    small = dealt.where("chunks is null").drop("chunks").repartition(*order).sortWithinPartitions(*order).mapInArrow(_in_cells(p, least), LINKS)
    large = dealt.where("chunks is not null").withColumn("part", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    large = large.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("chunks", "other")
    order += ["i", "j"]
    large = large.repartition(*order).sortWithinPartitions(*order).mapInArrow(_in_tiles(p, least), LINKS)
    found = cut(small.unionByName(large))
    linked = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    valid = units.select("node").withColumn("valid", F.lit(True))
    ends = connected_components(found.where("kind = 1").select("a", "b"))
    both = nodes.join(valid, "node", "left").join(linked, "node", "left").join(ends, "node", "left").withColumn("root", F.coalesce("root", "node"))
    both = cut(both.select("h", "label", "embedding", "least_id", "root", F.when(F.col("valid"), F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n")))
    smallest = both.groupBy("root").agg(F.min("least_id").alias("component"))
    said = both.join(smallest, "root").select("h", F.col("label").alias("label_"), F.col("embedding").alias("embedding_"), "n", "component")
    own = F.col("n").isNull()  # not a node, or one without a direction
    out = rows.join(said, (rows["h"] == said["h"]) & (rows["label"] == said["label_"]) & (rows["embedding"] == said["embedding_"]), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(own, F.col("vec_id")).otherwise(F.col("component")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
