"""Pairs of 64-bit fingerprints that differ in few bits: block keys, pivot distance tables, bounded tiles.

Fingerprints within `radius` bits agree on all but `radius` of any `blocks` disjoint blocks of bits, so each is
dealt out once for every choice of `blocks - radius` blocks, and close ones meet in one run of equal keys.
Within a run the pivot table decides: every fingerprint carries its Hamming distances to reference fingerprints,
and a pair one of whose coordinates differs by more than `radius` is discarded (triangle inequality); survivors
are verified on the fingerprints. Runs are streamed; one longer than `tile` rows is dealt anew as pairs of chunks.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

PIVOTS = 16


def pivots(n: int = PIVOTS) -> list[int]:
    """n reference fingerprints (unsigned), the same in each session: SplitMix64 from a fixed start."""
    out, x, full = [], 42, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & full
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append(z ^ (z >> 31))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(blocks: int, radius: int) -> list[int]:
    """The bits that each key takes: one mask for every choice of blocks - radius of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose keys have about as many values as there are fingerprints; each number of blocks finds
    the same pairs, fewer make fewer rows and longer runs."""
    blocks = radius + 1
    while 64 * (blocks - radius) / blocks < np.log2(max(2, n)) and blocks < radius + 5:
        blocks += 1
    return blocks


def pivot_table(fp: Column, n: int = PIVOTS) -> list[Column]:
    """Columns pivot0.. of eight distances each, packed in a long, lowest byte first."""
    out = []
    for k in range(0, n, 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(pivots(n)[k : k + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))).cast("long"), 8 * i))
        out.append(packed.alias(f"pivot{k // 8}"))
    return out


def by_pivots(table: np.ndarray, x: int, among: np.ndarray, radius: int) -> np.ndarray:
    """Those of `among` none of whose coordinates differs from x's by more than radius."""
    for row in table:
        if not len(among):
            break
        at = row[among]
        among = among[np.abs(at - row[x]) <= radius]
    return among


def forest(fp: np.ndarray, table: np.ndarray, radius: int, linked: Callable | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the close pairs: breadth first, so that no group emits all its pairs.

    table: a row of distances for each pivot. linked(i, js) may narrow the close ones down to verified ones.
    """
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = by_pivots(table, x, rest, radius)
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= radius]
            if linked is not None and len(near):
                near = linked(x, near)
            if len(near):
                out += [(x, int(y)) for y in near]
                queue += near.tolist()
                rest = rest[~np.isin(rest, near, assume_unique=True)]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: Callable[[pa.Table], list[np.ndarray]], most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray, int, bool]]:
    """Whole runs of equal keys of sorted rows: (rows, where each run begins, chunk, cut).

    A run over `most` rows comes in chunks of that many, numbered from 0, each alone and marked as cut.
    """
    held: pa.Table | None = None
    chunk = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        starts = begins(keys(held))
        if chunk and len(starts) > 1:  # the rest of a cut run
            yield held.slice(0, starts[1]), np.array([0]), chunk, True
            held, starts, chunk = held.slice(starts[1]), starts[1:] - starts[1], 0
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1], 0, False
            held = held.slice(starts[-1])
        while most and held.num_rows > most:
            yield held.slice(0, most), np.array([0]), chunk, True
            held, chunk = held.slice(most), chunk + 1
        held = held.combine_chunks()
    if held is not None and held.num_rows:
        yield held, np.array([0]), chunk, bool(chunk)


def begins(columns: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _table(rows: pa.Table) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(rows["pivot%d" % k].to_numpy()).view(np.uint8).reshape(-1, 8).T for k in range(PIVOTS // 8)]).astype(np.int16)


EDGES = pa.schema([("c", pa.int32()), ("chunk", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _first_runs(radius: int, masked: list[int], most: int):
    """Of rows (c, fp, pivots) sorted by key: edges (c = -1), and the rows of runs over `most` (their c and chunk)."""
    values = np.array(masked, np.uint64)

    def edges(a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.record_batch([np.full(n, -1, np.int32), np.zeros(n, np.int32), np.asarray(a, np.int64), np.asarray(b, np.int64)], schema=EDGES)

    def keys(t: pa.Table) -> list[np.ndarray]:
        c = t["c"].to_numpy()
        return [c, t["fp"].to_numpy().view(np.uint64) & values[c]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, chunk, split in runs(batches, keys, most):
            fp = rows["fp"].to_numpy()
            if split:
                n = len(fp)
                yield pa.record_batch([rows["c"].to_numpy(), np.full(n, chunk, np.int32), fp, np.zeros(n, np.int64)], schema=EDGES)
                continue
            sizes = np.diff(np.append(starts, len(fp)))
            if not (sizes > 1).any():
                continue
            table, u = _table(rows), fp.view(np.uint64)
            two = starts[sizes == 2]
            two = two[(np.abs(table[:, two] - table[:, two + 1]) <= radius).all(axis=0)]
            two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= radius]
            a, b = [fp[two]], [fp[two + 1]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                if found := forest(u[s : s + n], table[:, s : s + n], radius):
                    pair = np.array(found) + s
                    a.append(fp[pair[:, 0]])
                    b.append(fp[pair[:, 1]])
            if sum(map(len, a)):
                yield edges(np.concatenate(a), np.concatenate(b))

    return work


def _tiles(radius: int):
    """Of rows (key, i, j, fp, pivots) sorted by key and tile: edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, _, _ in runs(batches, lambda t: [t[k].to_numpy() for k in ("key", "i", "j")]):
            fp, table = rows["fp"].to_numpy(), _table(rows)
            for s, e in zip(starts, [*starts[1:], len(fp)]):
                if found := forest(fp[s:e].view(np.uint64), table[:, s:e], radius):
                    pair = np.array(found) + s
                    yield pa.record_batch([fp[pair[:, 0]], fp[pair[:, 1]]], names=["a", "b"])

    return work


def _masked(fp: Column, masked: list[int]) -> Column:
    return fp.bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)) for m in masked]), F.col("c") + 1))


def keyed(fps: DataFrame, masked: list[int]) -> DataFrame:
    """(c, fp) of each fingerprint for each mask c, dealt out and sorted so that equal keys are next to each other."""
    rows = fps.select("fp").withColumn("c", F.explode(F.array(*[F.lit(i) for i in range(len(masked))])))
    key = _masked(F.col("fp"), masked)
    return rows.repartition(F.xxhash64("c", key)).sortWithinPartitions("c", key).select("c", "fp")


def tiles(rows: DataFrame, key: str = "key") -> DataFrame:
    """Rows (key, chunk, ..) once for each pair of chunks i <= j of their key that holds them."""
    last = rows.groupBy(key).agg(F.max("chunk").alias("last"))
    both = rows.join(last, key).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return both.select(*[c for c in both.columns if c not in ("chunk", "other", "last")], F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def close_forest(fps: DataFrame, radius: int = 3, blocks: int | None = None, most: int = 4096) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints `fp` (long) of fps, whose connected groups are those of all
    pairs at Hamming distance `radius` or less. Only a spanning forest of each run is emitted; no link is lost.

    blocks: by default by the number of fingerprints; the groups don't depend on it. most: rows of a run that
    one task holds; longer ones are compared as pairs of chunks. fps is read twice: pass a checkpointed table.
    """
    masked = masks(blocks or blocks_for(fps.count(), radius), radius)
    dealt = keyed(fps, masked).select("c", "fp", *pivot_table(F.col("fp")))
    first = cut(dealt.mapInArrow(_first_runs(radius, masked, most), "c int, chunk int, a long, b long"))
    over = first.where("c >= 0").select("c", "chunk", F.col("a").alias("fp"))
    t = tiles(over.withColumn("key", F.xxhash64("c", _masked(F.col("fp"), masked))))
    t = t.select("key", "i", "j", "fp", *pivot_table(F.col("fp"))).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return first.where("c < 0").select("a", "b").unionByName(t.mapInArrow(_tiles(radius), "a long, b long"))
