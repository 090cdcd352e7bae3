"""Pairs of likely similar things: bands of minima of hashed features, which the caller verifies.

Two sets of Jaccard similarity s share a band of `rows` minima with probability s ** rows, and some of `bands` bands with
1 - (1 - s ** rows) ** bands. Members of short runs of equal keys are paired, each pair once; long runs are searched
breadth first in tiles of bounded size, so that a group of similar members never makes all its pairs.
"""

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .hamming import begins, runs, tiles

PAIRED = 16  # members of a run that are paired outright
KEY = (1 << 48) - 1  # the bits of a key that must agree; those above say the size
DEALT, BUCKET, HELD = 1 << 19, 1 << 19, 1 << 22  # keys that a task packs at a time; of a bucket, about; that are held until long runs leave
STEP = 1.01  # between sizes that are told apart
FOUND = pa.schema([("key", pa.int64()), ("chunk", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose high bits depend on all bits of h (uint64)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def band_keys(features: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The int32 key of each band, for each stretch of features (mixed, uint64) that begins at starts; none may be empty."""
    r = np.random.default_rng(42)
    x = (features >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), bands), np.int32)
    for k in range(bands):
        key = np.zeros(len(starts), np.uint64)
        for flip, factor in r.integers(0, 1 << 32, (rows, 2), np.uint32):
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((x ^ flip) * (factor | np.uint32(1)), starts)
        out[:, k] = (mixed(key) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def sized(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(things, bands) keys as candidates() takes them: band number, key and size of the thing in a long."""
    code = np.log(np.maximum(sizes, 1)) / np.log(STEP)
    return (keys.astype(np.int64) & 0xFFFFFFFF) | np.arange(keys.shape[1]) << 32 | code.astype(np.int64)[:, None] << 48


def _dealt(entries: Callable, buckets: int):
    """(bucket, keys, ids): what entries(batch) has, (keys, ids) of longs, packed into a row for each bucket, time and again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*held))
            at = (mixed((keys & KEY).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            starts = begins([at := at[order]])
            edges = pa.py_buffer((8 * np.append(starts, len(at))).astype(np.int32).tobytes())
            packed = [pa.Array.from_buffers(pa.binary(), len(starts), [None, edges, pa.py_buffer(x[order].tobytes())]) for x in (keys, ids)]
            return pa.record_batch([at[starts], *packed], names=["bucket", "keys", "ids"])

        for batch in batches:
            held.append(entries(batch))
            size += len(held[-1][0])
            if size > DEALT:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return work


def _found(most: int, least: float, bound: int = HELD):
    """Of (bucket, keys, ids) sorted by bucket: pairs of sizes of a ratio of `least` or more (chunk = -1), and the members of long
    runs (id in a), of those over `most` in chunks. One bucket is held; beyond `bound`, the members of its long runs leave first."""
    apart = int(np.log(1 / least) / np.log(STEP)) + 2

    def rows_of(key, chunk, a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.record_batch([np.asarray(key, np.int64), np.broadcast_to(np.int32(chunk), n), np.asarray(a, np.int64), np.asarray(b, np.int64)], schema=FOUND)

    def chunks(key: int, members: np.ndarray, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(members), most):
            some = members[k : k + most]
            yield rows_of(np.full(len(some), key), hot.get(key, 0), some, np.zeros(len(some)))
            hot[key] = hot.get(key, 0) + 1

    def paired(keys: np.ndarray, ids: np.ndarray, hot: dict[int, int]) -> Iterator[pa.RecordBatch]:
        keys, ids, starts = in_runs(keys, ids, hot)
        key, size = keys & KEY, keys >> 48
        sizes = np.diff(np.append(starts, len(ids)))
        long = sizes > most
        if hot:
            long |= np.isin(key[starts], list(hot))
        for s, n in zip(starts[long].tolist(), sizes[long].tolist()):
            yield from chunks(int(key[s]), ids[s : s + n], hot)
        run = np.repeat(np.arange(len(starts)), sizes)
        short = (sizes <= PAIRED) & ~long
        for step in range(1, int(sizes[short].max(initial=1))):  # all pairs that are `step` apart, of all short runs at once
            i = np.flatnonzero((run[:-step] == run[step:]) & short[run[step:]] & (np.abs(size[:-step] - size[step:]) <= apart))
            yield rows_of(np.zeros(len(i)), -1, np.minimum(ids[i], ids[i + step]), np.maximum(ids[i], ids[i + step]))
        if len(i := np.flatnonzero((~short & ~long)[run])):
            yield rows_of(key[i], 0, ids[i], np.zeros(len(i)))

    def in_runs(keys: np.ndarray, ids: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those whose key others have, too, or that is hot, each once, sorted by key and id; and where each key begins."""
        order = np.argsort(key := keys & KEY)
        same = np.diff(key[order]) == 0
        some = np.append(same, False) | np.append(False, same)
        if hot:
            some |= np.isin(key[order], list(hot))
        order = order[some]
        order = order[np.lexsort((ids[order], key[order]))]
        keys, ids, key = keys[order], ids[order], key[order]
        if not len(keys):
            return keys, ids, np.empty(0, np.int64)
        once = begins([key, ids])
        return keys[once], ids[once], begins([key[once]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, size, hot, limit = [], None, 0, {}, bound
        for batch in batches:
            for bucket, keys, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield from paired(*(np.concatenate(x) for x in zip(*held)), hot)
                    held, size, hot, limit = [], 0, {}, bound
                now = bucket
                held.append((np.frombuffer(keys, np.int64), np.frombuffer(ids, np.int64)))
                size += len(held[-1][0])
                if size > limit:
                    keys, ids = (np.concatenate(x) for x in zip(*held))
                    order = np.lexsort((ids, key := keys & KEY))
                    order = order[begins([key[order], ids[order]])]  # each once
                    keys, ids, key = keys[order], ids[order], key[order]
                    starts = begins([key])
                    sizes = np.diff(np.append(starts, len(key)))
                    over = (sizes > most) | np.isin(key[starts], list(hot))
                    for s, n in zip(starts[over].tolist(), sizes[over].tolist()):
                        yield from chunks(int(key[s]), ids[s : s + n], hot)
                    rest = ~np.repeat(over, sizes)
                    held, size = [(keys[rest], ids[rest])], int(rest.sum())
                    limit = max(bound, 2 * size)
        if held:
            yield from paired(*(np.concatenate(x) for x in zip(*held)), hot)

    return work


def candidates(rows: DataFrame, entries: Callable, n: int, most: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Of rows that entries(batch) makes (keys, ids) of, long arrays of some n in all, with keys of sized(), which may repeat: pairs
    (a, b) whose sizes have a ratio of `least` or more, and tiles (key, i, j, id) of runs of many members.

    Keys and ids are dealt out packed, so many to a bucket (BUCKET, about) as a task sorts at once."""
    dealt = rows.mapInArrow(_dealt(entries, max(64, n // BUCKET)), "bucket int, keys binary, ids binary").repartition("bucket").sortWithinPartitions("bucket")
    found = cut(dealt.mapInArrow(_found(most, least), "key long, chunk int, a long, b long"))
    over = found.where("chunk >= 0").select("key", "chunk", F.col("a").alias("id")).distinct()
    return cut(found.where("chunk < 0").select("a", "b").distinct()), tiles(over)


class Known:
    """What a task has found out so far: which nodes are connected, and which pairs aren't linked."""

    MOST = 300_000  # of either that is remembered

    def __init__(self):
        self.parent, self.apart = {}, set()

    def root(self, x):
        parent, at = self.parent, x
        while (up := parent.get(at, at)) != at:
            at = up
        while x != at:
            parent[x], x = at, parent.get(x, x)
        return at

    def link(self, x, y) -> None:
        self.parent[self.root(x)] = self.root(y)

    def ask(self, pairs: list[tuple], bodies: dict, linked: Callable) -> dict:
        """Whether linked() links each of those pairs (x <= y) that aren't known to be apart; a pair is asked once."""
        pairs = [p for p in dict.fromkeys(pairs) if p not in self.apart]
        out = dict(zip(pairs, linked([bodies[x] for x, _ in pairs], [bodies[y] for _, y in pairs]))) if pairs else {}
        self.apart.update(p for p, ok in out.items() if not ok)
        return out

    def forget(self) -> None:
        if len(self.apart) > self.MOST:
            self.apart.clear()
        if len(self.parent) > self.MOST:
            self.parent.clear()


def _verify_pairs(linked: Callable):
    """A spanning forest of the verified links among the pairs of rows (first, id, mates, node, body) sorted by first: a row's node
    pairs with those of its mates, ids of the same first. Ids may have several nodes. What is connected already isn't compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for rows, _, _, _ in runs(batches, lambda t: [t["first"].to_numpy()]):
            node = rows["node"].to_pylist()
            bodies, of, edges = dict(zip(node, rows["body"].to_pylist())), defaultdict(list), []
            places = list(zip(rows["first"].to_pylist(), rows["id"].to_pylist()))
            for place, x in zip(places, node):
                of[place].append(x)
            open_ = [(x, y) for (first, _), y, mates in zip(places, node, rows["mates"].to_pylist()) for m in mates for x in of[first, m]]
            while open_:
                hoped, asked, later = Known(), [], []  # a forest of what may be linked; if it is, the others needn't be compared
                for x, y in open_:
                    a, b = known.root(x), known.root(y)
                    if a != b:
                        if hoped.root(a) != hoped.root(b):
                            hoped.link(a, b)
                            asked.append((x, y))
                        else:
                            later.append((x, y))
                if asked:
                    said = linked([bodies[x] for x, _ in asked], [bodies[y] for _, y in asked])
                    for p in [p for p, ok in zip(asked, said) if ok]:
                        known.link(*p)
                        edges.append(p)
                open_ = later
            known.forget()
            if edges:
                yield pa.record_batch([pa.array([p[k] for p in edges], rows["node"].type) for k in (0, 1)], names=["a", "b"])

    return work


def _verify_tiles(linked: Callable):
    """A spanning forest of the verified links of the tiles. Tiles of other bands hold much the same members: what a task has
    found connected isn't compared again, nor what it has found apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for rows, starts, _, _ in runs(batches, lambda t: [t[k].to_numpy() for k in ("key", "i", "j")]):
            node = rows["node"].to_pylist()
            bodies = dict(zip(node, rows["body"].to_pylist()))
            edges = []
            tiles = [([m[0]], m[1:]) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]) if (m := list(dict.fromkeys(node[s:e])))]
            while tiles := [t for t in tiles if t[1]]:  # breadth first in all tiles at once: a member of each against the rest
                asked = []
                for k, (queue, rest) in enumerate(tiles):
                    x, root = queue.pop(), known.root
                    of = root(x)
                    queue += [y for y in rest if root(y) == of]
                    rest = [y for y in rest if root(y) != of]
                    tiles[k] = queue, rest
                    asked.append([(x, y) if x < y else (y, x) for y in rest])
                said = known.ask([p for pairs in asked for p in pairs], bodies, linked)
                for k, ((queue, rest), pairs) in enumerate(zip(tiles, asked)):
                    ok = [said.get(p, False) for p in pairs]
                    for p, is_ in zip(pairs, ok):
                        if is_ and known.root(p[0]) != known.root(p[1]):
                            known.link(*p)
                            edges.append(p)
                    queue += [y for y, is_ in zip(rest, ok) if is_]
                    rest = [y for y, is_ in zip(rest, ok) if not is_]
                    if not queue and rest:
                        queue.append(rest.pop(0))
                    tiles[k] = queue, rest
            known.forget()
            if edges:
                yield pa.record_batch([pa.array([p[k] for p in edges], rows["node"].type) for k in (0, 1)], names=["a", "b"])

    return work


def verified(pairs: DataFrame, tiled: DataFrame, content: DataFrame, linked: Callable, kind: str) -> DataFrame:
    """Edges (a, b) between nodes of content (id, node, body) whose connected groups are those of all candidates that
    linked(bodies, bodies) links: it says so of each pair. kind: the SQL type of node.

    Pairs (a < b, each once; an id has no more than some hundreds) meet by the least mate of b, where a body comes once for all its pairs."""
    schema = f"a {kind}, b {kind}"
    mates = pairs.groupBy("b").agg(F.collect_list("a").alias("mates")).withColumn("first", F.array_min("mates"))  # like members have the same first
    rows = mates.select("first", F.col("b").alias("id"), "mates").unionByName(mates.select("first", F.explode("mates").alias("id"), F.lit(None).cast("array<bigint>").alias("mates")))
    rows = rows.groupBy("first", "id").agg(F.flatten(F.collect_list("mates")).alias("mates"))
    two = rows.join(content, "id").select("first", "id", "mates", "node", "body").repartition("first").sortWithinPartitions("first").mapInArrow(_verify_pairs(linked), schema)
    first = F.min("id").over(Window.partitionBy("key", "i", "j")).alias("first")  # tiles of like members go to one task
    many = tiled.select("*", first).join(content, "id").select("first", "key", "i", "j", "node", "body").repartition("first").sortWithinPartitions("first", "key", "i", "j", "node")
    return two.unionByName(many.mapInArrow(_verify_tiles(linked), schema))
