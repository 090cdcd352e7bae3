"""SimHash near-duplicates, decided with pivot distance tables.

A document's fingerprint is the majority vote of the XXH64 values (seed 42) of its word shingles. Documents whose
fingerprints differ in `radius` bits or fewer are linked, and every document gets the smallest doc_id of its group.
Distances to random reference fingerprints crowd around 32 of 64 bits, so pivots alone would leave a constant share
of all pairs; block keys bring close fingerprints together first, and the pivot table discards within each run.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, texts
from .hamming import close_forest
from .minhash import band_keys, candidates, mixed, sized, verified

SEED = 42
ROWS = 6  # of minima that agree in a band, in drop_similar


def majority(hashes: np.ndarray, starts: np.ndarray, slice_rows: int = 1 << 17) -> np.ndarray:
    """The fingerprint of each stretch of hashes (uint64) that begins at starts; none may be empty."""
    sizes = np.diff(np.append(starts, len(hashes)))
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + slice_rows)))
        lo, hi = starts[i], starts[j] if j < len(starts) else len(hashes)
        if j == i + 1 and hi - lo > slice_rows:  # one long text: add up slice by slice
            votes = sum(_bits(hashes[k : min(k + slice_rows, hi)]).sum(axis=0, dtype=np.int64) for k in range(lo, hi, slice_rows))[None]
        else:
            votes = np.add.reduceat(_bits(hashes[lo:hi]), starts[i:j] - lo, axis=0, dtype=np.int32)
        won = votes * 2 > sizes[i:j, None]
        out[i:j] = np.packbits(won.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
        i = j
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each shingle of `words` words, lower-cased in A-Z; of the whole sequence if it has fewer; none if none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not w:
        return []
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    line = b" ".join(w)
    begin = np.cumsum([0, *[len(x) + 1 for x in w]]).tolist()
    h, n = xxhash.xxh64_intdigest, len(w) - words
    return [h(line[a : b - 1], SEED) for a, b in zip(begin[: n + 1], begin[words:])]


def _fingerprint(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.zeros(batch.num_rows, np.uint64)
            hashes, starts, at = [], [], []
            total = 0

            def flush():
                if at:
                    fp[at] = majority(np.concatenate(hashes), np.array(starts))

            for i, text in enumerate(texts(batch)):
                if found := shingle_hashes(text, words):
                    starts.append(total)
                    at.append(i)
                    hashes.append(np.array(found, np.uint64))
                    total += len(found)
                if total > 1 << 19:
                    flush()
                    hashes, starts, at, total = [], [], [], 0
            flush()
            yield pa.record_batch([batch.column(0), fp.view(np.int64)], names=["doc_id", "fp"])

    return work


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row of docs, whole texts. Null or wordless texts have fingerprint zero."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint(words), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int | None = None, most: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text; other columns don't matter).

    component_id: the smallest doc_id that can be reached by links of at most `radius` differing bits. Equal
    fingerprints are one node, so copies never make pairs. Rows without words are linked with each other. Rows
    without doc_id get a fingerprint and their group's id, which is null if nobody in the group has one. Repeated
    rows come back as often as they come in. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(close_forest(nodes, radius, blocks, most))
    joined = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(joined.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id. Rows without doc_id stay (nothing
    tells them apart), and so do all rows that carry the kept doc_id."""
    gone = near_duplicates(docs, words, radius).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def _sets(words: int, bands: int):
    """(doc_id, row, id, keys) of rows (doc_id, row, text): id is of the set of shingles, keys of its bands of minima."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sets, at, size = [], [[]] * batch.num_rows, [], [], 0

            def fill() -> None:  # the keys of all sets that are held, at once: a call costs as much for one short text
                n = np.array([len(x) for x in sets])
                found = sized(band_keys(mixed(np.concatenate(sets)), np.cumsum(n) - n, bands, ROWS), n)
                for i, k in zip(at, found.tolist()):
                    keys[i] = k

            for i, text in enumerate(texts(batch)):
                found = np.unique(np.array(shingle_hashes(text, words), np.uint64))
                ids.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
                if len(found):
                    sets.append(found)
                    at.append(i)
                    size += len(found)
                if size > 1 << 17:
                    fill()
                    sets, at, size = [], [], 0
            if sets:
                fill()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(keys, schema.field("keys").type)], schema=schema)

    return work


def _bands(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ids) of rows (id, keys)."""
    keys = batch.column(1)
    return keys.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), keys.value_lengths().to_numpy())


def _bodies(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).tobytes() for t in texts(batch)]
            yield pa.record_batch([batch.column(0), batch.column(0), pa.array(bodies, pa.binary())], names=["id", "node", "body"])

    return work


def jaccard_pairs(least: float):
    """linked(bodies, bodies): of each pair of sets (sorted hashes, as bytes), whether the Jaccard similarity reaches least."""

    def reaches(x: bytes, y: bytes) -> bool:
        if min(len(x), len(y)) < least * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        return both >= least * ((len(x) + len(y)) // 8 - both) - 1e-9

    return lambda xs, ys: [reaches(x, y) for x, y in zip(xs, ys)]


def drop_similar(docs: DataFrame, words: int = 5, least: float = 0.8, bands: int = 24, most: int = 256, radius: int | None = None) -> DataFrame:
    """docs with one document of each group, as drop_near_duplicates; linked are documents whose sets of shingles of `words`
    words have a Jaccard similarity of `least` or more, verified exactly. Candidates meet in one of `bands` bands of
    ROWS minima: at 0.8, all but one in a thousand do. most: documents that one task compares at a time. radius: with it, linked are
    also the documents of one group of near_duplicates() at that radius, so that a group holds what either method links."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("string").alias("text"))
    rows = cut(keyed.mapInArrow(_sets(words, bands), "doc_id long, row long, id long, keys array<long>"))
    nodes = cut(rows.groupBy("id").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")))
    pairs, tiled = candidates(rows.where("size(keys) > 0").select("id", "keys"), _bands, bands * rows.count(), most, least)
    every = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(tiled.select("id")).distinct()
    text = keyed.join(nodes.join(every, "id").select("id", "row"), "row").dropDuplicates(["id"]).select("id", "text")
    content = cut(text.mapInArrow(_bodies(words), "id long, node long, body binary"))
    edges = verified(pairs, tiled, content, jaccard_pairs(least), "long")
    if radius is not None:
        near = near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text"), radius=radius).select(F.col("doc_id").alias("row"), "component_id").distinct()
        of = cut(rows.select("row", "id").distinct().join(near, "row").select("component_id", F.col("id").alias("a")).distinct())
        edges = edges.unionByName(of.join(of.groupBy("component_id").agg(F.min("a").alias("b")), "component_id").where("a <> b").select("a", "b"))
    parts = connected_components(edges)
    joined = nodes.join(parts, nodes.id == parts.node, "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    kept = joined.groupBy("root").agg(F.min("least").alias("kept"))
    gone = rows.join(joined.join(kept, "root").select("id", "kept"), "id").where("doc_id <> kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
