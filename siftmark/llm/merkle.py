"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line, its node the SHA-256 of its text. A section ends after a paragraph whose node has its lowest
three bits unset, so that inserted paragraphs shift no later section; its node hashes its paragraphs'. The root
hashes the sections and is the printed fingerprint: equal roots mean equal texts. Below a paragraph hang hashes of
its pieces (sentences, cut at 48 characters), so that likeness and edits show inside long paragraphs too.
Comparison goes down differing branches only.
"""

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = re.compile(r"[^.!?]{1,48}[.!?]*|[.!?]+")
LOWEST = -(1 << 63)
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16  # rows of a bucket, about; a bucket is streamed, so more only take longer


class Tree(NamedTuple):
    root: bytes
    sections: list[bytes]
    spans: list[tuple[int, int]]  # of each section: its paragraphs, from and to
    paragraphs: list[bytes]
    texts: list[str]


def _sha(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()


def grow(text: str) -> Tree:
    """The tree of a whole text; an empty one has one empty paragraph."""
    lines = text.split("\n")
    nodes = [_sha(x.encode("utf-8", "surrogatepass")) for x in lines]
    sections, spans, begin = [], [], 0
    for i, node in enumerate(nodes, 1):
        if not node[-1] & 7 or i == len(nodes):
            sections.append(_sha(b"".join(nodes[begin:i])))
            spans.append((begin, i))
            begin = i
    return Tree(_sha(b"".join(sections)), sections, spans, nodes, lines)


def _rest(a: list, b: list) -> tuple[list[int], list[int]]:
    """What of a and of b (by place) is left when equal members are paired off."""
    have = Counter(b)
    left = []
    for i, x in enumerate(a):
        if have[x] > 0:
            have[x] -= 1
        else:
            left.append(i)
    right = []
    for j in range(len(b) - 1, -1, -1):  # the later ones of equal members are left over
        if have[b[j]] > 0:
            have[b[j]] -= 1
            right.append(j)
    return left, right[::-1]


def _pieces(lines: list[str]) -> list[int]:
    h = xxhash.xxh3_64_intdigest
    return [h(p) for x in lines for p in PIECE.findall(x)]


def _size(lines: list[str]) -> int:
    return sum(len(PIECE.findall(x)) for x in lines)


def compare(a: Tree, b: Tree, size_a: int, size_b: int) -> tuple[float, list[int]]:
    """(likeness from 0 to 1, the paragraphs of a that b lacks). size_a, size_b: pieces of the whole texts.

    Likeness is twice the pieces in common over the pieces of both. Equal sections, then equal paragraphs, are
    paired off whole; only the pieces of what is left are compared.
    """
    if a.root == b.root:
        return 1.0, []
    if not size_a + size_b:  # they differ in blank paragraphs only
        return 0.0, list(range(len(a.paragraphs)))
    left, right = _rest(a.sections, b.sections)
    pa_, pb = [i for k in left for i in range(*a.spans[k])], [i for k in right for i in range(*b.spans[k])]
    left, right = _rest([a.paragraphs[i] for i in pa_], [b.paragraphs[i] for i in pb])
    changed = [pa_[i] for i in left]
    mine, other = _pieces([a.texts[i] for i in changed]), _pieces([b.texts[pb[j]] for j in right])
    lost = len(_rest(mine, other)[0])
    return 2 * (size_a - lost) / (size_a + size_b), changed


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds (2**k - 1 of them) are at most the key, by binary search."""
    steps = [(len(bounds) + 1) >> i for i in range(1, (len(bounds) + 1).bit_length())]
    listed = F.lit(bounds).cast("array<long>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.element_at(listed, at + step) <= key, at + step).otherwise(at))


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, extra, key, doc_id, text) sorted within its partitions, each bucket a stretch of ascending doc_id.

    After each bucket's rows comes, with extra = 1, the first row of the next one (after the last: of the first), so
    every row's follower is at hand. Bounds of the buckets are quantiles; they and the buckets' first ids, as many
    as there are buckets, are all that reaches the driver. Texts are shuffled once. Null ids come first.
    """
    spark = docs.sparkSession
    n = buckets or min(MOST_BUCKETS, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // BUCKET_ROWS))
    n = 1 << max(1, (n - 1).bit_length())
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0]
    if at is None:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("extra"), "key", "doc_id", "text")
    bucket = _rank(F.col("key"), list(at))
    firsts = sorted((r["bucket"], r["first"]) for r in rows.groupBy(bucket.alias("bucket")).agg(F.min("key").alias("first")).collect())
    before = [(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)]
    before = spark.createDataFrame(before, "bucket int, first long")
    extra = rows.join(F.broadcast(before), F.col("key") == F.col("first")).select("bucket", F.lit(1).alias("extra"), "key", "doc_id", "text")
    whole = rows.select(bucket.alias("bucket"), F.lit(0).alias("extra"), "key", "doc_id", "text").unionByName(extra)
    return whole.repartition("bucket").sortWithinPartitions("bucket", "extra", "key", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed array<int>"


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((k, pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("changed", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for bucket, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if extra and (held is None or held[1]):
                continue  # a further row with the next bucket's first id
            tree, size = grow(text), _size(text.split("\n"))
            if held is not None and held[0] == bucket and not held[1]:
                _, _, last_id, last, last_tree, last_size = held
                new = edited(last, text)
                new_tree = grow(new)
                near, changed = compare(last_tree, new_tree, last_size, _size(new_tree.texts))
                near_next, _ = compare(last_tree, tree, last_size, size)
                out.append({"doc_id": last_id, "n_chars": len(last), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": last_tree.root.hex(), "edited_fingerprint": new_tree.root.hex(), "near_edited": near, "near_next": near_next, "changed": changed})
            held = (bucket, extra, doc_id, text, tree, size)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def against_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) with its fingerprint, that of its edited text, and their likeness.

    The edit puts the beginning of the next document (ascending doc_id; of equal ids by text) in place of the
    second half. changed: the paragraphs of the text, from 0, that the edited one lacks. Null texts count as empty. Rows
    without doc_id come first. A lone document follows itself. Repeated rows follow each other.
    """
    return in_order(docs, buckets).mapInArrow(_work, OUT)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [grow(x or "") for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([t.root.hex() for t in trees], pa.string()), pa.array([[s.hex() for s in t.sections] for t in trees], pa.list_(pa.string())), pa.array([[p.hex() for p in t.paragraphs] for t in trees], pa.list_(pa.string()))], names=["doc_id", "fingerprint", "sections", "paragraphs"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, sections, paragraphs) of every row of docs: the root and the nodes below it, in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_roots, "doc_id long, fingerprint string, sections array<string>, paragraphs array<string>")
