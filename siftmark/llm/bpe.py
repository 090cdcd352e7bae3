"""Byte-level BPE, encoded and decoded with numpy.

Distinct pieces of the pre-tokenising pattern are laid out in padded matrices by length. In each round every row
merges its leftmost pair of least rank; pairs are looked up in an open-addressing hash table, and rows that are
done leave the matrix, as do columns that no row needs. The vocabulary is a file of ranks, read once and broadcast.
"""

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, texts

NONE = np.int32(2**31 - 1)
CELLS = 1 << 20  # of a matrix
LONG = 2048  # bytes from which a piece is merged alone
CACHED = 300_000  # pieces that a task remembers


class Vocabulary:
    """Ranks of byte strings, and the table of the pairs of them whose joined bytes have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int32)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):  # all at once; of those that meet in a slot one stays, the rest move on
            free = self.keys[at] == 2**64 - 1
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair joined, NONE for those without; negative ids are padding."""
        keys = left.astype(np.int64).view(np.uint64) << np.uint64(32) | right.astype(np.int64).view(np.uint64)
        out, todo, at = np.full(keys.shape, NONE, np.int32).ravel(), np.flatnonzero((left >= 0) & (right >= 0)), None
        keys = keys.ravel()
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (there != 2**64 - 1)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
            if not len(todo):
                break
        return out.reshape(left.shape)

    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """The ids of each row (padded with -1) after all merges."""
        out: list = [None] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), NONE, np.int32)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            if (done := best == NONE).any():
                sizes = (ids[done] >= 0).sum(axis=1)
                for r, row, n in zip(rows[done].tolist(), ids[done], sizes.tolist()):
                    out[r] = row[:n]
                rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            ids[r, at] = best
            shift = np.arange(ids.shape[1] - 1) > at[:, None]
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            last = np.full((len(rows), 1), NONE, np.int32)
            ranks = np.where(shift[:, :], np.concatenate([ranks[:, 1:], last], 1), ranks)[:, : max(1, ids.shape[1] - 1)]
            width = ids.shape[1]
            right = np.where(at + 1 < width, ids[r, np.minimum(at + 1, width - 1)], -1)
            if width > 1:
                here = at < width - 1
                ranks[r[here], at[here]] = self.pair_ranks(ids[r, at], right)[here]
                before = at > 0
                ranks[r[before], at[before] - 1] = self.pair_ranks(ids[r, np.maximum(at - 1, 0)], ids[r, at])[before]
            else:
                ranks[:] = NONE
            if width > 2 and (ids[:, -1] < 0).all():
                used = max(1, int((ids >= 0).sum(axis=1).max()))
                ids, ranks = ids[:, :used].copy(), ranks[:, : max(1, used - 1)].copy()
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long row: a heap of pairs by rank and place, and links between what is left, so that each merge
        costs the logarithm of the row's length."""
        n = len(ids)
        now = self.pair_ranks(ids[:-1], ids[1:]).tolist() + [int(NONE)]  # of the pair that begins at each place
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(now) if r != NONE]
        heapq.heapify(heap)

        def look_up(i: int) -> None:
            j = after[i]
            now[i] = r = self.ranks.get(self.bytes[ids[i]] + self.bytes[ids[j]], int(NONE)) if j < n else int(NONE)
            if r != NONE:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if now[i] != r:  # merged since
                continue
            j = after[i]
            ids[i], after[i], now[j], ids[j] = r, after[j], int(NONE), -1
            if after[i] < n:
                before[after[i]] = i
            look_up(i)
            if before[i] >= 0:
                look_up(before[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list = [None] * len(raw)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = np.array([rank], np.int32)
            elif len(p) >= LONG:
                out[i] = self.merge_long(self.of_byte[np.frombuffer(p, np.uint8)])
            else:
                sizes.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, members in sizes.items():
            for k in range(0, len(members), step := max(1, CELLS // width)):
                some = members[k : k + step]
                flat = np.frombuffer(b"".join([raw[i].ljust(width, b"\0") for i in some]), np.uint8).reshape(-1, width)
                n = np.array([len(raw[i]) for i in some])
                ids = np.where(np.arange(width) < n[:, None], self.of_byte[flat], np.int32(-1))
                for i, row in zip(some, self.merge_matrix(ids[:, : n.max()].copy())):
                    out[i] = row
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class Encoder:
    """Encodes texts; remembers pieces, up to a bound, after which it begins anew."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.index = Codes()
        self.flat, self.sizes, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, batch: list[str]) -> Iterator[np.ndarray]:
        if len(self.index) > CACHED:
            self.forget()
        index, known, places = self.index, len(self.index), []
        for text in batch:
            places.append(np.array(list(map(index.__getitem__, self.split(text))), np.int64))
        if len(index) > known:
            new = self.vocabulary.encode_pieces(index.newest(len(index) - known))
            self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in new], np.int64)])
            self.flat = np.concatenate([self.flat, *new])
            self.starts = np.cumsum(self.sizes) - self.sizes
        for at in places:
            n = self.sizes[at]
            total = int(n.sum())
            yield self.flat[np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(total)]


def _groups(batch: list[str], chars: int = 1 << 21) -> Iterator[list[str]]:
    group, size = [], 0
    for t in batch:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encode(shared, pattern: str, decoded: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(shared.value), pattern)
        for batch in batches:
            at = 0
            for group in _groups(texts(batch)):
                ids = list(encoder.encode(group))
                columns = [batch.column(0).slice(at, len(group)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array([encoder.vocabulary.decode(x) for x in ids], pa.binary()))
                at += len(group)
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return work


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids binary [, decoded binary]) of every row of docs (doc_id, text): whole texts.

    ids: little-endian unsigned 32-bit integers; pieces() turns them into an array. decoded: the bytes that the ids
    stand for. No special tokens. Null and empty texts have no ids. Repeated rows and rows without doc_id come
    back as they are. A piece of any length is merged whole. No shuffle; the ranks are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(shared, pattern, decoded), "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (doc_id, ids binary) with the text that the ids stand for; null ids are an empty text, bytes that
    aren't UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for batch in batches:
            out = [v.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, text string")
