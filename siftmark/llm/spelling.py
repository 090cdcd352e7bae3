"""Words that are one letter away from a more frequent one.

Words that differ by one inserted, deleted or replaced letter agree in their first or in their last letters, half as
many as the shorter one has; words that do lie next to each other in one of four sorted orders. Stretches of such an
order are indexed in bit slices: for each position and letter a bitset over the words that have it there. All words of a
stretch are looked up at once, a letter at a time: bitsets follow the words that agree so far, and those with one error, by
its kind, which reads the index one position ahead or behind.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hamming import runs, tiles

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SPOILT = 97  # one occurrence in so many loses a letter
LEAST_LETTERS, LEAST_N = 5, 3
RATIO = 2  # how many times as often a word's form occurs
HELD = 400_000  # words that a task adds up before it sends them
STRETCH = 512  # words that are indexed together, at least
MOST = 4096  # words of one key that are indexed together, at most


def _counted(spoilt: int, letters: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % spoilt == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= letters:
                        found[run] += n
                if len(found) > HELD:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return work


def words(docs: DataFrame, spoilt: int = SPOILT, letters: int = LEAST_LETTERS, least: int = LEAST_N) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of Latin letters, A-Z lower-cased, of `letters` letters and `least` occurrences
    or more. Of runs whose crc32 with their doc_id is divisible by `spoilt` one letter is left out first."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted(spoilt, letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(words, positions) of code points below 256, 0 behind a word's end; and the lengths."""
    raw = [w.encode("latin-1") for w in column.to_pylist()]
    length = np.array([len(w) for w in raw])
    table = np.zeros((len(raw), int(length.max()) + 1), np.uint8)
    table[np.arange(table.shape[1]) < length[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return table, length


def one_error(asked: tuple[np.ndarray, np.ndarray], among: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of asked, row of among) of words one error apart, of which the shorter has `size` letters; all have
    size or size + 1."""
    (q, q_length), (v, v_length) = asked, among
    n, wide = len(v), -(-len(v) // 64)
    alphabet, code = np.unique(q[:, : size + 1], return_inverse=True)
    code = code.reshape(len(q), -1)

    def bitset(rows: np.ndarray) -> np.ndarray:
        """Rows of booleans over the words of `among` as rows of bits."""
        out = np.zeros(rows.shape[:-1] + (wide * 8,), np.uint8)
        packed = np.packbits(rows, axis=-1, bitorder="little")
        out[..., : packed.shape[-1]] = packed
        return out.view(np.uint64)

    def slices(p: int) -> np.ndarray:
        """For each letter of the alphabet the words that have it at position p."""
        return bitset(v[:, p] == alphabet[:, None]) if 0 <= p < v.shape[1] else np.zeros((len(alphabet), wide), np.uint64)

    shape = (len(q), wide)
    exact, extra = np.full(shape, ~np.uint64(0)), np.full(shape, ~np.uint64(0))  # extra: the word of `among` has a letter more
    replaced, missing = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    is_short, is_long = bitset((v_length == size)[None]), bitset((v_length == size + 1)[None])
    behind, here, ahead = slices(-1), slices(0), slices(1)
    short = q_length == size
    hits = np.zeros(shape, np.uint64)
    for p in range(size + 1):
        c = code[:, p]
        same = here[c]
        replaced = (replaced & same) | (exact & ~same)
        missing = (missing & behind[c]) | exact
        exact = exact & same
        extra = (extra & ahead[c]) | exact
        if p == size - 1:
            hits[short] = ((replaced & is_short) | (extra & is_long))[short]
        behind, here, ahead = here, ahead, slices(p + 2)
    hits[~short] = (missing & is_short)[~short]
    row, word = np.divmod(np.flatnonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little").ravel()), wide * 64)
    ok = word < n
    return row[ok], word[ok]


FOUND = "word string, n long, near long, form string, form_n long, size int, from_end boolean, key string, chunk int"


def _summed(word: np.ndarray, n: np.ndarray, q: np.ndarray, v: np.ndarray) -> pa.RecordBatch | None:
    """For each word of pairs (q, v): how many there are, and which v occurs most."""
    if not len(q):
        return None
    order = np.lexsort((word[v], -n[v], q))
    q, v = q[order], v[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    at, best = q[starts], v[starts]
    none = np.zeros(len(at), np.int64)
    return pa.record_batch([pa.array(word[at], pa.string()), none, np.diff(np.append(starts, len(q))), pa.array(word[best], pa.string()), n[best], pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.bool_()), pa.nulls(len(at), pa.string()), np.full(len(at), -1, np.int32)], names=[c.split()[0] for c in FOUND.split(", ")])


def _pairs(rows: pa.Table, run: np.ndarray, size: int, from_end: bool, apart: np.ndarray | None = None) -> pa.RecordBatch | None:
    """What one_error() finds among rows of equal `run`. Pairs that agree in their first letters are found there
    and not counted again from the end; of two chunks (apart) only pairs across them count."""
    letters = _letters(rows["word"])
    q, v = one_error(letters, letters, size)
    ok = run[q] == run[v]
    if apart is not None:
        ok &= apart[q] != apart[v]
    q, v = q[ok], v[ok]
    if from_end:
        first = letters[0][:, : size // 2]
        ok = (first[q] != first[v]).any(1)
        q, v = q[ok], v[ok]
    return _summed(np.array(rows["word"].to_pylist(), object).astype(str), rows["n"].to_numpy(), q, v)


def _found(most: int, stretch: int):
    """Of (size, from_end, key, word, n) in that order: sums of pairs (chunk -1), and the words of keys of more than `most`."""

    def keys(t: pa.Table) -> list[np.ndarray]:
        return [np.asarray(t[c].to_pandas()) for c in ("size", "from_end", "key")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, chunk, split in runs(batches, keys, most):
            if split:
                k = rows.num_rows
                yield pa.record_batch([rows["word"].combine_chunks(), rows["n"].to_numpy(), np.zeros(k, np.int64), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), rows["size"].combine_chunks(), rows["from_end"].combine_chunks(), rows["key"].combine_chunks(), np.full(k, chunk, np.int32)], names=[c.split()[0] for c in FOUND.split(", ")])
                continue
            ends = np.append(starts[1:], rows.num_rows)
            size, from_end = rows["size"].to_numpy(), rows["from_end"].to_numpy()
            kind = size[starts] * 2 + from_end[starts]
            i = 0
            while i < len(starts):  # whole runs of one kind, up to `stretch` words
                j = i + 1
                while j < len(starts) and kind[j] == kind[i] and ends[j] - starts[i] <= stretch:
                    j += 1
                s, e = int(starts[i]), int(ends[j - 1])
                if e - s > j - i:  # else each run is a word alone
                    out = _pairs(rows.slice(s, e - s), np.repeat(np.arange(j - i), ends[i:j] - starts[i:j]), int(size[s]), bool(from_end[s]))
                    if out is not None:
                        yield out
                i = j

    return work


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of tiles (size, from_end, key, i, j) with words (chunk, word, n), in that order: sums of pairs."""
    for rows, starts, _, _ in runs(batches, lambda t: [np.asarray(t[c].to_pandas()) for c in ("size", "from_end", "key", "i", "j")]):
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
            part = rows.slice(s, e - s)
            i, j = part["i"][0].as_py(), part["j"][0].as_py()
            out = _pairs(part, np.zeros(e - s, np.int8), part["size"][0].as_py(), part["from_end"][0].as_py(), part["part"].to_numpy() if i != j else None)
            if out is not None:
                yield out


def near(vocabulary: DataFrame, most: int = MOST, stretch: int = STRETCH) -> DataFrame:
    """(word, n_near, form_n, form): for each word of vocabulary (word, n; distinct, of letters below U+0100) that has any, the
    number of words one error apart, and the most frequent of them (ties: the least). No pairs are emitted, only sums."""
    length = F.length("word")
    as_pair = lambda size: F.array(*[F.struct(size.alias("size"), F.lit(e).alias("from_end"), (F.right("word", F.floor(size / 2).cast("int")) if e else F.left("word", F.floor(size / 2).cast("int"))).alias("key")) for e in (False, True)])
    rows = vocabulary.select("word", "n", F.explode(F.concat(as_pair(length), as_pair(length - 1))).alias("k")).select("word", "n", "k.*")
    order = ["size", "from_end", "key"]
    found = cut(rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_found(most, stretch), FOUND))
    over = found.where("chunk >= 0").select(F.struct(*order).alias("k"), *order, "chunk", F.col("chunk").alias("part"), "word", "n")
    tiled = tiles(over, "k").drop("k").repartition(*order, "i", "j").sortWithinPartitions(*order, "i", "j").mapInArrow(_tiled, FOUND)
    sums = found.where("chunk < 0").unionByName(tiled)
    best = sums.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form: null for roots): what following forms from a word leads to in the end.

    Each round every word looks up what its present end leads to, so paths halve; the words left are those not yet at a root."""
    done = forms.where("form is null").select("word", F.col("word").alias("root"))
    open_ = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    done = cut(done)
    while not open_.isEmpty():
        up = done.select(F.col("word").alias("root"), F.col("root").alias("end")).unionByName(open_.select(F.col("word").alias("root"), F.col("root").alias("end")))
        ended = done.where("word = root").select(F.col("word").alias("end"), F.lit(True).alias("ended"))
        moved = cut(open_.join(up, "root").select("word", "end").join(ended, "end", "left").select("word", F.col("end").alias("root"), F.coalesce("ended", F.lit(False)).alias("ended")))
        done = done.unionByName(moved.where("ended").select("word", "root"))
        open_ = moved.where("not ended").select("word", "root")
    return done


def variants(docs: DataFrame, spoilt: int = SPOILT, letters: int = LEAST_LETTERS, least: int = LEAST_N, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text), as words() counts them.

    form: the most frequent word that is one inserted, deleted or replaced letter away (ties: the first by code points), if it
    occurs `ratio` times as often at least, else null, and form_n null with it. root: where forms lead in the end, the word itself
    if it has none. Null or empty texts have no words, a null doc_id counts as empty, repeated rows count as often as
    they come; without words the result is empty.
    """
    if letters < 2 or ratio < 2:
        raise ValueError("words of one letter agree in no half, and forms must be more frequent")
    vocabulary = cut(words(docs, spoilt, letters, least))
    both = vocabulary.join(near(vocabulary), "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    out = cut(both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    return out.join(roots(out.select("word", "form")), "word").select("word", "form", "root", "n", "n_near", "form_n")
