"""Phrases of words that stand together more often than their parts would by chance.

Every run of one to three words is a Rabin-Karp fingerprint: numpy prefix polynomials over the bytes give words, and
over the words' values runs of words, for a whole window of texts at once. Tasks add equal fingerprints up and send
them in byte planes, dealt out by their leading bits, each with a second hash and a pointer to one text that has it.
Only of fingerprints that are frequent in all is the text read. A fingerprint under which second hashes differ, or that the
text pointed to doesn't have, stands for several phrases: its occurrences are counted again by their texts.
"""

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .minhash import mixed

LEAST = 10  # occurrences of a phrase
LONGEST = 3  # words of a phrase
COVERED = 50  # percent of a phrase's occurrences within a longer one, from which it goes
BITS = 56  # of a fingerprint; with the second hash, 80 bits tell phrases apart
WINDOW = 1 << 18  # bytes that are hashed at once, but for longer words
HELD = 5_000_000  # unlike runs of words that a task holds before it sends them, about
CHUNK = 500_000  # runs of words that are added up at once
PART = 1 << 20  # bytes of text that are split into words at once, but for longer texts
SLICE_CHARS = 8_000_000  # characters of text for a slice of fingerprints that one task adds up
MARKS = 20  # leading bits by which fingerprints are marked that stand for several phrases

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)  # 1 between words, 2 between pieces
KIND[[32, 9]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


class Polynomials:
    """Prefix polynomials modulo 2**64 with an odd base, which has an inverse: the values of stretches, wherever they begin."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.of_byte = r.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        self.base = int(r.integers(0, 1 << 62)) << 3 | 5
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            out = [np.full(n, x % (1 << 64), np.uint64) for x in (self.base, pow(self.base, -1, 1 << 64))]
            for x in out:
                x[0] = 1
            self.up, self.down = (np.multiply.accumulate(x) for x in out)

    def stretches(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=prefix[1:])
        return (prefix[end] - prefix[begin]) * self.down[begin]


class Words:
    """The words of the texts of an Arrow column: where each begins and ends, and its text."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.bytes, at = LOWER[raw], offsets - offsets[0]
        kind = KIND[self.bytes]
        inside = kind == 0
        first = np.zeros(len(inside) + 1, bool)
        first[at] = True  # a text begins here, or ends
        after = np.append(False, inside[:-1])
        self.begin = np.flatnonzero(inside & (~after | first[:-1]))
        before = np.append(inside[1:], False)
        self.end = np.flatnonzero(inside & (~before | first[1:])) + 1
        self.text = np.searchsorted(at, self.begin, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.begin)
        self.joined = (np.diff(piece) == 0) & (np.diff(self.text) == 0)  # to the next word

    def phrase(self, i: int, n: int) -> bytes:
        return b" ".join(self.bytes[self.begin[k] : self.end[k]].tobytes() for k in range(i, i + n))


class Hasher:
    """Fingerprints and second hashes of runs of words."""

    def __init__(self, bits: int):
        self.kept = np.uint64(((1 << bits) - 1) << (64 - bits))
        self.bytes, self.words = [Polynomials(s) for s in (1, 2)], [Polynomials(s) for s in (3, 4)]

    def runs(self, words: Words, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(fingerprints, second hashes, first words, length) of all runs of words, a window at a time.

        seeds: a number for each text; runs under unlike numbers are unlike."""
        i, n = 0, len(words.begin)
        while i < n:
            j = max(i + 1, int(np.searchsorted(words.begin, words.begin[i] + WINDOW)))
            over = min(n, j + LONGEST - 1)  # runs that begin in the window may end behind it
            lo, hi = words.begin[i], words.end[over - 1]
            b, e = words.begin[i:over] - lo, words.end[i:over] - lo
            values = [mixed(p.stretches(p.of_byte[words.bytes[lo:hi]], b, e) + (e - b).astype(np.uint64)) for p in self.bytes]
            joined = words.joined[i : over - 1]
            ok = np.ones(over - i, bool)
            for k in range(1, LONGEST + 1):
                if k > 1:
                    ok = ok[:-1] & joined[k - 2 :]
                at = np.flatnonzero(ok[: j - i])
                seed = seeds[words.text[at + i]] + np.uint64(k)
                fp, check = (mixed(p.stretches(v, at, at + k) + seed) for p, v in zip(self.words, values))
                yield fp & self.kept, (check >> np.uint64(40)).astype(np.uint32), at + i, k
            i = j


def _planes(x: np.ndarray, size: int) -> bytes:
    """The lowest `size` bytes of x, all lowest ones first: those planes that hardly change compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :size].T).tobytes()


def _from_planes(b: bytes, size: int, kind) -> np.ndarray:
    out = np.zeros((len(b) // size, np.dtype(kind).itemsize), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(size, -1).T
    return out.view(kind).ravel()


def _added(fp: np.ndarray, check: np.ndarray, count: np.ndarray):
    """Of equal fingerprints: (fingerprint, least second hash, occurrences, or less than 0 if second hashes differ, one row of it)."""
    order = np.argsort(fp)
    fp = fp[order]
    new = np.ones(len(fp), bool)
    new[1:] = fp[1:] != fp[:-1]
    starts = np.flatnonzero(new)
    c, n = check[order], count[order]
    least, total = np.minimum.reduceat(c, starts), np.add.reduceat(np.abs(n), starts)
    unlike = (np.maximum.reduceat(c, starts) != least) | (np.minimum.reduceat(n, starts) < 0)
    return fp[starts], least, np.where(unlike, -total, total), order[starts]


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in langs], np.uint64)


def _parts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of rows whose texts have `most` bytes together, or are a single one."""
    at = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


SENT = "slice int, flush long, fp binary, second binary, n binary, text binary, other binary"


def _sent(k: int, flush: int, *columns: bytes, other: bytes = b"") -> pa.RecordBatch:
    columns = (*(columns or [b""] * 4), other)
    return pa.record_batch([pa.array([k], pa.int32()), pa.array([flush], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]], names=[c.split()[0] for c in SENT.split(", ")])


def _send(slices: int, bits: int):
    """Sums of the fingerprints of a task, a row for each slice of them; the keys of the texts that they point to, a row for all of
    a flush (slice -2 and less, by its number, which is a hash of the keys); and how many words languages have (slice -1)."""
    shift = np.uint64(64 - (slices.bit_length() - 1))
    edges = np.arange(1, slices, dtype=np.uint64) << shift

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words_of = Hasher(bits), Counter()
        new, chunks, keys, n_new = [], [], [], 0

        def add_up() -> None:
            fp, second, text = (np.concatenate([h[k] for h in new]) for k in range(3))
            fp, second, n, one = _added(fp, second, np.ones(len(fp), np.int32))
            chunks.append((np.searchsorted(fp, edges), fp, second, n.astype(np.int32), text[one]))
            new.clear()

        def out() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(keys).tobytes()
            flush = xxhash.xxh64_intdigest(key)
            yield _sent(-2 - flush % slices, flush - (1 << 63), other=key)
            for k in range(slices):
                cuts = [slice(c[0][k - 1] if k else 0, c[0][k] if k < slices - 1 else len(c[1])) for c in chunks]
                fp, second, n, text = (np.concatenate([c[i][s] for c, s in zip(chunks, cuts)]) for i in range(1, 5))
                if len(fp):
                    fp, second, n, one = _added(fp, second, n)
                    yield _sent(k, flush - (1 << 63), _planes(np.diff(fp >> np.uint64(64 - bits), prepend=np.uint64(0)), 8), _planes(second, 3), _planes(n.astype(np.int32), 4), _planes(text[one], 4))
            chunks.clear()
            keys.clear()

        for batch in batches:
            for i, j in _parts(batch.column(2), PART):
                part = batch.slice(i, j - i)
                words, langs = Words(part.column(2)), part.column(1).to_pylist()
                for lang, n in zip(langs, np.bincount(words.text, minlength=j - i).tolist()):
                    words_of[lang] += n
                before = sum(map(len, keys))
                keys.append(part.column(0).to_numpy())
                for fp, second, at, n in hasher.runs(words, _seeds(langs)):
                    if len(fp):
                        new.append((fp, second, (words.text[at] + before).astype(np.uint32)))
                        n_new += len(fp)
                    if n_new > CHUNK:
                        add_up()
                        n_new = 0
                if sum(len(c[1]) for c in chunks) > HELD:
                    if new:
                        add_up()
                        n_new = 0
                    yield from out()
        if new:
            add_up()
        if chunks:
            yield from out()
        if words_of:
            yield _sent(-1, 0, other=json.dumps(words_of).encode())

    return work


FOUND = "kind int, fp long, a long, several boolean, flush long, text int, key long, lang string"
FREQUENT, TOTAL, KEY = range(3)  # kinds: a frequent fingerprint, the words of a language, the key of a flush's text


def _found(kind: int, n: int, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in FOUND.split(", ")]
    return pa.table([pa.array(np.full(n, kind, np.int32)) if c == "kind" else pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(n, kinds[t]) for c, t in fields], names=[c for c, _ in fields])


def _frequent(least: int, bits: int):
    def work(rows: pa.Table) -> pa.Table:
        k = rows["slice"][0].as_py()
        if k == -1:
            total = Counter()
            for x in rows["other"].to_pylist():
                total.update(json.loads(x))
            return _found(TOTAL, len(total), lang=list(total), a=list(total.values()))
        if k < -1:
            keys = {f: np.frombuffer(x, np.int64) for f, x in zip(rows["flush"].to_pylist(), rows["other"].to_pylist())}  # equal ones of a part that is there twice
            sizes = [len(x) for x in keys.values()]
            return _found(KEY, sum(sizes), flush=np.repeat(np.array(list(keys), np.int64), sizes), text=np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), key=np.concatenate(list(keys.values())))
        fp, second, n, flush, text = [], [], [], [], []
        for r in rows.to_pylist():
            fp.append(np.cumsum(_from_planes(r["fp"], 8, np.uint64), dtype=np.uint64) << np.uint64(64 - bits))
            second.append(_from_planes(r["second"], 3, np.uint32))
            n.append(_from_planes(r["n"], 4, np.int32).astype(np.int64))
            flush.append(np.full(len(n[-1]), r["flush"]))
            text.append(_from_planes(r["text"], 4, np.uint32))
        fp, _, total, one = _added(*map(np.concatenate, (fp, second, n)))
        ok = np.abs(total) >= least
        one = one[ok]
        return _found(FREQUENT, len(one), fp=fp[ok].view(np.int64), a=np.abs(total[ok]), several=total[ok] < 0, flush=np.concatenate(flush)[one], text=np.concatenate(text)[one].astype(np.int32))

    return work


def _read(bits: int):
    """Of rows (lang, text, found: fp, a): the phrase that each fingerprint stands for in its text, null if it isn't there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            for i, j in _parts(batch.column(1), PART // 4):
                part = batch.slice(i, j - i)
                words, langs = Words(part.column(1)), part.column(0).to_pylist()
                found = part.column(2)
                items = found.flatten()
                fp, a = items.field(0).to_numpy().view(np.uint64), items.field(1).to_numpy()
                lang = np.repeat(np.arange(part.num_rows), np.diff(found.offsets.to_numpy()))
                where, size = np.full(len(fp), -1), np.zeros(len(fp), np.int32)  # a fingerprint tells languages apart: any text may show it
                order = np.argsort(fp)
                for h, _, at, n in hasher.runs(words, _seeds(langs)):
                    k = np.searchsorted(fp, h, sorter=order)
                    k = order[np.minimum(k, len(fp) - 1)] if len(fp) else k
                    hit = np.flatnonzero(fp[k] == h) if len(fp) else np.zeros(0, int)
                    where[k[hit]], size[k[hit]] = at[hit], n
                out = [words.phrase(w, n).decode() if w >= 0 else None for w, n in zip(where.tolist(), size.tolist())]
                yield pa.record_batch([pa.array([langs[r] for r in lang], pa.string()), pa.array(out, pa.string()), size, a, fp.view(np.int64)], names=["lang", "phrase", "words", "a", "fp"])

    return work


def _again(bits: int, marked: np.ndarray):
    """Texts of all runs of words whose fingerprints are marked, added up by task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, marks = Hasher(bits), np.zeros(1 << MARKS, bool)
        marks[marked] = True
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(found)
            cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.int32()), pa.array(list(found.values()), pa.int64())]
            return pa.record_batch(cols, names=["fp", "lang", "phrase", "words", "a"])

        for part in (b.slice(i, j - i) for b in batches for i, j in _parts(b.column(2), PART)):
            words, langs = Words(part.column(2)), part.column(1).to_pylist()
            for fp, _, at, n in hasher.runs(words, _seeds(langs)):
                hit = np.flatnonzero(marks[(fp >> np.uint64(64 - MARKS)).astype(np.int64)])
                for f, w in zip(fp[hit].view(np.int64).tolist(), at[hit].tolist()):
                    found[f, langs[words.text[w]], words.phrase(w, n).decode(), n] += 1
                if len(found) > 200_000:
                    yield out()
                    found.clear()
        if found:
            yield out()

    return work


def phrases(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words int, a): every run of one to three words within a piece that occurs `least` times or more in the
    texts of its language; and (lang, n): how many words each language has.

    docs: lang, text; other columns don't matter. Null texts are empty, a null lang is `und`. bits of a fingerprint
    don't change the result: with few, more is counted by the texts.
    """
    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(lang, text).alias("key"), lang.alias("lang"), text.alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = 1 << max(5, (chars // SLICE_CHARS).bit_length())
    sent = rows.mapInArrow(_send(slices, bits), SENT)
    found = cut(sent.groupBy("slice").applyInArrow(_frequent(least, bits), FOUND))
    frequent, totals = found.where(F.col("kind") == FREQUENT), found.where(F.col("kind") == TOTAL).select("lang", F.col("a").alias("n"))
    pointed = frequent.where("not several").select("fp", "a", "flush", "text").join(found.where(F.col("kind") == KEY).select("flush", "text", "key"), ["flush", "text"])
    wanted = pointed.groupBy("key").agg(F.collect_list(F.struct("fp", "a")).alias("found"))  # no more than a text has runs
    read = rows.dropDuplicates(["key"]).join(wanted, "key").select("lang", "text", "found").mapInArrow(_read(bits), "lang string, phrase string, words int, a long, fp long")
    read = cut(read)
    unsure = frequent.where("several").select("fp").unionByName(read.where("phrase is null").select("fp"))
    out = read.where("phrase is not null").select("lang", "phrase", "words", "a")
    if unsure.isEmpty():
        return out, totals  # it stands already: read is written, and writing it again would only make files
    marked = unsure.select(F.shiftrightunsigned("fp", 64 - MARKS).alias("mark")).distinct().toArrow()["mark"].to_numpy()  # at most 2**MARKS
    counted = rows.mapInArrow(_again(bits, marked), "fp long, lang string, phrase string, words int, a long").join(unsure, "fp", "left_semi")
    return cut(out.unionByName(counted.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least))), totals


def _top(rows: DataFrame, by: str, order: list[Column], most: int, parts: tuple[int, ...] = (64, 8)) -> DataFrame:
    """rows with rank, the first `most` of each value of `by`: of each of its parts first, so that no task holds it whole."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts[0]))
    for n in parts:
        w = Window.partitionBy(by, F.pmod(part, F.lit(n))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts[0]))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, most: int = 2000, least: int = LEAST, covered: int = COVERED, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `most` phrases of two or three words that stand together most.

    a: occurrences; n: words of the language; l and r: occurrences of the two parts at the cut that scores least (the first
    such), score: 1,000,000 a a / (l r), rounded down, exact up to 38 digits. A phrase of which a longer frequent one holds
    `covered` percent of the occurrences is left out. Ties: more occurrences, then byte order. Null texts are
    empty, a null lang counts as `und`; repeated rows count as often as they come; tables without words give no rows.
    """
    found, totals = phrases(docs, least, bits)
    long = found.where("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    two = F.array(F.struct(F.lit(1).alias("k"), joined(1, 1).alias("first"), joined(2, 1).alias("rest")))
    three = F.array(F.struct(F.lit(1).alias("k"), joined(1, 1).alias("first"), joined(2, 2).alias("rest")), F.struct(F.lit(2).alias("k"), joined(1, 2).alias("first"), joined(3, 1).alias("rest")))
    cuts = long.select("lang", "phrase", "words", "a", F.explode(F.when(F.col("words") == 2, two).otherwise(three)).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    of = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    wide = "cast({} as decimal(15,0))".format
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    best = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    inner = long.where("words = 3").select("lang", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(covered) * F.col("a"), F.lit(True)))
    top = _top(kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
