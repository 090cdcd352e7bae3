"""Fuzzy line deduplication: bands of minima of normalised lines, edit similarity, connected groups.

A line takes part by its normalised form: lower-cased words, punctuation dropped, single spaces. Lines with equal
forms are one node. Nodes meet where one of BANDS bands of minima agrees (see line_keys), and a pair is linked if the
edit similarity of the forms (1 - distance / longer length) reaches the threshold. Of every connected group one
occurrence stays, that of the smallest (doc_id, line number).

One word in ten that is another moves about nine bits of a 64-bit SimHash: blocks that bring nine in ten of the similar
lines together would need some sixty keys a line, sixteen bands of minima bring more.
"""

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, free_names, texts, written
from .minhash import band_keys, candidates, mixed, sized, verified

PUNCTUATION = re.compile(r"[!-/:-@\[-^`{-~]+")  # of ASCII, without the underscore
BEYOND = re.compile(r"[^\w\x00-\x7f]")  # marks that belong to letters, too: those stay
WORD = re.compile(r"[^\x00-\x20]+")
BANDS, ROWS = 16, 4  # the bands that similar lines may meet in, and how many minima must agree there
FEW_WORDS, LONG_WORDS = 8, 16  # a line of fewer words, or of more bytes a word, is told by its bytes
LEAST_SHARED = 0.0  # of the features of two lines: none, the edit distance alone decides
TOGETHER, FEW, LONG, SIDE_BY_SIDE = 16, 4, 500, 65_536  # pairs of one form, and their characters, from which they are compared at once; bits of a stretch
FETCHED = 8_000_000  # lines up to which a bitmap says which texts are fetched


def normalise(line: str) -> str:
    """The line's form: its words in lower case, punctuation and symbols left out, with single spaces between them."""
    return " ".join(WORD.findall(PUNCTUATION.sub("", plain(line.lower()))))


class _Instead(dict):
    """What stands for a character that is beyond ASCII and no word's; remembered. (A cached function would be sent to tasks
    by its name, for which they would need this package.)"""

    def __missing__(self, c: str) -> str:
        x = self[c] = " " if c.isspace() else c if unicodedata.category(c)[0] == "M" else ""
        return x


INSTEAD = _Instead()


def plain(text: str) -> str:
    """text without the punctuation, symbols and invisible characters beyond ASCII, and with spaces for its white space."""
    return text if text.isascii() else BEYOND.sub(lambda c: INSTEAD[c[0]], text)


PLAIN_LEADS = np.array([b < 0xC0 or 0xC3 <= b <= 0xC9 for b in range(256)])


def lowered(text: str) -> np.ndarray:
    """The bytes of plain(text.lower()). Text of Latin letters alone (U+00C0 to U+027F but for two signs) is plain as it is."""
    low = text.lower()
    raw = low.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    if not PLAIN_LEADS[b].all() or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
        b = np.frombuffer(plain(low).encode("utf-8", "surrogatepass"), np.uint8)
    return b


def edit_distance(a: str, b: str, limit: int) -> int:
    """The edit distance, or limit + 1 if it is more: bit-parallel, on what equal beginnings and ends leave."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return min(len(a), limit + 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = where.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(across | up)), up & across
        score += bool(rise & top) - bool(fall & top)
        if score - left > limit:
            return limit + 1
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        eq |= down
        up, down = fall | (full & ~(eq | rise)), rise & eq
    return min(score, limit + 1)


def _common(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def by_words(v: list[str], w: list[str]) -> int:
    """An upper bound of the edit distance of two lines of words: words that each line has once and that keep their order
    stay, what lies between them is replaced."""
    once_v, once_w = Counter(v), Counter(w)
    at = {x: j for j, x in enumerate(w) if once_w[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(v) if x in at and once_v[x] == 1]
    ends, last, before = [], [], []  # the longest ascending run of places: least end of each length, and whose it is
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before.append(last[n - 1] if n else -1)
        if n == len(ends):
            ends.append(j)
            last.append(k)
        else:
            ends[n], last[n] = j, k
    kept, k = [(len(v), len(w))], last[-1] if last else -1
    while k >= 0:
        kept.append(pairs[k])
        k = before[k]
    total, i, j = 0, 0, 0
    for end_i, end_j in reversed(kept):
        if end_i - i or end_j - j:
            x, y = v[i:end_i], w[j:end_j]
            while x and y and x[-1] == y[-1]:
                x.pop(), y.pop()
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            total += max(sum(map(len, x[n:])) + len(x) - n, sum(map(len, y[n:])) + len(y) - n)
        i, j = end_i + 1, end_j + 1
    return total


def distances(xs: list[str], ys: list[str], limits: list[int] | None = None) -> np.ndarray:
    """The edit distances of pairs of strings that aren't empty, all at once: bit-parallel, 64 rows to a word; a column
    of all pairs is one step. With limits, pairs leave once what is left of them can't bring them down to their limit; theirs is
    limit + 1."""
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    codes = np.frombuffer("".join([*xs, *ys]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, codes = np.unique(codes, return_inverse=True)
    rows, words = np.arange(len(xs)), (n.max() + 63) // 64
    starts_x, starts_y = np.cumsum(n) - n, n.sum() + np.cumsum(m) - m
    equal = np.zeros((len(letters) * len(xs), words), np.uint64)
    for i in range(n.max()):
        some = rows[n > i]
        equal[codes[starts_x[some] + i] * len(xs) + some, i // 64] |= np.uint64(1 << i % 64)
    equal = np.ascontiguousarray(equal.T)
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full((words, len(xs)), 2**64 - 1, np.uint64), np.zeros((words, len(xs)), np.uint64)
    rise, fall, score = np.empty_like(up), np.empty_like(up), n.copy()
    last = (n - 1) // 64, rows
    bit = ((n - 1) % 64).astype(np.uint64)
    most = None if limits is None else np.array(limits)
    out = score.copy() if most is None else most + 1
    for j in range(m.max()):
        if most is not None and j % 8 == 0:
            stay = np.flatnonzero(score - np.maximum(m - j, 0) <= most)
            if len(stay) < 0.8 * len(rows):
                if not len(stay):
                    return out
                rows, n, m, most, score, starts_y, bit = (v[stay] for v in (rows, n, m, most, score, starts_y, bit))
                words = (n.max() + 63) // 64
                up, down = (np.ascontiguousarray(v[:words, stay]) for v in (up, down))
                rise, fall = np.empty_like(up), np.empty_like(up)
                last = (n - 1) // 64, np.arange(len(rows))
                if j >= m.max():
                    break
        at = codes[np.minimum(starts_y + j, len(codes) - 1)] * len(xs) + rows
        more, less = one, np.uint64(0)  # what comes in from the rows above
        for k in range(words):
            eq, u, d = equal[k][at], up[k], down[k]
            across = eq | d
            eq |= less
            level = (((eq & u) + u) ^ u) | eq
            p, q = d | ~(level | u), u & level
            rise[k], fall[k] = p, q
            p, q, more, less = p << one | more, q << one | less, p >> top, q >> top
            up[k], down[k] = q | ~(across | p), p & across
        step = (rise[last] >> bit & one).astype(np.int64) - (fall[last] >> bit & one).astype(np.int64)
        score += np.where(m > j, step, 0)
    out[rows] = score if most is None else np.minimum(score, most + 1)
    return out


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _bits(x: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little", count=n)


def within(x: str, ys: list[str], limits: list[int]) -> list[bool]:
    """Of each of ys, whether its edit distance from x is its limit or less: bit-parallel, all of ys side by side in one long
    integer, with a bit after each that takes up the carry. Now and then those leave that no column to come can bring
    down to their limit."""
    ends = [min(_common(x[::-1], y[::-1]), len(x), len(y)) for y in ys]
    order, out = sorted(range(len(ys)), key=ends.__getitem__), [False] * len(ys)
    while order:
        some, size = [], 0
        while order and (not some or size < SIDE_BY_SIDE):
            some.append(order.pop())
            size += len(ys[some[-1]]) + 1
        k = min(_common(x, ys[i]) for i in some)
        e = min(min(ends[i], len(x) - k, len(ys[i]) - k) for i in some)
        found = _within(x[k : len(x) - e], [ys[i][k : len(ys[i]) - e] for i in some], np.array([limits[i] for i in some]))
        for i in np.array(some)[found].tolist():
            out[i] = True
    return out


def _within(x: str, ys: list[str], limits: np.ndarray) -> np.ndarray:
    """The places of those of ys whose edit distance from x is their limit or less."""
    text = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).tolist()
    n, of = np.array([len(y) for y in ys]), np.arange(len(ys))
    codes = np.frombuffer("\0".join([*ys, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[np.cumsum(n + 1) - 1] = -1

    def set_up(j: int) -> None:
        nonlocal starts, gaps, rest, full, low, where
        gaps = np.cumsum(n + 1) - 1
        starts = gaps - n
        row = np.arange(len(codes)) - np.repeat(starts, n + 1) + 1
        row[gaps] = 0
        rest, first = np.repeat(n, n + 1) - row, np.zeros(len(codes), bool)
        first[starts] = True
        full = _number(codes >= 0)
        low, where = _number(first) & full, {c: _number(codes == c) for c in set(text[j:])}

    starts = gaps = rest = full = low = where = None
    set_up(0)
    up, down = full, 0
    for j in range(len(text) + 1):
        if j == len(text) or j % 32 == 0 and j > limits.min():
            steps = [_bits(v, len(codes)) for v in (up, down)]
            total = np.cumsum(steps[0].astype(np.int32) - steps[1])
            so_far = j + total - np.repeat(np.append(0, total[gaps[:-1]]), n + 1)
            so_far[gaps] = j
            stay = np.minimum.reduceat(so_far + np.abs(rest - (len(text) - j)), starts) <= limits
            if j == len(text) or not stay.any():
                return of[stay]
            if stay.sum() < 0.7 * len(n):
                some = np.repeat(stay, n + 1)
                kept, codes = [v[some] for v in steps], codes[some]
                n, of, limits = n[stay], of[stay], limits[stay]
                set_up(j)
                up, down = (_number(v) for v in kept)
        eq = where[text[j]]
        across = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = down | (full ^ (across | up)), up & across
        rise, fall = (rise << 1) & full | low, (fall << 1) & full
        eq |= down
        up, down = fall | (full ^ (eq | rise)), rise & eq


def beside(xs: list[str], ys: list[str], limits: list[int]) -> list[bool]:
    """Of each pair, whether its edit distance is its limit or less: as within(), for pairs that have no form in common. Those about
    alike in length go side by side; the shorter form's end is drawn out to the group's longest, the other's by as much."""
    out, todo = [False] * len(xs), []
    for i, (x, y, limit) in enumerate(zip(xs, ys, limits)):
        if len(x) > len(y):
            x, y = y, x
        k = _common(x, y)
        x, y = x[k:], y[k:]
        k = _common(x[::-1], y[::-1])
        x, y = x[: len(x) - k], y[: len(y) - k]
        if not x or len(y) <= limit:
            out[i] = len(y) <= limit
        else:
            todo.append((len(x), i, x, y))
    todo.sort(reverse=True)
    k = 0
    while k < len(todo):
        some, size = [], 0
        while k < len(todo) and (not some or size < SIDE_BY_SIDE and 2 * todo[k][0] >= some[0][0] - 64):
            some.append(todo[k])
            size += len(todo[k][3]) + some[0][0] - todo[k][0] + 8
            k += 1
        found = _beside([v[2] for v in some], [v[3] for v in some], np.array([limits[v[1]] for v in some]))
        for j in found.tolist():
            out[some[j][1]] = True
    return out


def _beside(xs: list[str], ys: list[str], limits: np.ndarray) -> np.ndarray:
    """The places of those pairs whose edit distance is their limit or less. Each of ys has whole bytes of the long integer, and a bit
    after it at least."""
    size = max(map(len, xs))
    ends = [" " * (size - len(x)) for x in xs]
    n = np.array([len(y) + len(e) for y, e in zip(ys, ends)])
    of, width, codes, columns = np.arange(len(xs)), n // 8 * 8 + 8, [], []
    for x, y, e, w in zip(xs, ys, ends, width.tolist()):
        own = np.full(w, -1, np.int64)
        own[: len(y) + len(e)] = np.frombuffer((y + e).encode("utf-32-le", "surrogatepass"), np.uint32)
        none, where = bytes(w // 8), {c: np.packbits(own == ord(c), bitorder="little").tobytes() for c in {*x, *e}}
        codes.append(own)
        columns.append([where.get(c, none) for c in x + e])
    codes = np.concatenate(codes)

    def set_up() -> None:
        nonlocal starts, gaps, rest, spare, full, low
        starts = np.cumsum(width) - width
        gaps = starts + n  # these stand for no character of y at all
        row = np.arange(len(codes)) - np.repeat(starts, width) + 1
        row[gaps] = 0
        rest = np.repeat(n, width) - row
        spare, first = rest < 0, np.zeros(len(codes), bool)
        first[starts] = True
        full, low = _number(codes >= 0), _number(first)

    starts = gaps = rest = spare = full = low = None
    set_up()
    up, down, begun, steps_of = full, 0, 0, list(zip(*columns))
    for j in range(size + 1):
        if j == size or j % 32 == 0 and j > limits.min():
            steps = [_bits(v, len(codes)) for v in (up, down)]
            total = np.cumsum(steps[0].astype(np.int32) - steps[1])
            so_far = j + total - np.repeat(np.append(0, total[starts[1:] - 1]), width)
            so_far[gaps] = j
            so_far[spare] = 1 << 30
            stay = np.minimum.reduceat(so_far + np.abs(rest - (size - j)), starts) <= limits
            if j == size or not stay.any():
                return of[stay]
            if stay.sum() < 0.7 * len(n):
                some = np.repeat(stay, width)
                kept, codes = [v[some] for v in steps], codes[some]
                columns = [c for c, ok in zip(columns, stay.tolist()) if ok]
                n, of, limits, width = n[stay], of[stay], limits[stay], width[stay]
                set_up()
                up, down = (_number(v) for v in kept)
                begun, steps_of = j, list(zip(*[c[j:] for c in columns]))
        eq = int.from_bytes(b"".join(steps_of[j - begun]), "little")
        across = ((((eq & up) + up) ^ up) | eq | down) & full
        rise, fall = down | (full ^ (across | up)), up & across
        rise, fall = (rise << 1) & full | low, (fall << 1) & full
        eq |= down
        up, down = fall | (full ^ (eq | rise)), rise & eq


class Form:
    """A form's words, and what its band keys are made of: pairs of neighbouring words, or runs of four bytes."""

    def __init__(self, form: str):
        self.form, self.words = form, form.split(" ")

    @property
    def features(self) -> set:
        form, w = self.form, self.words
        raw = form.encode("utf-8", "surrogatepass") if len(w) < FEW_WORDS or not form.isascii() or len(form) > LONG_WORDS * len(w) else form
        few = len(w) < FEW_WORDS or len(raw) > LONG_WORDS * len(w)
        return {raw[i : i + 4] for i in range(max(1, len(raw) - 3))} if few else set(zip(w, w[1:]))

    def near_enough(self, other: "Form", limit: int) -> bool | None:
        """Whether the edit distance is limit or less, if cheap bounds tell."""
        v, w = self.words, other.words
        if len(v) == len(w) and sum(max(len(x), len(y)) for x, y in zip(v, w) if x != y) <= limit:
            return True
        return True if by_words(v, w) <= limit else None


def similar_pairs(least: float):
    """linked(xs, ys): of each pair of forms, whether 1 - edit distance / longer length reaches least."""

    def linked(xs: list[str], ys: list[str]) -> list[bool]:
        limits = [int((1 - least) * max(len(x), len(y)) + 1e-9) for x, y in zip(xs, ys)]
        known: dict[str, Form] = {}

        def of(x: str) -> Form:
            if x not in known:
                known[x] = Form(x)
            return known[x]

        out = [False if abs(len(x) - len(y)) > n else x == y or None for x, y, n in zip(xs, ys, limits)]

        def together(enough: Callable[[int, str], bool]) -> None:
            """Compares at once the open pairs of a form that enough(how many, form) holds for."""
            open_ = [i for i, ok in enumerate(out) if ok is None]
            often, beside = Counter(chain((xs[i] for i in open_), (ys[i] for i in open_))), defaultdict(list)
            for i in open_:
                x, y = xs[i], ys[i]
                one, other = (x, y) if often[x] >= often[y] else (y, x)
                beside[one].append((i, other))
            for x, those in beside.items():
                if enough(len(those), x):
                    at = [i for i, _ in those]
                    for i, ok in zip(at, within(x, [y for _, y in those], [limits[i] for i in at])):
                        out[i] = ok

        together(lambda n, x: n >= TOGETHER)  # those of long runs, which are mostly unlike
        out = [of(x).near_enough(of(y), n) if ok is None else ok for ok, x, y, n in zip(out, xs, ys, limits)]
        together(lambda n, x: n >= FEW and n * len(x) >= LONG)
        open_, few = sorted((i for i, ok in enumerate(out) if ok is None), key=lambda i: len(xs[i])), []
        while open_:
            words = len(xs[open_[0]]) * 3 // 128 + 2  # about alike in length, so that few columns are idle
            some = [i for i in open_[: max(1, 32_768 // words)] if len(xs[i]) < 64 * words]
            open_ = open_[len(some) :]
            if len(some) < 8 * words:  # a step costs as much for few pairs as for many
                few += some
                continue
            limit = [limits[i] for i in some]
            for i, ok in zip(some, (distances([xs[i] for i in some], [ys[i] for i in some], limit) <= limit).tolist()):
                out[i] = ok
        for i, ok in zip(few, beside([xs[i] for i in few], [ys[i] for i in few], [limits[i] for i in few])):
            out[i] = ok
        return out

    return linked


class Words:
    """Hashes of all words of a text at once: a polynomial in each word's bytes, modulo 2**64, from prefix sums."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        every = np.arange(256)
        self.kept = (every <= 32) | (every >= 128) | np.isin(every, np.frombuffer(b"0123456789_abcdefghijklmnopqrstuvwxyz\x7f", np.uint8))
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        """Powers of the base and of its inverse."""
        steps = np.full((2, n), self.BASE, np.uint64)
        steps[1] = pow(self.BASE, -1, 1 << 64)
        steps[:, 0] = 1
        self.power, self.inverse = np.multiply.accumulate(steps, axis=1)

    def lines(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all words of a text, how many words each line has, characters of its form, the bytes that are left
        of the text)."""
        raw = lowered(text)
        b = raw[self.kept[raw]]
        if len(b) > len(self.power):
            self.grow(1 << len(b).bit_length())
        edge = np.diff((b > 32).astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.power[: len(b)], out=sums[1:])
        h = mixed((sums[end] - sums[start]) * self.inverse[start])
        letters = np.zeros(len(b) + 1, np.int64)
        np.cumsum(b & 0xC0 != 0x80, out=letters[1:])
        upto = np.append(0, np.cumsum(letters[end] - letters[start]))
        at = np.concatenate([[0], np.searchsorted(start, np.flatnonzero(b == 10)), [len(start)]])
        sizes = np.diff(at)
        return h, sizes, np.maximum(np.diff(upto[at]) + sizes - 1, 0), b


def line_keys(hashes: np.ndarray, sizes: np.ndarray, b: np.ndarray, take: np.ndarray, bands: int) -> np.ndarray:
    """The band keys of the lines `take` (each of a word at least) from all their pairs of neighbouring words; from their runs
    of four bytes where they have few words for their length, as short lines have, and those of scripts without spaces."""
    ends = np.append(np.flatnonzero(b == 10), len(b))
    begin = np.append(0, ends[:-1] + 1)[take]
    length, word = ends[take] - begin, (np.cumsum(sizes) - sizes)[take]
    sizes = sizes[take]
    few = (sizes < FEW_WORDS) | (length > LONG_WORDS * sizes)
    n = np.where(few, np.maximum(length - 3, 1), sizes - 1)
    starts = np.cumsum(n) - n
    at = np.repeat(np.where(few, begin, word) - starts, n) + np.arange(n.sum())
    of = np.repeat(few, n)
    padded = np.concatenate([b, np.full(4, 10, np.uint8)]).astype(np.uint64)
    four = sum(padded[at[of] + k] << np.uint64(8 * k) for k in range(4))
    features = np.empty(len(at), np.uint64)
    features[of] = four
    first = at[~of]
    features[~of] = hashes[first] * np.uint64(Words.BASE) + hashes[first + 1]
    tiny = np.flatnonzero(length < 4)  # their four bytes would reach into the next line
    features[starts[tiny]] = hashes[word[tiny]]
    return band_keys(mixed(features), starts, bands, ROWS)


def _scan(least_words: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("again", pa.int64()), ("line", pa.int32()), ("node", pa.binary()), ("id", pa.int64()), ("chars", pa.int64()), ("keys", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Words(), set()  # seen: ids whose keys this task has given
        for batch in batches:
            at, no, held, size = [], [], [], 0

            def out() -> pa.RecordBatch:
                joined = "\n".join(held)
                hashes, sizes, chars, b = known.lines(joined)
                bare, enough = {}, sizes >= max(1, least_words)
                if not least_words and not sizes.all():  # lines of marks alone: each is its own form
                    of = joined.split("\n")
                    bare = {i: x.encode("utf-8", "surrogatepass") for i in np.flatnonzero(sizes == 0).tolist() if (x := of[i].strip())}
                    enough[list(bare)] = True
                take = np.flatnonzero(enough)
                begin, n, data, digest = (np.cumsum(sizes) - sizes)[take], sizes[take], memoryview(hashes.tobytes()), xxhash.xxh3_128_digest
                nodes = [digest(data[8 * i : 8 * (i + k)] if k else b"mark" + bare[j]) for i, k, j in zip(begin.tolist(), n.tolist(), take.tolist())]
                ids = np.frombuffer(b"".join([x[:8] for x in nodes]), np.int64)
                if len(seen) > 1 << 19:
                    seen.clear()
                new = np.zeros(len(n), bool)
                for i, (k, x) in enumerate(zip(n.tolist(), ids.tolist())):
                    if k and x not in seen:
                        seen.add(x)
                        new[i] = True
                packed = line_keys(hashes, sizes, b, take[new], bands).tobytes() if new.any() else b""
                keys = iter(range(0, len(packed), 4 * bands))
                keys = [packed[(k := next(keys)) : k + 4 * bands] if x else None for x in new.tolist()]
                rows = pa.array(np.array(at)[take])
                return pa.record_batch([*(batch.column(i).take(rows) for i in range(3)), np.array(no, np.int32)[take], pa.array(nodes, pa.binary()), ids, chars[take], pa.array(keys, pa.binary())], schema=schema)

            for i, text in enumerate(texts(batch)):
                n = text.count("\n") + 1
                at += [i] * n
                no += range(n)
                held.append(text)
                size += len(text)
                if size > 250_000:  # what fits a core's cache
                    yield out()
                    at, no, held, size = [], [], [], 0
            if held:
                yield out()

    return work


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes that, with doc_id, tell rows of docs apart that don't have the same doc_id and text."""
    return [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("again"), "text", "doc_id")]


def occurrences(docs: DataFrame, least_words: int = 0, bands: int = BANDS) -> DataFrame:
    """(doc_id, row, again, line, node, id, chars, keys) of each line of at least least_words words, with 0 of each that
    isn't blank; lines are numbered from 0. node: a hash of the form, id its first half; keys: its band keys, at least
    once for each form that has words, elsewhere null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[k.alias(n) for k, n in zip(row_keys(docs), ("row", "again"))], F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(least_words, bands), "doc_id long, row long, again long, line int, node binary, id long, chars long, keys binary")


def _bands(bands: int):
    """(keys, ids) of each band of rows (id, chars, keys)."""

    def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, chars, keys = (batch.column(i) for i in range(3))
        keys = np.frombuffer(b"".join(keys.to_pylist()), np.int32).reshape(-1, bands)
        return sized(keys, chars.to_numpy()).ravel(), np.repeat(ids.to_numpy(), bands)

    return entries


def _place(row: Column, line: Column, bits: int) -> Column:
    return row.bitwiseXOR(F.shiftleft(line.cast("long"), 7)).bitwiseAND((1 << bits) - 1)


def _forms(bitmaps: dict[int, bytes] | None, bits: int):
    """(row, again, line, form) of the lines whose place's bit is set; of all without bitmaps."""
    wanted = np.zeros(1 << bits, bool)
    for bucket, bitmap in (bitmaps or {}).items():
        wanted[bucket << 15 : (bucket + 1) << 15] = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")[: 1 << bits]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, forms = [], [], []
            for i, (row, text) in enumerate(zip(batch.column(0).to_pylist(), texts(batch))):
                lines = np.arange(text.count("\n") + 1)
                if bitmaps is not None:
                    lines = np.flatnonzero(wanted[(row ^ lines << 7) & (1 << bits) - 1])
                if len(lines):
                    of = text.split("\n")
                    rows += [i] * len(lines)
                    at += lines.tolist()
                    forms += [normalise(of[k]) for k in lines]
            if rows:
                rows = pa.array(rows)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(forms, pa.string())], names=["row", "again", "line", "form"])

    return work


def forms_at(docs: DataFrame, wanted: DataFrame, most: int = FETCHED) -> DataFrame:
    """(row, again, line, form) of the lines of wanted (row, again, line), and of some others.

    Up to `most` wanted lines a bitmap of sixteen bits or so a line (16 MB at most) says which lines a scan of docs hands
    on; beyond, it hands on all, and the join with wanted, which is the caller's, picks those that count.
    """
    n, bitmaps, bits = wanted.count(), None, 15
    if n <= most:
        bits = max(15, (16 * n - 1).bit_length())
        places = wanted.select(_place(F.col("row"), F.col("line"), bits).alias("at")).distinct()
        found = places.groupBy(F.floor(F.col("at") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bitmap"))
        bitmaps = {r["bucket"]: bytes(r["bitmap"]) for r in found.collect()}
    row, again = row_keys(docs)
    rows = docs.select(row.alias("row"), again.alias("again"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_forms(bitmaps, bits), "row long, again long, line int, form string")


def links(docs: DataFrame, found: DataFrame, nodes: DataFrame, bands: int, similarity: float, most: int) -> DataFrame:
    """Edges (a, b) between nodes (id, node, row, again, line) that share a band and are similar; found: occurrences(); row, again, line: where the form
    stands.

    Texts are fetched only for nodes that have a candidate. A key with more than `most` nodes is compared as pairs of
    chunks, so no task holds it whole.
    """
    pairs, tiled = candidates(found.where("keys is not null").select("id", "chars", "keys"), _bands(bands), bands * found.count(), most, similarity)
    every = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(tiled.select("id")).distinct()
    cand = cut(every.join(nodes, "id"))
    content = cut(cand.join(forms_at(docs, cand), ["row", "again", "line"]).select("id", "node", F.col("form").alias("body")).dropDuplicates(["node"]))
    return verified(pairs, tiled, content, similar_pairs(similarity), "binary")


def dropped_lines(docs: DataFrame, similarity: float = 0.8, least_words: int = 0, bands: int = BANDS, most: int = 1024) -> DataFrame:
    """(doc_id, row, again, lines array<int>): the line numbers of each row that repeat another occurrence."""
    found, _ = written(occurrences(docs, least_words, bands), "lines")
    one = [F.min("row").alias("row"), F.min_by("again", "row").alias("again"), F.min_by("line", "row").alias("line")]
    nodes = cut(found.groupBy("node", "id").agg(*one, F.count("*").alias("n")))
    parts = connected_components(links(docs, found, nodes.drop("n"), bands, similarity, most))
    alone = nodes.where("n > 1").select("node").join(parts.select("node"), "node", "left_anti")  # repeats that nothing else is linked to
    grouped = parts.select("node", "root").unionByName(alone.select("node", F.col("node").alias("root")))
    place = F.struct("doc_id", "line", "row", "again")
    several = cut(found.select("node", "doc_id", "line", "row", "again").join(grouped, "node").drop("node"))
    kept = several.groupBy("root").agg(F.min(place).alias("kept"))
    again = several.join(kept, "root").where(~place.eqNullSafe(F.col("kept")))
    return again.groupBy("doc_id", "row", "again").agg(F.collect_set("line").alias("lines"))


def _without(text_at: int):
    """Rows (.., n_dropped, lines) with those lines out of their text; lines itself is used up here."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, gone = batch.columns[:-1], batch.column(batch.num_columns - 1)
            if gone.null_count < batch.num_rows:
                out = columns[text_at].to_pylist()
                for i, lines in enumerate(gone.to_pylist()):
                    if lines:
                        lines = set(lines)
                        out[i] = "\n".join([x for k, x in enumerate(out[i].split("\n")) if k not in lines])
                columns[text_at] = pa.array(out, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return work


def dedup_lines(docs: DataFrame, similarity: float = 0.8, least_words: int = 0, bands: int = BANDS, most: int = 1024) -> DataFrame:
    """docs with its repeated lines gone, and a column n_dropped (replaced, if docs has one).

    All lines take part but blank ones and, if least_words is more than 0, those of fewer words; those of marks alone go
    only as exact repeats. The other lines keep their order and spelling. n_chars, if there, is set to the new length.
    A text may end up empty; no row goes. Null texts stay null. Rows that are equal in doc_id and text count as one
    occurrence and stay equal. A null doc_id sorts before others. Ties are settled by line number, then by hashes of
    the row. An empty table stays empty. Other columns don't matter, whatever their names.

    bands: in how many bands of minima similar lines may meet; more find more of them. most: nodes of a band key that
    are compared in one task.
    """
    row, again, doc_id, lines = free_names(docs.columns, "_row", "_again", "_id", "_lines")
    names = [c for c in docs.columns if c.lower() != "n_dropped"]
    gone = dropped_lines(docs, similarity, least_words, bands, most)
    gone = gone.select(F.col("doc_id").alias(doc_id), F.col("row").alias(row), F.col("again").alias(again), F.col("lines").alias(lines))
    keys = free_names([*docs.columns, row, again, doc_id, lines], "_key", "_further")
    rows = docs.withColumns(dict(zip(keys, row_keys(docs)))).select(*names, *keys)
    out = rows.join(gone, (F.col(keys[0]) == F.col(row)) & (F.col(keys[1]) == F.col(again)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)), "left")
    out = out.select(*names, F.coalesce(F.size(F.col(lines)), F.lit(0)).alias("n_dropped"), F.col(lines).alias(lines))
    out = out.withColumn("n_dropped", F.when(F.col(lines).isNull(), 0).otherwise(F.col("n_dropped")))
    out = out.mapInArrow(_without([c.lower() for c in names].index("text")), out.drop(lines).schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out
