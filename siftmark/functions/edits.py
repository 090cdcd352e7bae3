"""Edit distances of whole texts, bit-parallel: a column of the distance matrix is one number, a bit for each character.

Before that two bounds: the characters that one text has more of than the other, and the cost of an alignment found on the way; where they
meet, that is the distance. Else matrices are computed: those of many pairs side by side, in words of 64 rows, each a column behind the word
above it; of long texts, and of few pairs, each for itself, in one long integer. Of long texts that are alike only a band around the
diagonal is computed, as wide as twice the distance supposed; if the distance turns out larger, the band is doubled. The first guess is the
alignment's cost, or comes from how unlike the texts' beginnings are. Results are exact whatever the guess.

Texts are strings, or bytes of which each is a character.
"""

import bisect
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE = 400  # characters from which the first guess is made
LONG = 20_000  # texts of so many characters are compared each for itself
LANES, FEW = 6144, 1024  # words side by side; with fewer than FEW, each pair for itself is faster
STEPS = 32  # columns after which pairs that are done make room for others


def _points(x: str | bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)


def _places(x: str | bytes) -> dict:
    """For each character of x a number whose bit i says whether it stands at place i."""
    points, as_read = _points(x), int if isinstance(x, bytes) else chr
    return {as_read(c): int.from_bytes(np.packbits(points == c, bitorder="little").tobytes(), "little") for c in np.unique(points).tolist()}


def _whole(a: str | bytes, b: str | bytes) -> int:
    """The distance by the whole matrix: a bit for each character of a. Bits beyond those touch no others, and go now and then."""
    at, full = _places(a).get, (1 << len(a)) - 1
    up, down = full, 0  # vertical steps of +1 and of -1
    for j in range(0, len(b), 64):
        for c in b[j : j + 64]:
            same = at(c, 0)
            still = (((same & up) + up) ^ up) | same | down
            level, falls = ((still | up) ^ down) << 1, (up & still) << 1  # horizontal steps that aren't +1, and those of -1
            both = still & level
            up, down = falls ^ level ^ both, still ^ both
        up, down = up & full, down & full
    return len(b) + up.bit_count() - down.bit_count()


def _within(a: str | bytes, b: str | bytes, most: int) -> int | None:
    """The distance if it is `most` or less, by the diagonals that such a path can reach; len(a) >= len(b), and a is longer than most."""
    above = (most - len(a) + len(b)) // 2
    below = above + len(a) - len(b)
    at, wide = _places(a), above + below + 1
    full, edge = (1 << wide) - 1, 1 << (wide - 1)
    up, down, distance = (full >> above) << above, 0, below
    shift, n = -above, len(a) - below
    row = edge >> 1
    for j, c in enumerate(b):
        same = at.get(c, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & full
        shift += 1
        still = ((((same & up) + up) ^ up) | same | down) & full
        rises, falls = down | (full ^ (still | up)), still & up
        if j < n:  # along the lowest diagonal
            if not still & edge:
                distance += 1
                if distance > most + above:  # what is left can't bring it down far enough
                    return None
        else:  # along the last row
            if rises & row:
                distance += 1
            elif falls & row:
                distance -= 1
            row >>= 1
        still >>= 1
        up, down = falls | (full ^ (still | rises)), still & rises
    return distance if distance <= most else None


def _least(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound: an edit takes one character and gives one at most."""
    size = int(max(x.max(), y.max())) + 1
    more = np.bincount(x, minlength=size) - np.bincount(y, minlength=size)
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def _aligned(x: np.ndarray, y: np.ndarray, wide: int = 16, far: int = 8) -> int | None:
    """The cost of an alignment, an upper bound: replaces what differs, and skips up to `far` characters of either text where most of the
    next `wide` differ. None for texts that don't go together."""
    i = j = cost = 0
    most = 2 * wide  # characters at once; few at first, as most texts that don't go together show it there
    while i < len(x) and j < len(y):
        n = min(len(x) - i, len(y) - j, most)
        off = x[i : i + n] != y[j : j + n]
        upto = np.zeros(n + 1, np.int64)
        np.cumsum(off, out=upto[1:])
        dense = np.flatnonzero(upto[wide:] - upto[:-wide] > wide // 2)
        if not len(dense):
            n = n if n < most else n - wide
            cost, i, j, most = cost + int(upto[n]), i + n, j + n, 4096
            continue
        at = int(dense[0]) + int(np.argmax(off[dense[0] :]))
        cost, i, j = cost + int(upto[at]), i + at, j + at
        best, u, v = (2 * wide, 0, 0), x[i : i + far + 2 * wide], y[j : j + far + 2 * wide]
        if len(u) == len(v) == far + 2 * wide:
            skipped = np.arange(1, far + 1)[:, None] + np.arange(2 * wide)
            skips = [np.count_nonzero(s[skipped] != t[: 2 * wide], 1).tolist() for s, t in ((u, v), (v, u))]
            best = min(best, *((c + d, d, 0) for d, c in enumerate(skips[0], 1)), *((c + d, 0, d) for d, c in enumerate(skips[1], 1)))
        else:
            for d in range(1, far + 1):
                for p, q in ((d, 0), (0, d)):
                    m = max(0, min(len(u) - p, len(v) - q, 2 * wide))
                    best = min(best, (int((u[p : p + m] != v[q : q + m]).sum()) + d + 2 * wide - m, p, q))
        if best[0] > wide:
            return None
        cost, i, j = cost + best[1] + best[2], i + best[1], j + best[2]
    return cost + len(x) - i + len(y) - j


class _Lanes:
    """Whole matrices of many pairs at once. A lane is a word of 64 rows of one matrix; a pair's lanes follow each other, each a column behind
    the one before, whose horizontal steps it takes up. Rows end with the last lane. Characters are numbered by how often the first text has
    them; 0 is one that it doesn't have, and what a lane sees before it begins and when it is done."""

    def __init__(self, pairs: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Of each pair the longer text, the other, and the characters of the longer, which are 254 at most."""
        self.pairs, self.out = pairs, np.zeros(len(pairs), np.int64)
        self.queue = sorted((-(-len(x) // 64), k) for k, (x, _, _) in enumerate(pairs))  # lanes, pair
        self.code = np.zeros(max(int(t.max()) for x, y, _ in pairs for t in (x, y)) + 1, np.uint8)
        self.letters = max(len(found) for _, _, found in pairs) + 1
        n = min(sum(w for w, _ in self.queue), max(LANES, self.queue[-1][0]))
        self.masks, self.seen = np.zeros((n, self.letters), np.uint64), np.zeros(n, np.int64)
        self.steps = np.zeros((2, n), np.uint64)  # `down` and `up` of _whole()
        self.upper = np.zeros(2 * n + 1, np.uint64)  # `level` and `falls` that lanes take up, and a place for what the last one gives
        self.live: list[list] = []  # (lane, lanes, pair, second text, its next place, columns to come, distance if all of them are +1)
        self.free = [(0, n)]

    def _fill(self) -> None:
        """Pairs of the queue take free lanes, of those that fit the widest first."""
        left: list[tuple[int, int]] = []
        for lane, n in sorted(self.free):
            if left and sum(left[-1]) == lane:
                lane, n = left[-1][0], left.pop()[1] + n
            while fit := bisect.bisect(self.queue, n, key=lambda x: x[0]):
                w, k = self.queue.pop(fit - 1)
                self._begin(k, lane, w)
                lane, n = lane + w, n - w
            if n:
                left.append((lane, n))
        self.free = left

    def _begin(self, k: int, lane: int, w: int) -> None:
        x, y, found = self.pairs[k]
        mine, unused = slice(lane, lane + w), 64 * w - len(x)
        self.code[found] = np.arange(1, len(found) + 1)
        rows, text = np.zeros(64 * w, np.uint8), np.zeros(len(y) + w + 2 * STEPS, np.uint8)
        rows[unused:], text[: len(y)] = self.code[x], self.code[y]
        self.code[found] = 0
        numbers = np.arange(1, len(found) + 1, dtype=np.uint8)
        self.masks[mine] = 0
        self.masks[mine, 1 : len(found) + 1] = np.packbits(rows == numbers[:, None], axis=1, bitorder="little").view("<u8").T
        level, falls = self.upper[:-1].reshape(2, -1)
        self.seen[mine], level[mine], falls[mine], level[lane] = 0, 1, 0, 0
        self.steps[0, mine], self.steps[1, mine], self.steps[1, lane] = 0, ~np.uint64(0), (1 << 64) - (1 << unused)
        self.live.append([lane, w, k, text, 0, len(y) + w - 1, len(x) + len(y) + w - 1])

    def _pack(self) -> None:
        """Lanes of live pairs move together, free ones behind them; those go, if no pair is to come."""
        kept = np.concatenate([np.arange(lane, lane + n) for lane, n, *_ in [*self.live, *(self.free if self.queue else ())]])
        self.masks, self.seen, self.steps = self.masks[kept], self.seen[kept], self.steps[:, kept]
        self.upper = np.append(self.upper[:-1].reshape(2, -1)[:, kept], np.uint64(0))
        lane = 0
        for p in self.live:
            p[0], lane = lane, lane + p[1]
        self.free = [(lane, len(kept) - lane)]

    def _columns(self) -> np.ndarray:
        """STEPS columns further. For each of them and each live pair, how far its last row has stayed behind a step of +1 in each column."""
        n, masks, steps, upper, outer = len(self.seen), self.masks.ravel(), self.steps, self.upper[:-1], self.upper[1:]
        (down, up), falls = steps, upper[n:]
        first, wide = np.array([p[:2] for p in self.live]).T
        first, end = np.concatenate([first, first + n]), np.concatenate([first + wide, first + wide + n])
        comes = np.ascontiguousarray(np.array([p[3][p[4] : p[4] + STEPS] for p in self.live]).T).astype(np.int64)
        heads, seen, table = first[: len(wide)], np.append(np.zeros(STEPS, np.int64), self.seen), np.arange(n) * self.letters
        place, (same, still), (gives, passed) = np.empty(n, np.int64), np.empty((2, n), np.uint64), np.empty((2, 2 * n), np.uint64)
        (g, h), (moved, fallen) = gives.reshape(2, n), passed.reshape(2, n)
        behind = np.empty((STEPS, 2 * len(wide)), np.uint64)
        plus, both, either, differ, right, last = np.add, np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.right_shift, np.array(63, np.uint64)
        for j in range(STEPS):  # as in _whole()
            now = seen[STEPS - 1 - j : STEPS - 1 - j + n]
            now[heads] = comes[j]
            plus(now, table, place)
            masks.take(place, None, same, "wrap")
            either(same, falls, same)
            both(same, up, still)
            plus(still, up, still)
            differ(still, up, still)
            either(still, same, still)
            either(still, down, still)
            either(still, up, g)
            differ(g, down, g)
            both(up, still, h)
            plus(gives, gives, passed)
            either(passed, upper, passed)
            right(gives, last, outer)
            self.upper.take(end, None, behind[j], "wrap")
            upper[first] = 0
            both(still, moved, same)
            differ(still, same, down)
            differ(moved, same, up)
            differ(up, fallen, up)
        self.seen = seen[:n].copy()
        return np.cumsum(behind[:, : len(wide)] + behind[:, len(wide) :], axis=0).astype(np.int64)

    def run(self) -> np.ndarray:
        """The distances."""
        self._fill()
        while self.live:
            stayed, going = self._columns(), []
            for i, p in enumerate(self.live):
                if p[5] <= STEPS:
                    self.out[p[2]] = p[6] - stayed[p[5] - 1, i]
                    self.free.append((p[0], p[1]))
                else:
                    p[4], p[5], p[6] = p[4] + STEPS, p[5] - STEPS, p[6] - stayed[-1, i]
                    going.append(p)
            self.live = going
            self._fill()
            if self.live and sum(n for _, n in self.free) > 0.15 * len(self.seen):
                self._pack()
                self._fill()
        return self.out


def _alone(a: str | bytes, b: str | bytes, aligned: int | None) -> int:
    """The distance of one pair, of which a is the longer."""
    if len(a) <= 2 * SAMPLE:
        return _whole(a, b)
    guess = aligned if aligned is not None else int(1.25 * len(a) * _whole(a[:SAMPLE], b[:SAMPLE]) / SAMPLE)
    most = max(SAMPLE // 8, len(a) - len(b), guess)
    while 2 * most < 0.8 * len(a):
        found = _within(a, b, most)
        if found is not None:
            return found
        most *= 2
    return _whole(a, b)


def distances(pairs: Iterable[tuple[str | bytes, str | bytes]]) -> list[int]:
    """Of each pair of texts the least number of characters to insert, delete or replace that turns one into the other."""
    out, beside, alone = [], [], []
    for k, (a, b) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        x, y = _points(a), _points(b)
        off = x[: len(y)] != y
        unlike = int(np.count_nonzero(off))
        start = int(off.argmax()) if unlike else len(y)
        off = x[start:][::-1][: len(y) - start] != y[start:][::-1]
        end = int(off.argmax()) if off.any() else len(y) - start
        x, y = x[start : len(x) - end], y[start : len(y) - end]
        out.append(len(x))
        if not len(y):
            continue
        aligned = unlike if len(x) == len(y) and 2 * unlike < len(x) else None
        if aligned is None or aligned != _least(x, y):
            aligned = _aligned(x, y) if len(x) > 2 * SAMPLE else None
        if aligned is not None and aligned == _least(x, y):
            out[k] = aligned
            continue
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        often = np.bincount(x) if len(x) < LONG else np.zeros(0, np.int64)
        found = np.flatnonzero(often)
        if 0 < len(found) < 255:
            beside.append((k, a, b, aligned, (x, y, found[np.argsort(-often[found], kind="stable")])))
        else:
            alone.append((k, a, b, aligned))
    if sum(len(p[1]) for p in beside) < 64 * FEW:
        alone, beside = alone + [p[:4] for p in beside], []
    for k, a, b, aligned in alone:
        out[k] = _alone(a, b, aligned)
    if beside:
        for p, d in zip(beside, _Lanes([p[4] for p in beside]).run().tolist()):
            out[p[0]] = d
    return out


def edit_distance(a: str | bytes, b: str | bytes) -> int:
    """distances() of one pair."""
    return distances([(a, b)])[0]


def distance(a: Column, b: Column) -> Column:
    """edit_distance() of two text columns, in Arrow batches; null if either is."""

    @F.pandas_udf("long")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        there = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
        found = iter(distances(there))
        return pd.Series([None if x is None or y is None else next(found) for x, y in zip(a, b)], dtype="Int64")

    return of(a, b)
