"""External induced sorting of the suffixes of many terminated strings, with common-prefix values.

The text is an array of symbols in which 0 ends a string; terminators count as equal characters but as different
suffixes, in text order, so no common prefix goes beyond one.  One level works like this:

1. A backward scan finds for every position whether it is L (its suffix is larger than the next one) or S, and the
   length of the run of its character; S* is an S after an L.
2. The S*-substrings get names in order.  If names repeat, the string of names is sorted by the same procedure, which
   returns the order of the S*-suffixes and how many names neighbours share; the characters they share follow from the
   minimum of what neighbouring names share.
3. L-suffixes are induced from S*-suffixes, then S-suffixes from L-suffixes: a suffix becomes a tuple of the symbols up
   to the next suffix of known rank, and that rank; tuples go through a priority queue.  Common-prefix values of
   neighbours in the queue's order follow from the tuples and, where these tie, from the minimum of the known
   values between both ranks.

Everything that grows with the text is a ``Vector`` or a ``DiskQueue``: in memory up to ``limit`` entries, in files
beyond, read in blocks.  Joins by position are sorts through a queue; the lookups at scattered places (characters where
two tuples part, minima) read files in ascending order and give the pages back.  Memory is a few dozen blocks of
``limit`` entries whatever the text's length.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np

LIMIT = 1 << 18
FAN_IN = 128


class Vector:
    """Numbers written in order and read by ranges or places; beyond ``limit`` they live in a file without a name.

    wide: what is read is of 64 bits, whatever is stored.
    """

    def __init__(self, kind, folder: str, limit: int, wide: bool = False):
        self.kind, self.folder, self.limit, self.wide = np.dtype(kind), folder, limit, wide
        self.parts: list[np.ndarray] = []
        self.size, self.file, self.map = 0, None, None

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        for _, part in self.blocks(1 << 16):
            yield from part.tolist()

    def append(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.kind)
        self.size += len(values)
        if self.file is None:
            self.parts.append(values)
            if self.size > self.limit:
                self.file = tempfile.TemporaryFile(dir=self.folder, buffering=0)
                for part in self.parts:
                    _write(self.file, part)
                self.parts = []
        elif len(values):
            _write(self.file, values)

    def _held(self) -> np.ndarray:
        if len(self.parts) != 1:
            self.parts = [np.concatenate([np.empty(0, self.kind), *self.parts])]
        return self.parts[0]

    def read(self, a: int, b: int) -> np.ndarray:
        a, b = max(0, a), min(b, self.size)
        out = self._held()[a:b] if self.file is None else _read(self.file, self.kind, a, max(0, b - a))
        return out.astype(np.int64) if self.wide else out

    def blocks(self, step: int) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(0, self.size, step):
            yield a, self.read(a, a + step)

    def _mapped(self) -> np.ndarray:
        if self.map is None or len(self.map) != self.size * self.kind.itemsize:
            self.map = mmap.mmap(self.file.fileno(), self.size * self.kind.itemsize)
        return np.frombuffer(self.map, self.kind)

    def take(self, at: np.ndarray) -> np.ndarray:
        if self.file is None:
            return self._held()[at].astype(np.int64) if self.wide else self._held()[at]
        out, order = np.empty(len(at), self.kind), np.argsort(at, kind="stable")
        out[order] = self._mapped()[at[order]]
        self.map.madvise(mmap.MADV_DONTNEED)
        return out.astype(np.int64) if self.wide else out

    def put(self, at: np.ndarray, values: np.ndarray) -> None:
        if self.file is None:
            held = self._held()
            if not held.flags.writeable:
                self.parts = [held := held.copy()]
            held[at] = values
        else:
            self._mapped()[at] = values
            self.map.madvise(mmap.MADV_DONTNEED)  # pages of a file that is written stay in the system's cache


class Backwards:
    """A vector that was written from the last number to the first."""

    def __init__(self, vector: Vector):
        self.vector = vector

    def __len__(self) -> int:
        return len(self.vector)

    def read(self, a: int, b: int) -> np.ndarray:
        n = len(self.vector)
        return self.vector.read(n - min(b, n), n - a)[::-1]

    def take(self, at: np.ndarray) -> np.ndarray:
        return self.vector.take(len(self.vector) - 1 - at)


def _write(file, values: np.ndarray) -> None:
    data = memoryview(values).cast("B")
    while len(data):
        data = data[file.write(data) :]


def _read(file, kind: np.dtype, start: int, n: int) -> np.ndarray:
    out = np.empty(n, kind)
    data, at = memoryview(out).cast("B"), start * kind.itemsize
    while len(data):
        got = os.preadv(file.fileno(), [data], at)
        if not got:
            raise EOFError("a sort's file is shorter than what was written")
        data, at = data[got:], at + got
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    """The order of columns of tuples: one plain sort for each column, on the place among the columns before and the column's own."""
    place = rows[0]
    order = np.argsort(place)
    n = len(order)
    for column in rows[1:]:
        first = place[order]
        new = np.ones(n, bool)
        new[1:] = first[1:] != first[:-1]
        if new.all():
            break
        place = np.empty(n, np.uint64)
        place[order] = np.cumsum(new) - 1
        values = column
        if int(column.max()) >= 1 << 63 - n.bit_length():
            values = np.unique(column, return_inverse=True)[1].astype(np.uint64)
        place = place << np.uint64(int(values.max()).bit_length()) | values
        order = np.argsort(place)
    return order


def _arranged(rows: np.ndarray, keys: int) -> np.ndarray:
    """The tuples in order of their first ``keys`` columns."""
    if not rows.shape[1]:
        return rows
    order, out = _order(rows[:keys]), np.empty_like(rows)
    for k, column in enumerate(rows):
        np.take(column, order, out=out[k], mode="clip")
    return out


class DiskQueue:
    """A bulk priority queue of tuples of unsigned 64-bit numbers: ``keys`` columns that order them, then ``loads`` that don't.

    It holds ``limit`` tuples; beyond, they go to sorted runs in files, which are merged block by block.
    """

    def __init__(self, keys: int, loads: int, folder: str, limit: int = LIMIT):
        self.keys, self.columns, self.folder, self.limit = keys, keys + loads, folder, limit
        self.held: list[np.ndarray] = []
        self.count, self.runs = 0, []

    def push(self, *columns: np.ndarray) -> None:
        self.held.append(np.stack([np.asarray(c, np.uint64) for c in columns]))
        self.count += self.held[-1].shape[1]
        if self.count >= self.limit:
            self._spill([self._sorted()])

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.held, axis=1) if len(self.held) != 1 else self.held[0]
        self.held, self.count = [], 0
        return _arranged(rows, self.keys)

    def _spill(self, blocks, total: int | None = None) -> None:
        """One more run; a run holds its columns one after the other."""
        file = tempfile.TemporaryFile(dir=self.folder, buffering=0)
        at = 0
        for rows in blocks:
            n = rows.shape[1] if total is None else total
            for k in range(self.columns):
                data, place = memoryview(np.ascontiguousarray(rows[k])).cast("B"), (k * n + at) * 8
                while len(data):
                    put = os.pwrite(file.fileno(), data, place)
                    data, place = data[put:], place + put
            at += rows.shape[1]
        self.runs.append((file, at))
        if len(self.runs) >= FAN_IN and total is None:
            runs, self.runs = self.runs, []
            self._spill(self._merged(runs), sum(n for _, n in runs))

    def drain(self) -> Iterator[np.ndarray]:
        """All tuples in order, as blocks (columns, rows)."""
        if not self.runs:
            if self.held:
                yield self._sorted()
            return
        if self.count:
            self._spill([self._sorted()])
        runs, self.runs = self.runs, []
        yield from self._merged(runs)

    def _merged(self, runs) -> Iterator[np.ndarray]:
        at, size = [0] * len(runs), max(1024, self.limit // len(runs))
        kind = np.dtype(np.uint64)
        # what a run shows beyond the others' bound stays in its window, so every tuple is read once
        windows = [np.empty((self.columns, 0), np.uint64) for _ in runs]
        while True:
            for k, (file, n) in enumerate(runs):
                if windows[k].shape[1] < size and at[k] < n:
                    more = min(size, n - at[k])
                    fresh = np.stack([_read(file, kind, c * n + at[k], more) for c in range(self.columns)])
                    windows[k], at[k] = np.concatenate([windows[k], fresh], axis=1), at[k] + more
            last = [tuple(w[: self.keys, -1]) for w, a, (_, n) in zip(windows, at, runs, strict=True) if a < n]
            parts = windows
            if last:
                bound, parts = min(last), []
                for k, w in enumerate(windows):
                    below, equal = np.zeros(w.shape[1], bool), np.ones(w.shape[1], bool)
                    for column, b in zip(w[: self.keys], bound, strict=True):
                        below |= equal & (column < b)
                        equal &= column == b
                    cut = int(np.count_nonzero(below | equal))
                    parts.append(w[:, :cut])
                    windows[k] = w[:, cut:]
            rows = np.concatenate(parts, axis=1)
            if rows.shape[1]:
                yield _arranged(rows, self.keys)
            if not last:
                break
        for file, _ in runs:
            file.close()


class RangeMin:
    """Minimum of values[a+1..b] by a table of powers of two."""

    def __init__(self, values: Vector, step: int):
        self.rows = [values]
        while (1 << len(self.rows)) <= len(values):
            half, below = 1 << (len(self.rows) - 1), self.rows[-1]
            row = Vector(values.kind, values.folder, values.limit)
            for a in range(0, len(below) - half, step):
                b = min(a + step, len(below) - half)
                row.append(np.minimum(below.read(a, b), below.read(a + half, b + half)))
            self.rows.append(row)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in range(int(level.max(initial=-1)) + 1):
            own = np.flatnonzero(level == k)
            if len(own):
                row = self.rows[k]
                out[own] = np.minimum(row.take(a[own] + 1), row.take(b[own] - (1 << k) + 1))
        return out


class _Rows:
    """Tuples in order.  equal: twice the number of symbols equal to the tuple before, plus one if the symbols that part
    them are of one character; -1 if the tuples are equal."""

    def __init__(self, vector, bits: int):
        self.payload, self.size, self.rank, self.equal = (vector() for _ in range(4))
        self.first = vector(np.uint32 if bits <= 32 else np.uint64)  # symbols

    def close(self) -> None:
        """Only the order is needed from here on."""
        self.size = self.rank = self.equal = None


class Sorter:
    """Suffix order and capped common-prefix values.  cap: at most 255."""

    def __init__(self, cap: int, folder: str, limit: int = LIMIT):
        if not 0 < cap <= 255:
            raise ValueError("cap is 1 to 255")
        self.cap, self.folder, self.limit = cap, folder, limit
        self.step = max(1, limit // 4)
        self.places = np.dtype(np.int64)

    def vector(self, kind=None) -> Vector:
        """A vector of a kind, or of places and ranks."""
        return Vector(self.places if kind is None else kind, self.folder, self.limit, wide=kind is None)

    def sort(self, text: Vector | np.ndarray, terminated: bool = True) -> tuple[Vector, Vector]:
        """(suffixes in order, common prefix with the one before, at most cap).  terminated: zeros are terminators, the last symbol is one."""
        if not isinstance(text, Vector):
            own = self.vector(np.int64)
            own.append(text)
            text = own
        if terminated:  # names and places of deeper levels are smaller
            self.places = np.dtype(np.int32 if 2 * len(text) < 1 << 31 else np.int64)
        if len(text) <= 1:
            order, lcp = self.vector(), self.vector(np.uint8)
            order.append(np.zeros(len(text)))
            lcp.append(np.zeros(len(text)))
            return order, lcp
        sym, run, bits = self._symbols(text, terminated)
        stars = self._stars(sym, terminated)
        order, lcp = self._sorted_stars(sym, run, bits, stars, terminated)
        rank = self._by_place(order)
        larger = self._rows(sym, bits, self._larger(sym, stars, rank))
        larger_lcp = self._values(run, larger, lcp)
        larger.close()
        del order, lcp, rank, stars
        rank = self._by_place(larger.payload)
        smaller = self._rows(sym, bits, self._smaller(sym, rank, terminated))
        smaller_lcp = self._values(run, smaller, larger_lcp)
        smaller.close()
        return self._joined(run, larger, larger_lcp, smaller, smaller_lcp)

    def _symbols(self, text: Vector, terminated: bool):
        """Characters doubled, plus one for S; lengths of runs from each position on, at most 255; bits of a symbol."""
        top = max(int(part.max()) for _, part in text.blocks(self.step))
        sym, run = self.vector(np.uint16 if top < 1 << 15 else np.uint32 if top < 1 << 31 else np.uint64), self.vector(np.uint8)
        after, after_small, after_run = -1, True, 0
        for b in range(len(text), 0, -self.step):
            t = text.read(max(0, b - self.step), b).astype(np.int64)
            nxt = np.append(t[1:], after)
            same, up = t == nxt, t < nxt
            if after < 0:
                up[-1] = True
            if terminated:
                same &= t != 0
                up |= t == 0
            ends = np.flatnonzero(~same)
            at = np.cumsum(~same) - ~same  # the run's end that each position sees
            inside = at < len(ends)
            end = ends[np.minimum(at, len(ends) - 1)] if len(ends) else np.zeros(len(t), np.int64)
            small = np.where(inside, up[end], after_small)
            length = np.where(inside, end + 1, len(t) + after_run) - np.arange(len(t))
            sym.append(((t << 1) | small)[::-1])
            run.append(np.minimum(length, 255)[::-1])
            after, after_small, after_run = int(t[0]), bool(small[0]), int(length[0])
        return Backwards(sym), Backwards(run), (2 * top + 1).bit_length()

    def _stars(self, sym, terminated: bool) -> Vector:
        """Positions of S*; terminators and the last position are."""
        stars, before = self.vector(), 1
        for a in range(0, len(sym), self.step):
            s = sym.read(a, a + self.step)
            small = s & 1
            star = (small == 1) & (np.concatenate([[before], small[:-1]]) == 0)
            if terminated:
                star |= s <= 1
            if a + self.step >= len(sym):
                star[-1] = True
            stars.append(a + np.flatnonzero(star))
            before = int(small[-1])
        return stars

    def _by_place(self, order: Vector) -> Vector:
        """Ranks of what is sorted, in the order of its places."""
        queue, out = DiskQueue(1, 1, self.folder, self.limit), self.vector()
        for a, part in order.blocks(self.step):
            queue.push(part, np.arange(a, a + len(part)))
        for rows in queue.drain():
            out.append(rows[1])
        return out

    # -- tuples: blocks (place, symbols from there on, starts, sizes, ranks, payloads) ----------------

    def _starred(self, sym, stars: Vector, terminated: bool):
        j = 0
        for a in range(0, len(sym), self.step):
            known = stars.read(j, j + self.step + 1)
            own = int(np.searchsorted(known, a + self.step))
            starts = known[:own]
            size = np.ones(own, np.int64)
            follows = known[1 : own + 1]
            size[: len(follows)] = follows - starts[: len(follows)] + 1
            if terminated:
                size[sym.read(a, a + self.step)[starts - a] <= 1] = 1
            # a terminator is its own rank, so it never ties with another
            yield a, starts, size, np.where(size == 1, np.arange(j, j + own), 0), np.arange(j, j + own)
            j += own

    def _larger(self, sym, stars: Vector, rank: Vector):
        j = 0
        for a in range(0, len(sym), self.step):
            s = sym.read(a, a + self.step)
            starts = a + np.flatnonzero((s & 1) == 0)
            known, ranks = stars.read(j, j + self.step + 1), rank.read(j, j + self.step + 1)
            at = np.searchsorted(known, starts)
            yield a, starts, known[at] - starts + 1, ranks[at], starts
            j += int(np.searchsorted(known, a + self.step))

    def _smaller(self, sym, rank: Vector, terminated: bool):
        """From the end to the front, as the next L decides; terminators and the last symbol stand for themselves."""
        left, stop, stop_rank = len(rank), len(sym), 0
        for a in reversed(range(0, len(sym), self.step)):
            s = sym.read(a, a + self.step)
            small = (s & 1) == 1
            own = (s <= 1) if terminated else np.zeros(len(s), bool)
            if a + self.step >= len(sym):
                own[-1] = True
            stops = np.flatnonzero(~small | own)
            ranks, large = a + stops, ~small[stops]
            n = int(large.sum())
            ranks[large] = rank.read(left - n, left)
            left -= n
            stops, ranks = np.append(a + stops, stop), np.append(ranks, stop_rank)
            starts = a + np.flatnonzero(small)
            at = np.searchsorted(stops, starts)
            yield a, starts, stops[at] - starts + 1, ranks[at], starts
            stop, stop_rank = int(stops[0]), int(ranks[0])

    def _rows(self, sym, bits: int, feed, stars: Vector | None = None) -> _Rows:
        """The tuples of ``feed`` in order: by the symbols of the tuple, then by rank.  A payload is the tuple's start, or its number in ``stars``."""
        per = 63 // bits
        words = -(-6 // per)
        packed = per * words
        queue = DiskQueue(words + 1, 2, self.folder, self.limit)  # symbols and rank; payload, size
        for a, starts, size, rank, payload in feed:
            block = sym.read(a, a + self.step + packed)
            padded = np.zeros(self.step + packed, np.uint64)
            padded[: len(block)] = block
            queue.push(*_words(lambda j, at=starts - a: padded[at + j], size, per, words, bits), rank, payload, size)  # noqa: B023
        out, before, longer = _Rows(self.vector, bits), None, False
        shift = np.uint64(bits * (per - 1))
        for rows in queue.drain():
            equal, whole = _compared(rows[:words], before, per, bits)
            size = rows[words + 2].astype(np.int64)
            tied = np.flatnonzero(whole)
            equal[tied] = np.where(size[tied] <= packed, -1, -2)
            longer |= bool((equal == -2).any())
            out.payload.append(rows[words + 1])
            out.size.append(size)
            out.rank.append(rows[words])
            out.equal.append(equal)
            out.first.append(rows[0] >> shift)
            before = rows[:words, -1]
        if longer:
            self._untie(sym, bits, out, per, words, stars)
        return out

    def _untie(self, sym, bits: int, out: _Rows, per: int, words: int, stars: Vector | None) -> None:
        """Groups of tuples that agree in all packed symbols and are longer go on by their next symbols, round by round."""
        packed = per * words
        places = self.vector()
        for a, equal in out.equal.blocks(self.step):
            following = out.equal.read(a + 1, a + len(equal) + 1)
            tied = equal == -2
            tied[: len(following)] |= following == -2
            places.append(a + np.flatnonzero(tied))
        offset = packed
        while len(places):
            queue = DiskQueue(words + 2, 2, self.folder, self.limit)
            group = -1
            for a, at in places.blocks(self.step):
                equal = out.equal.take(at)
                groups = np.maximum.accumulate(np.where(equal == -2, -1, at))
                groups[groups < 0] = group
                group = int(groups[-1])
                size, rank, payload = out.size.take(at), out.rank.take(at), out.payload.take(at)
                starts = payload if stars is None else stars.take(payload)
                word = _words(lambda j: _symbols_at(sym, starts, size, offset + j), size - offset, per, words, bits)  # noqa: B023
                queue.push(groups, *word, rank, payload, size)
            done, last, count, before = self.vector(), -1, 0, None
            for rows in queue.drain():
                g = rows[0].astype(np.int64)
                new = np.concatenate([[g[0] != last], g[1:] != g[:-1]])
                head = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
                at = g + np.where(head < 0, count + np.arange(len(g)), np.arange(len(g)) - head)
                size = rows[words + 3].astype(np.int64)
                equal, whole = _compared(rows[1 : words + 1], before, per, bits)
                equal += 2 * offset
                equal[whole] = np.where(size[whole] <= offset + packed, -1, -2)
                out.payload.put(at, rows[words + 2])
                out.size.put(at, size)
                out.rank.put(at, rows[words + 1])
                inner = ~new
                out.equal.put(at[inner], equal[inner])
                done.append(at)
                count = (len(g) - int(head[-1])) if head[-1] >= 0 else count + len(g)
                last, before = int(g[-1]), rows[1 : words + 1, -1]
            places = self.vector()
            for _, at in done.blocks(self.step):
                equal, following = out.equal.take(at), np.minimum(at + 1, len(out.equal) - 1)
                tied = (equal == -2) | ((out.equal.take(following) == -2) & (following > at))
                places.append(at[tied])
            offset += packed

    # -- common prefixes ------------------------------------------------------------------------------

    def _parted(self, run, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Common characters of suffixes whose tuples part: the equal symbols, and the shorter run where one character is L and S."""
        out = equal >> 1
        more = np.flatnonzero(equal & 1)
        if len(more):
            out[more] += np.minimum(run.take(a[more] + out[more]), run.take(b[more] + out[more]))
        return out

    def _values(self, run, rows: _Rows, known: Vector) -> Vector:
        """Common prefixes of neighbours among sorted suffixes; known: those of the suffixes whose ranks ended the tuples."""
        least, out = None, self.vector(np.uint8)
        start, rank = -1, -1
        for a, starts in rows.payload.blocks(self.step):
            b = a + len(starts)
            size, ranks, equal = rows.size.read(a, b), rows.rank.read(a, b), rows.equal.read(a, b)
            before, ranks_before = np.append(start, starts[:-1]), np.append(rank, ranks[:-1])
            lcp = np.zeros(len(starts), np.int64)
            part = np.flatnonzero(equal >= 0)
            lcp[part] = self._parted(run, before[part], starts[part], equal[part])
            tie = np.flatnonzero(equal == -1)
            single = tie[size[tie] == 1]  # terminators
            lcp[single] = 1
            tie = tie[size[tie] > 1]
            if len(tie):
                least = RangeMin(known, self.step) if least is None else least
                r1, r2 = ranks_before[tie], ranks[tie]
                lcp[tie] = size[tie] - 1 + least.between(np.minimum(r1, r2), np.maximum(r1, r2))
            if a == 0:
                lcp[0] = 0
            out.append(np.minimum(lcp, self.cap))
            start, rank = int(starts[-1]), int(ranks[-1])
        return out

    def _sorted_stars(self, sym, run, bits: int, stars: Vector, terminated: bool) -> tuple[Vector, Vector]:
        """Order of the S*-suffixes (as numbers in text order) and their common-prefix values."""
        rows = self._rows(sym, bits, self._starred(sym, stars, terminated), stars)
        names, shared = DiskQueue(1, 1, self.folder, self.limit), self.vector(np.uint8)
        count = 0
        for a, equal in rows.equal.blocks(self.step):
            size = rows.size.read(a, a + len(equal))
            fresh = (equal != -1) | ((size == 1) & terminated)
            if a == 0:
                fresh[0] = True
            names.push(rows.payload.read(a, a + len(equal)), count + np.cumsum(fresh) - 1)
            shared.append(np.minimum(np.maximum(equal, 0) >> 1, 255)[fresh])
            count += int(fresh.sum())
        name = self.vector()
        for part in names.drain():
            name.append(part[1])
        if count == len(stars):
            order, matched = rows.payload, None
        else:
            text = self.vector()
            for _, part in name.blocks(self.step):
                text.append(part + 1)
            order, matched = self.sort(text, False)
        del rows
        least, out, last = RangeMin(shared, self.step), self.vector(np.uint8), 0
        for a, b in order.blocks(self.step):
            before = np.append(last, b[:-1])
            k = matched.read(a, a + len(b)).astype(np.int64) if matched is not None else np.zeros(len(b), np.int64)
            lcp = np.full(len(b), self.cap, np.int64)
            part = np.flatnonzero(k < self.cap)
            part = part[part + a > 0]
            x, y, k = before[part], b[part], k[part]
            from_x, from_y = stars.take(x + k), stars.take(y + k)
            same = from_x - stars.take(x)  # characters of the equal names
            n1, n2 = name.take(x + k), name.take(y + k)
            equal = least.between(np.minimum(n1, n2), np.maximum(n1, n2))
            same += equal
            p, q = from_x + equal, from_y + equal
            inside = np.flatnonzero((same < self.cap) & (np.maximum(p, q) < len(sym)))
            s1, s2 = sym.take(p[inside]), sym.take(q[inside])
            alike = inside[(s1 >> 1) == (s2 >> 1)]
            same[alike] += np.minimum(run.take(p[alike]), run.take(q[alike]))
            lcp[part] = same
            if a == 0:
                lcp[0] = 0
            out.append(np.minimum(lcp, self.cap))
            last = int(b[-1])
        return order, out

    def _joined(self, run, larger: _Rows, larger_lcp: Vector, smaller: _Rows, smaller_lcp: Vector) -> tuple[Vector, Vector]:
        """Both kinds merged by their first symbol; in one character L stands before S."""
        sides = ((larger, larger_lcp), (smaller, smaller_lcp))
        at, order, lcp, last = [0, 0], self.vector(), self.vector(np.uint8), None
        while any(a < len(rows.first) for a, (rows, _) in zip(at, sides, strict=True)):
            firsts = [rows.first.read(a, a + self.step) for a, (rows, _) in zip(at, sides, strict=True)]
            bound = min((int(f[-1]) for f, a, (rows, _) in zip(firsts, at, sides, strict=True) if a + len(f) < len(rows.first)), default=None)
            # a side whose block may go on with the bound's symbol still gives all it shows of it: no other side has that symbol
            cut = [len(f) if bound is None else int(np.searchsorted(f, bound, "right")) for f in firsts]
            first = np.concatenate([f[:c] for f, c in zip(firsts, cut, strict=True)]).astype(np.int64)
            places = np.concatenate([rows.payload.read(a, a + c) for a, c, (rows, _) in zip(at, cut, sides, strict=True)])
            values = np.concatenate([v.read(a, a + c) for a, c, (_, v) in zip(at, cut, sides, strict=True)]).astype(np.int64)
            merged = np.argsort(first, kind="stable")
            first, places, values = first[merged], places[merged], values[merged]
            before_first, before = (np.append(first[0] if last is None else last[0], first[:-1]), np.append(places[0] if last is None else last[1], places[:-1]))
            edge = np.flatnonzero(before_first != first)
            alike = edge[(before_first[edge] >> 1) == (first[edge] >> 1)]
            values[edge] = 0
            values[alike] = np.minimum(run.take(before[alike]), run.take(places[alike]))
            order.append(places)
            lcp.append(np.minimum(values, self.cap))
            last = (int(first[-1]), int(places[-1]))
            at = [a + c for a, c in zip(at, cut, strict=True)]
        return order, lcp


def _symbols_at(sym, starts: np.ndarray, size: np.ndarray, j: int) -> np.ndarray:
    """The j-th symbol of tuples that have one; anything for the others."""
    return sym.take(np.where(j < size, starts + j, starts)).astype(np.uint64)


def _words(symbol, size: np.ndarray, per: int, words: int, bits: int) -> list[np.ndarray]:
    """Symbols packed into words, ``per`` to a word; zeros beyond the tuple."""
    out = []
    for w in range(words):
        word = np.zeros(len(size), np.uint64)
        for j in range(w * per, (w + 1) * per):
            word <<= np.uint64(bits)
            word |= np.where(j < size, symbol(j), np.uint64(0))
        out.append(word)
    return out


def _compared(words: np.ndarray, before: np.ndarray | None, per: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What each tuple shares with the one before it (see ``_Rows.equal``), and where all symbols agree."""
    m = words.shape[1]
    first = words[:, :1] ^ (np.uint64(2) << np.uint64(bits * (per - 1))) if before is None else before[:, None]
    shifted = np.concatenate([first, words[:, :-1]], axis=1)
    same, count, type_only = np.ones(m, bool), np.zeros(m, np.int64), np.zeros(m, bool)
    mask = np.uint64((1 << bits) - 1)
    for w in range(len(words)):
        differ = words[w] ^ shifted[w]
        # the bit after the highest goes, so that the conversion can't round up to the next power of two
        top = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
        place = -(-top // bits)  # symbols from the word's end up to the one that differs
        count += np.where(same, per - place, 0)
        own = same & (differ != 0)
        at = np.flatnonzero(own)
        type_only[at] = (differ[at] >> (np.uint64(bits) * (place[at] - 1).astype(np.uint64)) & mask) == 1
        same &= differ == 0
    return 2 * count + type_only, same
