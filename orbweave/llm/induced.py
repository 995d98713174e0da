"""Suffix and common-prefix arrays of a shard by external induced sorting.

Suffixes that start at a local minimum (S*) are ordered first: their substrings up to the next one are sorted
and named, and where names repeat, the string of names is sorted by the same function. From these, a forward
scan induces the L-type suffixes and a backward scan all S-type ones. A scan takes suffixes from a priority
queue in order of (first character, order of the following suffix) and puts in the one before each. Tuples
carry the suffix's common prefix with the one put in before it in its bucket: one more than the least common
prefix between their followers, kept as the suffix minima of the scan (an increasing stack, at most ``cap``
values). With a ``folder``, memory holds no more than ``KEEP`` tuples of a queue, the head of each of its runs, and
those minima: queues write sorted runs there and merge them again as they are read (``FAN`` at a time, so that their
heads stay few), and the text, the types, the orders and the common prefixes at every level are files mapped into
memory, whose pages the system drops as it likes. So a shard may be far larger than memory. Without a folder all of it
stays in memory.

This is exact, and checked against brute force; but it does a few interpreted steps for each byte in each of
two scans and at each level, so ``suffix_dedup`` uses it for a shard only where it is asked to (``matcher``).
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

KEEP = 1 << 18
#: Runs of a queue that are merged into one.
FAN = 64


def numbers(folder: str | None, n: int, dtype: type = np.int64) -> np.ndarray | list[int]:
    """``n`` zeros: a list, or an array in a file of ``folder`` that goes with the last reference to it."""
    if folder is None:
        return [0] * n
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(max(1, n) * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


class Grown:
    """Integers appended one by one, then read as ``values()``."""

    def __init__(self, folder: str | None):
        self.folder, self.part, self.n = folder, array("q"), 0
        self.file = tempfile.TemporaryFile(dir=folder) if folder else None

    def append(self, x: int) -> None:
        self.part.append(x)
        if self.file and len(self.part) == 1 << 16:
            self.flush()

    def flush(self) -> None:
        self.n += len(self.part)
        self.part.tofile(self.file)
        self.part = array("q")

    def values(self) -> np.ndarray | list[int]:
        if not self.file:
            return self.part.tolist()
        self.flush()
        self.file.flush()
        if not self.n:
            return np.zeros(0, np.int64)
        with self.file as f:
            return np.memmap(f, np.int64, "r+", shape=(self.n,))


class Queue:
    """A priority queue of tuples with sorted runs on disk."""

    def __init__(self, folder: str | None, keep: int):
        self.folder, self.keep = folder, keep
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # the first tuple of each run, the run's number, and the rest of it
        self.runs = 0

    def push(self, x: tuple) -> None:
        heapq.heappush(self.heap, x)
        if self.folder and len(self.heap) > self.keep:
            self._spill()

    def _spill(self) -> None:
        f = tempfile.TemporaryFile(dir=self.folder)
        self.heap.sort()
        for a in range(0, len(self.heap), 4096):
            pickle.dump(self.heap[a : a + 4096], f, pickle.HIGHEST_PROTOCOL)
        f.seek(0)
        self.heap = []
        self._head(self._read(f), self.runs)
        self.runs += 1
        if len(self.heads) > FAN:
            self._merge()

    def _merge(self) -> None:
        """All runs as one."""
        heads, self.heads = self.heads, []
        f = tempfile.TemporaryFile(dir=self.folder)
        part: list[tuple] = []
        for x in heapq.merge(*(chain([x], rest) for x, _, rest in heads)):
            part.append(x)
            if len(part) == 4096:
                pickle.dump(part, f, pickle.HIGHEST_PROTOCOL)
                part = []
        if part:
            pickle.dump(part, f, pickle.HIGHEST_PROTOCOL)
        f.seek(0)
        self._head(self._read(f), self.runs)
        self.runs += 1

    @staticmethod
    def _read(f) -> Iterator[tuple]:
        with f:
            while True:
                try:
                    part = pickle.load(f)
                except EOFError:
                    return
                yield from part

    def _head(self, rest: Iterator[tuple], run: int) -> None:
        x = next(rest, None)
        if x is not None:
            heapq.heappush(self.heads, (x, run, rest))

    def first(self) -> tuple | None:
        a = self.heap[0] if self.heap else None
        b = self.heads[0][0] if self.heads else None
        return b if a is None or (b is not None and b < a) else a

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            x, run, rest = heapq.heappop(self.heads)
            self._head(rest, run)
            return x
        return heapq.heappop(self.heap)


class Minima:
    """Least of the values from a time on, for values that come one at a time."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.values: list[int] = []

    def add(self, t: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.at.pop()
        self.values.append(value)
        self.at.append(t)

    def since(self, t: int) -> int:
        return self.values[bisect_left(self.at, t)]


def suffix_array(text: Sequence[int], cap: int, folder: str | None = None, keep: int = KEEP) -> tuple[Sequence[int], Sequence[int]]:
    """Suffixes of ``text`` (integers above 0) in order, and the common prefix of each with the one before, at most ``cap``."""
    n = len(text)
    if not n:
        return [], []
    t = numbers(folder, n + 1)
    t[:n] = text
    small = numbers(folder, n + 1, np.uint8)  # S-type
    small[n] = 1
    run = numbers(folder, n + 1)
    run[n] = 1
    for i in range(n - 1, -1, -1):
        here, after = t[i], t[i + 1]
        small[i] = here < after or (here == after and small[i + 1])
        run[i] = run[i + 1] + 1 if here == after else 1
    found = Grown(folder)
    for i in range(1, n + 1):
        if small[i] and not small[i - 1]:
            found.append(i)
    stars, star_lcp = _stars(t, small, found.values(), cap, folder, keep)
    letters = int(max(t)) + 1

    def scan(backward: bool, given: Sequence[int], given_lcp: Sequence[int]) -> tuple[Sequence[int], Sequence[int], Sequence[int]]:
        """``given`` suffixes in scan order, with what they share with the one before, merged with those they induce."""
        sign = -1 if backward else 1
        queue, minima, last = Queue(folder, keep), Minima(), numbers(folder, letters)
        order, lcps, own = Grown(folder), Grown(folder), Grown(folder)
        g, now, before, induced = 0, 0, -1, False
        while True:
            top = queue.first()
            if top is not None and (g == len(given) or top[0] <= sign * int(t[given[g]])):
                _, _, i, lcp = queue.pop()
                induced = True
            elif g < len(given):
                i, lcp = int(given[g]), int(given_lcp[g])
                g += 1
                if before >= 0 and induced:  # the first given one after induced ones
                    lcp = min(int(run[i]), int(run[before]), cap) if t[i] == t[before] else 0
                induced = False
            else:
                return order.values(), lcps.values(), own.values()
            order.append(i)
            lcps.append(lcp)
            own.append(int(induced))
            minima.add(now, lcp)
            before = i
            if i and bool(small[i - 1]) == backward:
                c = int(t[i - 1])
                shared = min(cap, 1 + minima.since(int(last[c]))) if last[c] else 0
                queue.push((sign * c, now, i - 1, shared))
                last[c] = now + 1
            now += 1

    order, lcps, own = scan(False, stars, star_lcp)
    back, back_lcp = Grown(folder), Grown(folder)
    after = 0  # the last one shares nothing with what follows
    for k in range(len(order) - 1, -1, -1):
        if own[k]:
            back.append(int(order[k]))
            back_lcp.append(after)
            after = int(lcps[k])
    order, lcps, _ = scan(True, back.values(), back_lcp.values())
    out = numbers(folder, len(order))
    out[:] = order[::-1]
    common = numbers(folder, len(order))
    common[1:] = lcps[:0:-1]
    return out, common


def _stars(t: Sequence[int], small: Sequence[int], stars: Sequence[int], cap: int, folder: str | None, keep: int) -> tuple[Sequence[int], Sequence[int]]:
    """S* suffixes in order, and their common prefixes."""
    count = len(stars)
    names = numbers(folder, count)
    queue = Queue(folder, keep)
    for k in range(count):
        i = int(stars[k])
        end = int(stars[k + 1]) if k + 1 < count else i
        queue.push((tuple(2 * int(t[j]) + int(small[j]) for j in range(i, end + 1)), k))
    name, previous = 0, None
    for _ in range(count):
        key, k = queue.pop()
        name += key != previous
        previous = key
        names[k] = name
    if name == count:
        ranked, common = numbers(folder, name), numbers(folder, name)
        for k in range(count):
            ranked[names[k] - 1] = k
    else:
        ranked, common = suffix_array(names, cap, folder, keep)
    order, out = numbers(folder, count), numbers(folder, count)
    for r in range(count):
        b = int(ranked[r])
        order[r] = stars[b]
        if r:
            a, k = int(ranked[r - 1]), int(common[r])
            same = int(stars[b + k] - stars[b]) if b + k < count else cap
            x, y = int(stars[a]) + same, int(stars[b]) + same
            while same < cap and x < len(t) and y < len(t) and t[x] == t[y]:
                same, x, y = same + 1, x + 1, y + 1
            out[r] = min(same, cap)
    return order, out


def matcher(parts: list[bytes], length: int, folder: str | None = "", keep: int = KEEP) -> list[np.ndarray]:
    """Which windows of these byte strings occur more than once among all of theirs: neighbours with a common prefix of ``length``.

    ``folder``: where queues and arrays lie; by default the process's own folder for temporary files, which on an
    executor holds what a task needs while it runs, as Spark's own spills do. ``None``: in memory.
    """
    folder = tempfile.gettempdir() if folder == "" else folder
    text = numbers(folder, sum(len(x) + 1 for x in parts), np.int16)
    at = 0
    for x in parts:
        codes = np.frombuffer(x, np.uint8).astype(np.int16) + 2
        text[at : at + len(x)] = codes if folder else codes.tolist()
        text[at + len(x)] = 1
        at += len(x) + 1
    order, lcp = suffix_array(text, length, folder, keep)
    hit = np.zeros(len(text), bool)
    for a in range(0, len(order), 1 << 20):
        near = np.asarray(lcp[a : a + (1 << 20) + 1]) >= length
        some = np.asarray(order[a : a + (1 << 20)])
        both = near[: len(some)].copy()
        both[: len(near) - 1] |= near[1:][: len(some)]
        hit[some[both]] = True
    starts = np.cumsum([0, *(len(x) + 1 for x in parts)])
    return [hit[s : s + max(0, len(x) - length + 1)] for s, x in zip(starts, parts, strict=False)]
