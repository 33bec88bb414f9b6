"""Suffixes of a shard in order, with common-prefix lengths, by external induced sorting.

A suffix that rises (is smaller than the next one) behind one that falls is a seed. Seeds are sorted by what lies between
them, named, and sorted by recursion over the sequence of names, down to one that fits the memory limit. A sweep over the
symbols upwards then induces all falling suffixes from them, and one downwards all rising ones: each scanned suffix gives
the one that starts a symbol earlier, which joins the queue of its own leading symbol behind all smaller ones. So queues
together are a monotone priority queue of suffix tuples, appended to and drained in order. Rare symbols share a
queue, which in its turn is taken whole.

In the last sweeps, over the bytes, a tuple carries the length of the common prefix with the one before it in its queue:
one more than the least such length among the suffixes scanned in between.

What is beyond the memory limit, text, seeds, names, orders and queues, is in anonymous files in Spark's local folder.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Common prefixes are not followed further.
CAP = 200
SEPARATOR = 0


def scratch_file():
    """An unlinked file where Spark itself spills; it goes with the task."""
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


class Limit:
    """The memory limit, and what follows from it: how many tuples are handled at once and which arrays are files."""

    def __init__(self, memory: int) -> None:
        self.memory, self.chunk = memory, max(16, memory // 256)

    def array(self, n: int, kind: type) -> np.ndarray:
        small = n * np.dtype(kind).itemsize <= self.memory // 8
        return np.zeros(n, kind) if small or not n else np.asarray(np.memmap(scratch_file(), kind, "w+", shape=(n,)))

    def slices(self, n: int) -> Iterator[slice]:
        return (slice(i, min(n, i + self.chunk)) for i in range(0, n, self.chunk))


class Queues:
    """First-in-first-out queues of (start, common prefix) by bucket; beyond half the limit they go to a file together."""

    def __init__(self, limit: Limit) -> None:
        self.parts: dict[int, list[tuple]] = {}
        self.most, self.held, self.file = limit.memory // 2, 0, None

    def push(self, bucket: int, starts: np.ndarray, common: np.ndarray | None = None) -> None:
        common = np.zeros(len(starts), np.uint8) if common is None else common
        self.parts.setdefault(bucket, []).append((starts.astype(np.int32, copy=False), common))
        self.held += 5 * len(starts)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or scratch_file()
        for parts in self.parts.values():
            live = [p for p in parts if len(p) == 2]
            if live:
                starts, common = (np.concatenate(x) for x in zip(*live, strict=True))
                at = self.file.seek(0, 2)
                self.file.write(starts.tobytes() + common.tobytes())
                parts[:] = [p for p in parts if len(p) == 3] + [(at, np.array([0, len(starts)]), len(starts))]
        self.held = 0

    def read(self, at: int, n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at + 4 * lo)
        starts = np.frombuffer(self.file.read(4 * (hi - lo)), np.int32)
        self.file.seek(at + 4 * n + lo)
        return starts, np.frombuffer(self.file.read(hi - lo), np.uint8)

    def take(self, bucket: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The next tuples of a bucket, about ``most``; none at its end."""
        found, size, parts = [], 0, self.parts.get(bucket, [])
        while parts and size < most:
            if len(parts[0]) == 2:
                found.append(parts.pop(0))
                self.held -= 5 * len(found[-1][0])
            else:
                at, span, n = parts[0]
                lo, hi = int(span[0]), int(min(span[1], span[0] + most - size))
                found.append(self.read(at, n, lo, hi))
                span[0] = hi
                if hi == span[1]:
                    parts.pop(0)
            size += len(found[-1][0])
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def backward(self, bucket: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a bucket, the last ones first, each piece in its own order."""
        for part in reversed(self.parts.get(bucket, [])):
            if len(part) == 2:
                yield part
            else:
                at, span, n = part
                for hi in range(int(span[1]), int(span[0]), -most):
                    yield self.read(at, n, max(int(span[0]), hi - most), hi)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, and where each key's run begins and ends in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    bounds = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]]) if len(k) else np.zeros(1, np.int64)
    return order, bounds[:-1], bounds[1:]


class Blocks:
    """Symbols by queue: a symbol with many suffixes has its own, others share one with their neighbours."""

    def __init__(self, seq: np.ndarray, n: int, limit: Limit) -> None:
        counts = np.zeros(int(seq[:n].max()) + 1, np.int64)
        for part in limit.slices(n):
            np.add.at(counts, seq[part], 1)
        size = 16 if len(counts) <= 256 else max(16, min(limit.chunk, n // 128))
        heavy, share = counts >= size, (np.cumsum(counts) - counts) // size
        new = np.ones(len(counts), bool)
        new[1:] = (share[1:] != share[:-1]) | heavy[1:] | heavy[:-1]
        self.of = (np.cumsum(new) - 1).astype(np.int32)
        self.single = np.bincount(self.of) == 1


def forward(queues: Queues, bucket: int, most: int) -> Iterator[np.ndarray]:
    while len((part := queues.take(bucket, most)[0])):
        yield part


def rises(seq: np.ndarray, n: int, i: int) -> bool:
    """Whether suffix i is smaller than the next one; the last one is not."""
    for j in range(i + 1, n, 4096):
        other = np.flatnonzero(seq[j : min(n, j + 4096)] != seq[i])
        if len(other):
            return bool(seq[j + other[0]] > seq[i])
    return False


def rising_seeds(seq: np.ndarray, n: int, limit: Limit) -> np.ndarray:
    """Positions of the rising suffixes behind a falling one, in order."""
    found, total, before = Queues(limit), 0, True
    for part in limit.slices(n):
        symbols = seq[part.start : min(n, part.stop + 1)].astype(np.int64)
        step = np.append(np.diff(symbols), [0] * (part.stop - part.start - len(symbols) + 1))
        change = np.where(step != 0, np.arange(len(step)), len(step))
        change = np.minimum.accumulate(change[::-1])[::-1]  # the next place where the symbol changes
        tail = rises(seq, n, part.stop - 1) if change[-1] == len(step) else False
        up = np.where(change < len(step), step[np.minimum(change, len(step) - 1)] > 0, tail)
        seeds = np.flatnonzero(up & ~np.append(before, up[:-1])) + part.start
        found.push(0, seeds)
        total, before = total + len(seeds), up[-1]
    out, at = limit.array(total, np.int32), 0
    for starts in forward(found, 0, limit.chunk):
        out[at : at + len(starts)] = starts
        at += len(starts)
    return out


def sweep(seq: np.ndarray, n: int, blocks: Blocks, given: Callable[[int], Iterator[np.ndarray]], d: int, limit: Limit, out: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """Induce falling suffixes from given(block), the seeds, upwards (d = 1), or rising from falling ones downwards (-1).

    out(block, starts, induced) gets each block's suffixes in the order of the sweep: of a symbol, first what was induced.
    """
    queues = Queues(limit)

    def push(starts: np.ndarray) -> None:
        block = blocks.of[seq[starts]]
        order, first, end = groups(block)
        for i, j in zip(first.tolist(), end.tolist(), strict=True):
            queues.push(int(block[order[i]]), starts[order[i:j]])

    def predecessors(starts: np.ndarray, symbols: np.ndarray, induced: np.ndarray) -> np.ndarray:
        """True where the suffix that starts a symbol earlier is of the kind that this sweep induces."""
        before = d * seq[np.maximum(starts, 1) - 1].astype(np.int64)
        return (starts > 0) & np.where(induced, before >= symbols, before > symbols)

    if d > 0:
        push(np.array([n - 1], np.int32))  # behind the last suffix is the empty one
    count = len(blocks.single)
    for b in range(count) if d > 0 else range(count - 1, -1, -1):
        if blocks.single[b]:
            for kind, pieces in ((True, forward(queues, b, limit.chunk)), (False, given(b))):
                for starts in pieces:
                    induced = np.full(len(starts), kind)
                    out(b, starts, induced)
                    push(starts[predecessors(starts, d * seq[starts].astype(np.int64), induced)] - 1)
            continue
        parts = [list(forward(queues, b, limit.chunk)), list(given(b))]
        starts = np.concatenate([np.zeros(0, np.int32), *parts[0], *parts[1]])
        if not len(starts):
            continue
        induced = np.arange(len(starts)) < sum(map(len, parts[0]))
        # A symbol's suffixes come in three parts: induced before this block's turn, induced in it, given.
        key = 3 * d * seq[starts].astype(np.int64) + np.where(induced, 0, 2)
        order = np.argsort(key, kind="stable")
        starts, key, induced = starts[order], key[order], induced[order]
        go = predecessors(starts, (key - np.where(induced, 0, 2)) // 3, induced)
        inside = np.flatnonzero(go)
        inside = inside[blocks.of[seq[starts[inside] - 1]] == b]
        if len(inside):
            heap = list(zip(key[inside].tolist(), inside.tolist(), starts[inside].tolist(), strict=True))
            more, more_key = [], []
            while heap:
                _, _, start = heapq.heappop(heap)
                symbol = d * int(seq[start - 1])
                more.append(start - 1)
                more_key.append(3 * symbol + 1)
                if start > 1 and d * int(seq[start - 2]) >= symbol and blocks.of[seq[start - 2]] == b:
                    heapq.heappush(heap, (3 * symbol + 1, len(more), start - 1))
            key = np.concatenate([key, np.array(more_key, np.int64)])
            order = np.argsort(key, kind="stable")
            starts = np.concatenate([starts, np.array(more, np.int32)])[order]
            induced = np.concatenate([induced, np.ones(len(more), bool)])[order]
            go = predecessors(starts, d * seq[starts].astype(np.int64), induced)
        out(b, starts, induced)
        starts = starts[go] - 1
        push(starts[blocks.of[seq[starts]] != b])


def induce(seq: np.ndarray, n: int, blocks: Blocks, seeds: Callable[[int], Iterator[np.ndarray]], limit: Limit, out: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Both sweeps; out(starts, rising) gets all suffixes, the largest first."""
    falling = Queues(limit)
    sweep(seq, n, blocks, seeds, 1, limit, lambda b, starts, induced: falling.push(b, starts[induced]))
    back = lambda b: (starts[::-1] for starts, _ in falling.backward(b, limit.chunk))
    sweep(seq, n, blocks, back, -1, limit, lambda b, starts, induced: out(starts, induced))


class Ranks:
    """How many seeds are before a position."""

    def __init__(self, seeds: np.ndarray, n: int, limit: Limit) -> None:
        self.bits, self.before = limit.array(n // 64 + 1, np.uint64), limit.array(n // 64 + 2, np.int64)
        for part in limit.slices(len(seeds)):
            starts = seeds[part]
            np.bitwise_or.at(self.bits, starts >> 6, np.uint64(1) << (starts & 63).astype(np.uint64))
            np.add.at(self.before, (starts >> 6) + 1, 1)
        np.cumsum(self.before, out=self.before)

    def of(self, starts: np.ndarray) -> np.ndarray:
        word, low = starts >> 6, (np.uint64(1) << (starts & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & low)


def name_seeds(seq: np.ndarray, n: int, seeds: np.ndarray, order: np.ndarray, limit: Limit) -> tuple[np.ndarray, int]:
    """Ranks of what lies between seeds, by seed, and their number; order: seeds, sorted by that."""
    m, names, last, previous = len(seeds), limit.array(len(seeds), np.int32), -1, None
    ranks = Ranks(seeds, n, limit)
    for part in limit.slices(m):
        b = order[part].astype(np.int64)
        a = np.append(b[:1] if previous is None else previous, b[:-1])
        at_a, at_b = ranks.of(a), ranks.of(b)
        end = lambda at: np.where(at < m - 1, seeds[np.minimum(at + 1, m - 1)], n)
        size = end(at_b) - b + 1
        same = (end(at_a) - a + 1 == size) & (at_a < m - 1) & (at_b < m - 1)  # the last one ends with the text
        live = np.flatnonzero(same)
        for k in range(CAP):
            live = live[k < size[live]]
            if not len(live):
                break
            differ = seq[a[live] + k] != seq[b[live] + k]
            same[live[differ]] = False
            live = live[~differ]
        if previous is None:
            same[0] = False
        rank = last + np.cumsum(~same)
        names[at_b] = rank
        last, previous = int(rank[-1]), b[-1:]
    return names, last + 1


def sorted_seeds(seq: np.ndarray, n: int, blocks: Blocks, limit: Limit) -> np.ndarray:
    """Seeds in the order of their suffixes, by recursion over their names."""
    seeds = rising_seeds(seq, n, limit)
    if not len(seeds):
        return seeds
    m, by_block = len(seeds), Queues(limit)
    for part in limit.slices(m):
        starts = seeds[part]
        block = blocks.of[seq[starts]]
        by, first, end = groups(block)
        for i, j in zip(first.tolist(), end.tolist(), strict=True):
            by_block.push(int(block[by[i]]), starts[by[i:j]])
    order, at = limit.array(m, np.int32), m

    def keep(starts: np.ndarray, rising: np.ndarray) -> None:
        nonlocal at
        mine = starts[rising & (starts > 0)]
        mine = mine[seq[np.maximum(mine, 1) - 1] > seq[mine]][::-1]
        order[at - len(mine) : at] = mine
        at -= len(mine)

    induce(seq, n, blocks, lambda b: forward(by_block, b, limit.chunk), limit, keep)
    names, kinds = name_seeds(seq, n, seeds, order, limit)
    if kinds < m:
        place = sorted_suffixes(names, limit)
        for part in limit.slices(m):
            order[part] = seeds[place[part]]
    return order


def seeds_of_block(seq: np.ndarray, seeds: np.ndarray, blocks: Blocks, limit: Limit) -> Callable[[int], Iterator[np.ndarray]]:
    counts = np.zeros(len(blocks.single), np.int64)
    for part in limit.slices(len(seeds)):
        np.add.at(counts, blocks.of[seq[seeds[part]]], 1)
    end = np.cumsum(counts)
    return lambda b: (seeds[i : min(int(end[b]), i + limit.chunk)] for i in range(int(end[b] - counts[b]), int(end[b]), limit.chunk))


def sorted_suffixes(seq: np.ndarray, limit: Limit) -> np.ndarray:
    """The order of all suffixes of a sequence of names."""
    n = len(seq)
    if n <= 16 or 40 * n <= limit.memory:
        return sort_names(np.asarray(seq))
    blocks = Blocks(seq, n, limit)
    seeds = sorted_seeds(seq, n, blocks, limit)
    order, at = limit.array(n, np.int32), n

    def keep(starts: np.ndarray, rising: np.ndarray) -> None:
        nonlocal at
        order[at - len(starts) : at] = starts[::-1]
        at -= len(starts)

    induce(seq, n, blocks, seeds_of_block(seq, seeds, blocks, limit), limit, keep)
    return order


def sort_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence that fits in memory, by doubling the compared length until all differ."""
    rank, n, size = names.astype(np.int64), len(names), 1
    order = np.argsort(rank, kind="stable")
    while size < n:
        key = rank * (n + 2) + np.append(rank[size:], np.full(size, -1)) + 1
        order = np.argsort(key, kind="stable")
        differ = np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(differ)
        if rank[order[-1]] == n - 1 or 2 * size > CAP:  # a name is a byte at least: what still ties is equal up to CAP
            break
        size *= 2
    return order


class Ranges:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 * (step := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of [lo, hi), none of them empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k)])
        return out


class Induction:
    """One sweep over the bytes: what each scanned suffix induces, with common prefixes."""

    def __init__(self, text: np.ndarray, limit: Limit) -> None:
        self.text, self.queues = text, Queues(limit)
        self.open = np.full(256, CAP, np.uint8)  # least common prefix of what was scanned since the last push to each queue
        self.empty = np.ones(256, bool)

    def scan(self, starts: np.ndarray, common: np.ndarray, induced: np.ndarray) -> None:
        """``induced`` marks the scanned suffixes whose predecessor is of the kind that this sweep sorts."""
        at = np.flatnonzero(induced)
        if len(at):
            before = starts[at] - 1
            byte = self.text[before]
            order, first, ends = groups(byte)
            at, before, byte = at[order], before[order], byte[order]
            lo = np.concatenate([[0], at[:-1] + 1])
            lo[first] = 0
            ranges = Ranges(common)
            least = ranges.least(lo, at + 1)
            heads = byte[first]
            least[first] = np.where(self.empty[heads], 0, np.minimum(least[first], self.open[heads]))
            new = np.where(self.empty[heads], 0, np.minimum(least[first] + np.uint8(1), CAP)).astype(np.uint8)
            least = np.minimum(least + np.uint8(1), CAP).astype(np.uint8)
            least[first] = new
            self.open = np.minimum(self.open, common.min())
            rest = at[ends - 1] + 1
            self.open[heads] = CAP
            some = rest < len(common)
            self.open[heads[some]] = ranges.least(rest[some], np.full(some.sum(), len(common)))
            self.empty[heads] = False
            for b, i, j in zip(heads.tolist(), first.tolist(), ends.tolist(), strict=True):
                self.queues.push(b, before[i:j], least[i:j])
        elif len(common):
            self.open = np.minimum(self.open, common.min())


def run_at(text: np.ndarray, i: int) -> int:
    """How often the byte at i is repeated from there on, up to CAP."""
    other = np.flatnonzero(text[i : i + CAP] != text[i])
    return int(other[0]) if len(other) else CAP


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of pairs of suffixes, up to CAP, eight bytes at a time; text has CAP + 8 bytes more."""
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    out, live = np.full(len(a), CAP, np.int64), np.arange(len(a))
    for step in range(0, CAP, 8):
        x = words[a[live] + step] ^ words[b[live] + step]
        some = x != 0
        low = x[some] & (~x[some] + np.uint64(1))
        out[live[some]] = step + (np.frexp(low.astype(np.float64))[1] - 1) // 8
        live = live[~some]
        if not len(live):
            break
    return np.minimum(out, CAP)


def repeated(data: np.ndarray, memory: int = 256 << 20) -> np.ndarray:
    """True for each start of CAP bytes that also start elsewhere in the text, whose pieces end with SEPARATOR."""
    n, limit = len(data), Limit(memory)
    text = limit.array(n + CAP + 16, np.uint8)
    text[:n] = data
    blocks = Blocks(text, n, limit)
    seeds = sorted_seeds(text, n, blocks, limit)
    found = limit.array(n, bool)
    counts = np.zeros(257, np.int64)
    for part in limit.slices(len(seeds)):
        counts[1:] += np.bincount(text[seeds[part]], minlength=256)
    bounds = np.cumsum(counts)

    def mark(starts: np.ndarray, common: np.ndarray, previous: int) -> int:
        long = np.flatnonzero(common >= CAP)
        found[starts[long]] = True
        found[np.append(previous, starts[:-1])[long]] = True
        return int(starts[-1])

    upward, falling, last = Induction(text, limit), Queues(limit), np.full(256, -1)
    upward.scan(np.array([n], np.int32), np.zeros(1, np.uint8), np.array([True]))
    for c in range(256):
        while len((taken := upward.queues.take(c, limit.chunk))[0]):
            starts, least = taken
            last[c] = mark(starts, least, last[c])
            falling.push(c, starts, least)
            upward.scan(starts, least, (starts > 0) & (text[np.maximum(starts, 1) - 1] >= c))
        previous = None
        for i in range(int(bounds[c]), int(bounds[c + 1]), limit.chunk):
            starts = seeds[i : min(int(bounds[c + 1]), i + limit.chunk)]
            a = np.append(starts[:1] if previous is None else previous, starts[:-1]).astype(np.int64)
            least = np.minimum(common_prefix(text, a, starts.astype(np.int64)), n - np.maximum(a, starts)).astype(np.uint8)
            if previous is None:
                least[0] = min(run_at(text, last[c]), run_at(text, int(starts[0]))) if last[c] >= 0 else 0
            previous = starts[-1:]
            upward.scan(starts, least, starts > 0)

    down = Induction(text, limit)
    for c in range(255, -1, -1):
        at = -1  # the last, so the least, rising suffix
        while len((taken := down.queues.take(c, limit.chunk))[0]):
            starts, least = taken
            at = mark(starts, least, at)
            down.scan(starts, least, (starts > 0) & (text[np.maximum(starts, 1) - 1] <= c))
        if last[c] < 0:
            continue
        edge = min(run_at(text, at), run_at(text, last[c])) if at >= 0 else 0
        if edge >= CAP:
            found[[at, last[c]]] = True
        for starts, least in falling.backward(c, limit.chunk):
            back, common = starts[::-1], np.append(np.uint8(edge), least[:0:-1])
            edge = int(least[0])
            down.scan(back, common, (back > 0) & (text[np.maximum(back, 1) - 1] < c))
    return np.asarray(found)
