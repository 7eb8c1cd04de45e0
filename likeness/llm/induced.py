"""Sorting all suffixes of many short texts by external induction, with their common prefixes.

The text is a file of bytes: pieces (each byte plus one) with a zero after each; a zero ends every
comparison. Suffixes smaller than their right neighbour are type S, the others L; a seed is an S
suffix after an L suffix. Substrings between seeds are named, the names form a text a third as long
that is ordered by recursion, and the order of the seeds induces all others: suffix tuples
(position, length of the common prefix with the one before) pass through one queue per first byte,
first upwards for L, then downwards for S. The queues live on disk beyond a bound of memory; types,
names, seeds and distances to the ends are whole arrays in memory, as is the recursion. Common prefixes are carried along: that
of two induced suffixes is one more than the least one between the two that induced them.
"""

from __future__ import annotations

import os


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def types(t):
    """True where a suffix is smaller than its right neighbour; zeros are."""
    import numpy as np

    n = len(t)
    cut = np.ones(n, bool)
    cut[:-1] = (t[:-1] != t[1:]) | (t[:-1] == 0)
    ends = np.flatnonzero(cut)
    after = np.zeros(len(ends), t.dtype)
    after[:-1] = t[ends[:-1] + 1]
    rises = (t[ends] < after) | (t[ends] == 0)
    return np.repeat(rises, np.diff(np.concatenate([[-1], ends])))


def _named(t, small, seeds):
    """For each seed the rank (from 1) of its substring up to the next seed, zeros have 0; and whether no two are alike."""
    import numpy as np

    u = np.uint64
    inner = t[seeds] != 0
    ends = np.concatenate([seeds[1:], [len(t) - 1]])
    code = t.astype(np.uint64) * u(2) + small.astype(np.uint64)
    begin = seeds[0]
    at = np.repeat(seeds, np.diff(np.append(seeds, len(t))))
    value = _mix(code[begin:] * u(0x9E3779B97F4A7C15) + _mix((np.arange(begin, len(t)) - at).astype(np.uint64) + u(1)))
    h = np.add.reduceat(value, seeds - begin) + _mix(code[ends] * u(0xD1342543DE82EF95) + (ends - seeds).astype(np.uint64))
    mine = np.flatnonzero(inner)
    kinds, first, which = np.unique(h[mine], return_index=True, return_inverse=True)
    wide = code.astype(">u2") if int(t.max()) < 30_000 else code.astype(">u8")
    raw, size = wide.tobytes(), wide.itemsize
    a, b = seeds[mine[first]], ends[mine[first]] + 1
    words = [raw[x * size : y * size] for x, y in zip(a.tolist(), b.tolist())]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(1, len(words) + 1)
    names = np.zeros(len(seeds), np.int64)
    names[mine] = rank[which]
    return names, len(words) == len(mine)


def seed_order(t, small, direct: int = 4_000_000):
    """Seeds (zeros included) in the order of their suffixes."""
    import numpy as np

    start = small.copy()
    start[1:] &= ~small[:-1]
    start[0] = False
    seeds = np.flatnonzero(start | (t == 0))
    if not (t[seeds] != 0).any():
        return seeds
    names, unique = _named(t, small, seeds)
    return seeds[np.argsort(names, kind="stable") if unique else order(names, direct)]


def _insert(low, low_keys, high, high_keys, side: str):
    """Two sorted lists as one; ``side`` left: equal keys of ``high`` come first."""
    import numpy as np

    at = np.searchsorted(low_keys, high_keys, side) + np.arange(len(high))
    out = np.empty(len(low) + len(high), np.int64)
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = high, low
    return out


def doubled(t):
    """The same as ``order`` for a text that fits in memory easily: ranks by 1, 2, 4.. names until no piece is longer."""
    import numpy as np

    n = len(t)
    ends = np.flatnonzero(t == 0)
    left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)
    rank, step, longest = t.astype(np.int64), 1, int(left.max())
    while step < longest:
        second = np.zeros(n, np.int64)
        reach = np.flatnonzero(left > step)
        second[reach] = rank[reach + step]
        key = rank * (int(rank.max()) + 1) + second
        at = np.argsort(key)
        key = key[at]
        rank[at] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if int(rank.max()) == n - len(ends):  # all but the zeros differ
            break
        step *= 2
    return np.sort(rank * n + np.arange(n)) % n  # equal ones in place order; both factors are small


def order(t, direct: int = 4_000_000):
    """All positions of a text of names in the order of their suffixes; zeros come first, in place order.

    The recursion ends at texts of at most ``direct`` names. Used for the recursion, whose texts are small. Names are many, so instead of one queue per name
    a round takes the next step of all chains at once: suffixes are ordered by (name, place of
    the suffix after them), which is what a priority queue of such tuples would give out.
    """
    import numpy as np

    n = len(t)
    if n <= direct:
        return doubled(t)
    small = types(t)
    seeds = seed_order(t, small, direct)
    place = np.full(n, -1, np.int64)

    def chains(known, wanted, found_first: bool):
        """Suffixes of the wanted type, induced from ``known``; the union is ordered after every round."""
        found = np.zeros(0, np.int64)
        union = known
        place[union] = np.arange(len(union))
        front = known
        while True:
            front = front[front > 0] - 1
            front = front[wanted[front] & (t[front] != 0)]
            if not len(front):
                return found, union
            m = len(union) + 1
            key = t[front] * m + place[front + 1]
            front = front[np.argsort(key, kind="stable")]
            found = _insert(found, t[found] * m + place[found + 1], front, t[front] * m + place[front + 1], "left")
            union = _insert(known, t[known], found, t[found], "left" if found_first else "right")
            place[union] = np.arange(len(union))

    large, _ = chains(seeds, ~small, True)
    less, both = chains(large, small, False)
    return np.concatenate([np.flatnonzero(t == 0), both])


class Queues:
    """One first-in first-out queue of (position, prefix) per byte; what exceeds ``held`` tuples waits in files."""

    def __init__(self, folder: str, name: str, held: int = 4_000_000):
        self.folder, self.name, self.held = folder, name, held
        self.waiting: list[list] = [[] for _ in range(257)]
        self.in_file = [0] * 257
        self.count = 0

    def _path(self, c: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{c}")

    def push(self, c: int, positions, prefixes) -> None:
        self.waiting[c].append((positions, prefixes))
        self.count += len(positions)
        if self.count > self.held:
            for k, parts in enumerate(self.waiting):
                if parts:
                    with open(self._path(k), "ab") as f:
                        for p, x in parts:
                            f.write(_pack(p, x))
                            self.in_file[k] += len(p)
                    parts.clear()
            self.count = 0

    def pop(self, c: int):
        """All tuples that wait for byte ``c``, in order, a bounded number at a time."""
        import numpy as np

        while self.in_file[c] or self.waiting[c]:
            if self.in_file[c]:
                self.in_file[c] = 0
                old = self._path(c) + ".read"
                os.replace(self._path(c), old)
                with open(old, "rb") as f:
                    while block := f.read(9 * 1_000_000):
                        rows = np.frombuffer(block, ROW)
                        yield rows["at"], rows["lcp"]
                os.remove(old)
            elif self.waiting[c]:
                parts, self.waiting[c] = self.waiting[c], []
                self.count -= sum(len(p) for p, _ in parts)
                yield np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])


ROW = [("at", "<i8"), ("lcp", "u1")]


def _pack(positions, prefixes) -> bytes:
    import numpy as np

    rows = np.empty(len(positions), ROW)
    rows["at"], rows["lcp"] = positions, prefixes
    return rows.tobytes()


class _Least:
    """Least prefix over ranges of a batch, and over what came since each byte's last push."""

    def __init__(self, cap: int):
        import numpy as np

        self.cap, self.since, self.pushed = cap, np.full(257, cap, np.uint8), np.zeros(257, bool)

    def step(self, prefixes, target, pushing):
        """For the pushing tuples of a batch, by target byte and in order: (their indexes, their new prefixes)."""
        import numpy as np

        n = len(prefixes)
        table = np.empty((n.bit_length(), n), np.uint8)  # row k: the least of 2**k prefixes
        table[0] = prefixes
        for k in range(1, len(table)):
            half, size = 1 << (k - 1), n + 1 - (1 << k)
            np.minimum(table[k - 1, :size], table[k - 1, half : half + size], out=table[k, :size])
        table = table.reshape(-1)

        def least(a, b):  # inclusive
            k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            row = k * np.int64(n)
            return np.minimum(table[row + a], table[row + b + 1 - (np.int64(1) << k)])

        who = np.flatnonzero(pushing)
        who = who[np.argsort(target[who].astype(np.uint16), kind="stable")]  # 16 bits: sorted by digits
        c = target[who]
        new = np.zeros(len(who), np.uint8)
        if len(who):
            head = np.concatenate([[True], c[1:] != c[:-1]])
            again = np.flatnonzero(~head)
            new[again] = least(who[again - 1] + 1, who[again])
            firsts = np.flatnonzero(head)
            new[firsts] = np.minimum(self.since[c[firsts]], least(np.zeros(len(firsts), np.int64), who[firsts]))
            new = np.minimum(new + np.uint8(1), np.uint8(self.cap))
            new[firsts[~self.pushed[c[firsts]]]] = 0  # the first of its byte
        self.since = np.minimum(self.since, prefixes.min())
        if len(who):
            lasts = np.flatnonzero(np.concatenate([c[1:] != c[:-1], [True]]))
            end = who[lasts]
            self.since[c[lasts]] = np.where(end + 1 < n, least(np.minimum(end + 1, n - 1), np.full(len(end), n - 1)), self.cap)
            self.pushed[c] = True
        return who, new


def common(words, left, a, b, cap: int):
    """Common prefixes of suffix pairs, at most ``cap``: eight bytes at a time, up to the end of the shorter."""
    import numpy as np

    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(0, cap, 8):
        limit = len(words) - 1
        x = words[np.minimum(a[live] + k, limit)] ^ words[np.minimum(b[live] + k, limit)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        out[live] += same
        live = live[same == 8]
        if not len(live):
            break
    return np.minimum(np.minimum(out, cap), np.minimum(left[a], left[b])).astype(np.uint8)


def sorted_suffixes(t, folder: str, cap: int, direct: int = 4_000_000, held: int = 4_000_000):
    """Batches of (positions, prefixes) in falling order of the suffixes; a prefix is that with the suffix given out before.

    ``t``: unsigned bytes, each piece followed by a zero and 8 more zeros at the end. ``folder`` takes the
    queues' files. Prefixes are exact up to ``cap``. ``held`` bounds the tuples of a queue set in memory.
    """
    import numpy as np

    n = len(t) - 8
    words = np.ndarray((n,), "<u8", t, strides=(1,))
    text = t[:n]
    small = types(text)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)
    seeds = seed_order(text, small, direct)
    seed_lcp = np.zeros(len(seeds), np.uint8)
    same = np.flatnonzero(text[seeds[1:]] == text[seeds[:-1]]) + 1
    same = same[text[seeds[same]] != 0]
    seed_lcp[same] = common(words, left, seeds[same - 1], seeds[same], cap)
    cuts = np.searchsorted(text[seeds], np.arange(258))

    def before(pos):
        p = np.maximum(pos - 1, 0)
        return p, text[p].astype(np.int64)

    up, done = Queues(folder, "up", held), Queues(folder, "done", held)
    least = _Least(cap)
    for c in range(257):
        last = None

        def spread(pos, lcp):
            p, target = before(pos)
            who, new = least.step(lcp, target, (pos > 0) & ~small[p] & (target >= c))
            for a, b in _runs(target[who]):
                up.push(int(target[who[a]]), p[who[a:b]], new[a:b])

        for pos, lcp in up.pop(c):
            done.push(c, pos, lcp)
            last = pos[-1]
            spread(pos, lcp)
        pos, lcp = seeds[cuts[c] : cuts[c + 1]], seed_lcp[cuts[c] : cuts[c + 1]]
        if len(pos):
            lcp = lcp.copy()
            lcp[0] = 0 if last is None or c == 0 else common(words, left, np.array([last]), pos[:1], cap)[0]
            spread(pos, lcp)

    down = Queues(folder, "down", held)
    least = _Least(cap)
    for c in range(256, 0, -1):
        last = None

        def spread(pos, lcp):
            p, target = before(pos)
            who, new = least.step(lcp, target, (pos > 0) & small[p] & (target <= c) & (target > 0))
            for a, b in _runs(target[who]):
                down.push(int(target[who[a]]), p[who[a:b]], new[a:b])

        for pos, lcp in down.pop(c):
            last = pos[-1]
            spread(pos, lcp)
            yield pos, lcp
        parts = list(done.pop(c))  # the L suffixes of one byte, to be given out backwards
        if parts:
            pos, lcp = np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])
            edge = 0 if last is None else common(words, left, np.array([last]), pos[-1:], cap)[0]
            pos, lcp = pos[::-1], np.concatenate([[edge], lcp[:0:-1]]).astype(np.uint8)
            spread(pos, lcp)
            yield pos, lcp


def _runs(c):
    import numpy as np

    if not len(c):
        return []
    heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return zip(heads.tolist(), [*heads[1:].tolist(), len(c)])
