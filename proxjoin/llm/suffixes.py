"""Suffix sorting by external induction: disk-backed priority queues carry suffixes and common prefixes.

Suffixes are of type L or S (greater or less than the one that follows); stars are those of type S after one of type L.
Substrings from star to star are sorted by induction, and equal ones, compared character by character, get one name;
the string of names is sorted by recursion, and ends where all names differ or where it fits in memory, there by
doubling. From the sorted stars one pass over ascending first characters induces the L-type suffixes, one over
descending characters the S-type.

A pass takes its tuples from a priority queue whose priorities are (first character, order of arrival): a queue for
each character, drained whole batch by whole batch; beyond a budget all queues go to one file. A tuple has a suffix's
place and the prefix it shares with the tuple before it in its queue. A suffix induced from a scanned one shares one
character more with its predecessor than the least shared prefix scanned since the predecessor's source; so shared
prefixes of all neighbours come out of the passes, and no two suffixes but stars are ever compared. Strings end in
zeros, which are less than any other character and all different, in order of place.

Of a shard, the characters, their types and the flags of stars lie in memory up to ``memory`` bytes each, in mapped
files beyond; the passes' tuples are on disk beyond ``budget``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: A suffix's place, and what it shares with the tuple before it.
TUPLE = np.dtype([("place", "<i4"), ("shared", "<i2")])
#: Bytes of tuples that a pass's queues hold in memory, and of an array that lies in memory.
BUDGET, MEMORY = 2 << 20, 256 << 20
#: Bytes that sorting a name in memory takes.
NAME_BYTES = 64
NOTHING = np.zeros(0, TUPLE)


def _array(n: int, kind, memory: int) -> np.ndarray:
    """Zeros in memory, or in a mapped file that goes with the array."""
    if n * np.dtype(kind).itemsize <= memory:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=n)


class SpilledQueues:
    """First-in, first-out queues of tuples, one for each character; all go to one file when memory is short."""

    spills = 0

    def __init__(self, budget: int):
        self.held: dict[int, list[np.ndarray]] = {}
        self.stored: dict[int, list[tuple[int, int]]] = {}
        self.budget, self.size, self.file = budget, 0, None

    def add(self, c: int, tuples: np.ndarray) -> None:
        self.held.setdefault(c, []).append(tuples)
        self.size += tuples.nbytes
        if self.size > self.budget:
            self._spill()

    def put(self, tuples: np.ndarray, chars: np.ndarray, cuts: np.ndarray) -> None:
        """Add tuples that lie in order of their characters; ``cuts`` tells where a character begins."""
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tuples)], strict=True):
            self.add(int(chars[a]), tuples[a:b])

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for c, parts in self.held.items():
            whole = np.concatenate(parts)
            self.stored.setdefault(c, []).append((self.file.tell(), len(whole)))
            whole.tofile(self.file)
            self.file.flush()
        self.held, self.size = {}, 0
        SpilledQueues.spills += 1

    def take(self, c: int) -> np.ndarray:
        """All of a queue, which is empty then."""
        parts = []
        for at, n in self.stored.pop(c, ()):
            self.file.seek(at)
            parts.append(np.fromfile(self.file, TUPLE, n))
        held = self.held.pop(c, ())
        self.size -= sum(x.nbytes for x in held)
        parts += held
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else NOTHING


def _types(t: np.ndarray, memory: int, chunk: int = 1 << 20) -> np.ndarray:
    """True where the suffix is of type S. Zeros are; equal neighbours share the type of the run's end."""
    out = _array(len(t), bool, memory)
    follows, kind = 0, True
    for a in range((len(t) - 1) // chunk * chunk, -1, -chunk):
        x = np.asarray(t[a : a + chunk])
        m = len(x)
        after = np.r_[x[1:], x.dtype.type(follows)]
        differs, less = (x != after) | (x == 0), (x < after) | (x == 0)
        at = np.minimum.accumulate(np.where(differs, np.arange(m), m)[::-1])[::-1]
        out[a : a + m] = np.where(at == m, kind, less[np.minimum(at, m - 1)])
        follows, kind = int(x[0]), bool(out[a])
    return out


def _run(t: np.ndarray, place: int, cap: int) -> int:
    """How often the character at ``place`` is repeated there."""
    other = np.flatnonzero(t[place : place + cap] != t[place])
    return int(other[0]) if len(other) else min(cap, len(t) - place)


class _Pass:
    """One pass of the induction: scanned suffixes feed the queues of the characters before them."""

    def __init__(self, tagged: np.ndarray, small: bool, width: int, budget: int, cap: int):
        self.tagged, self.small, self.cap = tagged, int(small), cap
        self.queues = SpilledQueues(budget)
        # Least shared prefix scanned since a character's last tuple; below 0 where there is none yet.
        self.since = np.full(width, -1, np.int16) if cap else None

    def feed(self, now: np.ndarray) -> None:
        place, shared = now["place"], now["shared"]
        before = place - 1
        tags = self.tagged[before]
        at = np.flatnonzero((tags & 1 == self.small) & (tags > 1) & (place > 0))
        if len(at):
            chars = tags[at] >> 1
            order = np.argsort(chars, kind="stable")
            at, chars = at[order], chars[order]
            cuts = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
            out = np.zeros(len(at), TUPLE)
            out["place"] = before[at]
        if not self.cap:
            if len(at):
                self.queues.put(out, chars, cuts)
            return
        since = np.minimum(self.since, shared.min())
        if len(at):
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                c, s = chars[a], at[a:b]
                least = np.minimum.reduceat(shared[: s[-1] + 1], np.r_[0, s[:-1] + 1])
                least[0] = min(least[0], self.since[c])
                out["shared"][a:b] = np.minimum(least + 1, self.cap)
                rest = shared[s[-1] + 1 :]
                since[c] = rest.min() if len(rest) else self.cap
            self.queues.put(out, chars, cuts)
        self.since = since


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, budget: int, cap: int) -> Iterator[np.ndarray]:
    """Tuples of all suffixes in descending order, each with what it shares with the tuple before it (up to ``cap``;
    nothing is carried if that is 0), from the seeds in ascending order: stars and zeros.
    """
    width = int(t.max()) + 1
    # A character and its suffix's type in one number, so that a suffix is looked up once.
    tagged = _array(len(t), t.dtype, MEMORY)
    np.left_shift(t, 1, out=tagged)
    tagged |= s_type
    waiting = SpilledQueues(budget)
    chars = t[seeds["place"]]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    waiting.put(seeds[order], chars, np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]]))
    large, lists = _Pass(tagged, False, width, budget, cap), SpilledQueues(budget)
    zeros = NOTHING
    for c in range(width):
        last = None
        while len(now := large.queues.take(c)):
            lists.add(c, now)
            last = int(now["place"][-1])
            large.feed(now)
        now = waiting.take(c)
        if len(now):
            if cap:
                # A large suffix and a small one of one character share its shorter run.
                now["shared"][0] = 0 if last is None else min(_run(t, last, cap), _run(t, int(now["place"][0]), cap))
            large.feed(now)
            if c == 0:
                zeros = now
    small = _Pass(tagged, True, width, budget, cap)
    for c in range(width - 1, 0, -1):
        last = None
        while len(now := small.queues.take(c)):
            yield now
            last = int(now["place"][-1])
            small.feed(now)
        now = lists.take(c)
        if len(now):
            back = now[::-1].copy()
            if cap:
                back["shared"][1:] = now["shared"][:0:-1]
                back["shared"][0] = 0 if last is None else min(_run(t, last, cap), _run(t, int(back["place"][0]), cap))
            yield back
            small.feed(back)
    back = zeros[::-1].copy()
    back["shared"] = 0
    yield back


def _equal_substrings(t: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each substring but the first equals the one before it, character by character."""
    a, b, n = first[:-1], first[1:], length[1:]
    same = (length[:-1] == n) & (t[b] != 0)
    some, k = np.flatnonzero(same), 0
    while len(some):
        equal = t[a[some] + k] == t[b[some] + k]
        same[some[~equal]] = False
        k += 1
        some = some[equal]
        some = some[n[some] > k]
    return same


def _shared_prefixes(t: np.ndarray, places: np.ndarray, cap: int) -> np.ndarray:
    """Characters that each suffix shares with the one before it, up to ``cap``; 0 for the first."""
    out = np.zeros(len(places), np.int16)
    step = 16
    steps = np.lib.stride_tricks.sliding_window_view(np.r_[t, np.zeros(step + cap, t.dtype)], step)  # a row of characters is looked up at once
    some = np.arange(1, len(places))
    for k in range(0, cap, step):
        x, y = steps[places[some - 1] + k], steps[places[some] + k]
        ends = (x != y) | (x == 0)
        whole = ~ends.any(axis=1)
        out[some] = k + np.where(whole, step, ends.argmax(axis=1))
        some = some[whole]
        if not len(some):
            break
    return np.minimum(out, cap)


def _sorted_stars(t: np.ndarray, s_type: np.ndarray, budget: int, memory: int) -> np.ndarray:
    """Places of stars and zeros in the order of their suffixes."""
    star = _array(len(t), bool, memory)
    star[1:] = s_type[1:] & ~s_type[:-1]
    star |= t == 0
    stars = np.flatnonzero(star).astype(np.int32)
    seeds = np.zeros(len(stars), TUPLE)
    seeds["place"] = stars
    found = [now["place"][star[now["place"]]] for now in _induce(t, s_type, seeds, budget, 0)]
    order = np.concatenate(found)[::-1]
    number = np.searchsorted(stars, order)
    length = np.r_[np.diff(stars), 0].astype(np.int32) + 1  # up to the next star's first character
    fresh = np.r_[True, ~_equal_substrings(t, order, length[number])]
    if fresh.all():
        return order
    zeros = int((t[stars] == 0).sum())
    names = np.zeros(len(stars), np.int32)
    names[number] = np.maximum(np.cumsum(fresh) - zeros, 0)  # zeros come first, and stay zeros
    if len(names) * NAME_BYTES <= memory:
        return stars[_sort_names(names)]
    return stars[_recurse(names, budget, memory)]


def _recurse(names: np.ndarray, budget: int, memory: int) -> np.ndarray:
    return suffix_array(names, budget, memory)


def suffix_array(t: np.ndarray, budget: int = BUDGET, memory: int = MEMORY) -> np.ndarray:
    """Places of ``t`` (characters above zero; strings end in zeros, the last too) in the order of their suffixes."""
    return np.concatenate([x["place"] for x in descending(t, 0, budget, memory)])[::-1]


def descending(t: np.ndarray, cap: int, budget: int = BUDGET, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """Tuples of all suffixes of ``t``, greatest first, each with what it shares with the one before, up to ``cap``."""
    s_type = _types(t, memory)
    order = _sorted_stars(t, s_type, budget, memory)
    seeds = np.zeros(len(order), TUPLE)
    seeds["place"] = order
    if cap:
        seeds["shared"] = _shared_prefixes(t, order, cap)
    yield from _induce(t, s_type, seeds, budget, cap)


def _sort_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``names`` in memory: names of spans twice as long each time. Zeros all differ.

    A rank is the place of the first of all that share it; only those that share one are sorted again.
    """
    n, span = len(names), 1
    order = np.argsort(names, kind="stable")
    first = np.flatnonzero(np.r_[True, names[order[1:]] != names[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    zero = np.flatnonzero(names == 0)
    rank[zero] = np.arange(len(zero))
    ranked = rank[order]
    open_ = np.flatnonzero(np.r_[False, ranked[1:] == ranked[:-1]] | np.r_[ranked[1:] == ranked[:-1], False])
    while len(open_):
        some = order[open_]
        after = some + span
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by_key = np.argsort(key)
        some, key = some[by_key], key[by_key]
        order[open_] = some
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        rank[some] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size)]
        span *= 2
    return order


def repeated_starts(strings: list[bytes], length: int, budget: int = BUDGET, memory: int = MEMORY) -> list[np.ndarray]:
    """For each string, whether the ``length`` bytes from each of its first places stand elsewhere in the strings too."""
    wide = np.fromiter((len(s) for s in strings), np.int64, len(strings))
    begin = np.r_[0, np.cumsum(wide + 1)[:-1]]
    t = _array(int(wide.sum()) + len(strings), np.int16, memory)
    for s, a in zip(strings, begin.tolist(), strict=True):
        t[a : a + len(s)] = np.frombuffer(s, np.uint8)
        t[a : a + len(s)] += 1
    hit = _array(len(t), bool, memory)
    before = -1
    for now in descending(t, length, budget, memory):
        near = np.flatnonzero(now["shared"] >= length)
        if len(near):
            place = now["place"]
            hit[place[near]] = True
            hit[place[near - 1] if near[0] else np.r_[before, place[near[1:] - 1]]] = True
        before = now["place"][-1] if len(now) else before
    return [hit[s : s + max(0, w - length + 1)] for s, w in zip(begin.tolist(), wide.tolist(), strict=True)]
