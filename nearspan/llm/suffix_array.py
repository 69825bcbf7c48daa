"""Suffix arrays by induced sorting, in whole-array steps, and permuted common prefixes.

Suffixes are classified as smaller or larger than their successors. The leftmost
smaller ones are sorted by their substrings, which are named; if names repeat,
the string of names is sorted recursively, at most half as long. Substrings are
sorted by words of as many symbols as 64 bits hold, equal ones by their next
words, so that a level is induced once. The order of
all suffixes is then induced in two linear sweeps over the buckets of first
symbols. What some buckets' suffixes induce is a stable grouping by symbol; a
step of a sweep takes as many buckets as induce nothing into each other, so
that alphabets of many names take few steps too.
"""

from __future__ import annotations

import numpy as np

#: Suffixes that a step of a sweep takes at first, and at most.
STEP, MOST_STEP = 256, 1 << 14


def _place(order: np.ndarray, symbols: np.ndarray, fill: np.ndarray, into: np.ndarray, down: bool) -> None:
    """Appends ``order``, grouped by symbol and otherwise as it is, to the
    buckets: upwards from ``fill``, or downwards to it."""
    n = len(order)
    if not n:
        return
    grouped = np.argsort(symbols, kind="stable")
    by = symbols[grouped]
    heads = (by[1:] != by[:-1]).nonzero()[0] + 1
    nth = np.arange(n)
    if len(heads):
        sizes = np.empty(len(heads) + 1, np.int64)
        sizes[0], sizes[-1], sizes[1:-1] = heads[0], n - heads[-1], heads[1:] - heads[:-1]
        nth[heads[0] :] -= np.repeat(heads, sizes[1:])
        first = np.empty(len(sizes), by.dtype)
        first[0], first[1:] = by[0], by[heads]
    else:
        sizes, first = n, by[:1]
    if down:
        into[fill[by] - 1 - nth] = order[grouped]
        fill[first] -= sizes
    else:
        into[fill[by] + nth] = order[grouped]
        fill[first] += sizes


def _sweep(t: np.ndarray, found: np.ndarray, induced: np.ndarray, run: np.ndarray, sizes: np.ndarray, down: bool) -> None:
    """One sweep over ``found`` (-1: not yet known), upwards or downwards. The
    suffix before each one that is met, if it is ``induced``, goes to the next
    free place of its bucket, from the bucket's beginning or end. ``run`` says
    how many equal symbols lie before each place."""
    n, ends = len(t), np.cumsum(sizes)
    none = t.dtype.type(np.iinfo(t.dtype).max)
    # the symbol before each suffix, if it is induced; also of what is not known
    prior_symbol = np.full(n + 1, none, t.dtype)
    prior_symbol[1:n] = np.where(induced[: n - 1], t[: n - 1], none)
    heads = ends - sizes
    fill = ends.copy() if down else heads.copy()
    symbols = np.repeat(np.arange(len(sizes), dtype=t.dtype), sizes)  # by place in the array

    def before(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        goal = prior_symbol[part]
        at = (goal != none).nonzero()[0]
        return part[at] - 1, goal[at], at

    def one(c: int) -> None:
        """A bucket that induces into itself: by runs of its symbol. Of those
        that are there, first each one's prior suffix follows in their order,
        then what lies before these, as far as the runs go."""
        seeds = found[fill[c] : ends[c]][::-1] if down else found[heads[c] : fill[c]]
        far = run[seeds]
        of = np.repeat(np.arange(len(seeds)), far)
        nth = np.arange(1, len(of) + 1) - np.repeat(np.cumsum(far) - far, far)
        order = np.lexsort((of, nth))
        more = seeds[of[order]] - nth[order]
        if down:
            found[fill[c] - len(more) : fill[c]] = more[::-1]
            fill[c] -= len(more)
        else:
            found[fill[c] : fill[c] + len(more)] = more
            fill[c] += len(more)
        prior, goal, _ = before(found[heads[c] : ends[c]][::-1] if down else found[heads[c] : ends[c]])
        other = goal != c
        _place(prior[other], goal[other], fill, found, down)

    step, at = STEP, n if down else 0
    while at > 0 if down else at < n:
        if down:
            c = int(symbols[at - 1])
            last = int(symbols[max(0, at - step)])
            to = int(heads[last])
            prior, goal, places = before(found[to:at][::-1])
        else:
            c = int(symbols[at])
            last = int(symbols[min(n, at + step) - 1])
            to = int(ends[last])
            prior, goal, places = before(found[at:to])
        nearest = int(goal.max() if down else goal.min()) if len(prior) else -1
        if not len(prior) or (nearest < last if down else nearest > last):
            _place(prior, goal, fill, found, down)
            at, step = to, min(2 * step, MOST_STEP)
        elif nearest != c:  # buckets up to the first that something goes to are whole
            own = symbols[at - 1 - places] if down else symbols[at + places]
            some = own > nearest if down else own < nearest
            _place(prior[some], goal[some], fill, found, down)
            stop = int(ends[nearest]) if down else int(heads[nearest])
            step = max(16, 2 * abs(stop - at))
            at = stop
        else:
            one(c)
            at = int(heads[c]) if down else int(ends[c])


def _induce(t: np.ndarray, smaller: np.ndarray, least: np.ndarray, buckets: int) -> np.ndarray:
    """The suffix array that the leftmost smaller suffixes, in order, induce."""
    n = len(t)
    sizes = np.bincount(t, minlength=buckets)
    found = np.full(n, -1, least.dtype)
    seeds = least[::-1]
    _place(seeds, t[seeds], np.cumsum(sizes), found, True)
    run = np.arange(n, dtype=least.dtype)
    run -= np.maximum.accumulate(np.where(np.r_[True, t[1:] != t[:-1]], run, 0))
    _sweep(t, found, ~smaller, run, sizes, False)
    found[smaller[found] & (found >= 0)] = -1  # these are placed anew
    found[0] = n - 1
    _sweep(t, found, smaller, run, sizes, True)
    found[0] = n - 1
    return found


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one, the least symbol, is."""
    n = len(t)
    smaller = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        # a suffix compares to the next as the first unequal pair of symbols does
        runs = np.diff(np.r_[-1, differs])
        smaller[:-1] = np.repeat((t[:-1] < t[1:])[differs], runs)
    return smaller


def _leftmost(smaller: np.ndarray) -> np.ndarray:
    leftmost = np.zeros(len(smaller), bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    return leftmost


def _named(t: np.ndarray, places: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """Names of the substrings from each of the leftmost smaller ``places`` to
    the next, in their order, and how many there are. A substring that others
    begin with is greater than these: where it ends, on a smaller suffix, they
    go on with a larger one, which is less. So what follows an end is greatest."""
    n, m = len(t), len(places)
    bits = buckets.bit_length()
    each, pad = 64 // bits, np.uint64((1 << bits) - 1)
    length = np.diff(np.r_[places, n - 1]) + 1
    padded = np.zeros(n + each, t.dtype)
    padded[:n] = t

    def words(start: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        for k in range(each):
            symbols = padded[start + k].astype(np.uint64)
            symbols[left <= k] = pad
            out = out << np.uint64(bits) | symbols
        return out

    word = words(places, length)
    order = np.argsort(word)
    word = word[order]
    fresh = np.ones(m, bool)
    fresh[1:] = word[1:] != word[:-1]
    active = np.arange(m)
    done = 0
    while True:
        # places in the order whose substring goes on, and is equal to a neighbour's so far
        alone = fresh[active] & np.r_[fresh, True][active + 1]
        some = ~alone & (word & pad != pad)
        active = active[some]
        if not len(active):
            break
        done += each
        own = order[active]
        word = words(np.minimum(places[own] + done, n), length[own] - done)
        group = np.cumsum(fresh[active])
        by = np.lexsort((word, group))
        order[active], word = own[by], word[by]
        fresh[active[1:]] |= word[1:] != word[:-1]
    names = np.empty(m, places.dtype)
    names[order] = np.cumsum(fresh) - 1
    return names, int(fresh.sum())


def suffix_array(t: np.ndarray, buckets: int) -> np.ndarray:
    """Suffix array of symbols below ``buckets`` whose last is 0 and the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    if buckets < 1 << 16:
        # symbols that occur, numbered anew; short ones are grouped by radix
        used = np.bincount(t, minlength=buckets) > 0
        buckets = int(used.sum())
        t = (np.cumsum(used) - 1).astype(np.uint8 if buckets < 1 << 8 else np.uint16)[t]
    smaller = _smaller(t)
    leftmost = _leftmost(smaller)
    places = np.flatnonzero(leftmost).astype(np.int32 if n < 1 << 31 else np.int64)
    names, kinds = _named(t, places, buckets)
    if kinds < len(names):
        order = places[suffix_array(names, kinds)]
    else:
        order = np.empty_like(places)
        order[names] = places
    return _induce(t, smaller, order, buckets)


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, most: int | None = None, wanted: np.ndarray | None = None, sampled: int = 8) -> np.ndarray:
    """For each place of ``t`` (symbols of 8 or 16 bits), how many symbols its
    suffix shares with the one before it in ``order``; from ``most`` on, at
    least ``most``. Sampled places come first; a place shares at most one symbol
    less than the place before it, so the others start from what is left of
    their sampled neighbour's. Symbols are compared by words of eight bytes.
    Places that are not ``wanted`` may have less than they share."""
    n, size = len(t), t.dtype.itemsize
    each = 8 // size
    before = np.full(n, -1, order.dtype)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + each, t.dtype)
    padded[:n] = t
    words = np.ndarray((n,), "<u8", padded.tobytes(), strides=(size,))

    def extend(places: np.ndarray, shared: np.ndarray) -> np.ndarray:
        active = (before[places] >= 0).nonzero()[0]
        if most is not None:
            active = active[shared[active] < most]
        i = places[active] + shared[active]
        j = before[places[active]] + shared[active]
        while len(active):
            inside = (i < n) & (j < n)
            if not inside.all():
                active, i, j = active[inside], i[inside], j[inside]
            x = words[i] ^ words[j]
            whole = x == 0
            part = ~whole
            x = x[part]
            shared[active[part]] += (np.bitwise_count((x & -x) - np.uint64(1)) // (8 * size)).astype(shared.dtype)
            active, i, j = active[whole], i[whole] + each, j[whole] + each
            shared[active] += each
            if most is not None:
                left = shared[active] < most
                active, i, j = active[left], i[left], j[left]
        return shared

    out = np.zeros(n, order.dtype)
    some = np.arange(0, n, sampled)
    out[some] = extend(some, np.zeros(len(some), order.dtype))
    others = (np.arange(n) % sampled).astype(bool)
    rest = (others if wanted is None else others & wanted).nonzero()[0]
    out[rest] = extend(rest, np.maximum(0, out[rest - rest % sampled] - rest % sampled))
    return out
