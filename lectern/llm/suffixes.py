"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified as larger or smaller than their successor; the substrings between leftmost
smaller ones are sorted by inducing and named; where names repeat, the string of names is sorted by
doubling; the order of all suffixes is then induced from theirs in two linear scans, a bucket at a time.
"""

from __future__ import annotations

import numpy as np

from lectern.llm.text import mixed

_SMALL = 512


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a string of positive integers that ends in a single 0."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    if int(text.max()) >= _SMALL:
        return _by_doubling(text)
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _induce_by_bucket(text, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    names, kinds = _names(text, lms, ranked)
    if kinds < len(lms):
        ranked = lms[_by_doubling(names)]
    return _induce_by_bucket(text, smaller, ranked)


def _smaller(text: np.ndarray) -> np.ndarray:
    """Marks the suffixes that are smaller than their successor; the last counts as such."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    # In a run of one symbol the next other symbol decides.
    at = np.where(step != 0, np.arange(n - 1), n)
    decided = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(decided, n - 2)] > 0
    return out


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> tuple[np.ndarray, int]:
    """The leftmost-smaller substrings' names in text order, from their sorted order."""
    n = len(text)
    end = np.append(lms[1:], n - 1)
    hashes = PrefixHashes(text)
    which = np.searchsorted(lms, ranked)
    size = end[which] - ranked + 1
    key = hashes.of(ranked, np.minimum(size, n - ranked))
    new = np.ones(len(ranked), np.int64)
    new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1])
    names = np.empty(len(lms), np.int64)
    names[which] = np.cumsum(new) - 1
    return names, int(new.sum())


def _induce_by_bucket(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    n, kinds = len(text), int(text.max()) + 1
    counts = np.bincount(text, minlength=kinds)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.full(n, -1, np.int64)
    symbols = text.astype(np.uint16)
    by_symbol = symbols[seeds]
    order = np.argsort(by_symbol, kind="stable")
    seed_at = np.searchsorted(by_symbol[order], np.arange(kinds + 1))
    seeded = seeds[order]

    def larger_before(found: np.ndarray) -> np.ndarray:
        found = found[found > 0] - 1
        return found[~smaller[found]]

    head = starts.copy()
    for c in range(kinds):
        if not counts[c]:
            continue
        done = starts[c]
        parts = []
        while done < head[c]:  # what a bucket adds to itself is scanned in its turn
            new = larger_before(out[done : head[c]])
            done = head[c]
            same = symbols[new] == c
            parts.append(new[~same])
            mine = new[same]
            out[head[c] : head[c] + len(mine)] = mine
            head[c] += len(mine)
        parts.append(larger_before(seeded[seed_at[c] : seed_at[c + 1]]))
        _deal(out, head, symbols, np.concatenate(parts), 1)

    def smaller_before(found: np.ndarray) -> np.ndarray:
        found = found[found > 0] - 1
        return found[smaller[found]]

    larger_end = head
    tail = ends.copy()
    for c in range(kinds - 1, -1, -1):
        if not counts[c]:
            continue
        if c == 0:
            out[0] = n - 1
            tail[0] = 0
        done = ends[c]
        parts = []
        while done > tail[c]:
            new = smaller_before(out[tail[c] : done][::-1])
            done = tail[c]
            same = symbols[new] == c
            parts.append(new[~same])
            mine = new[same]
            out[tail[c] - len(mine) : tail[c]] = mine[::-1]
            tail[c] -= len(mine)
        parts.append(smaller_before(out[starts[c] : larger_end[c]][::-1]))
        _deal(out, tail, symbols, np.concatenate(parts), -1)
    return out


def _deal(out: np.ndarray, at: np.ndarray, symbols: np.ndarray, found: np.ndarray, step: int) -> None:
    """Puts each place into the bucket of its symbol, in order, from the front (step 1) or the back (-1)."""
    if not len(found):
        return
    own = symbols[found]
    order = np.argsort(own, kind="stable")
    ordered = own[order].astype(np.int64)
    nth = np.arange(len(found)) - np.searchsorted(ordered, ordered)
    out[at[ordered] + nth if step > 0 else at[ordered] - 1 - nth] = found[order]
    at += step * np.bincount(ordered, minlength=len(at))


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array of a string of any symbols that ends in a single least one.

    Suffixes that agree in so many symbols are ranked by what follows those, which twice as many then decide;
    suffixes that stand alone are done.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    slots, key = np.arange(n), text[order].astype(np.int64)
    step = 0
    while len(slots):
        places = order[slots]
        if step:  # no such suffix ends within ``step`` symbols: the last symbol stands once
            key = rank[places] * n + rank[places + step]
            sort = np.argsort(key, kind="stable")
            places, key = places[sort], key[sort]
            order[slots] = places
        head = np.append(True, key[1:] != key[:-1])
        rank[places] = slots[np.flatnonzero(head)[np.cumsum(head) - 1]]
        slots = slots[~(head & np.append(head[1:], True))]
        step = max(1, 2 * step)
    return order


class PrefixHashes:
    """Rolling hashes of any substrings of an integer string."""

    _BASE = 0xA24BAED4963EE407

    def __init__(self, text: np.ndarray):
        n = len(text)
        base, inverse = np.full(n + 1, self._BASE, np.uint64), np.full(n + 1, pow(self._BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        self.down = np.cumprod(inverse)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(text.astype(np.uint64) + np.uint64(0x51ED270B)) * np.cumprod(base)[:n], out=self.total[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * self.down[start]

    def of_all(self, size: int) -> np.ndarray:
        """``of`` for every start that has ``size`` symbols from it on."""
        n = max(0, len(self.total) - size)
        return (self.total[size:] - self.total[:n]) * self.down[:n]


def permuted_joins(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the text whether its suffix and the one before it in order have ``length`` symbols in common."""
    n = len(text)
    out = np.zeros(n, bool)
    windows = PrefixHashes(text).of_all(length)
    whole = order < len(windows)
    both = np.flatnonzero(whole[1:] & whole[:-1]) + 1
    out[order[both]] = windows[order[both]] == windows[order[both - 1]]
    return out


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in the text the common prefix, up to ``most``, of its suffix with the one before it in order."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    hashes = PrefixHashes(text)
    out = np.zeros(n, np.int64)
    place = np.arange(n)
    known = before < n
    step = 1 << (most.bit_length() - 1)
    while step:
        may = known & (np.maximum(place, before) + out + step <= n)
        i, j = (place + out)[may], (before + out)[may]
        out[may] += step * (hashes.of(i, step) == hashes.of(j, step))
        step >>= 1
    return np.minimum(out, most)
