"""Suffix arrays by induced sorting, in numpy: each bucket of a first symbol is induced as a whole.

The classic steps: classify suffixes as S or L, sort the leftmost-S (LMS) substrings by inducing from unsorted ones,
name them, sort the string of names recursively, and induce all suffixes from the sorted LMS ones. The recursion here
names pairs of neighbouring LMS substrings by the names of the level before, then fours, and so on: each level sorts only
what still shares a name, and it ends when all names differ.
"""

from __future__ import annotations

import numpy as np

from vouch.llm import words


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S: smaller than the suffix that follows it. The end is smaller than every suffix."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    rising = np.append(text[change + 1] > text[change], False)
    return np.repeat(rising, np.diff(np.append(-1, ends)))


def _placed(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order by symbol, the symbols that occur and how often."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return order, ordered[first], np.diff(np.append(first, len(ordered)))


def induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix array, given the LMS suffixes in their order (or any order, to sort LMS substrings)."""
    n, n_symbols = len(text), len(bounds) - 1
    array = np.full(n, -1, np.int32)
    present = np.flatnonzero(np.diff(bounds))
    order, symbols, counts = _placed(text[lms])
    of_symbol = np.split(lms[order], np.cumsum(counts)[:-1]) if len(lms) else []
    starters = dict(zip(symbols.tolist(), of_symbol, strict=True))

    head = bounds[:-1].copy()

    def put_l(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~is_s[before]]
        if len(before):
            order, symbols, counts = _placed(text[before])
            before = before[order]
            array[np.repeat(head[symbols] - (np.cumsum(counts) - counts), counts) + np.arange(len(before))] = before
            head[symbols] += counts

    # the end of the text comes first of all, and the last suffix is L
    put_l(np.array([n]))
    for c in present:
        done = bounds[c]
        while done < head[c]:
            done, block = head[c], array[done : head[c]].copy()
            put_l(block)
        if c in starters:
            put_l(starters[c])

    tail = bounds[1:].copy()

    def put_s(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[is_s[before]]
        if len(before):
            order, symbols, counts = _placed(text[before])
            before = before[order]
            array[np.repeat(tail[symbols] - 1 + (np.cumsum(counts) - counts), counts) - np.arange(len(before))] = before
            tail[symbols] -= counts

    for c in present[::-1]:
        done = bounds[c + 1]
        while done > tail[c]:
            done, block = tail[c], array[tail[c] : done][::-1].copy()
            put_s(block)
        put_s(array[bounds[c] : head[c]][::-1])
    return array


def sorted_lms(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """LMS suffixes in order."""
    induced = induce(text, is_s, lms, bounds)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    order = induced[is_lms[induced]]
    # name the substrings: equal ones are neighbours in this order
    number = np.full(len(text), -1, np.int32)
    number[lms] = np.arange(len(lms))
    ends = np.append(lms[1:] + 1, len(text))
    sums = words.prefix_sums(text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    h, size = words.range_hashes(sums, lms, ends), ends - lms
    at = number[order]
    opens = np.append(True, (h[at][1:] != h[at][:-1]) | (size[at][1:] != size[at][:-1]))[: len(at)]
    return lms[_sorted_names(at, opens)]


def _sorted_names(order: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a string of names, given its places in the order of their names, and where each name begins there.

    A level sorts what still shares its rank (the number of smaller suffixes) by the rank as far on as all ranks reach.
    """
    m, reach = len(order), 1
    rank = np.full(m + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(m), 0))
    shared = ~opens
    shared[:-1] |= ~opens[1:]
    places = np.flatnonzero(shared)
    order = order.copy()
    while len(places):
        at = order[places]
        key = rank[at] * (m + 1) + rank[np.minimum(at + reach, m)] + 1
        by_key = np.argsort(key)
        at, key = at[by_key], key[by_key]
        new = np.append(True, key[1:] != key[:-1])
        order[places] = at
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        places, reach = places[tied], 2 * reach
    return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of text (small unsigned integers), in order."""
    if not len(text):
        return np.zeros(0, np.int32)
    text = text.astype(np.uint16)
    is_s = classify(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    bounds = np.append(0, np.cumsum(np.bincount(text, minlength=int(text.max()) + 1)))
    return induce(text, is_s, sorted_lms(text, is_s, lms, bounds), bounds)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position of text (bytes), how many symbols its suffix shares with the one before it in the suffix array.

    A position whose preceding symbol is also that of the other suffix shares one symbol less than the position before
    it. Only the others are compared, eight bytes at a time; their prefixes add up to n log n at most.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int32)
    other = np.full(n, -1, np.int32)
    other[array[1:]] = array[:-1]
    text = text.astype(np.uint8)
    told = np.zeros(n, bool)
    told[1:] = (other[1:] > 0) & (text[:-1] == text[np.maximum(other[1:], 1) - 1])
    here = np.flatnonzero(~told & (other >= 0))
    of, common, k = other[here].astype(np.int64), np.zeros(n, np.int32), 0
    eight = np.lib.stride_tricks.as_strided(np.concatenate([text, np.zeros(8, np.uint8)]), (n + 1, 8), (1, 1))
    while len(here):
        left = n - k - np.maximum(here, of)
        x = eight[np.minimum(here + k, n)].copy().view("<u8").ravel() ^ eight[np.minimum(of + k, n)].copy().view("<u8").ravel()
        same = np.full(len(x), 8)
        differs = x != 0
        low = x[differs]
        same[differs] = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3
        same = np.minimum(same, left)
        common[here] += same.astype(np.int32)
        on = (same == 8) & (left > 8)
        here, of, k = here[on], of[on], k + 8
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(told, 0, at))
    return common[last] - (at - last)
