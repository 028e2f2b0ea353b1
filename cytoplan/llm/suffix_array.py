"""A two-stage suffix array in numpy: suffixes smaller than their successor are sorted directly, all others are induced from them."""

from __future__ import annotations

import numpy as np


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Whether each suffix of s is smaller than the one that starts after it (the end counts as smallest)."""
    n = len(s)
    step = np.full(n, -1, np.int8)
    np.sign(s[1:].astype(np.int16) - s[:-1].astype(np.int16), out=step[:-1], casting="unsafe")
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ decides for a run of equal symbols
    return step[np.minimum(at, n - 1)] > 0


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of s (small non-negative integers, below 512) in the order of their first `depth` symbols.

    Stage one sorts the suffixes that are smaller than their successor by their first symbols. Stage two scans the buckets of first
    symbols upwards: each suffix placed puts the one before it, if larger than it, at the next free place of its own bucket. A
    bucket is scanned as an array; a run of one symbol takes a further wave for each place of the run. Equal first `depth` symbols
    leave the order open.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    direct = smaller_than_next(s)
    starts = np.flatnonzero(direct)
    wide = np.zeros(n + depth, ">u2")
    wide[:n] = s + 1
    rows = np.lib.stride_tricks.sliding_window_view(wide, depth)[starts]
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, 2 * depth))).ravel() if s.max() > 254 else np.ascontiguousarray(rows.astype(np.uint8)).view(f"S{depth}").ravel()
    sorted_direct = starts[np.argsort(keys, kind="stable")]
    first = s[sorted_direct]
    top = int(s.max()) + 1
    cut = np.searchsorted(first, np.arange(top + 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(top)]
    larger = ~direct
    # The last suffix is larger than the empty one behind it, which comes before all others.
    if larger[n - 1]:
        induced[int(s[n - 1])].append(np.array([n - 1]))

    def induce(placed: np.ndarray, c: int) -> np.ndarray:
        """Hands the suffixes before the placed ones to their buckets; returns those of bucket c itself."""
        before = placed[placed > 0] - 1
        before = before[larger[before]]
        symbol = s[before]
        same = before[symbol == c]
        more, symbol = before[symbol > c], symbol[symbol > c]
        order = np.argsort(symbol, kind="stable")
        more, symbol = more[order], symbol[order]
        edges = np.flatnonzero(np.diff(symbol)) + 1
        for part in np.split(more, edges) if len(more) else ():
            induced[int(s[part[0]])].append(part)
        return same

    out = []
    for c in range(top):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        induced[c] = []
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        if cut[c + 1] > cut[c]:
            out.append(sorted_direct[cut[c] : cut[c + 1]])
            induce(out[-1], c)
    return np.concatenate(out)


def padded(raw: np.ndarray) -> np.ndarray:
    """raw with what common_prefix may read beyond its end."""
    return np.concatenate([raw, np.zeros(8, np.uint8)])


def common_prefix(raw: np.ndarray, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The length of the common prefix of the bytes of raw (padded) at the places one[i] and two[i], up to most[i].

    Eight bytes are compared at once; the last step steps back, so nothing beyond the prefixes is read but for prefixes under eight bytes.
    """
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    length, live = np.zeros(len(one), np.int64), np.flatnonzero(most > 0)
    while len(live):
        at = np.minimum(length[live], np.maximum(most[live] - 8, 0))
        a, b = (np.ascontiguousarray(words[x[live] + at]).view(np.uint64).ravel() for x in (one, two))
        differ = a ^ b
        equal = differ == 0
        short = ~equal
        if short.any():  # little-endian: the first differing byte is the lowest non-zero one
            low = differ[short] & (~differ[short] + np.uint64(1))
            length[live[short]] = at[short] + np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8
        live, at = live[equal], at[equal]
        length[live] = at + 8
        live = live[length[live] < most[live]]
    return np.minimum(length, most)


def adjacent_common(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each neighbouring pair of starts in `order`, the length of their common prefix in the bytes `raw` (zeros beyond its end), up to `most`."""
    if len(order) < 2:
        return np.zeros(0, np.int64)
    return common_prefix(np.concatenate([raw, np.zeros(most + 8, np.uint8)]), order[:-1], order[1:], np.full(len(order) - 1, most))
