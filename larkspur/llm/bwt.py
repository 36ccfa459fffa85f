"""Which positions of a set of strings start a substring of a given length that also starts elsewhere.

Threshold-bounded interval expansion: intervals of the suffix array are extended backward, breadth
first, on the Burrows-Wheeler transform. Round l sets the common-prefix values equal to l, so they
come in increasing order; after `least` rounds the values not set are at least `least`, and the
rounds stop there.
"""

from __future__ import annotations

import numpy as np


WIDTH = 5  # symbols of the first ranks: they fit 41 bits, and WIDTH * 3**4 is just over 400


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of strings that each end in their own separator, in order of their first `depth` symbols, or of all.

    symbols: bytes + 1, 0 at separators. Ranks of WIDTH symbols at first, then of two or three times as
    many a round; only suffixes that still share a rank are sorted again. A suffix that ends within the
    width of a round has a rank of its own by then, so no rank beyond a separator decides an order.
    """
    n, width = len(symbols), WIDTH
    one = np.zeros(n + width, np.int64)
    one[:n] = symbols
    two = one[:-1] * 257 + one[1:]
    key = (two[:n] * 257**2 + two[2 : n + 2]) * 257 + one[4 : n + 4]
    # What lies behind a separator doesn't count.
    inside, ends = np.ones(n, np.bool_), np.flatnonzero(symbols == 0)
    lengths = np.diff(ends, prepend=-1) - 1
    for k in range(width):
        short = ends[lengths >= k] - k
        inside[short] = False
        key[short] -= key[short] % 257 ** (width - k)
    bits = n.bit_length()
    if bits <= 22:  # the key and the place in one number, since numbers sort faster than their places
        key <<= bits
        key |= np.arange(n)
        key.sort()
        who = (key & ((1 << bits) - 1)).astype(np.int32)
        key >>= bits
    else:
        who = np.argsort(key, kind="stable").astype(np.int32)
        key = key[who]
    places, order, rank = np.arange(n, dtype=np.int32), np.empty(n, np.int32), np.empty(n, np.int32)
    new = np.ones(n, np.bool_)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    new |= ~inside[who]  # equal ones go by their separators, as the stable sort has them
    while True:
        order[places] = who
        heads = np.maximum.accumulate(np.where(new, places, 0))
        rank[who] = heads
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied) or (depth is not None and width >= depth):
            return order
        places, who = places[tied], who[tied]
        key = heads[tied].astype(np.int64) << bits
        key |= rank[who + width]
        if 3 * bits < 64:
            key <<= bits
            key |= rank.take(who + 2 * width, mode="clip")
            width *= 3
        else:
            width *= 2
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        new = np.ones(len(who), np.bool_)
        np.not_equal(key[1:], key[:-1], out=new[1:])


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, the sorted positions where a substring of `least` bytes starts that starts at another position too."""
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    n = int(ends[-1]) + 1 if len(ends) else 0
    if not n:
        return [np.empty(0, np.int64) for _ in strings]
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    order = suffix_array(symbols, least)  # the order of longer repeats moves no interval of a shorter one
    last = symbols[order - 1]  # the transform; the first suffix wraps to the last separator
    # Last-to-first mapping: stable order of the transform. Separators never take part in an extension.
    psi = np.argsort(last, kind="stable").astype(np.int32)
    first_of = np.empty(n, np.int32)
    first_of[psi] = np.arange(n, dtype=np.int32)
    same = last[psi[1:]] == last[psi[:-1]]
    following, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    following[psi[:-1][same]] = psi[1:][same]
    before[psi[1:][same]] = psi[:-1][same]
    extends = last > 0
    before[~extends], following[~extends] = n, -1
    unset = np.ones(n + 1, np.bool_)  # unset[i]: the common prefix of suffixes i - 1 and i is not known yet
    unset[0] = unset[n] = False
    # Round 0: one interval for each first symbol; separators are intervals of their own.
    heads = symbols[order]
    starts = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]) | (heads[1:] == 0)]))
    lows, highs = starts.astype(np.int32), np.append(starts[1:] - 1, n - 1).astype(np.int32)
    unset[starts] = False
    for _ in range(1, least):
        single = lows == highs
        ranks = lows[single]
        ranks = ranks[extends[ranks]]
        moved = first_of[ranks]
        i, j = [moved], [moved]
        if not single.all():
            a, b = lows[~single], highs[~single]
            sizes = (b - a + 1).astype(np.int64)
            ends_at = np.cumsum(sizes)
            ranks = np.arange(ends_at[-1], dtype=np.int32) + np.repeat((a - (ends_at - sizes)).astype(np.int32), sizes)
            i.append(np.sort(first_of[ranks[before[ranks] < np.repeat(a, sizes)]]))
            j.append(np.sort(first_of[ranks[following[ranks] > np.repeat(b, sizes)]]))
        i, j = np.concatenate(i), np.concatenate(j)
        fresh = unset[j + 1]
        lows, highs = i[fresh], j[fresh]
        if not len(lows):
            break
        unset[highs + 1] = False
    repeated = np.zeros(n, np.bool_)
    repeated[order[unset[:-1] | unset[1:]]] = True
    begins = ends - lengths
    return [np.flatnonzero(repeated[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
