"""Adaptive context-mixing range coder for blocks of token ids.

A block holds up to BLOCK ids and is coded by itself: its models start empty, and it ends in a
checksum of its ids. The ids that occur in a block are listed and renumbered; each id is then one step
of a range coder whose distribution mixes three predictions:

- order 0: counts of the block's ids so far, each with a base of 1;
- order 1: the id that followed the previous id last time;
- order 2: the id that followed the previous two last time.

The two guesses are places of the table beside the ids, so their weights are their hits so far. An id is
coded by order 2 if its guess is right, else by order 1 if that one is, else by its own place, and the
place that was taken is what is counted. The counts are taken over at the steps of _periods.

Blocks of a call are coded in lockstep, one array operation a step for all. A coder knows all contexts
beforehand: it finds the right guesses by sorting a block's steps by context, so only its own state goes
step by step. As tables hold places, a decoder takes all places of a period before it resolves the guesses
among them. Steps cost what their look-ups miss in the caches, so tables are ragged and of few bytes. A table's
weights add up to a power of two of at most 16 bits, so a decoder finds a place by one look-up, and a
step puts out one 16-bit word at most. A block that has ended runs on unused and without effect.

Layout of a block, little-endian: n ids and alphabet size (u32 each), crc32 of the ids as u32 (u32),
words (u32), the alphabet as gaps (a byte each, or 255 and u16), then the coder's 16-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192
STEP = 24  # weight of one occurrence
TABLE = 4096  # order-2 slots a block
PERIOD = 512  # most ids between two tables
NEAR, FAR = np.uint16(1213), np.uint16((1 << 16) - 1212)
GUESSES = 2  # places 0 and 1 of a table: what order 1 and order 2 say
_PLACES = np.arange(BLOCK, dtype=np.uint32)
_LOW = np.int64(1) << 48
_RENORM = np.int64(1) << 32
_HEAD = struct.Struct("<4I")


def _periods(longest: int):
    """(first, end) steps that share a table: short ones at the start of a block."""
    edges = [k for k in (0, 16, 32, 64, 128, 256) if k < longest] + list(range(PERIOD, longest, PERIOD)) + [longest]
    return zip(edges[:-1], edges[1:], strict=True)


class _Tables:
    """Weights of each block's places, from the places taken so far, block after block: a flat place is the block's row + place."""

    def __init__(self, sizes: np.ndarray):
        self.places = sizes + GUESSES
        self.rows = np.cumsum(self.places) - self.places
        self.bits = np.array([max(12, s.bit_length() + 2) for s in self.places.tolist()], np.int64)
        self.base = np.cumsum(1 << self.bits) - (1 << self.bits)  # where a block's places by weight begin
        self.named = (np.arange(self.places.sum()) - np.repeat(self.rows, self.places)).astype(np.uint16)
        self.lift = self.named + np.float32(1.5)  # a weight of one for each place up to this one, and rounding
        self.mass = np.ones(len(self.named), np.int32)

    def refresh(self, step: int, taken: np.ndarray):
        """Take over the flat places taken since the last table: `below` and `weight` of each."""
        self.mass += STEP * np.bincount(taken.ravel(), minlength=len(self.mass))
        total, upper = STEP * step + self.places, self.mass.copy()
        upper[self.rows[1:]] -= total[:-1]  # each block's sum begins at 0
        np.cumsum(upper, out=upper)
        # Sums are below 2 ** 24, so these are exact; where rounding leaves off, each edge is still above the one before.
        edges = upper.astype(np.float32)
        edges *= np.repeat((((1 << self.bits) - self.places) / total).astype(np.float32), self.places)
        edges += self.lift
        np.copyto(upper, edges, casting="unsafe")
        below = np.empty_like(upper)
        below[1:] = upper[:-1]
        below[self.rows] = 0
        upper -= below
        self.below, self.weight = below, upper

    def held(self) -> np.ndarray:
        """The place of each weight, block by block."""
        return np.repeat(self.named, self.weight)


def _in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places by value, then place; the values there; whether each but the first equals the one before it)."""
    keys = values.astype(np.uint32)
    keys *= np.uint32(BLOCK)
    keys += _PLACES[: len(values)]
    keys.sort()
    at = (keys & np.uint32(BLOCK - 1)).astype(np.int64)
    keys //= np.uint32(BLOCK)
    return at, keys, _equal(keys)


def _equal(found: np.ndarray) -> np.ndarray:
    return found[1:] == found[:-1]


def _alphabet_and_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids that occur, in order; each id's place in its block's table: its own or a guess that says it)."""
    at, values, same = _in_order(ids)
    new = np.ones(len(ids), np.bool_)
    np.logical_not(same, out=new[1:])
    places = np.empty(len(ids), np.uint16)
    places[at] = np.cumsum(new) + (GUESSES - 1)
    past = np.zeros(len(ids) + 2, np.uint16)  # numbers of the ids, plus one; 0: none
    np.subtract(places, np.uint16(GUESSES - 1), out=past[2:])
    follows = np.full(len(ids), 1 << 16, np.uint32)
    follows[:-1] = ids[1:]
    places[at[1:][same & _equal(follows.take(at))] + 1] = 0
    at, _, same = _in_order(_slots(past[1:-1], past[:-2]))
    places[at[1:][same & _equal(ids.take(at))]] = 1
    return values[new].astype(np.int64), places


def _slots(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The order-2 slot of two ids, by their numbers plus one; 0: none."""
    return (last * NEAR + before * FAR) & np.uint16(TABLE - 1)


def _pack_gaps(alphabet: np.ndarray) -> bytes:
    gaps = alphabet.copy()
    gaps[1:] -= alphabet[:-1]
    wide = gaps >= 255
    out, used = np.empty((len(gaps), 3), np.uint8), np.ones((len(gaps), 3), np.bool_)
    out[:, 0], out[:, 1], out[:, 2] = np.where(wide, 255, gaps), gaps & 255, gaps >> 8
    used[:, 1:] = wide[:, None]
    return out[used].tobytes()


def _unpack_gaps(data: bytes, at: int, size: int) -> tuple[np.ndarray, int]:
    """(alphabet, where the coder's words begin)."""
    begin, left, wide = at, size, []
    while (found := data.find(b"\xff", at, at + left)) >= 0:
        wide.append(found - begin)
        left, at = left - (found - at) - 1, found + 3
    raw = np.frombuffer(data, np.uint8, at + left - begin, begin).astype(np.int64)
    wide = np.array(wide, np.int64)
    raw[wide] = raw[wide + 1] | raw[wide + 2] << 8
    single = np.ones(len(raw), np.bool_)
    single[wide + 1] = single[wide + 2] = False
    return np.cumsum(raw[single]), at + left


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of 1 to BLOCK ids below 65536 as bytes."""
    if not blocks:
        return []
    lengths, n = np.array([len(b) for b in blocks]), len(blocks)
    longest = int(lengths.max())
    by_block, alphabets = np.full((n, longest), GUESSES, np.uint16), []
    for row, ids in zip(by_block, blocks, strict=True):
        alphabet, row[: len(ids)] = _alphabet_and_places(ids)
        alphabets.append(alphabet)
    grid = np.ascontiguousarray(by_block.T)
    tables = _Tables(np.array([len(a) for a in alphabets], np.int64))
    bits, columns = tables.bits, np.arange(n)
    words = np.empty((longest, n), np.int32)  # plus one; 0: none at this step
    low, span = np.zeros(n, np.int64), np.full(n, _LOW)
    t, small = np.empty(n, np.int64), np.empty(n, np.int64)
    taken = np.empty((0, n), np.int64)
    for first, end in _periods(longest):
        tables.refresh(first, taken)
        taken = grid[first:end] + tables.rows
        starts, widths = tables.below.take(taken), tables.weight.take(taken)
        if end > lengths.min():
            over = np.arange(first, end)[:, None] >= lengths
            starts[over] = 0
            widths[over] = np.broadcast_to(1 << bits, over.shape)[over]
        for start, width in zip(starts, widths, strict=True):  # the word takes the start's place
            np.right_shift(span, bits, out=t)
            np.multiply(t, width, out=span)
            t *= start
            low += t
            np.subtract(span, _RENORM, out=small)
            small >>= 63  # all ones where a word is due
            np.right_shift(low, 32, out=t)  # with a carry, settled below
            t &= small
            np.subtract(t, small, out=start)
            t <<= 32
            low -= t
            small &= 16
            low <<= small
            span <<= small
        words[first:end] = starts
    by_block = np.ascontiguousarray(words.T)
    due = by_block > 0
    at = due.sum(axis=1)
    depth = int(at.max()) + 3
    written = np.zeros((n, depth), np.int32)
    written[np.arange(depth) < at[:, None]] = by_block[due] - 1
    for k in range(3):
        written[columns, at + k] = (low >> (32 - 16 * k)) & (0x1FFFF if k == 0 else 0xFFFF)
    carried = np.flatnonzero(written > 0xFFFF)
    written = written.ravel()
    while len(carried):  # at most one carry a word at a time
        written[carried] &= 0xFFFF
        carried -= 1
        written[carried] += 1
        carried = carried[written[carried] > 0xFFFF]
    written = written.reshape(n, depth)
    written = written.astype("<u2")
    out: list[bytes] = []
    for k, (ids, alphabet) in enumerate(zip(blocks, alphabets, strict=True)):
        size = int(at[k]) + 3
        while size and not written[k, size - 1]:
            size -= 1
        out.append(_HEAD.pack(len(ids), len(alphabet), zlib.crc32(ids.astype("<u4").tobytes()), size) + _pack_gaps(alphabet) + written[k, :size].tobytes())
    return out


@np.errstate(divide="ignore", over="ignore")  # in damaged blocks
def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a checksum fails."""
    if not coded:
        return []
    heads = [_HEAD.unpack_from(b) for b in coded]
    longest, n = max(h[0] for h in heads), len(coded)
    depth = max(h[3] for h in heads) + 4  # zeros from a block's words on
    words = np.zeros((n, depth), np.uint16)
    alphabets = []
    for k, (_, size, _, n_words) in enumerate(heads):
        alphabet, begin = _unpack_gaps(coded[k], _HEAD.size, size)
        alphabets.append(alphabet)
        words[k, :n_words] = np.frombuffer(coded[k], "<u2", n_words, begin)
    sizes, columns = np.array([h[1] for h in heads], np.int64), np.arange(n)
    tables = _Tables(sizes)
    bits, base, rows = tables.bits, tables.base, tables.rows
    ahead = (words[:, 0].astype(np.int64) << 32) | (words[:, 1].astype(np.int64) << 16) | words[:, 2]  # the code less the coder's low end
    at, words = columns * depth + 3, words.ravel()
    span, unit, t, more = np.full(n, _LOW), *(np.empty(n, np.int64) for _ in range(3))
    narrow, pair, half = np.empty(n, np.uint16), np.empty(n, np.uint32), np.empty(n, np.uint32)
    # What followed each id and each slot of two, plus one; 0: nothing yet.
    one, two = np.zeros(len(tables.mass), np.uint16), np.zeros(n * TABLE, np.uint16)
    ones, twos = rows, columns * TABLE  # where a block's entries begin
    a1, a2 = ones.copy(), twos.copy()
    guess1, guess2, slot, before = np.empty(n, np.uint16), np.empty(n, np.uint16), np.empty(n, np.uint16), np.zeros(n, np.uint16)
    by_step, taken = np.empty((longest, n), np.uint16), np.empty((0, n), np.int64)
    for first, end in _periods(longest):
        tables.refresh(first, taken)
        held, both = tables.held(), tables.below.astype(np.uint32)  # one look-up for two
        both |= tables.weight.astype(np.uint32) << 16
        taken = np.empty((end - first, n), np.int64)
        found = by_step[first:end]
        for place, flat in zip(found, taken, strict=True):
            np.right_shift(span, bits, out=unit)
            np.floor_divide(ahead, unit, out=t)
            t += base
            held.take(t, out=place, mode="clip")
            np.add(place, rows, out=flat)
            both.take(flat, out=pair, mode="clip")
            np.right_shift(pair, 16, out=half)
            np.multiply(unit, half, out=span)
            np.bitwise_and(pair, 0xFFFF, out=half)
            unit *= half
            ahead -= unit
            np.subtract(span, _RENORM, out=t)
            t >>= 63  # all ones where a word is due
            words.take(at, out=narrow, mode="clip")
            np.bitwise_and(narrow, t, out=more)
            at -= t
            t &= 16
            ahead <<= t
            ahead |= more
            span <<= t
        by1, by2 = found == 0, found == 1
        found -= np.uint16(GUESSES - 1)
        for x, is1, is2 in zip(found, by1, by2, strict=True):
            one.take(a1, out=guess1, mode="clip")
            two.take(a2, out=guess2, mode="clip")
            np.copyto(x, guess1, where=is1)
            np.copyto(x, guess2, where=is2)
            one[a1] = x
            two[a2] = x
            np.add(ones, x, out=a1)
            np.multiply(x, NEAR, out=slot)
            slot += before
            slot &= np.uint16(TABLE - 1)
            np.add(twos, slot, out=a2)
            np.multiply(x, FAR, out=before)
    by_step -= np.uint16(1)
    flat = np.ascontiguousarray(by_step.T)
    out: list[np.ndarray] = []
    for k, (length, _, crc, _) in enumerate(heads):
        ids = alphabets[k].astype("<u4").take(flat[k, :length], mode="clip")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("checksum of a block of token ids")
        out.append(ids)
    return out
