"""MD5 of many short texts at once, for draws that need one hash a row and round."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
LONGEST = 55  # bytes that one block of MD5 takes


def _first_bits(words: list, n: int) -> np.ndarray:
    """The first 32 bits of the MD5 of n messages of one block, its 16 words given as arrays, or as ints where all agree."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't touch the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], int):
            f += np.uint32((_ADDED[i] + words[g]) & 0xFFFFFFFF)
        else:
            f += words[g]
            f += np.uint32(_ADDED[i])
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        f <<= np.uint32(_TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap()


def first_bits(names: np.ndarray, size: int, suffix: bytes) -> np.ndarray:
    """The first 32 bits, as numbers, of the MD5 of each name followed by suffix; names: a row of `size` bytes each."""
    n, length = len(names), size + len(suffix)
    if length > LONGEST:
        return np.array([int.from_bytes(hashlib.md5(name.tobytes() + suffix).digest()[:4], "big") for name in names], np.uint32)
    tail = suffix + b"\x80" + bytes(LONGEST - length) + (8 * length).to_bytes(8, "little")
    held, rest = size // 4, size % 4
    words = list(np.ascontiguousarray(names[:, : 4 * held]).view("<u4").T.copy()) if held else []
    if rest:
        mixed = np.zeros((n, 4), np.uint8)
        mixed[:, :rest] = names[:, 4 * held :]
        mixed[:, rest:] = np.frombuffer(tail[: 4 - rest], np.uint8)
        words.append(mixed.view("<u4").ravel())
        tail = tail[4 - rest :]
    words += [int.from_bytes(tail[i : i + 4], "little") for i in range(0, len(tail), 4)]
    return _first_bits(words, n)
