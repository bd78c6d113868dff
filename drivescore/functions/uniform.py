"""``hash_uniform`` of runs of numbers, for tasks that make many draws of one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN = 32_768
# A run of numbers of like leading digits.
RUN_DIGITS = 4
RUN_NUMBERS = 10**RUN_DIGITS
_SINES = [int(abs(np.sin(k + 1)) * 2**32) for k in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _turned(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & 0xFFFFFFFF


def _steps(words: list, state: list, rows: int, last: bool) -> list:
    """The state after a block of sixteen words, each an array or one number for all rows; after the ``last`` block its first word is all that counts."""
    (a, b, c, d), begun = state, 0
    while begun < 16 and isinstance(words[begun], int) and isinstance(a, int):
        # Steps before the first word that varies are the same for all rows.
        t = (b + _turned((a + (d ^ (b & (c ^ d))) + words[begun] + _SINES[begun]) & 0xFFFFFFFF, _TURNS[begun])) & 0xFFFFFFFF
        a, b, c, d = d, t, b, c
        begun += 1
    a, b, c, d = (np.full(rows, v, np.uint32) if isinstance(v, int) else v.copy() for v in (a, b, c, d))
    f, t = np.empty_like(a), np.empty_like(a)
    # The first word of the sum is made by the fourth step from the end.
    for k in range(begun, 61 if last else 64):
        if k < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
            word = words[k]
        elif k < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
            word = words[(5 * k + 1) % 16]
        elif k < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
            word = words[(3 * k + 5) % 16]
        else:
            np.invert(d, f)
            f |= b
            f ^= c
            word = words[7 * k % 16]
        f += a
        if isinstance(word, int):
            f += np.uint32((word + _SINES[k]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[k])
        np.left_shift(f, np.uint32(_TURNS[k]), t)
        f >>= np.uint32(32 - _TURNS[k])
        t |= f
        t += b
        a, b, c, d, t = d, t, b, c, a
    if last:
        a = b
    return [np.uint32(s) + v if isinstance(s, int) else s + v for s, v in zip(state, (a, b, c, d), strict=True)]


def first_words(before: bytes, varied: np.ndarray, after: bytes) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of ``before``, a column of ``varied`` (byte, row) and ``after``, for each column."""
    many, rows = varied.shape
    length = len(before) + many + len(after)
    tail = after + b"\x80" + bytes(-(length + 9) % 64) + (8 * length).to_bytes(8, "little")
    words: list = np.frombuffer(before + bytes(many) + tail, "<u4").tolist()
    for k, digit in enumerate(varied, len(before)):
        word = words[k // 4]
        words[k // 4] = (np.uint32(word) if isinstance(word, int) else word) + (digit.astype(np.uint32) << np.uint32(8 * (k % 4)))
    state: list = list(_START)
    for block in range(0, len(words), 16):
        state = _steps(words[block : block + 16], state, rows, block + 16 == len(words))
    return state[0].byteswap()


def uniforms(before: bytes, first: int, last: int, after: bytes) -> Iterator[np.ndarray]:
    """``hash_uniform`` times 2^32 of before, number, after, for each number from first to last, by runs."""
    while first <= last:
        digits = len(str(first))
        # Numbers of a run have like leading digits, which are the same for all rows.
        end = min(last, first // RUN_NUMBERS * RUN_NUMBERS + RUN_NUMBERS - 1, 10**digits - 1)
        shared = max(digits - RUN_DIGITS, 0)
        numbers = np.arange(first, end + 1)
        varied = np.stack([numbers // 10 ** (digits - 1 - k) % 10 + 48 for k in range(shared, digits)])
        yield first_words(before + str(first)[:shared].encode(), varied, after)
        first = end + 1


def pair_words(texts: pa.Array, rows: np.ndarray, numbers: np.ndarray, after: bytes) -> np.ndarray:
    """``hash_uniform`` times 2^32 of text, number, after, for each pair of a row of ``texts`` and a number from 0; a text that is null is left out."""
    out = np.empty(len(rows), np.uint32)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    whole = texts.fill_null("").cast(pa.large_binary())
    begins, data = (np.frombuffer(part or b"", kind) for part, kind in zip(whole.buffers()[1:], (np.int64, np.uint8), strict=True))
    begins = begins[whole.offset : whole.offset + len(whole) + 1]
    lengths, length = np.unique(np.where(known, np.diff(begins), -1), return_inverse=True)
    digits = np.char.str_len(np.arange(numbers.max(initial=0) + 1).astype(str))
    # Pairs of one length of text and of number are one run: -1 is a text that is null.
    kind = (length * (digits[-1] + 1))[rows] + digits[numbers]
    for k in np.flatnonzero(np.bincount(kind)).tolist():
        size, width = int(lengths[k // (digits[-1] + 1)]), k % int(digits[-1] + 1)
        own = np.flatnonzero(kind == k)
        for begin in range(0, len(own), RUN):
            at = own[begin : begin + RUN]
            varied = [numbers[at] // 10 ** (width - 1 - j) % 10 + 48 for j in range(width)]
            if size >= 0:
                varied = [*(data[begins[rows[at]] + j] for j in range(size)), np.full(len(at), 124), *varied]
            out[at] = first_words(b"", np.stack(varied), b"|" + after)
    return out
