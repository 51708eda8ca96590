"""Stable 64-bit codes of words, and hashes of word windows, for use inside tasks."""

from __future__ import annotations

import numpy as np

#: An odd multiplier for rolling hashes (fixed value: the 64-bit golden ratio).
_BASE = 0x9E3779B97F4A7C15
#: Texts are coded in stretches of about this many bytes, cut between words.
STRETCH = 1 << 18


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed scrambling of unsigned 64-bit values (splitmix finaliser)."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            inverse = pow(_BASE, -1, 2**64)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_POWERS = Powers()
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte behind it; words are parted by space and the characters 9 to 13."""
    word = np.zeros(len(text) + 2, np.int8)
    word[1:-1] = ~_SPACES[np.frombuffer(text, np.uint8)]
    turns = np.flatnonzero(np.diff(word))
    return turns[::2], turns[1::2]


def _stretch_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    start, end = word_places(text)
    up, down = _POWERS.to(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTES[np.frombuffer(text, np.uint8)] * up[: len(text)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def placed_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 64-bit codes of the words of a text (polynomial hashes of their bytes, scrambled), and where each begins."""
    parts, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        cut = len(text)
        if cut - at > 2 * STRETCH:
            cut = max(text.rfind(s, at, at + STRETCH) for s in (b" ", b"\n", b"\t"))
            if cut <= at:  # a word longer than a stretch
                found = [p for s in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") if (p := text.find(s, at + STRETCH)) >= 0]
                cut = min(found, default=len(text))
        codes, start = _stretch_codes(text[at:cut])
        parts.append(codes)
        places.append(start + at)
        at = cut
    return np.concatenate(parts), np.concatenate(places)


def word_codes(text: bytes) -> np.ndarray:
    """Unsigned 64-bit codes of the words of a text."""
    return placed_codes(text)[0]


def batch_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts in a row, and how many words each text has."""
    codes, places = placed_codes(b"\n".join(texts))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return codes, np.diff(np.searchsorted(places, np.r_[0, ends]))


def window_hashes(codes: np.ndarray, size: int, base: int = _BASE) -> np.ndarray:
    """A hash of every window of size codes (none if there are fewer); codes may hold several rows."""
    n = codes.shape[-1] - size + 1
    if n <= 0:
        return codes[..., :0]
    total, done, power, width = None, 0, codes, 1
    left = size
    while left:  # windows of 1, 2, 4, ... codes, put together to size
        if left & 1:
            part = power[..., done : done + n]
            total = part if total is None else total * np.uint64(pow(base, width, 2**64)) + part
            done += width
        left >>= 1
        if left:
            power = power[..., : power.shape[-1] - width] * np.uint64(pow(base, width, 2**64)) + power[..., width:]
            width *= 2
    return mixed(total)
