"""Word and shingle hashes of many texts at once, by numpy over their bytes."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.zeros(256, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _TABLE[_b] = _b
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _PRIME, np.uint64))])
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, inverse, np.uint64))])
    return _powers, _inverses


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of a-z, 0-9 and non-ASCII bytes of the lowered
    text), and for each text the number of words before it (and the total)."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\0".join([*data, b""]), np.uint8)
    mapped = _TABLE[raw]
    inside = mapped != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]  # the buffer ends with a separator
    powers, inverses = _power_tables(max(1, len(raw) + 1))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mapped * powers[: len(raw)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])])
    return hashes, np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs over text ends are the caller's to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + words[k : k + n]
    return mix(out)


def text_words(text: str) -> list[str]:
    """The words that ``word_hashes`` sees, as text."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(bytes(x or 32 for x in _TABLE.tolist()))
    return [w.decode("utf-8", "surrogatepass") for w in data.split(b" ") if w]
