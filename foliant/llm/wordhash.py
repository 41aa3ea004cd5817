"""Vectorised hashes of words and of word spans, from the raw bytes of whole texts.

Word hashes are polynomial over a table of random byte codes, modulo 2**64 with an odd base, so
that one running sum gives the hash of any stretch; a finalizer mixes them. Spans of words are
hashed alike over the word hashes. Equal words have equal hashes on every machine.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_517))
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_BYTE_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Longer texts are hashed in pieces that end at white space, if there is any.
PIECE = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; kept for later calls, until forget()."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        inverse = U(pow(int(base), -1, 2**64))
        have = tuple(np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, b, U)])) for b in (base, inverse))
        if size <= 4 * PIECE:
            _powers[int(base)] = have
    return have


def forget() -> None:
    _powers.clear()


def _piece_words(data: bytes, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begins):
        return np.empty(0, U), begins, ends
    power, inverse = powers(_BYTE_BASE, len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(codes[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[begins]) * inverse[begins]), begins, ends


def words(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (byte offsets) of each word. lower: A-Z count as a-z."""
    codes = _LOWER if lower else _CODES
    if len(data) <= 2 * PIECE:
        return _piece_words(data, codes)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        h, b, e = _piece_words(data[at:stop], codes)
        parts.append((h, b + at, e + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def words_of(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and bounds: text i has words bounds[i] to bounds[i + 1]."""
    if len(texts) == 1:
        h, _, _ = words(texts[0] or b"", lower)
        return h, np.array([0, len(h)])
    h, begins, _ = words(b"\n".join(t or b"" for t in texts), lower)
    at = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return h, np.searchsorted(begins, at)


def span_sums(h: np.ndarray) -> np.ndarray:
    power, _ = powers(_WORD_BASE, len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return total


def spans(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word spans [begin, end); those of different lengths differ."""
    _, inverse = powers(_WORD_BASE, len(sums))
    return mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(U) * U(0xA24BAED4963EE407))
