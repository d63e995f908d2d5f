"""Word and word-window hashes of a text, all words at once.

A polynomial of the bytes is summed up from the left once; any word's value is the
difference of two totals, shifted back by the inverse power of its start. This is the
Karp-Rabin scheme over 64 bits; results go through a bit mixer, so windows of words
can again be combined as polynomials. Texts are cut at word boundaries into pieces
of about a megabyte, which bounds memory by the piece and not by the text.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Byte classes: blanks separate words, or everything but ASCII letters and digits and bytes of other characters.
BLANKS = np.ones(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: ASCII letters to lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        grown = max(size, 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(grown, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the whole result."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _piece(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power(len(data) + 1)
    totals = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=totals[1:])
    return mix((totals[ends] - totals[starts]) * inverse[starts]), starts, ends


def words(text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, start and end byte of every word, and the folded bytes."""
    data = FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = classes[data]
    if len(data) <= PIECE:
        return *_piece(data, inside), data.tobytes()
    parts, start = [], 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        if end < len(data):
            outside = np.flatnonzero(~inside[end : end + PIECE])
            while not len(outside) and end < len(data):
                end = min(end + PIECE, len(data))
                outside = np.flatnonzero(~inside[end : end + PIECE])
            end += int(outside[0]) if len(outside) else 0
        hashes, begins, ends = _piece(data[start:end], inside[start:end])
        parts.append((hashes, begins + start, ends + start))
        start = end
    return *(np.concatenate([p[k] for p in parts]) for k in range(3)), data.tobytes()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; none if there are fewer."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(size), np.uint64)
    for k in range(size):
        total = total * _STEP + hashes[k : k + count]
    return mix(total)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct window hashes of a text's blank-separated words, A-Z folded.

    A text of fewer words has one: its whole sequence. No words, no shingles.
    """
    hashes = words(text, BLANKS)[0]
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(size, len(hashes))))
