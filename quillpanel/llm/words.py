"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes of text that are taken apart at once.
WINDOW = 1 << 18
_POWER = U(0x9E3779B97F4A7C15 | 1)
_SHINGLE = U(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    h = h ^ U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def _fragments(buffer: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of word bytes: its sum of bytes times powers, its length, and its first place."""
    blank = spaces[buffer]
    before = np.concatenate([[True], blank[:-1]])
    after = np.concatenate([blank[1:], [True]])
    starts, lengths = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    lengths -= starts
    if not len(starts):
        return np.zeros(0, U), lengths, starts
    powers = np.cumprod(np.full(int(lengths.max()), _POWER))
    first = np.cumsum(lengths) - lengths
    letters = buffer[~blank].astype(U) + U(1)
    letters *= powers[np.arange(len(letters)) - np.repeat(first, lengths)]
    return np.add.reduceat(letters, first), lengths, starts


def _long_text(text: bytes, spaces: np.ndarray) -> np.ndarray:
    """Word hashes of one text, window by window; a word across windows is summed up over them."""
    out, held, length = [], 0, 0
    for at in range(0, len(text), WINDOW):
        buffer = np.frombuffer(text, np.uint8, min(WINDOW, len(text) - at), at)
        sums, lengths, starts = _fragments(buffer, spaces)
        if length and not (len(starts) and starts[0] == 0):  # the open word ended with its window
            out.append(mixed(np.array([held], U) + U(length)))
            held = length = 0
        elif length:
            sums[0] = U((held + int(sums[0]) * pow(int(_POWER), length, 1 << 64)) % (1 << 64))
            lengths[0] += length
            held = length = 0
        if len(starts) and not spaces[buffer[-1]]:
            held, length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        out.append(mixed(sums + lengths.astype(U)))
    if length:
        out.append(mixed(np.array([held], U) + U(length)))
    return np.concatenate(out)


def word_hashes(texts: list[bytes], spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all ``texts`` in order, and where each text's words begin and end.

    Works on at most WINDOW bytes at a time, whatever a text's length.
    """
    hashes, counts, group, size = [np.zeros(0, U)], [], [], 0

    def finish() -> None:
        nonlocal group, size
        if group:
            sums, lengths, starts = _fragments(np.frombuffer(b"\n".join(group), np.uint8), spaces)
            ends = np.cumsum([len(t) + 1 for t in group])
            counts.extend(np.diff(np.searchsorted(starts, ends), prepend=0).tolist())
            hashes.append(mixed(sums + lengths.astype(U)))
        group, size = [], 0

    for text in texts:
        if size + len(text) > WINDOW:
            finish()
        if len(text) > WINDOW:
            hashes.append(_long_text(text, spaces))
            counts.append(len(hashes[-1]))
        else:
            group.append(text)
            size += len(text) + 1
    finish()
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def shingle_sets(texts: list[bytes], spaces: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles; of all its words where it has fewer."""
    words, bounds = word_hashes(texts, spaces)
    n = max(0, len(words) - size + 1)
    rolled = words[:n].copy()
    for k in range(1, size):
        rolled = rolled * _SHINGLE + words[k : n + k]
    rolled = mixed(rolled, size)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = U(0)
            for w in words[a:b]:
                one = U((int(one) * int(_SHINGLE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mixed(np.array([one], U), int(b - a)))
        else:
            sets.append(np.zeros(0, U))
    return sets
