"""Sets of word shingles as 64-bit hashes, computed over whole texts a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words in a shingle, and bytes of text whose words are hashed at once.
WORDS, SLICE = 5, 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers, one to one (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(base & (2**64 - 1)), np.uint64), dtype=np.uint64)])


_UP = _powers(_BASE, SLICE + 1)
_DOWN = _powers(pow(_BASE, -1, 2**64), SLICE + 1)


def _word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``text`` (bytes, SLICE at most) and where they start."""
    inside = np.concatenate([[False], ~_SEPARATORS[text], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[_LOWER[text]] * _UP[: len(text)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)), starts


def _long_word(text: np.ndarray) -> np.uint64:
    """The hash of one word of more than SLICE bytes, as the words above have it."""
    total, up = 0, 1
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE]
        own = int(np.sum(_BYTES[_LOWER[part]] * _UP[: len(part)], dtype=np.uint64))
        total, up = (total + own * up) % 2**64, up * int(_UP[SLICE]) % 2**64
    return mixed(np.array([(total + len(text)) % 2**64], np.uint64))[0]


def long_text_hashes(text: np.ndarray) -> np.ndarray:
    """Word hashes of a text of any length, in slices that end between words."""
    out, at = [], 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            gaps = np.flatnonzero(_SEPARATORS[text[at:end]])
            if len(gaps):
                end = at + gaps[-1] + 1
            else:
                after = end
                while after < len(text) and not _SEPARATORS[text[after : after + SLICE]].any():
                    after += SLICE
                gap = np.flatnonzero(_SEPARATORS[text[after : after + SLICE]])
                end = min(after + (gap[0] if len(gap) else SLICE), len(text))
                if end - at > SLICE:
                    out.append(np.array([_long_word(text[at:end])], np.uint64))
                    at = end
                    continue
        out.append(_word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _joined(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    x = words[:n] + np.uint64(k)
    for j in range(1, k):
        x = x * _MULTIPLIER + words[j : n + j]
        x ^= x >> np.uint64(29)
    return mixed(x)


def _set_of(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    return np.unique(_joined(words, min(WORDS, len(words))))


def shingle_sets(texts: Iterator[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; texts are hashed together up to SLICE bytes."""

    def flush(held: list[bytes]) -> Iterator[np.ndarray]:
        joined = np.frombuffer(b"\n".join(held), np.uint8)
        words, starts = _word_hashes(joined)
        runs = _joined(words, WORDS) if len(words) >= WORDS else words[:0]
        begins = np.cumsum([0] + [len(t) + 1 for t in held])
        cuts = np.searchsorted(starts, begins)
        for a, b in zip(cuts, cuts[1:]):
            yield np.unique(runs[a : b - WORDS + 1]) if b - a >= WORDS else _set_of(words[a:b])

    held, size = [], 0
    for text in texts:
        text = text or b""
        if size + len(text) + 1 > SLICE and held:
            yield from flush(held)
            held, size = [], 0
        if len(text) + 1 > SLICE:
            yield _set_of(long_text_hashes(np.frombuffer(text, np.uint8)))
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        yield from flush(held)


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    total = mixed(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) if len(shingles) else np.uint64(0)
    return int(mixed(np.array([total], np.uint64) + np.array([len(shingles)], np.uint64) * _MULTIPLIER)[0])
