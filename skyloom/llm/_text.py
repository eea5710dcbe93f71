"""Vectorised word hashing shared by the text operators.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes with A-Z lowered, so a block of texts is
handled as one byte array, whose words are hashed together, eight bytes at a time, without a Python
loop over words. Hashes depend on the words alone, never on the block.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
BLOCK_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Spans of more bytes are hashed, and compared, one at a time.
_LONG = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number; the end is padded with zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans ``data[starts:ends]``; equal bytes give equal hashes anywhere.

    Eight bytes at a time are mixed in sequence by a bijection, so spans of equal length up to eight never collide;
    long spans are digested by BLAKE2.
    """
    n = ends - starts
    out = mix64((n + 1).astype(U64) * U64(0xA24BAED4963EE407))
    eight = _chunks(data)
    live = np.flatnonzero((n > 0) & (n <= _LONG))
    at, left = starts[live], n[live]
    while len(live):
        out[live] = mix64((out[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * U64(_P))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether ``data[starts:starts + lengths]`` and ``other[others:others + lengths]`` are the same bytes."""
    same = np.ones(len(starts), bool)
    a, b = _chunks(data), _chunks(other)
    live = np.flatnonzero((lengths > 0) & (lengths <= _LONG))
    done = 0
    while len(live):
        keep = _KEEP[np.minimum(lengths[live] - done, 8)]
        same[live] &= ((a[starts[live] + done] ^ b[others[live] + done]) & keep) == 0
        done += 8
        live = live[lengths[live] > done]
    for i in np.flatnonzero(lengths > _LONG).tolist():
        same[i] = np.array_equal(data[starts[i] : starts[i] + lengths[i]], other[others[i] : others[i] + lengths[i]])
    return same


def blocks(texts: list, limit: int = BLOCK_BYTES):
    """Yield (first, last, encoded texts) so that a block has about ``limit`` bytes or one text; null is empty."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, i, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, first + len(held), held


def join(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, each followed by one space, and where each text begins (with the end)."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    at = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raws], out=at[1:])
    return data, at


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (with the end)."""
    gap = SPACE[data]
    flips = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        flips = np.concatenate([[0], flips])
    starts, ends = flips[0::2], flips[1::2]
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raws: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the bounds of each text in them."""
    data, at = join(raws)
    starts, ends, bounds = word_spans(data, at)
    return span_hashes(LOWER[data] if lower else data, starts, ends), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a shorter text is one whole sequence, an empty one has none."""
    keys = mix64(np.arange(1, width + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)
    n = len(words) - width + 1
    grams = np.zeros(max(n, 0), U64)
    for j in range(width if n > 0 else 0):
        grams += words[j : j + n] * keys[j]
    grams = mix64(grams)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            s = np.sort(grams[lo : hi - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif hi > lo:
            short = (words[lo:hi] * keys[: hi - lo]).sum(dtype=U64) + U64(hi - lo)
            out.append(mix64(np.array([short], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
