"""Words and shingles of whole Arrow batches at once, as 64-bit hashes, by NumPy over the UTF-8 buffer.

A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64 and then mixed with its length.
The buffer is worked through in pieces of PIECE bytes that end between words, so that memory stays bounded by the
piece (or the longest single word), however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow, _inv = powers(_P, PIECE + 1), powers(_INV, PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_set(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


#: Space and U+0009 to U+000D.
SPACES = byte_set(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII that is neither letter nor digit; for words that are compared whatever their punctuation.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words in order: the text each stands in, its first and last byte, its hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: list[np.ndarray]


def words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACES, lower: np.ndarray | None = LOWER, spans: bool = False, prefixes: tuple[int, ...] = ()) -> Words:
    """spans: keep start and end (else empty arrays).  prefixes: also the hashes of the first so many bytes of longer words (else 0)."""
    global _pow, _inv
    n, at = len(data), 0
    texts, starts, ends, hashes = [], [], [], []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    while at < n:
        stop = min(at + PIECE, n)
        while stop < n and not spaces[data[stop]]:  # to the next space or the next text
            room = data[stop : stop + PIECE]
            found = np.flatnonzero(spaces[room])
            nearest = stop + (int(found[0]) if len(found) else len(room))
            k = int(np.searchsorted(offsets, stop))
            stop = min(nearest, int(offsets[k])) if k < len(offsets) else nearest
            if k < len(offsets) and stop == int(offsets[k]):
                break
        x = data[at:stop]
        on = ~spaces[x]
        cut = np.zeros(len(x) + 1, dtype=bool)
        a, b = np.searchsorted(offsets, [at, stop])
        cut[offsets[a:b] - at] = True
        cut[0] = cut[-1] = True
        prev = np.empty_like(on)
        prev[0], prev[1:] = False, on[:-1]
        s = np.flatnonzero(on & (~prev | cut[:-1]))
        nxt = np.empty_like(on)
        nxt[-1], nxt[:-1] = False, on[1:]
        e = np.flatnonzero(on & (~nxt | cut[1:])) + 1
        if len(s):
            if len(x) >= len(_pow):
                _pow, _inv = powers(_P, len(x) + 1), powers(_INV, len(x) + 1)
            v = (lower[x] if lower is not None else x).astype(U) + U(1)
            sums = np.zeros(len(x) + 1, dtype=U)
            np.cumsum(v * _pow[: len(x)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * _inv[s] ^ (e - s).astype(U) * U(0xD6E8FEB86659FD93)))
            for out, k in zip(heads, prefixes, strict=True):
                cut_at = np.minimum(s + k, len(x))
                out.append(np.where(e - s > k, mix((sums[cut_at] - sums[s]) * _inv[s] ^ U(k * 0x9E3779B9)), U(0)))
            texts.append((np.searchsorted(offsets, s + at, side="right") - 1).astype(np.int64))
            if spans:
                starts.append(s + at)
                ends.append(e + at)
        at = stop
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return Words(cat(texts, np.int64), cat(starts, np.int64), cat(ends, np.int64), cat(hashes, U), [cat(h, U) for h in heads])


@dataclass
class Shingles:
    """Shingles in order of text and place; first[t] to first[t + 1] are those of text t."""

    hash: np.ndarray
    first: np.ndarray


def shingles(w: Words, n_texts: int, k: int) -> Shingles:
    """All runs of k words inside a text; a text of 1 to k - 1 words has one shingle, the whole sequence."""
    count = np.bincount(w.text, minlength=n_texts)
    first_word = np.concatenate([[0], np.cumsum(count)])
    mult = powers(0xC2B2AE3D27D4EB4F, k + 1)[1:]
    have = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(have)])
    n = len(w.hash)
    acc = np.zeros(max(0, n - k + 1), dtype=U)
    for j in range(k if len(acc) else 0):
        acc += w.hash[j : n - k + 1 + j] * mult[j]
    out = np.empty(first[-1], dtype=U)
    whole = w.text[: len(acc)] == w.text[k - 1 :] if len(acc) else np.zeros(0, bool)
    long_texts = np.repeat(count >= k, have)
    out[long_texts] = acc[whole]
    for t in np.flatnonzero((count > 0) & (count < k)):
        part = w.hash[first_word[t] : first_word[t + 1]]
        out[first[t]] = (part * mult[: len(part)]).sum(dtype=U) + U(len(part))
    return Shingles(mix(out), first)


def slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose weights add up to at most `most` (or one heavier item)."""
    at, upto = 0, np.concatenate([[0], np.cumsum(weights)])
    while at < len(weights):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield at, stop
        at = stop


def segments(data: np.ndarray, off: np.ndarray, most: int, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts where those over `most` bytes are cut at the first separator from there on (a run without one stays whole), and whose text each is."""
    cuts: list[int] = []
    owners: list[int] = []
    for t in np.flatnonzero(np.diff(off) > most).tolist():
        at, end = int(off[t]), int(off[t + 1])
        while end - at > most:
            at += most
            while at < end and not len(found := np.flatnonzero(spaces[data[at : min(at + PIECE, end)]])):
                at = min(at + PIECE, end)
            if at >= end:
                break
            at += int(found[0])
            cuts.append(at)
            owners.append(t)
    place = np.searchsorted(off, np.array(cuts, np.int64), side="right")
    new = np.insert(off, place, cuts) if cuts else off
    owner = np.sort(np.concatenate([np.arange(len(off) - 1), np.array(owners, np.int64)]))
    return new, owner
