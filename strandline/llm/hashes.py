"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import WORD_BYTES

TABLE = np.frombuffer(WORD_BYTES, np.uint8)
U = np.uint64
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of one long text that are hashed at a time.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64; up to a slice's length they are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.ones(size, U)
        done = 1
        while done < size:
            step = U(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[: min(done, size - done)] * step
            done *= 2
        if size <= 2 * SLICE:
            _powers[base] = have
    return have[:n]


def fragments(b: np.ndarray, inside: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each run of word bytes, and the polynomial of its bytes."""
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    total = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * powers(BASE, len(b)), out=total[1:])
    return first, last, (total[last + 1] - total[first]) * powers(INVERSE, len(b) + 1)[first]


def finished(polynomial, length):
    """The hash of words from the polynomials of their bytes and their lengths."""
    return mix(polynomial + (length - 1).astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the n+1 offsets of the texts among the words. No word goes on into the next text."""
    if len(off) == 2 and len(data) > SLICE:
        h = long_word_hashes(data)
        return h, np.array([0, len(h)])
    b = TABLE[data]
    inside = b != 32
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(b))]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    first, last, poly = fragments(b, inside, begins, ends)
    return finished(poly, last - first + 1), np.searchsorted(first, off)


def long_word_hashes(data: np.ndarray) -> np.ndarray:
    """The same for one long text, a slice at a time; a word that crosses slices is put together from its fragments."""
    out: list[np.ndarray] = []
    poly, length = U(0), 0  # of the word that the last slice left open

    def close() -> None:
        nonlocal poly, length
        if length:
            out.append(finished(np.array([poly], U), np.array([length])))
        poly, length = U(0), 0

    for at in range(0, len(data), SLICE):
        b = TABLE[data[at : at + SLICE]]
        inside = b != 32
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first, last, p = fragments(b, inside, begins, ends)
        size = last - first + 1
        if length and inside[0]:
            with np.errstate(over="ignore"):
                poly = poly + p[0] * U(pow(BASE, length, 1 << 64))
            length += int(size[0])
            p, size, whole = p[1:], size[1:], int(size[0]) == len(b)
            if whole:
                continue
        close()
        if len(p) and inside[-1]:
            poly, length = p[-1], int(size[-1])
            p, size = p[:-1], size[:-1]
        out.append(finished(p, size))
    close()
    return np.concatenate(out) if out else np.zeros(0, U)
