"""Hashes of words and word n-grams, vectorised over a run of text."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
RUN = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(line: bytes) -> np.ndarray:
    n = len(line)
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(max(n, RUN), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    octets = np.frombuffer(line, np.uint8)
    ends = np.append(np.flatnonzero(octets == 32), n)
    starts = np.append(0, ends[:-1] + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers[1][starts])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word (no blanks inside), equal for equal words wherever they stand."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(line) <= 2 * RUN:
        return _run_hashes(line)
    out, a = [], 0
    while a < len(line):  # runs that end between words
        b = line.find(b" ", a + RUN)
        b = len(line) if b < 0 else b
        out.append(_run_hashes(line[a:b]))
        a = b + 1
    return np.concatenate(out)


_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def text_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of an encoded text, cut at ``[\\x20\\x09-\\x0D]``, without a list of all of them."""
    raw, out, a = raw.translate(_SPACES), [np.zeros(0, np.uint64)], 0
    while a < len(raw):
        b = raw.find(b" ", a + RUN)
        b = len(raw) if b < 0 else b
        out.append(word_hashes(raw[a:b].split()))
        a = b
    return np.concatenate(out)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word but the last n - 1; of the whole sequence if it is shorter."""
    n = min(n, len(words))
    if not n:
        return words
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k])
    return out
