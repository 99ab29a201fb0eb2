"""Words and n-grams as arrays of hashes, and sorted hash lists as compact bytes.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z in lower case. Its hash is a polynomial over
its bytes modulo 2**64, taken from running sums of the whole buffer and then mixed: a buffer of texts is cut and
hashed by array operations alone.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

U = np.uint64
#: An odd base for the polynomial, and the multipliers of the mixing step.
BASE = 0x9E3779B97F4A7C15
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Bytes hashed at once (more only where a single word is longer).
WINDOW = 1 << 18
#: Stands for the end of a text: no byte of UTF-8.
END = b"\xff"
BLANKS = (9, 10, 11, 12, 13, 32)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(MIX[0])
    h = h ^ (h >> U(33))
    h = h * U(MIX[1])
    return h ^ (h >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; kept where they are few."""
    return tuple(x[:n] for x in _powers(2 * WINDOW)) if n <= 2 * WINDOW else _powers.__wrapped__(n)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, U(base))
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def word_hashes(buffer: bytes) -> np.ndarray:
    """The hashes of all words of a buffer, in order."""
    out, at, n = [], 0, len(buffer)
    while at < n:
        stop = min(n, at + WINDOW)
        if stop < n:
            back = max(buffer.rfind(bytes([c]), at, stop + 1) for c in BLANKS)
            stop = back if back > at else min((k for c in BLANKS if (k := buffer.find(bytes([c]), stop)) >= 0), default=n)
        own = np.frombuffer(buffer, np.uint8, stop - at, at)
        word = ~_BLANK[own]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        p, inverse = powers(len(own) + 1)
        sums = np.zeros(len(own) + 1, U)
        np.cumsum((own.astype(U) + U(1)) * p[:-1], out=sums[1:])
        out.append(mixed((sums[end] - sums[start]) * inverse[start]))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, U)


END_HASH = word_hashes(END)[0]


def text_words(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, each text followed by one END_HASH; where each text begins, and the length)."""
    parts = []
    for t in texts:
        raw = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")
        parts += [raw.lower(), END]
    words = word_hashes(b" ".join(parts))
    ends = np.flatnonzero(words == END_HASH)
    return words, np.concatenate([[0], ends + 1])


def packed(values: np.ndarray, low: int = 0) -> bytes:
    """Ascending values >= low as bytes: the differences' byte planes, the highest of them deflated."""
    if not len(values):
        return b""
    d = np.diff(values.astype(U), prepend=U(low))
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    top = zlib.compress(planes[used - 1].tobytes(), 1)
    return bytes([used]) + len(top).to_bytes(4, "little") + top + planes[: used - 1].tobytes()


def unpacked(raw: bytes, low: int = 0) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    used, size = raw[0], int.from_bytes(raw[1:5], "little")
    top = np.frombuffer(zlib.decompress(raw[5 : 5 + size]), np.uint8)
    d = np.zeros((len(top), 8), np.uint8)
    d[:, used - 1] = top
    if used > 1:
        d[:, : used - 1] = np.frombuffer(raw, np.uint8, offset=5 + size).reshape(used - 1, -1).T
    return np.cumsum(d.view("<u8")[:, 0]) + U(low)


def packed_counts(n: np.ndarray) -> bytes:
    """Counts as bytes: one each, deflated, and those of 255 and more behind them."""
    big = n >= 255
    small = zlib.compress(np.where(big, 255, n).astype(np.uint8).tobytes(), 1)
    return len(small).to_bytes(4, "little") + small + n[big].astype("<u8").tobytes()


def unpacked_counts(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:4], "little")
    n = np.frombuffer(zlib.decompress(raw[4 : 4 + size]), np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<u8", offset=4 + size).astype(np.int64)
    return n
