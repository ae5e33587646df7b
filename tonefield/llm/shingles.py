"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
#: Shingles that are hashed together; a long text needs no more memory at once.
STEP = 1 << 15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _B), ("down", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _tables[name] = np.multiply.accumulate(x)
    return _tables["up"], _tables["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """The runs of characters that are not ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def sequence(tokens: list[bytes], width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of `width` words, in order, and the runs' bytes.

    Fewer words make one run of all of them, or none if whole_if_short is off; no word makes none.
    """
    if not tokens or (len(tokens) < width and not whole_if_short):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = min(width, len(tokens))
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    n = len(tokens) - width + 1
    end = start[width - 1 :] + size[width - 1 :]
    out = np.empty(n, np.uint64)
    for at in range(0, n, STEP):
        to = min(n, at + STEP)
        low, high = start[at], end[to - 1]
        up, down = _powers(int(high - low) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low])])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mixed((sums[e] - sums[s]) * down[s])
    return out, end - start[:n]


def distinct(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes, ascending, and their bytes."""
    h, size = sequence(words(text), width)
    h, first = np.unique(h, return_index=True)
    return h, size[first]
