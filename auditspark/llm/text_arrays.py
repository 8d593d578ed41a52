"""Texts of a batch as arrays: code points or bytes, words, lines, and hashes of runs, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # odd multipliers of a 64-bit mixer (fixed values)
#: Characters handled at a time; a longer text is a part of its own.
PART = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def parts(texts: list[str], size: int = PART) -> Iterator[tuple[int, int]]:
    """(from, to) of texts that have about *size* characters together."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def before(flags: np.ndarray) -> np.ndarray:
    """Each place's left neighbour; the first has True."""
    out = np.empty_like(flags)
    out[0], out[1:] = True, flags[:-1]
    return out


def run_hashes(values: np.ndarray, starts: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the runs that begin at *starts* and reach to the next one, of the *counted* places only.

    Sums of mixed (place in the run, value) pairs: equal runs have equal hashes, others differ but for one chance in 2^64.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(values), dtype=np.uint64)
    place -= np.repeat(starts, np.diff(starts, append=len(values))).astype(np.uint64) if starts[0] == 0 else np.concatenate(
        [np.zeros(starts[0], np.uint64), np.repeat(starts, np.diff(starts, append=len(values))).astype(np.uint64)])
    x = mixed((place << np.uint64(21)) + values.astype(np.uint64) + _A)
    if counted is not None:
        x[~counted] = 0
    return mixed(np.add.reduceat(x, starts))


def pairs(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One 64-bit number for each (hash, owner)."""
    return mixed(hashes + mixed((owner.astype(np.uint64) + np.uint64(1)) * _A))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(does the key come twice or more, is it a later one of equal keys) by place."""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, later


class Texts:
    """Some texts as one array of code points, each text with a line break after it."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, self.n) + 1
        self.starts = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.solid = ~((self.codes == 32) | (self.codes - np.uint32(9) <= 4))
        self.word_starts = np.flatnonzero(self.solid & ~before(self.solid) | (np.arange(len(self.codes)) == 0) & self.solid)
        self.word_doc = self.doc[self.word_starts]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, dtype=np.int64)
