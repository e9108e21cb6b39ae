"""Hashes of words and of runs of words, for many texts at once in numpy.

A word is a run of anything but space and bytes 9 to 13.  Its hash is a sum of random
64-bit values per byte and place, mixed; a run of words is a polynomial of its words'
hashes, mixed again.  Nothing depends on the process, so retries and other workers
find the same values.
"""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_NEXT_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: Bytes hashed at a time; a single longer word is still taken whole.
PIECE = 1 << 21


def mix(x):
    """Every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _values(seed: int, lower: bool):
    table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    if lower:
        table[65:91] = table[97:123]
    table[_BLANK] = 0
    return table


def _places(n: int):
    return np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), U(0x9E3779B97F4A7C15))]))


class Words:
    """``hashes`` of all words of some texts, in order; text i owns words first[i] to first[i + 1]."""

    def __init__(self, texts: list[str | None], lower: bool = False, seed: int = 0, spans: bool = False):
        raw = [(t or "").encode() for t in texts]
        lengths = np.array([len(b) + 1 for b in raw], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        data = b"\n".join(raw) + b"\n"
        table, hashes, starts, ends = _values(seed, lower), [], [], []
        at = 0
        while at < len(data):
            to = at + PIECE
            if to < len(data):
                gap = _NEXT_BLANK.search(data, to)
                to = gap.end() if gap else len(data)
            h, s, e = self._piece(np.frombuffer(data, np.uint8, min(to, len(data)) - at, at), table)
            hashes.append(h)
            starts.append(s + at)
            if spans:
                ends.append(e + at)
            at = to
        self.hashes = np.concatenate(hashes)
        where = np.concatenate(starts)
        self.first = np.searchsorted(where, begins)
        if spans:
            self.data, self.starts, self.ends = data, where, np.concatenate(ends)

    @staticmethod
    def _piece(buf, table):
        blank = _BLANK[buf]
        before = np.concatenate([[True], blank[:-1]])
        starts = np.flatnonzero(before & ~blank)
        if not len(starts):
            return np.zeros(0, U), starts, starts
        ends = np.flatnonzero(blank & ~before)
        if len(ends) < len(starts):
            ends = np.concatenate([ends, [len(buf)]])
        lengths = ends - starts
        body = buf[starts[0]:]
        reach = np.diff(np.concatenate([starts, [len(buf)]]))
        place = np.arange(len(body)) - np.repeat(starts - starts[0], reach)
        factors = _places(int(reach.max()))
        sums = np.add.reduceat(table[body] * factors[place], starts - starts[0])
        return mix(sums + lengths.astype(U) * U(0xD6E8FEB86659FD93)), starts, ends

    def counts(self):
        return np.diff(self.first)

    def runs(self, k: int):
        """(hash, index of first word, text) of every run of ``k`` consecutive words of one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        acc = self.hashes[:n].copy()
        for i in range(1, k):
            acc *= U(0xC2B2AE3D27D4EB4F)
            acc += self.hashes[i:i + n]
        text = np.repeat(np.arange(len(self.first) - 1), self.counts())[:n]
        at = np.flatnonzero(np.arange(n) + k <= self.first[text + 1])
        return mix(acc[at]), at, text[at]


def shingle_sets(texts: list[str | None], k: int) -> list:
    """Sorted distinct hashes of each text's ``k``-word runs, A-Z lower-cased; fewer words are one run, none no set."""
    words = Words(texts, lower=True)
    hashes, _, text = words.runs(k)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(words.counts()):
        if n >= k:
            out.append(np.unique(hashes[cut[i]:cut[i + 1]]))
        elif n:
            acc = U(int(n))
            with np.errstate(over="ignore"):
                for h in words.hashes[words.first[i]:words.first[i + 1]]:
                    acc = acc * U(0xC2B2AE3D27D4EB4F) + h
            out.append(mix(np.array([acc])))
        else:
            out.append(np.zeros(0, U))
    return out
