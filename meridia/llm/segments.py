"""Stretches of a text that any tokenizer with the usual byte-level pattern treats independently.

The pattern lets a token begin with one space and otherwise keeps letters, digits,
signs and white space apart.  A space followed by something visible therefore always
begins a new match, whatever stands before it, and nothing to its left changes what
follows.  Texts are cut there, and each stretch is tokenized once and remembered.
"""

from __future__ import annotations

import re

_ODD = re.compile(r" (?:[\s\x00-\x20]|\Z)")
_CUT = re.compile(r" (?=[^\s\x00-\x20])")

#: Most stretches remembered by one worker, and the longest worth remembering.
REMEMBERED, LONGEST = 700_000, 64
#: After a word of Latin letters these are always a match of their own.
MARKS = ",."


def stretches(text: str) -> list[str]:
    """The text cut before every space that something visible follows; all but the first lost that space."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Memo(dict):
    """key -> what ``make`` says of it; starts anew when full."""

    def __init__(self, make, most: int = REMEMBERED // 2):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit), every independent stretch encoded once.

    ``encode`` turns a list of strings into a list of such bytes.  Of each group of texts
    only the stretches not yet known are encoded; when too many are known, all are forgotten.
    """

    def __init__(self, encode, most: int = REMEMBERED):
        self.encode, self.known, self.most = encode, {}, most
        self.openings = {}
        self.marks = dict(zip(MARKS, encode(list(MARKS)), strict=True))

    def _first(self, texts: list[str]) -> list[bytes]:
        """Ids of the stretches that begin a text, remembered apart: no space stands before them."""
        if len(self.openings) > self.most // 8:
            self.openings = {}
        new = [t for t in set(texts) if t not in self.openings]
        made = dict(zip(new, self.encode(new), strict=True))
        self.openings.update((t, ids) for t, ids in made.items() if len(t) <= LONGEST)
        return [made[t] if t in made else self.openings[t] for t in texts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [stretches(t) for t in texts]
        firsts = self._first([c.pop(0) for c in cut])
        if len(self.known) > self.most:
            self.known = {}
        known = self.known
        new = set().union(*cut).difference(known)
        marked = [s for s in new if s[-1:] in self.marks and s[:-1].isalpha() and max(s) < "\u0250"]
        plain = list(new.difference(marked).union(s[:-1] for s in marked).difference(known))
        known.update(zip(plain, self.encode([" " + s for s in plain]), strict=True))
        known.update([(s, known[s[:-1]] + self.marks[s[-1]]) for s in marked])
        get = known.__getitem__
        out = [a + b"".join(map(get, c)) for a, c in zip(firsts, cut, strict=True)]
        if max(map(len, new), default=0) > LONGEST:
            for s in [*plain, *marked]:
                if len(s) > LONGEST:
                    del known[s]
        return out
