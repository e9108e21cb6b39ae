"""Byte-level BPE with the exact merges, by longest matches and backtracking.

A piece of text (one match of the split pattern) is mapped byte for byte to Latin-1
so that an Aho-Corasick automaton finds all vocabulary entries in it in one pass.
From the left the longest entry is tried first; it is accepted if it is compatible
with its left neighbour, that is, if merging those two entries' bytes by rank gives
just these two.  A sequence whose neighbours are all compatible is the merge result,
and there is only one, so an end that proved dead is never tried again and the work
is linear in the bytes.  Compatibility of two entries is memoised.
"""

from __future__ import annotations

import base64
import struct
from array import array

from pyspark.sql import DataFrame

from meridia.llm.common import id_and_text, kept, map_slices
from meridia.llm.segments import Encoder, Memo

NEVER = 1 << 62
#: Most pairs of entries, pieces and stretches of text one worker remembers.
PAIRS, PIECES, STRETCHES = 500_000, 100_000, 350_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Vocabulary of a rank file: base64 bytes and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def decoded(entries: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(entries.__getitem__, array("I", ids)))


class Codec:
    """Encoder and decoder for one vocabulary in which every entry outranks its parts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.width = {i: len(b) for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in ranks.items():
            self.auto.add_word(b.decode("latin-1"), i)
        self.auto.make_automaton()
        self._last, self._left, self._right, self._shorter, self._fit = {}, {}, {}, {}, {}
        self.packed = Memo(self._pack_piece, PIECES)
        self.encode_all = Encoder(lambda texts: [b"".join(map(self.packed.__getitem__, self.find(t))) for t in texts], STRETCHES)

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two entries whose merge makes ``token``; None for a single byte."""
        if token not in self._last:
            whole = self.bytes[token]
            parts = [whole[i:i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._last[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._last[token]

    def edge(self, token: int, side: int) -> list[int]:
        """The entries at the left (0) or right (1) edge of ``token`` as it grows: first a byte, at last itself."""
        memo = self._right if side else self._left
        if token not in memo:
            grown, t = [token], token
            while (made := self.last_merge(t)) is not None:
                t = made[side]
                grown.append(t)
            memo[token] = grown[::-1]
        return memo[token]

    def compatible(self, left: int, right: int) -> bool:
        """No merge ever crosses the border between the two.

        Both edges grow in the order of the ranks; of equal ranks the merge further
        left comes first.  The border holds if, at each state, what lies on its two
        sides has no common merge that would come before the next growth.
        """
        key = left << 32 | right
        if key not in self._fit:
            if len(self._fit) >= PAIRS:
                self._fit.clear()
            self._fit[key] = self._holds(self.edge(left, 1), self.edge(right, 0))
        return self._fit[key]

    def _holds(self, west: list[int], east: list[int]) -> bool:
        i = j = 0
        while True:
            cross = self.ranks.get(self.bytes[west[i]] + self.bytes[east[j]], NEVER)
            grow_w = west[i + 1] if i + 1 < len(west) else NEVER
            grow_e = east[j + 1] if j + 1 < len(east) else NEVER
            if cross < grow_w and cross <= grow_e and cross != NEVER:
                return False
            if grow_w == grow_e == NEVER:
                return True
            if grow_w <= grow_e:
                i += 1
            else:
                j += 1

    def shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of ``token``; -1 if none."""
        if token not in self._shorter:
            b = self.bytes[token]
            self._shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return self._shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest = array("q", [-1]) * len(piece)
        for end, token in self.auto.iter(piece.decode("latin-1")):
            longest[end + 1 - self.width[token]] = token  # ends ascend, so the longest stays
        out: list[int] = []
        dead, at, token = bytearray(len(piece) + 1), 0, longest[0]
        while at < len(piece):
            while token >= 0 and (dead[at + self.width[token]] or (out and not self.compatible(out[-1], token))):
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at += self.width[token]
                token = longest[at] if at < len(piece) else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= self.width[token]
                token = self.shorter(token)
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def _pack_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return decoded(self.bytes, ids)


def _codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return kept(("byte_bpe", hash(vocabulary), pattern), lambda: Codec(read_ranks(vocabulary), pattern))


def _vocabulary(docs: DataFrame, path: str):
    """The rank file, read by the driver and sent once to each executor; a vocabulary is some MB at most."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: one row per input row.

    ``ids`` holds little-endian unsigned 32-bit integers.  NULL and empty text have
    no ids.  Rows are independent: NULL or repeated doc_ids pass through, an empty
    table gives no rows, other columns are ignored.
    """
    ranks = _vocabulary(docs, path)

    def step():
        codec = _codec(ranks.value, pattern)
        return lambda t: {"doc_id": t.column("doc_id"), "ids": codec.encode_all(t.column("text").to_pylist())}

    return map_slices(id_and_text(docs, id_col, text_col), step, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of :func:`encode` with ``decoded``, the bytes of the text."""
    ranks = _vocabulary(encoded, path)

    def step():
        entries = kept(("byte_bpe entries", hash(ranks.value)), lambda: {i: b for b, i in read_ranks(ranks.value).items()})
        return lambda t: {
            "doc_id": t.column("doc_id"), "ids": t.column("ids"),
            "decoded": [decoded(entries, x or b"") for x in t.column("ids").to_pylist()]}

    return map_slices(encoded.select("doc_id", "ids"), step, "doc_id bigint, ids binary, decoded binary")
