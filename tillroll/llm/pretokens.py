"""Cutting texts into pieces that byte-level BPE can encode apart, with a bounded memo.

No match of the splitting pattern runs past the start of white space that follows something else, so a text
may be cut before each space or line feed that has no white space before it. Most pieces are words that
come again and again; a worker remembers what they gave. When ``MEMO_LIMIT`` pieces are held, they become the old
generation: those met again move to the new one, the rest go with the next change. Pieces longer than ``LONG``
are forgotten after their text, so what is held is bounded in bytes too.
"""

from __future__ import annotations

import re

#: Every character that any of the libraries takes for white space, but for space and line feed.
OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_ASCII_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_CUT = re.compile(r"(?<=[^\s" + OTHER_SPACES + r"])(?=[ \n])")

#: Pieces in each of the two generations a worker remembers (about 200 bytes each).
MEMO_LIMIT = 300_000

#: Characters of the longest piece that is remembered.
LONG = 64


def _plain(text: str) -> bool:
    """Whether single spaces and line feeds are the only white space and never meet."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (_ASCII_SPACES if text.isascii() else OTHER_SPACES))


class Memo:
    """Remembers ``encode(piece)``; ``encode_many`` gets the unseen pieces of one text as a list."""

    def __init__(self, encode_many, limit: int = MEMO_LIMIT):
        self.encode_many, self.limit = encode_many, limit
        self.spaced: dict = {}   # of " " + key, or of the key if it begins with a line feed
        self.whole: dict = {}    # of the key itself
        self.old: tuple[dict, dict] = ({}, {})
        self.long: list[tuple[dict, str]] = []   # pieces to forget after the text

    def _fill(self, memo: dict, old: dict, keys: list[str], piece) -> None:
        new = []
        for k in dict.fromkeys(keys):
            if k not in memo:
                if (v := old.get(k)) is None:
                    new.append(k)
                else:
                    memo[k] = v
        if new:
            self.long += [(memo, k) for k in new if len(k) > LONG]
            memo.update(zip(new, self.encode_many([piece(k) for k in new]), strict=True))

    def of(self, text: str) -> list:
        """What the pieces of the text give, in order."""
        out = self._of(text)
        if self.long:
            for memo, key in self.long:
                memo.pop(key, None)
            self.long.clear()
        return out

    def _of(self, text: str) -> list:
        if not text:
            return []
        if len(self.spaced) + len(self.whole) > self.limit:
            self.old, self.spaced, self.whole = (self.spaced, self.whole), {}, {}
        if not _plain(text):
            keys = _CUT.split(text)
            self._fill(self.whole, self.old[1], keys, str)
            return list(map(self.whole.__getitem__, keys))
        keys = text.replace("\n", " \n").split(" ")
        first = keys[0]
        if first not in self.whole:
            self._fill(self.whole, self.old[1], [first], str)
        keys[0] = first = self.whole[first]
        memo = self.spaced
        try:
            out = list(map(memo.__getitem__, keys[1:]))
        except KeyError:
            self._fill(memo, self.old[0], keys[1:], lambda k: k if k[:1] == "\n" else f" {k}")
            out = list(map(memo.__getitem__, keys[1:]))
        out.insert(0, first)
        return out
