"""Operator 12 - SentencePiece (BPE model) encoding and decoding by a table of last tokens.

For every prefix of a text there is one token that its encoding ends with. An automaton over the pieces gives
all pieces that end at a position; the one that goes with the last token of the prefix before it (the merges
would have left a border between the two) is stored. The ids are then read from the table backwards. The
result equals the library's merges, ties between equal scores (leftmost first) included.

The white space sign is in no piece after anything else, and some characters (line feeds, say) are in no merged
piece: no merge crosses such borders, so a text is cut there and the pieces that come again are remembered, up to
``MEMO_BYTES`` a worker; longer ones than ``LONG`` are encoded each time. Both facts are read from the model; a
model without them is encoded text by text.

Null and empty texts give no ids (their hashes are those of nothing); rows with the same id each get their row;
extra columns go no further; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.common import fresh, slices

#: The white space sign, and the kinds of pieces in a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)

#: What a worker remembers: bytes of pieces of text with their ids in each of two generations, and adjacent pairs of tokens.
MEMO_BYTES = 80 << 20
LONG = 64
PAIR_LIMIT = 400_000


#: What a piece gives: its ids as decimals joined by commas, and the bytes they decode to.
Known = tuple[bytes, bytes]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def _numbers(decimal: bytes) -> list[int]:
    return list(map(int, decimal.split(b","))) if decimal else []


class Model:
    """The pieces of a ``.model`` file of BPE type and how it prepares a text.

    Raises ValueError for what is not handled: other types than BPE, a table of character replacements, removal of
    extra white space, white space as a suffix, user-defined or unused pieces, no byte pieces.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in message if k == 3), b"")))
        self.dummy = bool(normal.get(3, 1))
        pieces = [dict(_fields(v)) for k, v in message if k == 1]
        self.texts = [p.get(1, b"").decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        self.scores = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        handled = {
            "type BPE": trainer.get(3, 1) == 2, "byte pieces": bool(trainer.get(35, 0)) and self.kinds.count(BYTE) == 256,
            "no replacements": not normal.get(2), "no white space removed": not normal.get(4, 1), "white space escaped": bool(normal.get(5, 1)),
            "white space as prefix": not trainer.get(24, 0), "normal pieces only": not {USER_DEFINED, UNUSED} & set(self.kinds),
        }
        if not all(handled.values()):
            raise ValueError(f"{path}: not handled, needs {', '.join(k for k, ok in handled.items() if not ok)}")


class Encoder:
    """Tokens are numbered: characters of the vocabulary first, then merged pieces by score (best first)."""

    def __init__(self, path: str):
        import ahocorasick

        m = Model(path)
        byte_id = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(m.texts, m.kinds, strict=True)) if k == BYTE}
        self.bytes_of = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode()
                         for t, k in zip(m.texts, m.kinds, strict=True)]
        self.dummy = m.dummy
        vocabulary = {t: i for i, (t, k) in enumerate(zip(m.texts, m.kinds, strict=True)) if k == NORMAL}
        self.fallback = lambda char: tuple(byte_id[b] for b in char.encode())
        merged = sorted((t for t in vocabulary if len(t) > 1), key=lambda t: -m.scores[vocabulary[t]])
        characters = sorted(set(chain.from_iterable(vocabulary)))
        tokens = characters + merged
        self.number = {t: i for i, t in enumerate(tokens)}
        self.ids = [(vocabulary[t],) if t in vocabulary else self.fallback(t) for t in tokens]
        # equal scores share a rank: the merges then go from left to right
        self.rank = [-1] * len(characters)
        for i, t in enumerate(merged):
            tied = i and m.scores[vocabulary[merged[i - 1]]] == m.scores[vocabulary[t]]
            self.rank.append(self.rank[-1] if tied else i)
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        auto = ahocorasick.Automaton()
        for t, n in self.number.items():
            if len(t) > 1:
                parts = self._last_merge(t, n)
                if parts is None:
                    continue   # the merges never make this piece
                if max(self.rank[p] for p in parts) > self.rank[n]:
                    raise ValueError(f"{path}: {t!r} is better than a part of it; the table of last tokens needs parts before wholes")
                self.halves[n] = parts
                self.joined[parts] = n
            auto.add_word(t, (n, len(t)))
        auto.make_automaton()
        self.auto = auto
        self.pairs: dict[tuple[int, int], bool] = {}
        # Where no merge can cross: before white space that follows anything else, around characters of no merged piece.
        inside = set(chain.from_iterable(merged))
        self.cuts_spaces = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in merged)
        self.cuts_lines = self.cuts_spaces and "\n" not in inside
        self.segments = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.cuts_spaces else r"(?s:.+)")
        self.memo: dict[str, Known] = {}    # by piece
        self.words: dict[str, Known] = {}   # by word of a plain text, its white space taken off
        self.old: tuple[dict[str, Known], dict[str, Known]] = ({}, {})   # the generation before; what is met again moves on
        self.held = 0

    def _last_merge(self, piece: str, number: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a piece joins; None if the merges don't end with it."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                n = self.number.get(parts[i] + parts[i + 1])
                if n is not None and n != number and (best is None or self.rank[n] < best):
                    best, at = self.rank[n], i
            if at < 0:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return self.number[parts[0]], self.number[parts[1]]

    def goes(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens a and b.

        The merges that made them are undone, the latest first; the border falls if a merge across it would have come
        before the one undone. Of equal ranks the left one comes first.
        """
        joined, halves, rank = self.joined, self.halves, self.rank
        limit = len(rank)
        while True:
            across = joined.get((a, b))
            if across is not None and rank[across] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], halves[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, halves[b][0]
            else:
                return True   # two characters

    def last_tokens(self, piece: str) -> list[tuple[int, int]]:
        """The last token (number, length) of every prefix; number -1: a character that the vocabulary doesn't have."""
        last: list[tuple[int, int] | None] = [None] * len(piece)
        pairs, goes = self.pairs, self.goes
        if len(pairs) > PAIR_LIMIT:
            pairs.clear()
        for end, token in self.auto.iter(piece):
            if last[end] is not None:
                continue
            begin = end - token[1]
            if begin >= 0:
                before = last[begin]
                if before is not None:   # else an unknown character: nothing merges with it
                    key = (before[0], token[0])
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = goes(*key)
                    if not ok:
                        continue
            last[end] = token
        return [x or (-1, 1) for x in last]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of text, from the table's end backwards."""
        whole = self.number.get(piece)
        if whole is not None and (len(piece) == 1 or whole in self.halves):
            return self.ids[whole]
        last, out, at = self.last_tokens(piece), [], len(piece)
        while at:
            number, size = last[at - 1]
            out.append(self.ids[number] if number >= 0 else self.fallback(piece[at - 1]))
            at -= size
        return tuple(chain.from_iterable(reversed(out)))

    def _remember(self, memo: dict[str, Known], key: str, ids: tuple[int, ...]) -> Known:
        return self._keep(memo, key, (",".join(map(str, ids)).encode(), b"".join(map(self.bytes_of.__getitem__, ids))))

    def _keep(self, memo: dict[str, Known], key: str, found: Known) -> Known:
        if len(key) <= LONG:
            memo[key] = found
            self.held += 300 + 4 * len(key) + len(found[0]) + len(found[1])
        return found

    def _turn(self) -> None:
        """Begins a new generation where the present one is full."""
        if self.held > MEMO_BYTES:
            self.old, self.memo, self.words, self.held = (self.memo, self.words), {}, {}, 0

    def _of_piece(self, piece: str) -> Known:
        found = self.old[0].get(piece)
        return self._keep(self.memo, piece, found) if found else self._remember(self.memo, piece, self.piece(piece))

    def _of_word(self, word: str) -> Known:
        found = self.old[1].get(word)
        if found:
            return self._keep(self.words, word, found)
        if word[:1] != "\n":
            return self._remember(self.words, word, self.piece(SPACE + word))
        return self._remember(self.words, word, self.piece("\n") + (self.piece(word[1:]) if word[1:] else ()))

    def known(self, text: str) -> list[Known]:
        """The pieces of a text, between which nothing merges.

        In a plain text (single spaces, none at the start) every space or line feed begins a word.
        """
        if not text:
            return []
        self._turn()
        if self.cuts_lines and self.dummy and "  " not in text and text[0] != " " and SPACE not in text:
            words, keys = self.words, text.replace("\n", " \n").split(" ")
            try:
                return list(map(words.__getitem__, keys))
            except KeyError:
                return [words.get(k) or self._of_word(k) for k in keys]
        text = (SPACE if self.dummy else "") + text.replace(" ", SPACE)
        memo = self.memo
        return [memo.get(p) or self._of_piece(p) for p in self.segments.findall(text)]

    def encode(self, text: str) -> list[int]:
        return _numbers(b",".join(x[0] for x in self.known(text)))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids as the library decodes them: bytes that are no UTF-8 become U+FFFD, the prefix goes."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return (data[1:] if self.dummy and data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and ids where asked for) of every whole text. One narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids_hash, text_hash, all_ids = [], [], [], []
                for text in part.column("text").to_pylist():
                    decimal, decoded = zip(*e.known(text)) if text else ((), ())
                    decimal, decoded = b",".join(decimal), b"".join(decoded)
                    n.append(decimal.count(b",") + bool(decimal))
                    ids_hash.append(hashlib.sha256(decimal).hexdigest())
                    text_hash.append(hashlib.sha256(decoded[1:] if e.dummy else decoded).hexdigest())
                    if with_ids:
                        all_ids.append(_numbers(decimal))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), names)

    return fresh(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)
