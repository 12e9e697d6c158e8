"""Operator 9 - byte-level BPE encoding and decoding by backtracking over an automaton.

Tokens, their bytes mapped to Latin-1, go into a pyahocorasick automaton that gives all tokens beginning at
each position. The encoder takes the longest; if the token does not go with the one before (the merges would
have joined across the border), it tries the next shorter, and if none goes, it takes back the token before.
A position known to have no way on is not tried again, so the work is linear in the text. Which adjacent
tokens go together is remembered. The result equals the merges exactly.

Null and empty texts give no ids (their hashes are those of nothing); rows with the same id each get their
row; extra columns go no further; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.common import fresh, slices
from tillroll.llm.pretokens import LONG, Memo

#: Adjacent pairs, and matches of the pattern, that a worker remembers.
PAIR_LIMIT = 400_000
WORD_LIMIT = 300_000


class Encoder:
    """Encodes and decodes by the ranks of a ``.tiktoken`` file."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes}
        self.length = {r: len(t) for r, t in self.bytes.items()}
        self.match = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.joined: dict[tuple[int, int], int] = {}   # the two tokens that a token's last merge joined
        self.halves: dict[int, tuple[int, int]] = {}
        auto = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.halves[rank] = pair = tuple(parts)
                self.joined[pair] = rank
            elif len(token) > 1:
                continue   # the merges never make this token
            auto.add_word(token.decode("latin-1"), (rank, len(token)))
        auto.make_automaton()
        self.auto = auto
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.memo = Memo(lambda pieces: [self._piece(p) for p in pieces])

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The token's parts before its last merge: merges of ranks under ``below`` only."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def goes(self, a: int, b: int) -> bool:
        """Whether merging leaves a border between the tokens a and b. The merges that built them are undone
        from the latest on; a merge across the border that would have come before the one undone forbids it."""
        joined, halves = self.joined, self.halves
        limit = len(self.bytes) + 1
        while True:
            made = joined.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                if a not in halves:   # a single byte
                    if b not in halves:
                        return True
                    limit, b = b + 1, halves[b][0]
                else:
                    limit, a = a, halves[a][1]
            elif b in halves:
                limit, b = b + 1, halves[b][0]
            elif a in halves:
                limit, a = a, halves[a][1]
            else:
                return True

    def word(self, word: str) -> list[int]:
        """Ids of one match of the pattern."""
        data = word.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (rank, size) in self.auto.iter(data.decode("latin-1")):
            starts[end - size + 1].append(rank)   # shorter ones end, and so come, first
        pairs, length = self.pairs, self.length
        if len(pairs) > PAIR_LIMIT:
            pairs.clear()
        out: list[int] = []
        left: list[int] = []                # for each token of out, how many shorter ones remain
        dead = bytearray(n + 1)
        at, rest = 0, len(starts[0])
        while at < n:
            found = -1
            options = starts[at]
            while rest:
                rest -= 1
                rank = options[rest]
                if dead[at + length[rank]]:
                    continue
                if out:
                    key = (out[-1], rank)
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self.goes(*key)
                    if not ok:
                        continue
                found = rank
                break
            if found >= 0:
                out.append(found)
                left.append(rest)
                at += length[found]
                rest = len(starts[at]) if at < n else 0
            else:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                rest = left.pop()
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        words, out = self.words, []
        for m in self.match(piece):
            ids = words.get(m)
            if ids is None:
                if len(words) >= WORD_LIMIT:
                    words.clear()
                ids = tuple(self.word(m))
                if len(m) <= LONG:
                    words[m] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else tuple(chain.from_iterable(out))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.memo.of(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


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
                    ids = e.encode(text or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(e.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), names)

    return fresh(docs, doc_id=id_col, text=text_col).mapInArrow(run, schema)
