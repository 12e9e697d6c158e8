"""Operator 6 - token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list; a heap holds its adjacent pairs by rank (ties: leftmost).
Popping the lowest, unless one of its ends has changed, joins two symbols and pushes the two new pairs. The
count is the initial symbols minus the merges; no identifiers are made.

Null and empty texts have 0 tokens, rows with the same id each get their row, extra columns go no further,
an empty table gives an empty result. Special strings inside texts count as one token, as the library does.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.common import fresh, slices
from tillroll.llm.pretokens import LONG, Memo

#: Pre-tokens a worker remembers.
PRE_LIMIT = 500_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes
    for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class HeapCounter:
    """Counts the tokens of a byte-level BPE ``.json`` vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or stand alone are not handled")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        number = {s: i for i, s in enumerate(model["vocab"])}
        self.ranks = {(number[a], number[b]): (r, number[a + b]) for r, (a, b) in enumerate(pairs)}
        self.byte = [number[s] for _, s in sorted(byte_symbols().items())]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.added = added
        self.match = regex.compile(public_tokenizers.PATTERN).findall
        self.pre: dict[str, int] = {}
        self.memo = Memo(lambda pieces: [self._piece(p) for p in pieces])

    def merged(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        sym = [self.byte[b] for b in data]
        n = len(sym)
        if n < 2:
            return n
        ranks = self.ranks
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*ranks[p], i, p[0], p[1]) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in ranks]
        heap = [(r, i, made, a, b) for r, made, i, a, b in heap]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue   # an end of this pair has been joined to something else
            merges += 1
            sym[i], sym[j] = made, -1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if (p := (made, sym[k])) in ranks:
                    r, m = ranks[p]
                    heapq.heappush(heap, (r, i, m, made, sym[k]))
            h = prev[i]
            if h >= 0 and (p := (sym[h], made)) in ranks:
                r, m = ranks[p]
                heapq.heappush(heap, (r, h, m, sym[h], made))
        return n - merges

    def _piece(self, piece: str) -> int:
        if self.special and any(a in piece for a in self.added):
            return sum(1 if x in self.added else self._plain(x) for x in self.special.split(piece) if x)
        return self._plain(piece)

    def _plain(self, piece: str) -> int:
        pre, total = self.pre, 0
        for m in self.match(piece):
            n = pre.get(m)
            if n is None:
                if len(pre) >= PRE_LIMIT:
                    pre.clear()
                n = self.merged(m.encode())
                if len(m) <= LONG:
                    pre[m] = n
            total += n
        return total

    def count(self, text: str) -> int:
        return sum(self.memo.of(text))


@lru_cache(maxsize=2)
def counter(path: str) -> HeapCounter:
    return HeapCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text. No shuffle: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [c.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return fresh(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
