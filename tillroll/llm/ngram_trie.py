"""Operator 10 - language-model scoring with an Elias-Fano n-gram trie.

A bigram model, P(w | u) = m * c(u, w) / c(u) + (1 - m) * P(w) with m = c(u) / (c(u) + ``MASS``) and the add-one
P(w) = (c(w) + 1) / (N + V + 1), learnt from the training documents. The trie's levels are cut into shards by
hash of context and successor, so that no context, however frequent, makes one shard. A shard has three
Elias-Fano sequences - its contexts; the pointers, where each context's successors begin; the successors,
numbered relative to their context - and its probabilities c(u, w) / N, quantised to 16 bits. It is one flat
buffer, memory-mapped by the task that answers for it: a query finds its context, then searches the range of
successors that the pointers give.

Documents are read in blocks of about ``BLOCK_BYTES``. A block sends each shard its distinct words or word
pairs once, with their training counts, packed; the shards add the counts up over all blocks, build the model
and answer each block with as many numbers; the block's texts meet the answers and are scored. So what is
shuffled is a block's distinct n-grams, never the model as a whole or a row for each token. Blocks are named
by a hash of their content, so answers can't meet another block's texts.

Words are known by 63-bit hashes, successors within a context by 40-bit ones. Null and empty texts are the one
end token. A document is held out if crc32 of its doc_id as text (null: the empty text) leaves 2 when divided
by 7. Rows with the same doc_id each count and get their row. Extra columns go no further; an empty table gives
an empty result.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import U64, fresh, hash_words, land, mix64, partitions, slices, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, words_of
from tillroll.llm.elias_fano import EliasFano, encode as ef_encode

BLOCK_BYTES = 16 << 20
#: Weight of the unigram model, in tokens.
MASS = 20.0
#: Steps of a quantised probability for each power of ten; the last code is for what was never seen.
STEPS, UNSEEN = 2000, 65535
#: Hashes of the end token and of the place before the first word, which no word has.
END, BEGIN = (1 << 63) - 1, (1 << 63) - 2
_SUCCESSOR = U64((1 << 40) - 1)
_HEAD = struct.Struct("<4sQQ")


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities; 0 becomes UNSEEN."""
    with np.errstate(divide="ignore"):
        q = np.round(-np.log10(p) * STEPS)
    return np.where(np.isfinite(q), np.minimum(q, UNSEEN - 1), UNSEEN).astype("<u2")


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == UNSEEN, 0.0, 10.0 ** (-codes.astype(np.float64) / STEPS))


class Trie:
    """Contexts and their successors in a flat buffer."""

    def __init__(self, buffer):
        magic, self.n_contexts, self.n = _HEAD.unpack_from(buffer, 0)
        if magic != b"NGT1":
            raise ValueError("not an n-gram trie")
        self.contexts = EliasFano(buffer, _HEAD.size)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, "<u2", self.n, self.successors.end)

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, p: np.ndarray) -> bytes:
        """From pairs sorted by (context, word) and their probabilities."""
        new = np.ones(len(contexts), bool)
        new[1:] = contexts[1:] != contexts[:-1]
        starts = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        relative = (rank.astype(U64) << U64(40)) | words
        return _HEAD.pack(b"NGT1", len(starts), len(words)) + ef_encode(contexts[starts]) + ef_encode(np.append(starts, len(words))) + ef_encode(relative) + quantise(p).tobytes()

    def load(self) -> None:
        """Decodes the three sequences for a large batch of queries."""
        self._contexts, self._pointers = self.contexts.all(), self.pointers.all().astype(np.int64)
        self._successors = self.successors.all()

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of many pairs (after ``load``)."""
        if not self.n:
            return np.full(len(contexts), UNSEEN, "<u2")
        rank = np.minimum(np.searchsorted(self._contexts, contexts), self.n_contexts - 1)
        known = self._contexts[rank] == contexts
        low, high = np.where(known, self._pointers[rank], 0), np.where(known, self._pointers[rank + 1], 0)
        target = (rank.astype(U64) << U64(40)) | words
        end = high.copy()
        while (low < high).any():   # in step, each query within its context's successors
            middle = (low + high) // 2
            below = (low < high) & (self._successors[np.minimum(middle, self.n - 1)] < target)
            low, high = np.where(below, middle + 1, low), np.where(below | (low >= high), high, middle)
        at = np.minimum(low, self.n - 1)
        hit = known & (low < end) & (self._successors[at] == target)
        return np.where(hit, self.codes[at], UNSEEN).astype("<u2")

    def find_one(self, context: int, word: int) -> int:
        """One pair by select alone, nothing decoded: a search of the contexts, then of their successors."""
        def first(seq: EliasFano, low: int, high: int, value: int) -> int:
            while low < high:
                middle = (low + high) // 2
                if int(seq.select(middle)[0]) < value:
                    low = middle + 1
                else:
                    high = middle
            return low

        rank = first(self.contexts, 0, self.n_contexts, context)
        if rank >= self.n_contexts or int(self.contexts.select(rank)[0]) != context:
            return UNSEEN
        start, end = (int(x) for x in self.pointers.select([rank, rank + 1]))
        target = (rank << 40) | word
        at = first(self.successors, start, end, target)
        return int(self.codes[at]) if at < end and int(self.successors.select(at)[0]) == target else UNSEEN


class Block:
    """A block's tokens: words, their hashes, and its distinct words and pairs in the order shards get them."""

    def __init__(self, doc_ids: list, texts: pa.Array, shards: int):
        bounds, codes, dictionary = words_of(texts)
        self.hashes = np.concatenate([hash_words(dictionary) >> U64(1), np.array([END, BEGIN], U64)])
        end, begin = len(dictionary), len(dictionary) + 1
        n = np.diff(bounds)
        self.n_tokens = n + 1
        self.ends = np.cumsum(self.n_tokens) - 1
        total = int(self.n_tokens.sum())
        self.codes = np.full(total, end, np.int64)
        inner = np.ones(total, bool)
        inner[self.ends] = False
        self.codes[inner] = codes
        self.before = np.full(total, begin, np.int64)
        self.before[1:] = self.codes[:-1]
        self.before[np.append(0, self.ends[:-1] + 1)[: len(n)]] = begin
        self.held_out = np.array([zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in doc_ids], bool)
        self.train = np.repeat(~self.held_out, self.n_tokens)
        self.shards = shards
        self.n_words = begin   # of the vocabulary, the end included

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, bounds): the distinct words dealt to shard s are order[bounds[s]:bounds[s + 1]]."""
        h = self.hashes[: self.n_words]
        shard = (mix64(h) % U64(self.shards)).astype(np.int64)
        order = np.lexsort((h, shard))
        return order, np.searchsorted(shard[order], np.arange(self.shards + 1))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, successors, which pair each token is, order, bounds)."""
        names, which = np.unique(self.before * (self.n_words + 1) + self.codes, return_inverse=True)
        context = self.hashes[names // (self.n_words + 1)]
        word = mix64(self.hashes[names % (self.n_words + 1)]) & _SUCCESSOR
        shard = (mix64(context ^ mix64((word & U64(15)) + U64(1))) % U64(self.shards)).astype(np.int64)
        order = np.lexsort((word, context, shard))
        return context, word, which, order, np.searchsorted(shard[order], np.arange(self.shards + 1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the input with their names, which follow from their rows alone."""
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            name = xxhash.xxh3_64()
            for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                name.update(f"{d} {-1 if text is None else len(text)} ")
                name.update(text or "")
            yield int(np.int64(np.uint64(name.intdigest()))), part


def word_answers(d: DataFrame, shards: int) -> DataFrame:
    """(block, shard, data) with the training counts of each block's words, and rows without block of (n, v)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in _blocks(batches):
            b = Block(part.column("doc_id").to_pylist(), part.column("text"), shards)
            counts = np.bincount(b.codes[b.train], minlength=b.n_words).astype(np.uint32)
            order, at = b.words()
            rows = [order[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(shards, name)), pa.array(range(shards), pa.int32()), pa.array([squeeze_sorted(b.hashes[r]) for r in rows], pa.binary()), pa.array([squeeze(counts[r]) for r in rows], pa.binary())],
                ["block", "shard", "words", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        words = [unsqueeze_sorted(x.as_py()) for x in table.column("words")]
        counts = np.concatenate([unsqueeze(x.as_py(), np.uint32) for x in table.column("counts")])
        _, which = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(which, weights=counts).astype(np.uint64)
        ends = np.cumsum([0] + [len(w) for w in words])
        data = [squeeze(total[which[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        shard = table.column("shard")[0].as_py()
        return pa.table({"block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "shard": pa.array([shard] * (len(data) + 1), pa.int32()), "data": pa.array([*data, None], pa.binary()),
                         "n": pa.array([None] * len(data) + [int(total.sum())], pa.int64()), "v": pa.array([None] * len(data) + [int((total > 0).sum())], pa.int64())})

    asked = d.mapInArrow(ask, "block long, shard int, words binary, counts binary")
    return land(asked.groupBy("shard").applyInArrow(answer, "block long, shard int, data binary, n long, v long"), "words")


def pair_answers(d: DataFrame, shards: int, n: int) -> DataFrame:
    """(block, shard, data) with the codes of each block's pairs, from the trie's shards."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in _blocks(batches):
            b = Block(part.column("doc_id").to_pylist(), part.column("text"), shards)
            context, word, which, order, at = b.pairs()
            counts = np.bincount(which[b.train], minlength=len(context)).astype(np.uint32)
            rows = []
            for x, y in zip(at[:-1], at[1:], strict=True):
                own = order[x:y]
                c = context[own]
                start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
                rows.append([squeeze_sorted(c[start]), squeeze(np.diff(np.append(start, len(c))).astype(np.uint32)), squeeze(np.ascontiguousarray(word[own].view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)), squeeze(counts[own])])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(shards, name)), pa.array(range(shards), pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(4))],
                                             ["block", "shard", "contexts", "runs", "words", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        contexts, words, counts, ends = [], [], [], [0]
        for c, r, w, k in zip(*(table.column(x).to_pylist() for x in ("contexts", "runs", "words", "counts")), strict=True):
            contexts.append(np.repeat(unsqueeze_sorted(c), unsqueeze(r, np.uint32)))
            raw = unsqueeze(w, np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            words.append(wide.reshape(-1).view(U64))
            counts.append(unsqueeze(k, np.uint32))
            ends.append(ends[-1] + len(raw))
        context, word, count = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)
        seen = np.flatnonzero(count)
        order = seen[np.lexsort((word[seen], context[seen]))]
        c, w, k = context[order], word[order], count[order].astype(np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(k, at) if len(at) else np.zeros(0, np.int64)
        with tempfile.TemporaryFile() as f:
            f.write(Trie.build(c[at], w[at], total / max(n, 1)))
            f.flush()
            trie = Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
            trie.load()
            codes = [trie.find(context[a:b], word[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "data": pa.array([squeeze(x) for x in codes], pa.binary())})

    asked = d.mapInArrow(ask, "block long, shard int, contexts binary, runs binary, words binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "block long, shard int, data binary")


def score(docs: DataFrame, mass: float = MASS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = fresh(docs, doc_id="doc_id", text="text")
    shards = max(partitions(docs.sparkSession), 1)
    words = word_answers(d, shards)
    totals = words.where("block is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = totals["n"], totals["v"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, part in _blocks(batches):
            rows = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, name)), pa.array(np.zeros(rows, np.int32)), pa.array(range(rows), pa.int32()), part.column("doc_id"), part.column("text"), pa.nulls(rows, pa.binary())],
                                             ["block", "what", "place", "doc_id", "text", "data"])

    schema = f"block long, what int, place int, doc_id {kind}, text string, data binary"
    none = [F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text")]
    rows = (d.mapInArrow(texts, schema)
            .unionByName(words.where("block is not null").select("block", F.lit(1).alias("what"), F.col("shard").alias("place"), *none, "data"))
            .unionByName(pair_answers(d, shards, n).select("block", F.lit(2).alias("what"), F.col("shard").alias("place"), *none, "data")))

    def block_scores(table: pa.Table) -> pa.Table:
        table = table.sort_by([("what", "ascending"), ("place", "ascending")])
        what = table.column("what").to_numpy()
        own, counts, codes = (table.filter(pa.array(what == w)) for w in (0, 1, 2))
        # a block read twice with the same rows has the same answers; each copy of a row keeps its place
        copies = max(1, len(counts) // shards)
        place = own.column("place").to_numpy()
        out = []
        for copy in range(copies):
            mine = own.take(pa.array(np.flatnonzero(np.arange(len(place)) % copies == copy)))
            b = Block(mine.column("doc_id").to_pylist(), mine.column("text").combine_chunks(), shards)
            got = [unsqueeze(x, U64) for x in counts.column("data").to_pylist()[copy::copies]]
            order, at = b.words()
            if [len(x) for x in got] != np.diff(at).tolist():
                raise RuntimeError("a block's answers don't fit its texts")
            c = np.zeros(b.n_words + 1, np.float64)
            c[order] = np.concatenate(got)
            got = [unsqueeze(x, "<u2") for x in codes.column("data").to_pylist()[copy::copies]]
            context, _, which, order, at = b.pairs()
            if [len(x) for x in got] != np.diff(at).tolist():
                raise RuntimeError("a block's answers don't fit its texts")
            joint = np.zeros(len(context))
            joint[order] = restored(np.concatenate(got))
            c[b.n_words] = c[b.n_words - 1]   # as many begins as ends: one a training document
            single = (c[b.codes] + 1) / (n + 1 * (v + 1))
            base = np.log10(single)
            past = c[b.before]
            p = (joint[which] * max(n, 1) + mass * single) / (past + mass)
            total = lambda x: np.add.reduceat(x, np.append(0, b.ends[:-1] + 1)) if len(b.ends) else x[:0]
            out.append(pa.table({"doc_id": mine.column("doc_id"), "held_out": pa.array(b.held_out), "n_tokens": pa.array(b.n_tokens.astype(np.int64)), "n_known": pa.array(total((c[b.codes] > 0).astype(np.int64))),
                                 "train_tokens": pa.array(np.full(len(b.ends), n, np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(np.log10(p)))}))
        return pa.concat_tables(out)

    return rows.groupBy("block").applyInArrow(block_scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
