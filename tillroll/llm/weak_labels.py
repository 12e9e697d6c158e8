"""Operator 2 - quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or abstain on every document; people's labels of some
documents, where given, vote as one more labeller. Expectation-maximisation over the counts of vote patterns
(at most 3 ^ labellers rows, whatever the corpus) estimates how often each labeller votes what on good and on
bad documents, without knowing which are which. The posteriors then label a bounded sample of ``SAMPLE``
documents, on which a hashed linear scorer is trained; the scorer gives every whole document's probability.
The same is done for a second target, toxicity, with labellers of its own.

A document is kept if it is more likely good than not and its probability of being toxic is under ``TOXIC_FROM``. Null texts and texts
without words have probability 0 of being good and are not kept. Rows with the same id each get their row;
extra columns go no further; an empty table gives an empty result (with nothing to learn from, any table does
as the labellers' starting accuracies say).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, hash_words, land, mix64, slices, words_of

#: Documents whose posterior labels train the scorer (the rows of smallest hash of doc_id).
SAMPLE = 8000
#: Weights of the scorer (a power of two).
BUCKETS = 1 << 18
#: Under so many words a text's averages say little: labellers abstain and the scorer sees a step of their own.
SHORT = 40
#: Probability from which a document counts as toxic: the scorer shrinks what few words say.
TOXIC_FROM = 0.1
#: Features in fewer documents of the sample get no weight.
LEAST_DOCS = 3

#: Common English insults, for the labeller of toxicity.
INSULTS = ("clown", "disgusting", "dumb", "fool", "hate", "idiot", "jerk", "loser", "moron", "pathetic", "scum",
           "stupid", "trash", "ugly", "worthless")

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_SPACES = b" \t\n\r\x0b\x0c"

QUALITY = ("capitals", "symbols", "repeats", "lines", "variety", "sentences", "length", "people")
TOXIC = ("insults", "people")


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: shares and counts the labellers and the scorer look at; also the words."""
    bounds, codes, dictionary = words_of(texts)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(codes), bool)
    again[1:] |= (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    again[2:] |= (codes[2:] == codes[:-2]) & (doc[2:] == doc[:-2])
    dictionary = dictionary.cast(pa.large_string())
    lengths = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(dictionary, r"[.!?,;:]$").to_numpy(zero_copy_only=False)
    unique = [np.unique(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out = {k: np.zeros(len(n)) for k in ("upper", "symbols", "lines")}
    for i, text in enumerate(texts.to_pylist()):
        raw = (text or "").encode()
        solid = len(raw.translate(None, _SPACES))
        up, low = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
        out["upper"][i] = up / max(1, up + low)
        out["symbols"][i] = (len(raw) - len(raw.translate(None, _SYMBOLS))) / max(1, solid)
        rows = (text or "").split("\n")
        out["lines"][i] = 1 - len(set(rows)) / len(rows) if len(rows) >= 4 else 0.0
    per = np.maximum(n, 1)

    def mean(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=of_word, minlength=len(n)) / per

    bare = pc.utf8_trim(dictionary, ".,;:!?\"'()")
    found = pc.is_in(bare, value_set=pa.array(INSULTS, pa.large_string())).to_numpy(zero_copy_only=False)
    return out | {
        "n": n, "repeats": mean(again), "variety": np.array([len(u) for u in unique]) / np.sqrt(per), "sentences": mean(ends[codes]),
        "length": mean(lengths[codes]), "insults": np.bincount(doc, weights=found[codes], minlength=len(n)), "unique": unique, "dictionary": dictionary}


def votes(s: dict[str, np.ndarray]) -> tuple[list[str], list[str]]:
    """Vote patterns for quality (1 good, 0 bad, - abstains) and toxicity, without the people's votes."""
    long = s["n"] >= SHORT

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, "0", np.where(good, "1", "-"))

    q = [vote(s["upper"] > 0.3, s["upper"] < 0.15),
         vote(s["symbols"] > 0.03, s["symbols"] < 0.005),
         vote(s["repeats"] > 0.2, long & (s["repeats"] < 0.05)),
         vote(s["lines"] > 0.3, s["lines"] < 0.1),
         vote(long & (s["variety"] < 3), long & (s["variety"] > 5)),
         vote(long & ((s["sentences"] < 0.01) | (s["sentences"] > 0.6)), (s["sentences"] > 0.03) & (s["sentences"] < 0.4)),
         vote(long & ((s["length"] > 6.5) | (s["length"] < 3.5)), (s["length"] > 4.4) & (s["length"] < 5.8))]
    t = [np.where(s["insults"] > 0, "1", "-")]
    return ["".join(x) for x in zip(*q, strict=True)], ["".join(x) for x in zip(*t, strict=True)]


def fit_labellers(patterns: dict[str, int], prior: float, rounds: int = 60, start: float = 0.8) -> tuple[float, np.ndarray]:
    """EM. Returns (share of class 1, table[labeller, class, vote]) for votes 0, 1 and abstain; a vote counts
    one pseudo-count, so that what was never seen stays possible."""
    keys = list(patterns)
    if not keys:
        keys, counts = ["-"], np.array([0.0])
    else:
        counts = np.array([patterns[k] for k in keys], float)
    v = np.array([["01-".index(c) for c in k] for k in keys])
    width = v.shape[1]
    table = np.empty((width, 2, 3))
    table[:, 0] = [start * 0.6, (1 - start) * 0.6, 0.4]
    table[:, 1] = [(1 - start) * 0.6, start * 0.6, 0.4]
    share = prior
    for _ in range(rounds):
        p = posterior(v, share, table)
        share = float((counts * p).sum() + 10 * prior) / (counts.sum() + 10)
        for j in range(width):
            for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
                seen = np.bincount(v[:, j], weights=weight, minlength=3) + 10 * np.array(
                    [start * 0.6, (1 - start) * 0.6, 0.4] if c == 0 else [(1 - start) * 0.6, start * 0.6, 0.4])
                table[j, c] = seen / seen.sum()
    return share, table


def posterior(v: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of class 1 for rows of votes (0, 1, 2 for abstain)."""
    odds = np.full(len(v), math.log(share) - math.log1p(-share))
    for j in range(v.shape[1]):
        odds += np.log(table[j, 1, v[:, j]]) - np.log(table[j, 0, v[:, j]])
    return 1 / (1 + np.exp(-odds))


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], dict[str, np.ndarray]]:
    """Hashed features of each text: of its distinct words (the word, its first five characters, its shape) and,
    apart, of its statistics in steps."""
    s = statistics(texts)
    d = s["dictionary"]
    mask = np.uint64(BUCKETS - 1)

    def hashed(values: pa.Array, salt: int) -> np.ndarray:
        e = values.dictionary_encode()
        return (mix64(hash_words(e.dictionary) + np.uint64(salt)) & mask).astype(np.int32)[e.indices.to_numpy(zero_copy_only=False)]

    if len(d):
        shape = pc.replace_substring_regex(pc.replace_substring_regex(d, r"\pL+", "a"), r"\pN+", "9")
        of_word = np.stack([hashed(d, 1), hashed(pc.utf8_slice_codeunits(d, 0, 5), 2), hashed(shape, 3)])
    else:
        of_word = np.zeros((3, 0), np.int32)
    words = [np.unique(of_word[:, u]) for u in s["unique"]]
    steps = [np.where((s["n"] < SHORT) & (k not in ("upper", "symbols")), 40, np.minimum(s[k] * m, 15)).astype(np.int64) for k, m in
             (("upper", 15), ("symbols", 60), ("repeats", 15), ("lines", 10), ("variety", 1), ("sentences", 15), ("length", 2))]
    shapes = [(mix64(np.array([j * 64 + x[i] for j, x in enumerate(steps)], np.uint64) + np.uint64(7777)) & mask).astype(np.int32) for i in range(len(words))]
    return words, shapes, s


def margin(words: np.ndarray, shapes: np.ndarray, w: np.ndarray, bias: float) -> float:
    return bias + float(w[words].sum()) / math.sqrt(max(1, len(words))) + float(w[shapes].sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, decay: float = 1e-4, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch AdaGrad; the labels are probabilities. A feature counts by its log odds
    between the classes, so the few telling ones outweigh the many that every document has."""
    w, bias = np.zeros(BUCKETS, np.float64), 0.0
    if not rows:
        return w.astype(np.float32), bias
    y = np.array([r[2] for r in rows])
    at = np.concatenate([np.concatenate([r[0], r[1]]) for r in rows])
    size = np.array([len(r[0]) + len(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    value = np.concatenate([np.concatenate([np.full(len(r[0]), 1 / math.sqrt(max(1, len(r[0]))), np.float32), np.ones(len(r[1]), np.float32)]) for r in rows])
    used = np.bincount(at, minlength=BUCKETS) >= LEAST_DOCS
    keep = used[at]
    at, row, value = at[keep], row[keep], value[keep]
    names, at = np.unique(at, return_inverse=True)
    at = at.astype(np.int32)
    in_one, in_all = np.bincount(at, weights=y[row], minlength=len(names)) + 1, np.bincount(at, minlength=len(names)) + 2
    tell = np.log(in_one / (y.sum() + 1)) - np.log((in_all - in_one) / (len(y) - y.sum() + 1))
    value *= tell[at].astype(np.float32)
    v, past, past_bias = np.zeros(len(names)), np.full(len(names), 1e-6), 1e-6
    for _ in range(rounds):
        z = bias + np.bincount(row, weights=v[at] * value, minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(at, weights=error[row] * value, minlength=len(names)) + decay * v / len(names)
        past += g * g
        v -= rate * g / np.sqrt(past)
        gb = error.sum()
        past_bias += gb * gb
        bias -= rate * gb / math.sqrt(past_bias)
    w[names] = v * tell
    return w.astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE):
    """The trained scorer, ``texts -> (p_good, p_toxic)``. ``labels``: (doc_id, quality, toxic), 1, 0 or null."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = fresh(docs, doc_id="doc_id", text="text")

    def vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                q, t = votes(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(q, pa.string()), pa.array(t, pa.string())], ["doc_id", "q", "t"])

    voted = d.mapInArrow(vote_rows, f"doc_id {kind}, q string, t string")
    if labels is not None:
        people = fresh(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        voted = voted.join(people, "doc_id", "left")
        said = lambda c: F.when(F.col(c) >= 1, "1").when(F.col(c) <= 0, "0").otherwise("-")
        first = people
    else:
        said = lambda c: F.lit("-")
        first = d.select("doc_id").where("doc_id is not null")
    voted = land(voted.select("doc_id", F.concat("q", said("quality")).alias("q"), F.concat("t", said("toxic")).alias("t")), "votes")
    counts = {r["q"] + " " + r["t"]: r["n"] for r in voted.groupBy("q", "t").agg(F.count("*").alias("n")).collect()}   # at most 3 ^ labellers
    models = []
    for i, prior in ((0, 0.8), (1, 0.1)):
        patterns: dict[str, int] = {}
        for k, n in counts.items():
            p = k.split(" ")[i]
            patterns[p] = patterns.get(p, 0) + n
        models.append(fit_labellers(patterns, prior))

    # the sample: bounded by its parameter, so its ids can be broadcast and its features brought to the driver
    ids = first.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = land(ids, "sample")

    def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, shapes, _ = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([x.tobytes() for x in shapes], pa.binary())], ["doc_id", "w", "s"])

    chosen = d.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(sample_rows, f"doc_id {kind}, w binary, s binary").dropDuplicates(["doc_id"])
    known = voted.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = chosen.join(known, "doc_id").collect()
    rows.sort(key=lambda r: str(r["doc_id"]))
    trained = []
    for column, (share, table) in zip(("q", "t"), models, strict=True):
        p = posterior(np.array([["01-".index(c) for c in r[column]] for r in rows]), share, table) if rows else []
        trained.append(train([(np.frombuffer(r["w"], np.int32), np.frombuffer(r["s"], np.int32), float(x)) for r, x in zip(rows, p, strict=True)]))
    shipped = spark.sparkContext.broadcast(trained)   # 2 x BUCKETS weights

    def score(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, shapes, s = features(texts)
        good, toxic = (np.array([1 / (1 + math.exp(-max(-30.0, min(30.0, margin(a, b, w, bias))))) for a, b in zip(words, shapes, strict=True)]) for w, bias in shipped.value)
        return np.where(s["n"] == 0, 0.0, good), np.where(s["n"] == 0, 0.0, toxic)

    return score


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = 0.5, toxic: float = TOXIC_FROM) -> DataFrame:
    """(doc_id, p_good, p_toxic, kept) of every document."""
    score = fit(docs, labels, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                good, bad = score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(good), pa.array(bad), pa.array((good >= threshold) & (bad < toxic))], ["doc_id", "p_good", "p_toxic", "kept"])

    return fresh(docs, doc_id="doc_id", text="text").mapInArrow(run, f"doc_id {kind}, p_good double, p_toxic double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, threshold: float = 0.5, toxic: float = TOXIC_FROM) -> DataFrame:
    """The documents that are kept, with all their columns."""
    score = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                good, bad = score(part.column("text"))
                yield part.filter(pa.array((good >= threshold) & (bad < toxic)))

    return docs.mapInArrow(run, docs.schema)
