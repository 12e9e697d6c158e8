"""Operator 8 - embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Equal vectors are one class from the start: its first row goes on, with the number of rows, and is stored once.
Vectors, scaled to length 1, are centred, rotated onto their principal axes and then by a learnt rotation
whose signs balance the bits and lose least (iterative quantisation, fitted on ``SAMPLE`` vectors). The code
is cut into chunks; each chunk is a hash table. The chunks grow with the logarithm of the table, so buckets stay
of about ``BUCKET`` rows, and further rotations, each with chunks of its own, make up for it: tables are added
until at most ``MISS`` of the pairs planted in the sample at the threshold, the hardest ones, meet in none. Where
that takes more than ``TABLES``, chunks are narrower and buckets larger.

Only codes go to the tables. Those that agree in a chunk meet in its bucket and are compared there: by Hamming
distance over the rotations up to that table's (the limit is the largest distance of a planted pair, so none of
them fails) and by the earlier tables (a pair counts in the first where it meets). Classes that keep a partner
fetch their vectors and are scored in double precision, block by block as matrix products: no pair leaves the
task. Buckets above ``BLOCK`` rows are cut into pairs of blocks, so none is held whole.

Each block gives its classes' link counts and, for connected ones, an edge to the smallest of their part of
the block: as many rows as classes, whatever the number of links, and enough for the components.

Vectors null, zero, of another length than most, or holding null or non-finite components link with nothing.
Rows with the same vec_id are vectors of their own but share a name in the result:
each shows the sum of their links and the component that any of them reaches. Extra columns go no
further; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import components, fresh, land

#: Vectors on which the rotation is fitted (those of smallest hash of vec_id).
SAMPLE = 20_000
#: Rows a bucket should hold, and rows of a block.
BUCKET, BLOCK = 64, 512
#: Rounds of the rotation's fit.
ROUNDS = 50
#: Share of the planted pairs that no table may find, and tables before chunks get narrower instead.
MISS, TABLES = 0.001, 64


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    v = F.transform("v", lambda x: x.cast("double"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return fresh(vectors, vec_id="vec_id", v="embedding").withColumn("v", v).where(good & F.col("vec_id").isNotNull())


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) so that the signs of (x - mean) @ projection are the code."""
    dim = sample.shape[1]
    if len(sample) < 2:
        return np.zeros(dim), np.eye(dim)[:, :bits]
    mean = sample.mean(axis=0)
    x = sample - mean
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :bits]
    x = x @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(x @ rotation >= 0, 1.0, -1.0).T @ x)
        rotation = (u @ w).T
    return mean, axes @ rotation


def planted(sample: np.ndarray, least: float, seed: int = 9) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of cosine ``least``: the sample's vectors turned towards others of it, and in any direction."""
    rng = np.random.default_rng(seed)
    out = []
    for towards in (sample[rng.permutation(len(sample))], rng.normal(size=sample.shape)):
        side = towards - (towards * sample).sum(axis=1, keepdims=True) * sample
        size = np.linalg.norm(side, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6   # copies have no direction
        out.append((sample[some], least * sample[some] + math.sqrt(max(0.0, 1 - least**2)) * side[some] / size[some]))
    return out


def signs(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of many vectors."""
    return ((x - mean) @ projection >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64))


def chunk(code: np.ndarray, at: int, width: int) -> np.ndarray:
    return (code >> np.uint64(at)) & np.uint64((1 << width) - 1)


def tables_for(sample: np.ndarray, least: float, bits: int, width: int) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, int]], int, float]:
    """(mean, projections, tables as (projection, first bit), width, share of planted pairs missed)."""
    pairs = planted(sample, least)
    mean, projections = sample.mean(axis=0), []
    codes: list[list[tuple[np.ndarray, np.ndarray]]] = []
    while True:
        cuts: list[tuple[int, int]] = []
        open_ = [np.ones(len(a), bool) for a, _ in pairs]
        missed = max((o.mean() for o in open_ if len(o)), default=0.0)
        while not cuts or missed > MISS and (len(cuts) < TABLES or width == 1):
            r, at = divmod(len(cuts), bits // width)
            if r == len(projections):
                mean, p = fit(sample, bits, seed=8 + r)
                projections.append(p)
                codes.append([(signs(a, mean, p), signs(b, mean, p)) for a, b in pairs])
            cuts.append((r, at * width))
            for o, (a, b) in zip(open_, codes[r], strict=True):
                o &= chunk(a ^ b, at * width, width) != 0
            missed = max((o.mean() for o in open_ if len(o)), default=0.0)
        if missed <= MISS:
            cuts += [(r, i * width) for r, at in cuts[-1:] for i in range(at // width + 1, bits // width)]   # the last rotation whole
            return mean, projections[:cuts[-1][0] + 1], cuts, width, missed
        width -= 1


def limits(sample: np.ndarray, least: float, mean: np.ndarray, projections: list[np.ndarray]) -> list[int]:
    """Largest Hamming distance of a planted pair over the first, the first two, ... rotations."""
    most = np.zeros(len(projections), np.int64)
    for a, b in planted(sample, least):
        apart = np.stack([np.bitwise_count(signs(a, mean, p) ^ signs(b, mean, p)).astype(np.int64) for p in projections], axis=1).cumsum(axis=1)
        most = np.maximum(most, apart.max(axis=0, initial=0))
    return most.tolist()


def whole_groups(batches: Iterator[pa.RecordBatch], parse) -> Iterator[tuple[tuple, np.ndarray]]:
    """Arrays of whole groups and the groups' bounds, of batches sorted by (t, bucket, b1, b2); ``parse`` gives
    the group's four columns as a matrix first. What is held back is one pair of blocks."""
    held: list[tuple] = []

    def bounds(g: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]).any(axis=1)]))

    def done(parts: list[tuple]) -> tuple[tuple, np.ndarray]:
        joined = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        return joined, np.append(bounds(joined[0]), len(joined[0]))

    for batch in batches:
        if not batch.num_rows:
            continue
        now = parse(batch)
        last = int(bounds(now[0])[-1])
        if last:
            yield done([*held, tuple(v[:last] for v in now)])
            held = [tuple(v[last:] for v in now)]
        elif held and (held[-1][0][-1] == now[0][0]).all():
            held.append(now)
        else:
            if held:
                yield done(held)
            held = [now]
    if held:
        yield done(held)


def sides(g: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a pair; all rows twice where a block meets itself."""
    if g[2] == g[3]:
        p = np.arange(len(block))
        return p, p
    return np.flatnonzero(block == g[2]), np.flatnonzero(block == g[3])


def near_duplicates(vectors: DataFrame, least: float = 0.95, bits: int = 64) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    good = sound(vectors)
    shape = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    all_ids = fresh(vectors, vec_id="vec_id")
    if shape is None:
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    dim, n = shape["dim"], shape["n"]
    good = good.where(F.size("v") == dim).withColumn("vec_id", F.col("vec_id").cast("long"))
    rows = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = matrix(rows.column("v").combine_chunks())
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    bits = min(bits, dim, 64)
    width = max(1, min(bits, 16, math.ceil(math.log2(max(2, n / BUCKET)))))
    mean, projections, cuts, width, _ = tables_for(sample, least, bits, width)
    most = limits(sample, least, mean, projections)
    # single-precision components travel as they are; lengths are divided out in double precision on arrival
    raw_type = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            raw = pa.array([r.tobytes() for r in x.astype(raw_type)], pa.binary())
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            codes = np.stack([signs(x, mean, p) for p in projections], axis=1).view(np.int64)
            code = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * codes.shape[1], pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("h1"), batch.column("h2"), code, raw], ["vec_id", "h1", "h2", "code", "v"])

    # 128 bits tell vectors apart
    keyed = good.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(8), F.reverse("v")))
    coded = keyed.mapInArrow(encode, "vec_id long, h1 long, h2 long, code array<long>, v binary")
    first = coded.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "code", "v")).alias("r"), F.count("*").alias("n"))
    classes = land(first.select(F.monotonically_increasing_id().alias("id"), F.col("r.vec_id").alias("rep"), "n", "h1", "h2", "r.code", "r.v"), "itq", "none")
    several = classes.where("n > 1").select("h1", "h2", "id", "rep", "n")
    members = land(keyed.select("vec_id", "h1", "h2").join(several, ["h1", "h2"]).select("vec_id", "id", "rep", "n"), "itq-members")

    mask = (1 << width) - 1
    chunks = F.array(*[F.shiftrightunsigned(F.col("code")[r], at).bitwiseAND(F.lit(mask).cast("long")) for r, at in cuts])
    dealt = classes.select("id", "code", F.posexplode(chunks).alias("t", "bucket"))
    large = land(dealt.groupBy("t", "bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK), "itq-large")
    r = dealt.join(large, ["t", "bucket"], "left").withColumn("blocks", F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK).cast("int"))
    r = r.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rotation = F.element_at(F.array(*[F.lit(r + 1) for r, _ in cuts]), F.col("t") + 1)
    r = r.select("t", "bucket", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", F.slice("code", 1, rotation).alias("code"))
    key = ["t", "bucket", "b1", "b2"]
    r = r.repartition(*key).sortWithinPartitions(*key, "block", "id")

    def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
        return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]

    def padded(column: pa.Array) -> np.ndarray:
        """Codes as a matrix; rotations that were not sent are zero in all rows of a group."""
        size = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(column), len(projections)), np.uint64)
        out[np.arange(len(projections))[None, :] < size[:, None]] = column.flatten().to_numpy().view(np.uint64)
        return out

    def met(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Whether codes agree in a table before t."""
        out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], bool)
        for r, at in cuts[:t]:
            out |= chunk(a[..., r] ^ b[..., r], at, width) == 0
        return out

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parse(batch: pa.RecordBatch) -> tuple:
            return np.stack(numbers(batch, *key), axis=1), *numbers(batch, "block", "id"), padded(batch.column("code"))

        for (g, block, ids, code), cut in whole_groups(batches, parse):
            stay = np.zeros(len(ids), bool)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                p, q = sides(g[a], block[a:b])
                if b - a < 2 or not len(p) or not len(q):
                    continue
                t, c = int(g[a, 0]), code[a:b]
                apart = np.zeros((len(p), len(q)), np.int64)
                for k in range(cuts[t][0] + 1):
                    apart += np.bitwise_count(c[p, k][:, None] ^ c[q, k][None, :])
                near = apart <= most[cuts[t][0]]
                if p is q:
                    np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                new = ~met(c[p[i]], c[q[j]], t)
                stay[a + p[i[new]]] = True
                stay[a + q[j[new]]] = True
            if stay.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[stay].astype(d)) for v, d in ((g[:, 0], np.int32), (g[:, 1], np.int64), (g[:, 2], np.int32), (g[:, 3], np.int32),
                                                                                           (block, np.int32), (ids, np.int64))], [*key, "block", "id"])

    kept = land(r.mapInArrow(meet, "t int, bucket long, b1 int, b2 int, block int, id long"), "itq-near")
    s = kept.join(classes.select("id", "rep", "n", "code", "v"), "id")
    s = s.repartition(*key).sortWithinPartitions(*key, "block", "id")

    def group(g: np.ndarray, block: np.ndarray, rep: np.ndarray, n: np.ndarray, code: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links, smallest rep reached) of the rows of one pair of blocks."""
        p, q = sides(g, block)
        links, label = np.zeros(len(rep), np.int64), rep.copy()
        link = x[p] @ x[q].T >= least
        if p is q:
            np.fill_diagonal(link, False)
        i, j = np.nonzero(link)
        old = met(code[p[i]], code[q[j]], int(g[0]))
        link[i[old], j[old]] = False
        if not link.any():
            return links, label
        links[p] += link @ n[q]
        if p is not q:
            links[q] += link.T @ n[p]
        none = np.iinfo(np.int64).max
        while True:   # smallest label over the links, until nothing changes
            new = label.copy()
            new[p] = np.minimum(new[p], np.where(link, label[q][None, :], none).min(axis=1))
            new[q] = np.minimum(new[q], np.where(link, label[p][:, None], none).min(axis=0))
            if (new == label).all():
                return links, label
            label = new

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parse(batch: pa.RecordBatch) -> tuple:
            x = np.frombuffer(b"".join(batch.column("v").to_pylist()), raw_type).reshape(batch.num_rows, -1).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            return np.stack(numbers(batch, *key), axis=1), *numbers(batch, "block", "rep", "n", "id"), padded(batch.column("code")), x

        for (g, block, rep, n, ids, code, x), cut in whole_groups(batches, parse):
            links, low = np.zeros(len(ids), np.int64), rep.copy()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    links[a:b], low[a:b] = group(g[a], block[a:b], rep[a:b], n[a:b], code[a:b], x[a:b])
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (ids, rep, n, links, low)], ["id", "rep", "n", "links", "low"])

    found = land(s.mapInArrow(score, "id long, rep long, n long, links long, low long"), "links")
    edges = found.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionByName(members.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    mapping = components(edges, "itq")
    by_class = found.where("n > 1").groupBy("id").agg(F.sum("links").alias("links"))
    copies = members.join(by_class, "id", "left").select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    counted = found.where("n = 1").select(F.col("rep").alias("vec_id"), "links").unionByName(copies).groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    named = mapping.join(counted, mapping["node"] == counted["vec_id"], "full").select(F.coalesce("node", "vec_id").alias("found_id"), "n_links", "component")
    out = all_ids.join(named, F.col("vec_id") == F.col("found_id"), "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select(F.col("vec_id").cast(kind).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
