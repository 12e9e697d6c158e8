"""Operator 1 - mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source has a target of words. Its rate r = target / words gives every document floor(r) certain whole
copies; the rest of the rate, p, is the inclusion odds of one more copy. Documents of the source are ranked
by u / (1 - u) divided by p / (1 - p), u drawn from a hash of the document, and the first in rank are taken
until the words still missing are reached (the last one only if that comes nearer): a fixed-size
unequal-probability sample, as p differs between sources and, with ``weight``, between documents.

Ranks are summed without one task holding a source: words are pre-aggregated by (source, bin of u), a prefix
sum over the bins (at most ``BINS`` rows a source) finds the bin where the target is reached, that bin is cut
into as many again, and only the rows of the one of these that holds the target are ranked one by one.

Null text: size 0. Null source: a source of its own, last in order. Rows that repeat a document (same id,
text and source) share a draw and so their fate. Extra columns go no further; an empty table gives an empty
result. A source without words has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import WORD, fresh, land

#: Bins of the draw in which a source's words are pre-aggregated, and again of the bin where the target lies.
BINS = 128


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row a source: weights 5, 2, 1, repeating by code point
    (null last), share ``share`` of all words; no target is above ``cap`` times its source's size.

    Resharing what capped sources leave until none is above its cap equals one water level: in order of
    cap / weight, source i is capped if the level that the sources from i on would share is above it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(3))
    s = sources.withColumn("w", F.when(turn == 0, 5.0).when(turn == 1, 2.0).otherwise(1.0))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    onward = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    s = s.withColumn("capped", F.col("level") >= F.col("ratio"))
    s = s.withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("water") * F.col("w")).alias("target"))


def draw_of(doc_id: Column, source: Column, text: Column, seed: str) -> Column:
    """The hash that decides a document's draw (hexadecimal)."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), part(doc_id), part(source), part(text)))


def _located(rows: DataFrame, column: str) -> DataFrame:
    """Rows of (source, column, size, before) with the ``words`` of their bin, and ``before`` grown by those of the
    source's earlier bins."""
    bins = rows.groupBy("source", column).agg(F.sum("size").alias("words"), F.min("before").alias("base"))
    upto = Window.partitionBy("source").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("b_source"), F.col(column).alias("b_bin"), "words",
                       (F.col("base") + F.coalesce(F.sum("words").over(upto), F.lit(0))).alias("b_before"))
    at = F.col("source").eqNullSafe(F.col("b_source")) & (F.col(column) == F.col("b_bin"))
    return rows.drop("words", "before").join(bins, at).withColumnRenamed("b_before", "before").drop("b_source", "b_bin")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", weight: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, draw) of every document.

    ``weight``: an optional column of positive relative odds of the documents' last copy.
    """
    return _decided(docs, share, cap, seed, weight).drop("text_key")


def _text_key(text: Column) -> Column:
    """Tells texts apart, null from empty too."""
    return F.when(text.isNotNull(), F.md5(text))


def _decided(docs: DataFrame, share: float, cap: float, seed: str, weight: str | None = None) -> DataFrame:
    """The mix's rows with ``text_key``: (doc_id, source, text_key) names a document."""
    names = {"doc_id": "doc_id", "text": "text", "source": "source"} | ({"odds": weight} if weight else {})
    d = fresh(docs, **names)
    text = F.coalesce("text", F.lit(""))
    draw = draw_of(F.col("doc_id"), F.col("source"), F.col("text"), seed)
    d = d.select(
        "doc_id", draw.alias("draw"), "source", _text_key(F.col("text")).alias("text_key"), F.coalesce(F.col("odds"), F.lit(1.0)).cast("double").alias("odds") if weight else F.lit(1.0).alias("odds"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        ((F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).alias("u"))
    d = land(d, "mix-sizes")   # narrow: the texts are read once
    sources = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap)
    sources = land(sources.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
                   .withColumn("whole", F.floor("rate"))
                   .withColumn("p", F.col("rate") - F.col("whole"))
                   .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("s_source"))
    of = sources.select(F.col("source").alias("s_source"), "source_size", "target", "whole", "p", "rest")
    ranked = d.join(of, same, "left").drop("s_source")
    # u / (1 - u) over the odds p / (1 - p) of one more copy, made a number in (0, 1) again to bin it
    inclusion = F.col("p") / (1 - F.col("p")) * F.col("odds")
    rank = F.when(F.col("p") > 0, F.col("u") / (1 - F.col("u")) / inclusion).otherwise(F.lit(float("inf")))
    ranked = ranked.withColumn("rank", rank)
    place = F.when(F.col("p") > 0, F.col("rank") * F.col("p") / (1 - F.col("p")))   # the draw's own odds, when documents weigh the same
    spot = F.coalesce(F.least(F.floor(place / (1 + place) * (BINS * BINS)), F.lit(BINS * BINS - 1)), F.lit(BINS * BINS - 1)).cast("int")
    ranked = ranked.withColumn("coarse", F.floor(spot / BINS).cast("int")).withColumn("bin", spot).withColumn("before", F.lit(0).cast("long"))
    ranked = _located(ranked, "coarse")
    crossing = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    below = (F.col("before") + F.col("words") <= F.col("rest")).cast("int")
    inner = _located(ranked.where(crossing), "bin")
    outer = ranked.where(~crossing).withColumn("more", below).unionByName(inner.where(~crossing).withColumn("more", below))
    inner = inner.where(crossing)
    order = Window.partitionBy("source", "bin").orderBy(F.struct("rank", "u", "doc_id", "size")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy("source", "bin", "rank", "u", "doc_id", "size")
    inner = inner.withColumn("reached", F.col("before") + F.sum("size").over(order)).withColumn("step", F.sum("size").over(peers))
    # taken if it ends below the target, or steps over it and so comes nearer than stopping before it
    nearer = F.col("reached") - F.col("rest") <= F.col("rest") - (F.col("reached") - F.col("step"))
    started = F.col("reached") - F.col("step") < F.col("rest")
    inner = inner.withColumn("more", (started & ((F.col("reached") <= F.col("rest")) | nearer)).cast("int"))
    columns = ["doc_id", "size", "source_size", "target", "whole", "more", "p", "source", "draw", "text_key"]
    both = outer.select(*columns).unionByName(inner.select(*columns))
    copies = F.col("whole") + F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("more")).otherwise(0)
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"), "source", "draw", "text_key")


def mixed(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    copies = _decided(docs, share, cap, seed).where("copies > 0").select(
        F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("text_key").alias("_mix_text"), F.col("copies").alias("_mix_copies")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_mix_id")) & docs["source"].eqNullSafe(F.col("_mix_source")) & _text_key(docs["text"]).eqNullSafe(F.col("_mix_text"))
    taken = docs.join(copies, same)
    return taken.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*[docs[c] for c in docs.columns])
