"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents stand in a shuffled line that is cut into blocks of equally many words, the same
number for all sources (a line's last block may be shorter). The schedule is a row of slots: golden-ratio
points, mapped through the sources' cumulative shares, name the source of each slot; the slots of a source
are ranked, and slot ``r`` takes the source's block ``r mod blocks``, so that a source is read through again
only when it has been read once. The last slot of a source takes only the words that its target leaves.
Reading pieces in order of ``slot`` gives the mix: every stretch of slots holds the sources near their shares.

All of it is DataFrame operations. Ranks and running sums come in two steps (sums of chunks, then places
within a chunk), so that a source with a third of all rows is no single task. The plan shuffles ids and
counts; ``mix`` joins it with the texts, which cross one shuffle. Tables of sources (``targets``) are one
task: they have a row for each source.

Defined cases: a null text has no words; a null source is a source of its own, last in order; documents
without words take part with 0 words; rows that agree in id, source, size (and text, where texts are
mixed) are that many documents, in no particular order; a table without words takes nothing; an empty
table gives an empty result. Extra columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, word_count, words

#: Fraction of the golden ratio in units of 2^-31; odd, so that each of 2^31 points occurs once.
GOLDEN = 1_327_217_885
POINTS = 2**31
#: Slots in a chunk of the schedule and documents on a shelf, at least; the most chunks and shelves; and cells of
#: the table that maps points to sources.
CHUNK = 4_096
SHELF = 512
CHUNKS = 65_536
CELLS = 4_096


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: float = 2.0
    block_words: int = 256
    seed: int = 17


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) with rank, weight and target: shares by weight of ``share`` times all words,
    stopped at ``cap`` times the source's own, the excess shared again until none is above.

    Sorted by cap over weight, the stopped sources come first; the level is what the others get for a
    weight of one. One row for each source, so one task holds a number of rows that documents don't raise.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(order) - 1)
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("source_rank") % len(mix.weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(mix.cap))
    full = Window.orderBy(F.col("most") / F.col("weight"), "source_rank")
    every = Window.partitionBy()
    lines = (
        ranked.withColumn("place", F.row_number().over(full))
        .withColumn("stopped", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(mix.share))
        .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
    )
    found = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("place", "level"))).over(every)
    return lines.withColumn("found", found["level"]).select("source", "source_rank", "source_size", F.least("most", F.coalesce(F.col("found") * F.col("weight"), F.col("most"))).alias("target"))


def _plan_of_sources(stats: DataFrame, mix: Mix) -> DataFrame:
    """Blocks, words to take and slots of each source, and its place in the shares."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    up_to = Window.orderBy("source_rank")
    return (
        stats.withColumn("goal", F.least(F.round("target"), F.col("source_size") * F.lit(mix.cap)).cast("long"))
        .withColumn("block", F.lit(mix.block_words).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("slots", (whole * F.col("blocks") + F.ceil((F.col("goal") - whole * F.col("source_size")) / F.col("block"))).cast("long"))
        .withColumn("high", F.sum("slots").over(up_to))
        .withColumn("low", F.col("high") - F.col("slots"))
    )


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, source_rank, turn): the source of each slot and the slot's rank among that source's.

    A point's source is found through a table of cells, by an equi-join. The points give each source its
    number of slots but for a few; a source's surplus is left out, and what it misses comes at the end.
    """
    spark = sources.sparkSession
    chunk = max(CHUNK, -(-slots // CHUNKS))
    width = max(1.0, slots / CELLS)
    cells = sources.where("slots > 0").select("source_rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width + 1))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.floor(((F.col("id") % POINTS) * GOLDEN % POINTS) / POINTS * slots).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width)).withColumn("chunk", F.floor(F.col("slot") / chunk))
    owned = points.join(cells, "cell").where("point >= low and point < high").select("slot", "chunk", "source_rank")
    counts = owned.groupBy("source_rank", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_rank", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("source_rank", "chunk").orderBy("slot")
    ranked = owned.withColumn("place", F.row_number().over(own) - 1).join(starts, ["source_rank", "chunk"]).select("slot", "source_rank", (F.col("start") + F.col("place")).alias("turn"))
    kept = ranked.join(sources.select("source_rank", F.col("slots").alias("wanted")), "source_rank").where("turn < wanted").drop("wanted")
    had = counts.groupBy("source_rank").agg(F.sum("n").alias("had"))
    missed = sources.join(had, "source_rank", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    late = missed.select("source_rank", F.explode(F.sequence("had", F.col("slots") - 1)).alias("turn"))
    late = late.select((F.lit(slots) + F.col("turn")).alias("slot"), "source_rank", "turn")
    return kept.unionByName(late)


def _line(items: DataFrame, sources: DataFrame, n_items: int, mix: Mix) -> DataFrame:
    """Each document's place in its source's shuffled line: ``start`` and ``size``, in words."""
    shelves = min(CHUNKS, 2 ** max(0, math.ceil(math.log2(max(1, n_items) / SHELF))))
    keys = [c for c in items.columns if c not in ("size", "copies")]
    copies = items.where("size > 0").join(sources.select(F.col("source").alias("_source"), "source_rank"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    mark = F.xxhash64(F.lit(mix.seed), *keys, "size", "copy")
    shuffled = copies.withColumn("mark", mark).withColumn("shelf", F.pmod(F.col("mark"), F.lit(shelves)))
    totals = shuffled.groupBy("source_rank", "shelf").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source_rank").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source_rank", "shelf", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source_rank", "shelf").orderBy("mark", *keys, "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = shuffled.withColumn("end", F.sum("size").over(inside)).join(starts, ["source_rank", "shelf"])
    return placed.select(*keys, "source_rank", "size", "copy", (F.col("first") + F.col("end") - F.col("size")).alias("start"))


def plan(docs: DataFrame, mix: Mix = Mix(), more_keys: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (one row for each kind of document, with ``copies``), sources, and what slots take of items:
    (keys.., source_rank, size, copy, pass, words, slot), where ``slot`` is the first of a pass."""
    rows = docs.select("doc_id", "source", *more_keys, word_count(F.col("text")).alias("size"))
    keys = rows.columns
    items = cut(rows.groupBy(*keys).agg(F.count("*").alias("copies")), "mix-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = cut(_plan_of_sources(targets(sizes, mix), mix), "mix-sources")
    n_slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    line = _line(items, sources, items.count(), mix)
    facts = sources.select("source_rank", "source_size", "goal", "block", "blocks")
    ends = F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))
    pieces = line.join(facts, "source_rank").withColumn("at", F.explode(ends)).withColumn("from", F.greatest("start", F.col("at") * F.col("block")))
    pieces = pieces.withColumn("piece", F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * F.col("block")) - F.col("from"))
    turns = schedule(sources, n_slots).join(sources.select("source_rank", "blocks"), "source_rank")
    turns = turns.select("source_rank", "slot", (F.col("turn") % F.col("blocks")).alias("at"), F.floor(F.col("turn") / F.col("blocks")).alias("pass"))
    left = F.col("goal") - F.col("pass") * F.col("source_size") - F.col("from")
    taken = pieces.join(turns, ["source_rank", "at"]).withColumn("words", F.least("piece", F.greatest(left, F.lit(0))))
    takes = taken.groupBy(*keys, "source_rank", "copy", "pass").agg(F.sum("words").alias("words"), F.min(F.when(F.col("words") > 0, F.col("slot"))).alias("slot"))
    return items, sources, takes


def taken_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (where the mix first reads it): one row for each
    document."""
    items, sources, takes = plan(docs, mix)
    per = takes.groupBy("doc_id", "source", "size", "copy").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    every = items.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).alias("i")
    same = F.col("i.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("i.source").eqNullSafe(F.col("t.source")) & (F.col("i.size") == F.col("t.size")) & (F.col("i.copy") == F.col("t.copy"))
    facts = sources.select(F.col("source").alias("_source"), "source_size", "target")
    out = every.join(per.alias("t"), same, "left").join(facts, F.col("i.source").eqNullSafe(F.col("_source")))
    return out.select(F.col("i.doc_id").alias("doc_id"), F.col("i.size").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"), F.col("t.first_slot").alias("first_slot"))


def mix(docs: DataFrame, how: Mix = Mix(), slot: str | None = None) -> DataFrame:
    """The documents that the mix takes, one row for each time; a partly taken document keeps its first
    words, joined by spaces. ``n_chars``, where there is one, is counted anew. With ``slot``, a column of that
    name says where in the schedule a row is read: sorted by it, the rows are the interleaved mix."""
    # two hashes name a document's id, source and text; documents that agree in them are numbered
    keys = [free_name(docs, f"mix_key{i}") for i in (1, 2)]
    number, taken, copy = free_name(docs, "mix_number"), free_name(docs, "mix_taken"), free_name(docs, "mix_copy")
    mark = [F.xxhash64(F.lit(i), F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.lit(i), F.col("text")) for i in (1, 2)]
    marked = docs.withColumns(dict(zip(keys, mark, strict=True)))
    _, _, takes = plan(marked, how, tuple(F.col(k) for k in keys))
    per = takes.where("words > 0").groupBy(*keys).agg(F.collect_list(F.struct("copy", "words", "size", "slot")).alias(taken))  # as many as copies and passes
    of_kind = Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    both = marked.join(per, keys).withColumn(number, F.row_number().over(of_kind))
    rows = both.withColumn(copy, F.explode(F.filter(taken, lambda t: t["copy"] == F.col(number)))).alias("d")
    take = F.col(copy)
    text = F.when(take["words"] >= take["size"], F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), take["words"].cast("int")), " "))
    columns = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"d.{c}") for c in docs.columns]
    return rows.select(*columns, *([take["slot"].alias(slot)] if slot else []))
