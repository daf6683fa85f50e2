"""Text quality by compression: sizes under a dictionary of good and one of bad text.

Labelled texts are cut into windows of characters; a sample of about ``fit_windows`` windows of each kind, drawn
by hash, trains zstandard dictionaries: ``pairs`` of them for each kind, each without another share of the windows,
since what one dictionary picks up varies. A document's blocks are compressed with all, and the sum of sizes by
dictionaries of bad text less that by good text, over the sum of both, is its normalised difference: positive
where good text helps more. A logistic curve, fitted on labelled texts that trained no dictionary, turns it into a
probability of good text.

``fit_windows`` bounds what is read into the driver; the curve is fitted on all labelled texts of its quarter,
and every whole text is scored. A text counts once, however many rows and labels it has.

Defined cases: a null or empty text has a difference of 0 and the curve's score for it; very long texts are
scored whole, block by block; repeated rows get equal scores; of contradicting labels of one id or text, bad
counts; null ids and null labels teach nothing; where labels of one kind are missing, or too few windows for
zstandard's trainer (a warning says so), every score is the share of good labels (0.5 without labels); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Sizes:
    #: Characters of a window that trains a dictionary, and of a block that is compressed.
    window: int = 64
    block: int = 256
    #: Bytes of a dictionary, and the level at which blocks are compressed.
    dictionary_bytes: int = 16_384
    level: int = 3
    #: Dictionaries of each kind, two at least.
    pairs: int = 3
    #: Windows of each kind that train its dictionary, about: a sample by hash where labelled texts have more.
    fit_windows: int = 20_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def labelled_texts(docs: DataFrame, labels: DataFrame, how: Sizes = Sizes()) -> DataFrame:
    """(mark, quality, windows, teaches) of each different text with a learnable label; ``mark`` is the text's hash.

    Texts do not move for it: ids are joined with hashes and lengths."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.xxhash64(_text()).alias("mark"), F.ceil(F.length(_text()) / how.window).alias("windows"))
    found = texts.join(known, "doc_id").groupBy("mark").agg(F.min("quality").alias("quality"), F.max("windows").alias("windows"))
    return found.withColumn("teaches", F.pmod(F.xxhash64(F.lit("quarter"), "mark"), F.lit(4)) > 0)


def sample_windows(docs: DataFrame, texts: DataFrame, how: Sizes = Sizes()) -> DataFrame:
    """(quality, piece): different windows of the texts that teach dictionaries, about ``fit_windows`` of each kind."""
    first = texts.where("teaches and windows > 0")
    total = first.groupBy("quality").agg(F.sum("windows").alias("n"))
    share = {r.quality: min(1.0, how.fit_windows / r.n) for r in total.collect()}
    limit = F.when(F.col("quality") == 1, int((1 << 30) * share.get(1, 0.0))).otherwise(int((1 << 30) * share.get(0, 0.0)))
    drawn = first.select("mark", "quality", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("k"))
    drawn = drawn.where(F.pmod(F.xxhash64(F.lit("window"), "mark", "k"), F.lit(1 << 30)) < limit)
    # fit_windows of both kinds at most (about), 30 bytes each: texts need not be shuffled to find theirs
    wanted = F.broadcast(drawn.groupBy("mark", "quality").agg(F.collect_list("k").alias("ks")))
    pieces = docs.select(_text().alias("text")).join(wanted, F.xxhash64("text") == F.col("mark"))
    pieces = pieces.select("quality", "text", F.explode("ks").alias("k"))
    return pieces.select("quality", F.substring(F.col("text"), (F.col("k") * how.window + 1).cast("int"), F.lit(how.window)).alias("piece")).distinct()


def train_dictionaries(docs: DataFrame, texts: DataFrame, how: Sizes = Sizes()) -> list[tuple[bytes, bytes]] | None:
    """Pairs of dictionaries of bad and of good text; None where zstandard has too few windows of a kind to train on."""
    import zstandard

    rows = sample_windows(docs, texts, how).orderBy(F.xxhash64("piece"), "piece").collect()
    made: tuple[list[bytes], list[bytes]] = ([], [])
    for kind in (0, 1):
        pieces = [r.piece.encode("utf-8", "surrogatepass") for r in rows if r.quality == kind]
        for out in range(how.pairs):
            told = [x for i, x in enumerate(pieces) if i % how.pairs != out]
            try:
                made[kind].append(zstandard.train_dictionary(how.dictionary_bytes, told, k=64, d=6, steps=1).as_bytes())
            except zstandard.ZstdError as e:
                warnings.warn(f"no dictionary of {'good' if kind else 'bad'} text from {len(told)} windows: {e}", stacklevel=2)
                return None
    return list(zip(*made))


class Scale:
    """Weighs texts with pairs of dictionaries."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], how: Sizes = Sizes()):
        import zstandard

        def tool(content: bytes):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=how.level)
            return zstandard.ZstdCompressor(level=how.level, dict_data=held, write_content_size=False, write_dict_id=False).compress

        self.pairs, self.block = [(tool(bad), tool(good)) for bad, good in pairs], how.block

    def difference(self, text: str | None) -> float:
        """How much smaller good text's dictionaries make the text than bad text's, as a share of all sizes."""
        text, by_bad, by_good = text or "", 0, 0
        for at in range(0, len(text), self.block):
            piece = text[at : at + self.block].encode("utf-8", "surrogatepass")
            for bad, good in self.pairs:
                by_bad += len(bad(piece))
                by_good += len(good(piece))
        return (by_bad - by_good) / (by_bad + by_good) if by_bad else 0.0


def differences(docs: DataFrame, dictionaries: list[tuple[bytes, bytes]], how: Sizes = Sizes()) -> DataFrame:
    """``docs`` with the column ``difference``; an existing column of that name is replaced."""

    @F.pandas_udf("double")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scale = Scale(dictionaries, how)
        for batch in batches:
            yield pd.Series([scale.difference(t) for t in batch], dtype="float64")

    return docs.withColumn("difference", weighed("text"))


def calibrate(measured: DataFrame) -> tuple[float, float] | None:
    """Slope and constant of the logistic curve, from (difference, quality) rows; None where one kind is missing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = measured.select(array_to_vector(F.array("difference")).alias("features"), F.col("quality").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(maxIter=100, regParam=1e-4).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def classify(docs: DataFrame, labels: DataFrame, how: Sizes = Sizes(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and difference of each document; held-out rows' labels are never read."""
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    texts = cut(labelled_texts(docs, labels, how), "quality-texts")
    dictionaries = train_dictionaries(docs, texts, how) if texts.select("quality").distinct().count() == 2 else None
    curve = None
    if dictionaries:
        measured = cut(differences(docs, dictionaries, how).select("doc_id", "held_out", F.xxhash64(_text()).alias("mark"), "difference"), "quality-differences")
        once = measured.where("not held_out").groupBy("mark").agg(F.min("difference").alias("difference"))
        curve = calibrate(cut(once.join(texts.where("not teaches"), "mark").select("difference", "quality"), "quality-curve"))
    if curve is None:
        share = texts.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        scored = docs.select("doc_id", "held_out", F.lit(0.0).alias("difference"), F.lit(0.5 if share is None else float(share)).alias("score"))
    else:
        line = F.lit(curve[0]) * F.col("difference") + F.lit(curve[1])
        scored = measured.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), line)))))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "difference")
