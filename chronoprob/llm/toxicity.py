"""Toxicity by compression distance.

Zstandard dictionaries are trained on labelled documents, of which near copies (classes of the n-gram join) count
once: on windows of ordinary text, and on stretches of toxic text; ``pairs`` of them, each without another share of
windows and stretches, whose differences add up. A stretch is as long a piece of a toxic text as all of its
short character sequences are richer in toxic documents than in ordinary ones, by the lower bound of their
log-odds; it may be part of a word, a word, or a phrase of words that are ordinary one by one, in scripts with
and without spaces. This selection is a step before the training; without it (``select`` off) the toxic dictionary is
trained on whole windows as well, and learns what both kinds share (see the README for figures). What the ordinary dictionary holds follows the toxic part in the toxic dictionary, and
padding stands for that part in the ordinary one, so that both hold the common part at equal distance and a
window's two compressed lengths differ only by what toxic text adds.

A document is cut into windows of words (of characters, where words are very long); the differences of its
windows (largest, two largest, mean) and the number of windows are turned into a probability by a logistic
curve, which other labelled documents calibrate.

Labels are read only where the caller marks rows as learnable. The dictionaries are trained on a bounded
number of labelled documents (``fit_rows``; of ordinary windows a sample of as many); every whole text is scored.

Defined cases: a null or empty text has no windows and differences of 0, and gets the calibrated score of
such; very long texts and words are scored whole; repeated rows get equal scores; without learnable labels of both
kinds, without a stretch of toxic text, or where zstandard cannot train (a warning says so), every score is 0; of
contradicting labels of one document the toxic one counts; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .jaccard_join import classes


#: Stands at the end of both dictionaries and before every window: one cheap match that keeps a window from
#: being stored as it is, where a difference would not show.
LEAD = bytes(range(33, 97))


@dataclass(frozen=True)
class Distance:
    window: int = 12
    #: Characters of a window at most; a longer one is cut into several.
    window_chars: int = 1024
    level: int = 9
    #: Dictionaries of each kind, two at least.
    pairs: int = 3
    #: Bytes of an ordinary dictionary, and whether toxic text is cut to its own stretches.
    ordinary_bytes: int = 16_384
    select: bool = True
    #: Length of character sequences, and bytes of the toxic dictionary for each that is toxic text's own.
    gram: int = 7
    bytes_for_gram: int = 3
    #: A sequence is toxic text's own if in so many documents, and so many times the ordinary rate, and if its
    #: log-odds less so many standard errors are above 0.
    support: int = 5
    ratio: float = 6.0
    errors: float = 2.0
    #: Labelled documents that are read, three quarters for the dictionaries and one for calibration, at most (about).
    fit_rows: int = 40_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _spaced(text: str | None) -> str:
    """The words in lower case with one space before, between and after them."""
    return f" {' '.join((text or '').lower().split())} "


def windows(text: str | None, how: Distance = Distance()) -> list[bytes]:
    """The windows of a text in lower case, each with a space before and after."""
    w = (text or "").lower().split()
    parts = [f" {' '.join(w[i : i + how.window])} " for i in range(0, len(w), how.window)]
    if any(len(p) > how.window_chars for p in parts):
        parts = [p[at : at + how.window_chars] for p in parts for at in range(0, len(p), how.window_chars)]
    return [p.encode("utf-8", "surrogatepass") for p in parts]


def one_per_class(learn: DataFrame) -> DataFrame:
    """(text, toxic): the first text of each class of near copies, toxic if any text of its class is."""
    texts = cut(learn.where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("mark", F.xxhash64("text")), "toxicity-texts")
    found = classes(texts.select(F.col("mark").alias("doc_id"), "text")).select(F.col("doc_id").alias("mark"), "class_id")
    kept = found.join(texts.select("mark", "toxic"), "mark").groupBy(F.col("class_id").alias("mark")).agg(F.max("toxic").alias("toxic"))
    return texts.drop("toxic").join(kept, "mark").select("text", "toxic")


def _grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def gram_counts(learn: DataFrame, how: Distance = Distance(), among: frozenset[str] | None = None) -> DataFrame:
    """(gram, t, o): toxic and ordinary documents that hold each character sequence (of ``among``, where given), added up
    by batch first."""
    n = how.gram
    wanted = None if among is None else learn.sparkSession.sparkContext.broadcast(among)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                grams = _grams(_spaced(text), n)
                counts[int(toxic)].update(grams if wanted is None else grams & wanted.value)
            every = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"gram": every, "t": [counts[1].get(g, 0) for g in every], "o": [counts[0].get(g, 0) for g in every]})

    return learn.select("text", "toxic").mapInPandas(counted, "gram string, t long, o long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _least(n_toxic: int, how: Distance) -> int:
    """Toxic documents that a sequence of toxic text's own is in at least."""
    return min(how.support, max(1, n_toxic // 4))


def supported_grams(learn: DataFrame, n_toxic: int, how: Distance = Distance()) -> frozenset[str]:
    """The sequences that are in enough toxic documents, of fit_rows at most: others need not be counted in ordinary ones."""
    counts = gram_counts(learn.where("toxic = 1"), how)
    return frozenset(r.gram for r in counts.where(F.col("t") >= _least(n_toxic, how)).select("gram").collect())


def rich_grams(counts: DataFrame, n_toxic: int, n_ordinary: int, how: Distance = Distance()) -> list[str]:
    """The sequences that are toxic text's own, by the lower bound of their log-odds."""
    t, o = F.col("t") + 0.5, F.col("o") + 0.5
    no_t, no_o = F.lit(n_toxic + 0.5) - F.col("t"), F.lit(n_ordinary + 0.5) - F.col("o")
    rate = (t / (n_toxic + 1)) / (o / (n_ordinary + 1))
    bound = F.log(t / no_t) - F.log(o / no_o) - how.errors * F.sqrt(1 / t + 1 / no_t + 1 / o + 1 / no_o)
    own = counts.where((F.col("t") >= _least(n_toxic, how)) & (rate >= how.ratio) & (bound > 0))
    return [r.gram for r in own.select("gram").orderBy("gram").collect()]


def stretches_of(text: str, rich: frozenset[str], n: int) -> list[str]:
    """The longest pieces of ``text`` all of whose sequences of ``n`` characters are rich."""
    out, start, end = [], 0, -1
    for i in range(len(text) - n + 1):
        if text[i : i + n] in rich:
            if i > end:  # a new one
                if end >= 0:
                    out.append(text[start:end])
                start = i
            end = i + n
    return [*out, text[start:end]] if end >= 0 else out


def train_dictionaries(learn: DataFrame, how: Distance = Distance()) -> list[tuple[bytes, bytes]] | None:
    """Pairs of (ordinary, toxic) dictionary contents from (text, toxic) rows; None where there is nothing to train on."""
    learn = cut(one_per_class(learn), "toxicity-learn")
    sizes = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_ordinary = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_ordinary:
        return None

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"piece": [x for text in pdf["text"] for x in windows(text, how)]})

    size = how.ordinary_bytes
    pieces = learn.where("toxic = 1").select("text")
    if how.select:
        rich = rich_grams(gram_counts(learn, how, supported_grams(learn, n_toxic, how)), n_toxic, n_ordinary, how)
        held, n = learn.sparkSession.sparkContext.broadcast(frozenset(rich)), how.gram

        def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"piece": [x.encode("utf-8", "surrogatepass") for text in pdf["text"] for x in stretches_of(_spaced(text), held.value, n)]})

        pieces, size = pieces.mapInPandas(found, "piece binary"), max(256, how.bytes_for_gram * len(rich))
    else:
        pieces = _share(pieces.mapInPandas(cut_up, "piece binary").distinct(), how.fit_rows)
    # different stretches of fit_rows documents; what many documents hold counts as the number of its binary digits
    toxic = [(bytes(r["piece"]), r["count"].bit_length()) for r in pieces.groupBy("piece").count().orderBy("piece").collect()]
    usual = _share(learn.where("toxic = 0").select("text").mapInPandas(cut_up, "piece binary").distinct(), how.fit_rows)
    common = [(bytes(r["piece"]), 1) for r in usual.orderBy("piece").collect()]
    made = []
    for out in range(how.pairs):
        own = _trained([x for i, x in enumerate(toxic) if i % how.pairs != out], size, 32, "toxic")
        shared = _trained([x for i, x in enumerate(common) if i % how.pairs != out], how.ordinary_bytes, 64, "ordinary")
        if own is None or shared is None:
            return None
        made.append((b"\0" * len(own) + shared + LEAD, own + shared + LEAD))
    return made


def _share(pieces: DataFrame, wanted: int) -> DataFrame:
    """About ``wanted`` of the different windows, by hash; all, where there are no more."""
    pieces = cut(pieces, "toxicity-windows")
    return pieces.where(F.pmod(F.xxhash64("piece"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, wanted / max(1, pieces.count()))))


def _trained(samples: list[tuple[bytes, int]], size: int, segment: int, kind: str) -> bytes | None:
    """The content of a dictionary that zstandard trains; None, with a warning, where it cannot."""
    import random
    import warnings

    import zstandard

    # the trainer wants many samples: it is told them as often as makes some 20,000
    times = -(-20_000 // max(1, sum(n for _, n in samples)))
    told = [x for x, n in samples for _ in range(n * times)]
    random.Random(5).shuffle(told)
    try:
        # the content stands behind a head of tables, for which there is room besides
        return zstandard.train_dictionary(size + 1024, told, k=segment, d=6, steps=1).as_bytes()[-size:]
    except zstandard.ZstdError as e:
        warnings.warn(f"no dictionary of {kind} text from {len(samples)} pieces: {e}", stacklevel=3)
        return None


#: Windows that are weighed at a time, and windows whose differences are kept.
AT_ONCE, KEPT = 2_000, 100_000


class Gauge:
    def __init__(self, pairs: list[tuple[bytes, bytes]], how: Distance):
        import zstandard

        def tool(content: bytes):
            # the level's tables have room for megabytes; some four places for each byte of the dictionary find the same
            # matches, and stay in the processor's cache
            log = max(12, (4 * len(content)).bit_length())
            shape = zstandard.ZstdCompressionParameters.from_level(how.level, **plain, hash_log=min(usual.hash_log, log), chain_log=min(usual.chain_log, log - 1))
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=shape)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=shape).compress

        plain = {"write_content_size": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
        usual = zstandard.ZstdCompressionParameters.from_level(how.level, **plain)
        self.pairs, self.how = [(tool(ordinary), tool(toxic)) for ordinary, toxic in pairs], how
        self.known: dict[bytes, int] = {}

    def differences(self, text: str | None) -> list[int]:
        """For each window, how many bytes shorter toxic dictionaries make it than ordinary ones, over all pairs."""
        return next(self.all_differences([text]))

    def all_differences(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """``differences`` of each text."""
        held, n = [], 0
        for text in texts:
            held.append(windows(text, self.how))
            n += len(held[-1])
            if n >= AT_ONCE:
                yield from self._weighed(held)
                held, n = [], 0
        yield from self._weighed(held)

    def _weighed(self, texts: list[list[bytes]]) -> Iterator[list[int]]:
        """Copies of texts and passages repeat windows: some that were weighed lately are kept. One dictionary weighs many
        windows before the next one does, as each has tables of its own."""
        if len(self.known) >= KEPT:
            self.known.clear()
        new = list(dict.fromkeys(w for text in texts for w in text if w not in self.known))
        for at in range(0, len(new), AT_ONCE):
            parts = [LEAD + w for w in new[at : at + AT_ONCE]]
            sizes = [[len(compress(part)) for part in parts] for pair in self.pairs for compress in pair]
            self.known.update(zip(new[at : at + AT_ONCE], (sum(s[::2]) - sum(s[1::2]) for s in zip(*sizes))))
        for text in texts:
            yield [self.known[w] for w in text]


def gauge(docs: DataFrame, dictionaries: list[tuple[bytes, bytes]], how: Distance = Distance()) -> DataFrame:
    """``docs`` with the struct ``gauge`` of largest, two (sum of the two largest), mean and windows."""

    @F.pandas_udf("largest double, two double, mean double, windows double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = Gauge(dictionaries, how)
        for batch in batches:
            rows = []
            for found in tool.all_differences(batch):
                d = sorted(found)
                rows.append((float(d[-1]), float(sum(d[-2:])), sum(d) / len(d), float(len(d))) if d else (0.0, 0.0, 0.0, 0.0))
            yield pd.DataFrame(rows, columns=["largest", "two", "mean", "windows"])

    return docs.withColumn("gauge", measured("text"))


def _features():
    g = F.col("gauge")
    return [g["largest"], g["two"], g["mean"], F.log1p(g["windows"]), *[F.greatest(g["largest"] - k, F.lit(0.0)) for k in (2, 4, 6, 12)]]


def calibrate(measured: DataFrame) -> list[float] | None:
    """Weights of the features and, last, the constant, from (gauge, toxic) rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = measured.select(array_to_vector(F.array(*_features())).alias("features"), F.col("toxic").cast("double").alias("label"))
    if rows.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(maxIter=50, regParam=1e-4).fit(rows)
    return [*map(float, model.coefficients), float(model.intercept)]


def classify(docs: DataFrame, labels: DataFrame, how: Distance = Distance(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; held-out rows' labels are never read."""
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n_known = known.count()
    # a bounded share of the labelled documents, three quarters of it for the dictionaries and one for calibration
    share = F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, how.fit_rows / max(1, n_known)))
    teaches = F.pmod(F.xxhash64(F.lit("quarter"), "_id"), F.lit(4)) > 0
    # fit_rows ids and marks, about half a megabyte: texts need not be shuffled to find them
    chosen = F.broadcast(known.where(share))
    learn = docs.where(~F.col("held_out")).join(chosen, F.col("doc_id") == F.col("_id"))
    dictionaries = train_dictionaries(learn.where(teaches).select("text", "toxic"), how)
    if dictionaries is None:
        return docs.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    measured = cut(gauge(docs, dictionaries, how).select("doc_id", "held_out", "gauge"), "toxicity-gauges")
    judged = measured.where(~F.col("held_out")).join(chosen, F.col("doc_id") == F.col("_id")).where(~teaches)
    weights = calibrate(judged.select("gauge", "toxic")) or [0.0] * len(_features()) + [-50.0]
    line = F.lit(weights[-1])
    for w, f in zip(weights, _features()):
        line = line + F.lit(w) * f
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), line))))
    scored = measured.withColumn("score", score)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
