"""Periodic runs of words: maximal stretches that repeat a period, found by seeds and diagonals.

A run with period q is a stretch of words in which words q apart are equal, q is the smallest such period, and no
neighbouring word extends it; it counts if its length is at least ``max(least, times * q)``. Laid over itself at
lag q it agrees in a diagonal of length - q places, so for all lags from 2^j to 2^(j+1) - 1 the diagonal holds a
k-gram of k words, the least of max(least, times * q) - q over these lags. Since k is above the lag, that k-gram
meets itself in a run exactly each period, so the pairs of an occurrence with the next one in the same document are all seeds
that are needed: pairs grow with the words, not with their square.

Seeds are extended in both directions along their diagonal. A table by lag holds how far the diagonal is covered;
a seed that begins within it is skipped, so no stretch is walked twice. K-grams are numbered exactly (no
hashes) by numbering pairs of shorter ones, and only at places whose k-gram of the level before occurs twice:
ordinary text ends after the first level.

A document is worked on by the task that reads it; nothing is shuffled. Defined cases: a null or empty text has no
words and no runs; texts of fewer than ``least`` words have no runs; very long texts and texts of one repeated
word are worked on whole, in time and memory in proportion to their words times the logarithm of the longest
period; repeated rows get equal results; an empty table gives an empty result; other columns stay, an existing
column named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass(frozen=True)
class Runs:
    #: The shortest run in words, and the shortest in periods (3 at least).
    least: int = 6
    times: int = 4

    def __post_init__(self):
        if self.times < 3 or self.least < 1:
            raise ValueError("runs need three periods at least")

    def overlap(self, level: int) -> int:
        """The least overlap of a run with itself at any lag from ``level`` to ``2 * level - 1``."""
        turn = self.least // self.times  # the overlap falls with the lag up to here and grows after it
        lags = {min(max(q, level), 2 * level - 1) for q in (level, turn, turn + 1, 2 * level - 1)}
        return min(max(self.least, self.times * q) - q for q in lags)


def _numbered(pairs: np.ndarray) -> np.ndarray:
    """A number for each value, equal for equal values only."""
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


class _Grams:
    """Numbers of the grams of each length at the places where they are asked for."""

    def __init__(self, ids: np.ndarray):
        self.n, self.powers = len(ids), {1: ids}

    def power(self, m: int) -> np.ndarray:
        """Numbers of the grams of ``m`` words, a power of two, at all places that have one."""
        if m not in self.powers:
            half = self.power(m // 2)
            upto = self.n - m + 1
            self.powers = {m // 2: half, m: _numbered(half[:upto] * self.n + half[m // 2 : m // 2 + upto])}
        return self.powers[m]

    def at(self, k: int, places: np.ndarray) -> np.ndarray:
        """Numbers of the grams of ``k`` words at ``places``: two overlapping grams of a power of two tell them."""
        m = 1 << (k.bit_length() - 1)
        one = self.power(m)
        return one[places] * np.int64(self.n) + one[places + (k - m)]


def seeds(ids: np.ndarray, how: Runs = Runs()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level of lags, places and lags of k-grams whose next occurrence is at a lag of the level."""
    grams, level, held = _Grams(ids), 1, np.arange(len(ids))
    while max(how.least, how.times * level) <= len(ids):
        k = how.overlap(level)
        places = held[held <= len(ids) - k]
        number = grams.at(k, places)
        order = np.argsort(number, kind="stable")  # places stay ascending within a number
        number, places = number[order], places[order]
        same, lag = number[1:] == number[:-1], np.diff(places)
        hit = same & (lag >= level) & (lag < 2 * level)
        by_place = np.argsort(places[:-1][hit], kind="stable")
        yield places[:-1][hit][by_place], lag[hit][by_place]
        level *= 2
        if how.overlap(level) >= k:  # longer grams occur twice only where these do
            twice = np.zeros(len(places), dtype=bool)
            twice[1:] |= same
            twice[:-1] |= same
            held = np.sort(places[twice])
            if not len(held):
                return


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading places of two arrays of one length agree; looks at stretches of doubling length."""
    at, step = 0, 16
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return len(a)


def runs_of(ids: np.ndarray, how: Runs = Runs()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    found, n = [], len(ids)
    for starts, lags in seeds(ids, how):
        covered: dict[int, int] = {}
        for i, q in zip(starts.tolist(), lags.tolist()):
            if i < covered.get(q, -1):
                continue
            end = i + _reach(ids[i : n - q], ids[i + q :])
            begin = i - _reach(ids[:i][::-1], ids[q : i + q][::-1])
            covered[q] = end
            if end - begin + q >= max(how.least, how.times * q):
                found.append((begin, end - begin + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For each word, whether no run holds it after the run's first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


_WORDS = re.compile(WORD)


def find_runs(docs: DataFrame, how: Runs = Runs()) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and collapsed (what no run repeats, joined by spaces)."""

    def one(text: str | None) -> tuple:
        w = _WORDS.findall(text or "")
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(x, len(number)) for x in w), dtype=np.int64, count=len(w))
        runs = runs_of(ids, how)
        if not runs:
            return len(w), [], " ".join(w)
        kept = kept_words(len(w), runs)
        return len(w), [dict(start=s, length=m, period=q) for s, m, q in runs], " ".join(x for x, k in zip(w, kept) if k)

    @F.pandas_udf(RUNS)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["n_words", "runs", "collapsed"])

    spare = "_found"
    while spare in {c.lower() for c in docs.columns}:
        spare += "_"
    stay = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    return docs.withColumn(spare, found("text")).select(*[F.col(f"`{c}`") for c in stay], F.col(f"{spare}.*"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each tenth text (by crc32 of the id) repeats a stretch of its words from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.greatest("n", F.lit(1))))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame, how: Runs = Runs()) -> DataFrame:
    """One row for each document: its number of runs, the longest run, and digests of all runs and kept words."""
    found = find_runs(docs.select("doc_id", "text"), how)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")

    def digest_of(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest_of(told).alias("runs_sha256"), digest_of(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("best.least")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.least) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
