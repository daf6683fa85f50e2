"""Vector codes by parts (product quantisation), with exact Lloyd rounds over two trees.

Components become integers, so sums, means and distances are exact and equal wherever a row is worked on. A
vector is cut into equal parts; each part position has a codebook of a few entries.

The tasks that read the vectors deal them into blocks and build, for each block and part, a tree of boxes with
cached counts and sums (``plant``); the trees are written once and read in every round. A round walks each tree
together with a tree of the codebook's entries, all pairs of nodes of a level at once: the least and the greatest
distance of two boxes bound those of their contents, a pair whose least distance is above another pair's
greatest for the same points is dropped, and a node that one entry is left for is assigned as a whole, by its cached
sums. Leaves for which several entries are left take integer distances of their points to these entries. Bounds
are integers too, and equal bounds drop nothing, so ties go to the lower index as they would without trees.

Tasks send counts and sums by part, entry and position, added up over their blocks; the codebooks (parts times
entries) are all that the driver holds.

Defined cases: rows whose vector is null or holds null or non-finite components take no part; vectors of unequal or
indivisible length, empty ones included, count as filled up with zeros to the next multiple of ``parts`` of the longest;
with fewer vectors than entries each codebook has as many entries as there are vectors; null ids come last among
the first entries, equal ids in the order of their components; repeated rows get equal codes; integer components
beyond the bound at which a squared distance of whole vectors could leave 64 bits (2^27 at 64 dimensions) count as
the bound, and a label's error beyond 64 bits as the largest long; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A block's vectors of one part in tree order, and where they stand in the block.
TREES = "block string, part int, width int, points binary, places binary"


@dataclass(frozen=True)
class Codes:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    #: Vectors of a block, and of a leaf of its trees.
    block: int = 2048
    leaf: int = 16


def integers(vectors: DataFrame, column: str, how: Codes = Codes()) -> DataFrame:
    """``vectors`` with ``q``, the integer components, without the rows that take no part."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * how.scale, F.lit(-(2.0**60))), F.lit(2.0**60))).cast("long"))
    return vectors.where(x.isNotNull() & ~bad).withColumn("q", whole)


def bound(dims: int) -> int:
    """The largest component for which squared distances of ``dims`` dimensions stay within 2^62."""
    return 1 << ((62 - (max(dims, 1) - 1).bit_length()) // 2 - 1)


def matrix(vectors: list | pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as rows of ``dims`` columns, filled up with zeros, within the bound."""
    vectors = pa.array(vectors, pa.list_(pa.int64())) if isinstance(vectors, list) else vectors
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    out[np.arange(dims) < vectors.value_lengths().to_numpy()[:, None]] = vectors.flatten().to_numpy()
    return np.clip(out, -bound(dims), bound(dims))


# trees


def levels(n: int, leaf: int) -> list[np.ndarray]:
    """The borders of a tree's nodes, from the root to its leaves: halves of halves of ``n`` places."""
    out = [np.array([0, n], dtype=np.int64)]
    while np.diff(out[-1]).max(initial=0) > leaf:
        b = out[-1]
        mid = (b[:-1] + b[1:]) // 2
        out.append(np.append(np.stack([b[:-1], mid], axis=1).ravel(), b[-1]))
    return out


def boxes(points: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(points, borders[:-1], axis=0), np.maximum.reduceat(points, borders[:-1], axis=0)


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The places of ``points`` in the order of a tree that halves each node along its widest side."""
    order = np.arange(len(points))
    for borders in levels(len(points), leaf)[:-1]:
        now = points[order]
        low, high = boxes(now, borders)
        node = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        side = (high - low).argmax(axis=1)[node]
        order = order[np.lexsort((now[np.arange(len(now)), side], node))]
    return order


def nearest(points: np.ndarray, entries: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums) by entry, and (codes, errors) of ``points``, which stand in tree order.

    Counts and sums of nodes with one entry left are the cached ones; codes and errors follow from them."""
    n, k = len(points), len(entries)
    turn = tree_order(entries, 1)
    sorted_entries = entries[turn]
    entry_levels, point_levels = levels(k, 1), levels(n, leaf)
    cached = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(points, axis=0)])
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, points.shape[1]), dtype=np.int64)
    codes = np.zeros(n, dtype=np.int64)
    data, model = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # pairs of nodes, ordered by data node
    for depth in range(max(len(entry_levels), len(point_levels))):
        mine, other = point_levels[min(depth, len(point_levels) - 1)], entry_levels[min(depth, len(entry_levels) - 1)]
        if depth:
            if depth < len(entry_levels):
                data, model = np.repeat(data, 2), np.stack([2 * model, 2 * model + 1], axis=1).ravel()
                full = np.diff(other)[model] > 0
                data, model = data[full], model[full]
            if depth < len(point_levels):
                data, model = np.concatenate([2 * data, 2 * data + 1]), np.concatenate([model, model])
                order = np.argsort(data, kind="stable")
                data, model = data[order], model[order]
        (low, high), (elow, ehigh) = boxes(points, mine), boxes(sorted_entries, other)
        gap = np.maximum(np.maximum(elow[model] - high[data], low[data] - ehigh[model]), 0)
        span = np.maximum(ehigh[model] - low[data], high[data] - elow[model])
        least, greatest = (gap * gap).sum(axis=1), (span * span).sum(axis=1)
        firsts = np.flatnonzero(np.append(True, data[1:] != data[:-1]))
        best = np.repeat(np.minimum.reduceat(greatest, firsts), np.diff(np.append(firsts, len(data))))
        keep = least <= best
        data, model = data[keep], model[keep]
        left = np.bincount(data, minlength=len(mine) - 1)
        single = (left[data] == 1) & (np.diff(other)[model] == 1)
        for d, m in zip(data[single], model[single]):
            start, end, code = mine[d], mine[d + 1], turn[other[m]]
            counts[code] += end - start
            sums[code] += cached[end] - cached[start]
            codes[start:end] = code
        data, model = data[~single], model[~single]
        if not len(data):
            break
    if len(data):  # leaves with several entries left, each a single entry
        leaves, chosen = point_levels[-1], turn[entry_levels[-1][model]]
        order = np.lexsort((chosen, data))
        data, chosen = data[order], chosen[order]
        for group in np.split(np.arange(len(data)), np.flatnonzero(data[1:] != data[:-1]) + 1):
            start, end, some = leaves[data[group[0]]], leaves[data[group[0]] + 1], chosen[group]
            part = points[start:end]
            apart = part[:, None, :] - entries[some][None, :, :]
            found = some[(apart * apart).sum(axis=2).argmin(axis=1)]  # the first of equals, and they ascend
            codes[start:end] = found
            counts += np.bincount(found, minlength=k)
            np.add.at(sums, found, part)
    apart = points - entries[codes]
    return counts, sums, codes, (apart * apart).sum(axis=1)


# Spark


def plant(vectors: DataFrame, dims: int, how: Codes = Codes()) -> tuple[DataFrame, DataFrame]:
    """The trees of all blocks (TREES), and (block, vec_ids, labels) of their vectors, from (vec_id, label, q) rows."""
    width = dims // how.parts

    def grown(rows: pa.Table) -> pa.RecordBatch:
        name, points, out = uuid.uuid4().hex, matrix(rows["q"].combine_chunks(), dims), []
        for p in range(how.parts):
            mine = points[:, p * width : (p + 1) * width]
            order = tree_order(mine, how.leaf) if width else np.arange(len(mine))
            out.append((name, p, width, mine[order].astype("<i8").tobytes(), order.astype("<i4").tobytes(), None, None))
        out.append((name, -1, width, None, None, rows["vec_id"].to_pylist(), rows["label"].to_pylist()))
        ids = pa.list_(pa.int64())
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), ids, ids)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["block", "part", "width", "points", "places", "vec_ids", "labels"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if (n := sum(map(len, held))) >= how.block:
                rows, whole = pa.Table.from_batches(held), n - n % how.block
                for at in range(0, whole, how.block):
                    yield grown(rows.slice(at, how.block))
                held = rows.slice(whole).to_batches()
        if sum(map(len, held)):
            yield grown(pa.Table.from_batches(held))

    both = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "q").mapInArrow(dealt, f"{TREES}, vec_ids array<long>, labels array<long>")
    both = cut(both, "part-codes-trees")
    return both.where("part >= 0").select("block", "part", "width", "points", "places"), both.where("part < 0").select("block", "vec_ids", "labels")


def _of(row) -> np.ndarray:
    return np.frombuffer(row.points, dtype="<i8").reshape(-1, row.width)


def lloyd_round(trees: DataFrame, books: np.ndarray, how: Codes = Codes()) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples():
                n, s, _, _ = nearest(_of(row), books[row.part], how.leaf)
                counts[row.part] = counts.get(row.part, 0) + n
                sums[row.part] = sums.get(row.part, 0) + s
        for p in counts:
            k, width = sums[p].shape
            yield pd.DataFrame({"part": p, "entry": np.repeat(np.arange(k), width), "at": np.tile(np.arange(width), k), "n": np.repeat(counts[p], width), "s": sums[p].ravel()})

    totals = trees.mapInPandas(added, "part int, entry int, at int, n long, s long")
    totals = totals.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).where("n > 0")
    after = books.copy()
    for r in totals.collect():  # as many rows as the codebooks have components
        after[r.part, r.entry, r.at] = int(r.s) // r.n
    return after


def assign(trees: DataFrame, ids: DataFrame, books: np.ndarray, how: Codes = Codes()) -> DataFrame:
    """(vec_id, label, code, error) of each vector."""

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                order = np.frombuffer(row.places, dtype="<i4")
                code, error = np.zeros(len(order), dtype="<i4"), np.zeros(len(order), dtype="<i8")
                if row.width:
                    _, _, code[order], error[order] = nearest(_of(row), books[row.part], how.leaf)
                out.append((row.block, row.part, code.tobytes(), error.tobytes()))
            yield pd.DataFrame(out, columns=["block", "part", "codes", "errors"])

    # a block's parts meet: rows of bounded size
    codes = trees.mapInPandas(coded, "block string, part int, codes binary, errors binary")
    codes = codes.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "codes", "errors"))).alias("parts"))

    @F.pandas_udf("array<struct<code: string, error: long>>")
    def told(parts: pd.Series) -> pd.Series:
        out = []
        for some in parts:
            codes = np.stack([np.frombuffer(p["codes"], dtype="<i4") for p in some], axis=1)
            errors = sum(np.frombuffer(p["errors"], dtype="<i8") for p in some)
            out.append([dict(code="".join(f"{x:02x}" for x in c), error=int(e)) for c, e in zip(codes, errors)])
        return pd.Series(out, dtype=object)

    rows = codes.select("block", told("parts").alias("told")).join(ids, "block")
    rows = rows.select(F.explode(F.arrays_zip("vec_ids", "labels", "told")).alias("r"))
    return rows.select(F.col("r.vec_ids").alias("vec_id"), F.col("r.labels").alias("label"), F.col("r.told.code").alias("code"), F.col("r.told.error").alias("error"))


def first_entries(vectors: DataFrame, dims: int, how: Codes = Codes()) -> np.ndarray:
    """The codebooks at first: the parts of the vectors of the smallest ids."""
    rows = vectors.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(how.entries).collect()
    return matrix([list(r.q) for r in rows], dims).reshape(len(rows), how.parts, dims // how.parts).swapaxes(0, 1).copy()


def train(vectors: DataFrame, trees: DataFrame, dims: int, how: Codes = Codes()) -> np.ndarray:
    books = first_entries(vectors, dims, how)
    for _ in range(how.rounds if dims else 0):
        books = lloyd_round(trees, books, how)
    return books


def digest_of(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, column: str = "embedding", how: Codes = Codes()) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of each vector, codebooks by part, entry and position)."""
    rows = integers(vectors, column, how).select("vec_id", "label", "q")
    longest = rows.agg(F.max(F.size("q"))).first()[0] or 0
    dims = -(-longest // how.parts) * how.parts
    trees, ids = plant(rows, dims, how)
    books = train(rows, trees, dims, how)
    return assign(trees, ids, books, how), books


def with_label_errors(vectors: DataFrame, how: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector."""
    codes, books = compress(vectors, how=how)
    codes = cut(codes, "part-codes")
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), largest).cast("long").alias("label_error"))
    by_label = by_label.select(F.col("label").alias("_label"), "label_error")
    joined = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
