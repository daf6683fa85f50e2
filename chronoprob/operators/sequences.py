"""Python over sequences: groups of rows in order, such as a trial, a stream or some islands of one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

Rows = dict[str, np.ndarray]


def runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[Rows]:
    """The columns of each run of rows with equal keys, across batches."""
    held: list[Rows] = []
    for pdf in batches:
        columns = {c: pdf[c].to_numpy(dtype=object if pdf[c].dtype.kind not in "biuf" else None) for c in pdf.columns}
        n = len(pdf)
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        for k in keys:
            v = columns[k]
            before = np.concatenate([held[-1][k][-1:] if held else v[:1], v[:-1]])
            new |= (v != before) & ~(pd.isna(v) & pd.isna(before))
        starts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *starts], [*starts, n]):
            if a < b:
                if new[a] and held:
                    yield _joined(held)
                    held = []
                held.append({c: v[a:b] for c, v in columns.items()})
    if held:
        yield _joined(held)


def _joined(parts: list[Rows]) -> Rows:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def map_sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], solve: Callable[[Rows], dict[str, Sequence]], schema: str) -> DataFrame:
    """``solve`` of each sequence: the rows that agree in ``keys``, sorted by ``order``, as arrays. A task takes
    its sequences one after another from sorted Arrow batches, which costs far less for each than a grouped map;
    one sequence has to fit in a task."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[dict[str, Sequence]] = []
        n = 0

        def given() -> pd.DataFrame:
            return pd.DataFrame({c: pd.Series([x for d in done for x in d[c]], dtype=object) for c in done[0]})

        for rows in runs(batches, keys):
            out = solve(rows)
            done.append(out)
            n += len(next(iter(out.values())))
            if n >= 10_000:
                yield given()
                done, n = [], 0
        if n:
            yield given()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(mapped, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of number arrays of one length, as rows."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    if whole.null_count or len(whole) == 0 or len(set(np.diff(whole.offsets.to_numpy()).tolist())) > 1:
        return np.stack([np.asarray(x, dtype=np.float64) for x in whole.to_pylist()])
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(whole), -1)


def arrays(rows: np.ndarray) -> pa.ListArray:
    """Rows of numbers as a column of arrays."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], np.ascontiguousarray(rows).ravel())


def begins(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Places of the rows whose keys differ from the row before, and of the first."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        column = table[k].combine_chunks()
        code = (pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def map_tables(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], solve: Callable[[pa.Table, np.ndarray], pa.RecordBatch | pa.Table], schema: StructType | str, rows: int = 40_000) -> DataFrame:
    """``solve`` of many whole sequences at once: a table of about ``rows`` rows, sorted by keys and ``order``, and the
    places where its sequences begin. What ``solve`` does row after row it can do for all sequences together, so the
    cost of a step is shared. One sequence has to fit in a task."""

    def given(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = solve(table, starts)
        yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = wanted = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= max(rows, wanted):
                table = pa.Table.from_batches(held)
                starts = begins(table, keys)
                last = int(starts[-1])  # the last sequence may go on
                if last:
                    yield from given(table.slice(0, last), starts[:-1])
                held, n = table.slice(last).to_batches(), table.num_rows - last
                wanted = 2 * n
        if n:
            table = pa.Table.from_batches(held)
            yield from given(table, begins(table, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(mapped, schema)


def by_length(starts: np.ndarray, n: int) -> tuple[np.ndarray, list[int]]:
    """Starts of the sequences, longest first, and how many of them reach each step."""
    lengths = np.diff([*starts, n])
    order = np.argsort(-lengths, kind="stable")
    reach = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return starts[order], reach.tolist()
