"""Rows that agree in all columns but those that are added up become one row, batch by batch and without a shuffle.

Sums over functions of an event's scores and coefficients cost one evaluation for each distinct set of these, not for each event. A task
holds LIMIT distinct rows at most; what goes beyond is handed on, so nothing is lost and rows that are all distinct pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct rows that a task holds before it hands them on.
LIMIT = 1 << 14
_FACTORS = np.random.default_rng(7).integers(1 << 62, size=4096, dtype=np.uint64) | np.uint64(1)


class Added:
    """The rows so far, each distinct one once. Keys are numbers, lists of one length of numbers, booleans or strings, without nulls."""

    def __init__(self, sums: tuple[str, ...], limit: int = LIMIT):
        self.sums, self.limit, self.codes, self.held = sums, limit, {}, None

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """What has to be handed on, if there are too many distinct rows."""
        new = self._merged(batch)
        if self.held is not None:
            new = self._merged(pa.Table.from_batches([self.held, new]).combine_chunks().to_batches()[0]) if new.num_rows and self.held.num_rows else new if new.num_rows else self.held
        self.held = new if new.num_rows <= self.limit else None
        return new if self.held is None else None

    def rest(self) -> pa.RecordBatch | None:
        held, self.held = self.held, None
        return held

    def _bits(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows x numbers of the key columns, bit by bit: NaN equals NaN, -0.0 does not equal 0.0."""
        parts = []
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name in self.sums:
                continue
            if pa.types.is_string(column.type):
                coded = column.dictionary_encode()
                known = np.array([self.codes.setdefault(x, len(self.codes)) for x in coded.dictionary.to_pylist()], np.uint64)
                parts.append(known[coded.indices.to_numpy()][:, None])
            elif pa.types.is_list(column.type):
                parts.append(np.ascontiguousarray(column.flatten().to_numpy(), np.float64).view(np.uint64).reshape(batch.num_rows, -1))
            elif pa.types.is_floating(column.type):
                parts.append(np.ascontiguousarray(column.to_numpy(), np.float64).view(np.uint64)[:, None])
            else:
                parts.append(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None])
        return np.hstack(parts)

    def _merged(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if batch.num_rows < 2:
            return batch
        bits = self._bits(batch)
        mixed = ((bits ^ (bits >> np.uint64(32))) * _FACTORS[: bits.shape[1]]).sum(axis=1, dtype=np.uint64)
        _, first, group = np.unique(mixed, return_index=True, return_inverse=True)
        if len(first) == batch.num_rows or not np.array_equal(bits[first][group], bits):  # rows that only their hash has in common stay apart
            return batch
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(len(first)))
        at, columns = pa.array(first), []
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name not in self.sums:
                columns.append(column.take(at))
            elif pa.types.is_list(column.type):
                values = column.flatten().to_numpy().reshape(batch.num_rows, -1)
                total = np.add.reduceat(values[order], starts, axis=0, dtype=values.dtype)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel())).cast(column.type))
            else:
                columns.append(pa.array(np.add.reduceat(column.to_numpy()[order], starts)))
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def added(batches: Iterator[pa.RecordBatch], *sums: str, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """The batches of a task with rows alike added up."""
    rows = Added(sums, limit)
    for batch in batches:
        full = rows.add(batch)
        if full is not None:
            yield full
    rest = rows.rest()
    if rest is not None:
        yield rest


def added_up(rows: DataFrame, *sums: str) -> DataFrame:
    """rows with those alike in all other columns added up, as far as a task sees them. A narrow step."""
    return rows.mapInArrow(lambda batches: added(batches, *sums), rows.schema)
