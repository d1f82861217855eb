"""Sets of rows as sorted arrays in shared files, memory-mapped by workers: filters a wide table without shuffling it.

A row is known by two 64-bit hashes of its id and text, so rows that share an id but not the text are apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, map_array, new_shared_folder, put_bytes

#: Rows of one file.
SHARD_ROWS = 1 << 21


def row_keys(id_col: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes of a row, made by the JVM; nulls are told apart from empty texts."""
    parts = id_col.cast("long"), text, text.isNull()
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


class RowSet:
    """The written set: files by shard, which is the remainder of the first hash."""

    def __init__(self, folder: str, shards: int, full: list[int]):
        self.folder, self.shards, self.full, self.maps = folder, shards, set(full), {}

    def _open(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.maps:
            a = map_array(f"{self.folder}/{k}.rows", np.int64)
            self.maps[k] = a[: len(a) // 2], a[len(a) // 2 :]
        return self.maps[k]

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(one), bool), np.mod(one, self.shards)
        for k in np.unique(shard).tolist():
            if k not in self.full:
                continue
            a, b = self._open(k)
            at = np.flatnonzero(shard == k)
            i, j = np.searchsorted(a, one[at]), np.searchsorted(a, one[at], "right")
            for step in range(int((j - i).max())):  # more than one only where 64-bit hashes collide
                here = i + step < j
                out[at[here]] |= b[i[here] + step] == two[at[here]]
        return out


def write_rows(rows: DataFrame) -> RowSet:
    """rows: k1, k2, as of :func:`row_keys`. The number of files follows the number of rows."""
    spark = rows.sparkSession
    rows = cut(rows.select("k1", "k2").distinct())
    folder, shards = new_shared_folder(spark, "rows"), max(1, math.ceil(rows.count() / SHARD_ROWS))
    keyed = rows.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))

    def write(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        k, a, b = key[0].as_py(), np.asarray(group.column("k1"), np.int64), np.asarray(group.column("k2"), np.int64)
        order = np.lexsort((b, a))
        put_bytes(f"{folder}/{k}.rows", a[order].tobytes(), b[order].tobytes())
        return pa.table({"shard": pa.array([k], pa.int32())})

    done = cut(dealt(keyed, "shard", shards).groupBy("shard").applyInArrow(write, "shard int"))
    return RowSet(folder, shards, [r["shard"] for r in done.collect()])


def filter_rows(df: DataFrame, rows: RowSet, keep_members: bool, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """Rows that are in the set (or are not): a narrow pass, no shuffle. ``carry`` leaves k1 and k2 behind the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.asarray(b.column(b.num_columns - i), np.int64) for i in (2, 1))
            got = b.filter(pa.array(rows.has(one, two) == keep_members))
            if got.num_rows:
                yield got if carry else pa.RecordBatch.from_arrays(got.columns[:-2], names=got.schema.names[:-2])

    one, two = row_keys(F.col(id_col), F.col(text))
    names, taken = ("k1", "k2"), {c.lower() for c in df.columns}
    while taken & set(names):
        names = tuple(f"_{n}" for n in names)
    keyed = df.select("*", one.alias(names[0]), two.alias(names[1]))
    return keyed.mapInArrow(run, keyed.schema if carry else df.schema)
