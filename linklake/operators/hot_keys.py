"""Per-key results where a few keys hold most rows.

Rows are first combined per (key, item) with map-side partial aggregation, which shuffles by the hash of both and so
spreads a crowded key over all tasks. Every split of that shuffle then encodes its keys as a dictionary and fills dense
accumulator arrays with ``bincount``; arrays travel in blocks (a block is a hash range of keys) and are summed in a
two-level distributed reduction. A key adds one array slot per split however many rows it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.runtime import parallelism

_LEAST = np.iinfo(np.int64).min
_BLOCK = "block int, part int, keys array<string>, n_rows array<bigint>, n_items array<bigint>, last array<bigint>"


def _accumulate(keys: pa.Array, n_rows: np.ndarray, n_items: np.ndarray, last: np.ndarray):
    coded = keys.dictionary_encode()
    codes, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    top = np.full(size, _LEAST)
    np.maximum.at(top, codes, last)
    return coded.dictionary, *(_sums(codes, x, size) for x in (n_rows, n_items)), top


def _sums(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact integer sums: bincount adds doubles, so high and low halves go separately."""
    low, high = values & 0xFFFFFF, values >> 24
    return np.bincount(codes, low, size).astype(np.int64) + (np.bincount(codes, high, size).astype(np.int64) << 24)


def _blocks(keys: pa.Array, arrays: list[np.ndarray], n_blocks: int, part: int) -> pa.RecordBatch:
    import xxhash

    at = np.array([xxhash.xxh32_intdigest(k) % n_blocks for k in keys.to_pylist()], dtype=np.int32)
    order = np.argsort(at, kind="stable")
    blocks, counts = np.unique(at[order], return_counts=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys.take(pa.array(order)), *(pa.array(a[order]) for a in arrays))]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(np.full(len(blocks), part, np.int32)), *lists], names=["block", "part", "keys", "n_rows", "n_items", "last"])


def _flat(t: pa.Table) -> list:
    columns = [t.column(c).combine_chunks() for c in ("keys", "n_rows", "n_items", "last")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return [columns[0].flatten(), *(c.flatten().to_numpy(zero_copy_only=False) for c in columns[1:])]


def per_key(df: DataFrame, key: Column, item: Column, at: Column, n_blocks: int | None = None) -> DataFrame:
    """(key, n_rows, n_items, last): rows, distinct items and greatest ``at`` of each key.

    ``key`` is cast to string, ``at`` to bigint. Rows whose key is null have no result; a null item counts as no item;
    ``last`` is null where every ``at`` of a key is null. Repeated rows count as rows each, once as items. An empty
    table gives no rows. Only the three expressions are read, so other columns, whatever their names, don't matter.
    """
    spark = df.sparkSession
    blocks = n_blocks or parallelism(spark)
    fan = max(1, math.isqrt(parallelism(spark)))
    rows = df.select(key.cast("string").alias("key"), F.xxhash64(item).alias("h1"), F.xxhash64(F.lit(1), item).alias("h2"), item.isNotNull().alias("has"), at.cast("bigint").alias("at")).where("key is not null")
    combined = rows.groupBy("key", "h1", "h2", "has").agg(F.count("*").alias("n"), F.max("at").alias("at")).select("key", "n", F.col("has").cast("bigint").alias("has"), F.coalesce("at", F.lit(_LEAST)).alias("at"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId() % fan, [], 0

        def fold(parts: list) -> tuple:
            return _accumulate(pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))

        for b in batches:
            if b.num_rows:
                held.append(_accumulate(b.column(0).cast(pa.string()), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))))
                n += len(held[-1][0])
            if n > 500_000:
                held = [fold(held)]
                n = 0
        if held:
            d, *arrays = fold(held)
            yield _blocks(d, arrays, blocks, part)

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d, *arrays = _accumulate(*_flat(t))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(d)], pa.int32()), x) for x in (d, *map(pa.array, arrays))]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), *lists], names=["block", "part", "keys", "n_rows", "n_items", "last"])

    def finish(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d, n_rows, n_items, last = _accumulate(*_flat(t))
        return pa.Table.from_arrays([d, pa.array(n_rows), pa.array(n_items), pa.array(last, mask=last == _LEAST)], names=["key", "n_rows", "n_items", "last"])

    arrays = combined.mapInArrow(fill, _BLOCK)
    return arrays.groupBy("block", "part").applyInArrow(merge, _BLOCK).groupBy("block").applyInArrow(finish, "key string, n_rows bigint, n_items bigint, last bigint")
