"""Texts to sequences of a fixed number of tokens, by bounded-space online best fit.

Each task streams its texts: a text goes into the open sequence whose free space fits it most tightly; if none fits, a
new one is opened. Open sequences are found through a bitset over free space (bit f is set while some open sequence has
f tokens free), so a lookup is a shift and a lowest-set-bit. At most ``open_bins`` are open; beyond that the fullest is
closed. What is open at the end of a task goes, as lengths only, into a second pass over few tasks. No text is split
unless it alone exceeds the capacity; then its full pieces are sequences and its rest is an item.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.runtime import Workspace

#: Folder and file of a public vocabulary in tiktoken's format; both are parameters everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PLACED = "sequence bigint, place int, doc_id bigint, start int, n_tokens int, closed boolean"


class OpenBins:
    """Open sequences under a bitset of their free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.by_free, self.n, self.made = 0, defaultdict(list), 0, 0

    def _take(self, free: int):
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n -= 1
        return bin_

    def _keep(self, free: int, bin_) -> None:
        self.by_free[free].append(bin_)
        self.bits |= 1 << free
        self.n += 1

    def add(self, items: list, size: int):
        """Places items of the total ``size`` together; yields the sequences that close."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, []
        bin_ += items
        if free == size:
            yield bin_
            return
        self._keep(free - size, bin_)
        if self.n > self.limit:
            yield self._take((self.bits & -self.bits).bit_length() - 1)

    def rest(self):
        """The sequences still open, fullest first."""
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


def encoder(blob: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _rows(bins: Iterator[list], at: int, base: int, closed: bool) -> tuple[list, int]:
    out = []
    for b in bins:
        out += [(base + at, k, *item, closed) for k, item in enumerate(b)]
        at += 1
    return out, at


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["sequence", "place", "doc_id", "start", "n_tokens", "closed"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _pack(vocabulary, pattern: str, capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, bins, at = None, OpenBins(capacity, limit), 0
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            enc = enc or encoder(vocabulary.value, pattern)
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(enc.encode_ordinary(text)) if text else 0
                full = n // capacity
                done = [[(doc, k * capacity, capacity)] for k in range(full)]
                if n % capacity:
                    done += bins.add([(doc, full * capacity, n % capacity)], n % capacity)
                rows, at = _rows(iter(done), at, base, True)
                out += rows
            if out:
                yield _batch(out)
        rows, at = _rows(bins.rest(), at, base, False)
        if rows:
            yield _batch(rows)

    return run


def _repack(capacity: int, limit: int):
    """Second pass: the content of one open sequence stays together as one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, at, base = OpenBins(capacity, limit), 0, (1 << 62) + (TaskContext.get().partitionId() << 33)
        group, last = [], None

        def place(group: list):
            return bins.add(group, sum(x[2] for x in group)) if group else ()

        for b in batches:
            out = []
            for s, *item in zip(*(b.column(c).to_pylist() for c in ("sequence", "doc_id", "start", "n_tokens"))):
                if s != last:
                    rows, at = _rows(place(group), at, base, True)
                    out += rows
                    group, last = [], s
                group.append(tuple(item))
            if out:
                yield _batch(out)
        rows, at = _rows(place(group), at, base, True)
        more, at = _rows(bins.rest(), at, base, True)
        if rows or more:
            yield _batch(rows + more)

    return run


def pack(documents: DataFrame, capacity: int = 2048, open_bins: int = 64, vocabulary: str = VOCABULARY, pattern: str = PATTERN, tasks_per_rest: int = 32) -> DataFrame:
    """(sequence, place, doc_id, start, n_tokens): where every piece of every text goes.

    ``start`` and ``n_tokens`` are in tokens of the text; texts up to the capacity are one piece. Null texts and texts
    without tokens have no piece, blank ones have the tokens of their white space. Repeated rows are packed as often as
    they come. Rows with a null id are packed too. An empty table gives no rows. Other columns are not read. Sequence
    numbers are unique but not consecutive.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be positive")
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    first = Workspace(spark, "packing").put(documents.select("doc_id", "text").mapInArrow(_pack(shared, pattern, capacity, open_bins), _PLACED))
    open_ = first.where("not closed")
    tasks = max(1, -(-open_.select(F.shiftright("sequence", 33).alias("p")).distinct().count() // tasks_per_rest))
    again = open_.repartition(tasks, F.expr(f"shiftright(sequence, 33) div {tasks_per_rest}")).sortWithinPartitions("sequence", "place").mapInArrow(_repack(capacity, open_bins), _PLACED)
    return first.where("closed").unionByName(again).drop("closed")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_sequences, n_tokens and the share of the sequences' room in use."""
    n = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("n"))
    return n.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), (F.sum("n") / (F.count("*") * capacity)).alias("used"))
