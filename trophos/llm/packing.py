"""Best-fit decreasing packing of tokenised documents into sequences.

A document is its ids and an end id.  Only one longer than a sequence is cut:
its last pieces are whole sequences, its first piece holds the rest.

Lengths are whole numbers up to the capacity, so best-fit decreasing does not
need the documents, only how many pieces there are of each length: a table of
at most ``capacity`` rows, whatever the corpus.  ``best_fit`` takes the lengths
from the largest down; a segment tree over the remaining capacities finds the
tightest one that an open bin has, in logarithmic time; equal pieces go into
equal bins as one run.  The runs, a few thousand at most, say where the pieces
of a length go by their number among those of that length; and that number is
the piece's place in its task plus the counts of the tasks before.

A null text is an empty one and becomes the end id alone.  Null and repeated
ids are kept as they are.  An empty table gives no sequence.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trophos.llm.bpe import encoder
from trophos.plans.scratch import Scratch

CAPACITY = 2_048
END_ID = 0


class Run(NamedTuple):
    """Pieces ``first`` to ``first + count`` of a length go to as many bins from ``bin`` on, at ``offset``."""

    length: int
    first: int
    count: int
    bin: int
    offset: int


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that finds the tightest."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: (first bin, bins)

    def add(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.runs[room].append((first, bins))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def _mark(self, room: int) -> None:
        node = self.leaves + room
        self.tree[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of ``length`` or more."""
        node = self.leaves + length
        if self.tree[node]:
            return length
        while node > 1:  # up to a right neighbour with an open bin, then down to its first
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of best-fit decreasing for ``counts`` pieces by length."""
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = bins.take(room)
            each = room // length  # a bin just used stays the tightest until it is full
            full = min(many, left // each)
            for k in range(each if full else 0):
                runs.append(Run(length, placed, full, first, capacity - room + k * length))
                placed += full
            left -= full * each
            bins.add(room - each * length, first, full)
            rest = min(left, each - 1) if full < many else 0
            for k in range(rest):
                runs.append(Run(length, placed, 1, first + full, capacity - room + k * length))
                placed += 1
            left -= rest
            if rest:
                bins.add(room - rest * length, first + full, 1)
                full += 1
            bins.add(room, first + full, many - full)
    return runs


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenised pieces, with the task that made each and its place there among equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, end, seen = TaskContext.get().partitionId(), end_id.to_bytes(4, "little"), np.zeros(capacity + 1, np.int64)
        tokens = encoder(path)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"]):
                ids = tokens.encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    length = stop - start
                    rows.append((i, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), seen[length]))
                    seen[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            at, *rest = zip(*rows) if rows else ((),) * 6
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [batch["doc_id"].take(pa.array(at, pa.int64())), *map(pa.array, rest, types)]
            columns.append(pa.array(np.full(len(rows), task), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "place", "task"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, place long, task int"
    )


def _placer(runs: list[Run]):
    """Arrow function of (length, number): sequence and offset."""
    table = np.array(sorted(runs) or [(0, 0, 0, 0, 0)], np.int64)

    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        length, number = np.asarray(length), np.asarray(number)
        at = np.zeros(len(length), np.int64)
        for size in np.unique(length):
            own = slice(*np.searchsorted(table[:, 0], [size, size + 1]))
            of = length == size
            at[of] = own.start + np.searchsorted(table[own, 1], number[of], "right") - 1
        found = table[at]
        columns = [pa.array(found[:, 3] + number - found[:, 1]), pa.array(found[:, 4])]
        return pa.StructArray.from_arrays(columns, ["sequence_id", "offset"])

    return F.arrow_udf(place, "sequence_id long, offset long")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(documents.sparkSession)
    # written once: tokenising is the costly part, and places must not change between reads
    cut = scratch.keep(pieces(documents, path, capacity, end_id))
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = _placer(best_fit(counts, capacity))
    found = cut.join(earlier, ["task", "length"]).withColumn("at", place("length", F.col("place") + F.col("earlier")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
