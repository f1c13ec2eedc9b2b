"""Packing documents into sequences by bounded-space online best-fit.

Each task packs the pieces of its own partition. A fixed number of open bins stand in stacks by free space; a bitset
of the free spaces in use gives the tightest bin that holds a piece by one shift and its lowest set bit. When all bins
are open and a piece needs a new one, the fullest closes. Sequence ids carry the partition, so tasks need no exchange;
a task that runs again packs its partition anew, and only whole attempts count.

Null texts count as empty and become the end token alone; equal rows are packed as rows of their own; empty tables
give empty tables; extra columns are not carried (join on the id).
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplens.llm.byte_bpe import encoder
from stoplens.llm.common import in_tasks

LENGTH, END, OPEN = 1024, 2, 4096
ROWS = 256


class OpenBins:
    """At most ``most`` bins (at least 1) of ``length`` tokens, open at once."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.used, self.n_open, self.next = length, most, 0, 0, 0
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        sequence = self.stacks[free].pop()
        if not self.stacks[free]:
            self.used ^= 1 << free
        self.n_open -= 1
        return sequence

    def place(self, need: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``need`` tokens, 1 to ``length``."""
        fits = self.used >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.used & -self.used).bit_length() - 1)  # the fullest
            free, sequence = self.length, self.next
            self.next += 1
        rest = free - need
        if rest:
            self.stacks[rest].append(sequence)
            self.used |= 1 << rest
            self.n_open += 1
        return sequence, self.length - free


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but perhaps the first."""
    first = total % length
    return [(0, first)] * bool(first) + [(s, length) for s in range(first, total, length)]


def pack_batches(batches, path: str, length: int, end: int, most: int):
    own, bins = encoder(path), OpenBins(length, most)
    base = TaskContext.get().partitionId() << 40
    tail = np.array([end], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows, piece, start, size, tokens, sequence, offset = [], [], [], [], [], [], []
            for row, ids in enumerate(own.encode([t or "" for t in part.column(1).to_pylist()])):
                ids += tail
                for k, (s, n) in enumerate(cut(len(ids) // 4, length)):
                    to, place = bins.place(n)
                    rows.append(row), piece.append(k), start.append(s), size.append(n), tokens.append(ids[4 * s:4 * (s + n)])
                    sequence.append(base + to), offset.append(place)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                pa.array(tokens, pa.binary()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
            ], ["id", "piece", "start", "length", "tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END,
                   most_open: int = OPEN) -> DataFrame:
    """(id, piece, start, length, tokens, sequence_id, offset) per piece; tokens as little-endian unsigned 32-bit ids."""
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        in_tasks(__name__, "pack_batches", path, length, end, most_open),
        f"id {kind}, piece int, start long, length long, tokens binary, sequence_id long, offset long")
