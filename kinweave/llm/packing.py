"""Best-fit packing of token sequences: bounded space, online.

A packer holds a fixed number of open bins. A bitset keyed by free space finds the open bin that a piece leaves
fullest with two operations on one integer. If no open bin has room and all places are taken, the fullest bin closes
and a new one opens. Only documents longer than a sequence are cut, into whole sequences and a rest.

Every partition packs what it reads, and a piece leaves the task when its bin closes; memory is the open bins. What is
still open at the end of a partition, at most `open_bins` bins, is staged unplaced, and a second pass packs it anew, the
longest pieces first, in groups of GROUP partitions: only that bounded remainder shuffles, and the number of
half-empty sequences does not grow with the partitions. A lost task repeats its work on the same rows.

Defined cases: a null or empty text is its end id alone; rows are packed as they come, equal rows and ids included; an
empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tokens import hold, slices, small_batches, trim, vocabulary_path, word_encoder
from kinweave.staging import stage

#: Open bins of a packer, and partitions whose open bins one task of the second pass packs, by lengths alone.
OPEN_BINS, GROUP = 256, 32
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary, row long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.int64()]

#: What the second pass reads of a piece, and what it gives.
_LENGTHS, _PLACES = ("row", "doc_id", "piece", "length", "ids_crc32"), "row long, sequence_id long, offset long"


class BestFit:
    """Places pieces one after another; `place` returns the bin and the offset there, and `closed` gets the bins that closed."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most, self.bits, self.open, self.opened = capacity, open_bins, 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open == self.most and length < self.capacity:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            b, free = self.opened, self.capacity
            self.opened += 1
        if left := free - length:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(b)
        return b, self.capacity - free


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048, open_bins: int = OPEN_BINS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian unsigned 32-bit)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("words")
        encoder = word_encoder(vocabulary or vocabulary_path("word_bpe_49k.json"))
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        packer, held, nth = BestFit(capacity, open_bins), defaultdict(list), count(part << 40)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                out: list[tuple] = []
                for key, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        seq, offset = packer.place(len(piece) // 4)
                        held[seq].append((key, k, at // 4, len(piece) // 4, zlib.crc32(piece), part << 40 | seq, offset, piece, next(nth)))
                    for seq in packer.closed:
                        out += held.pop(seq)
                    packer.closed.clear()
                yield batch_of(out)
        yield batch_of([(*row[:5], None, None, *row[7:]) for rows in held.values() for row in rows])
        trim()

    def again(rest: pa.Table) -> pa.Table:
        rest = rest.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        packer, base = BestFit(capacity, rest.num_rows), 1 << 62 | (rest["row"][0].as_py() >> 40) // GROUP << 32
        at = [packer.place(n) for n in rest["length"].to_pylist()]
        return pa.table({"row": rest["row"], "sequence_id": pa.array([base | seq for seq, _ in at], pa.int64()), "offset": pa.array([offset for _, offset in at], pa.int64())})

    placed, _ = stage(small_batches(docs).select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _SCHEMA), "packed", compression="lz4", dictionary=False)
    # ids stay out of the second pass, whose groups are held in memory, and come back by row
    rest = placed.where("sequence_id IS NULL")
    packed = rest.select(*_LENGTHS).groupBy(F.expr(f"shiftright(row, 40) div {GROUP}")).applyInArrow(again, _PLACES)
    rest = rest.drop("sequence_id", "offset").join(packed, "row").select(_NAMES)
    return placed.where("sequence_id IS NOT NULL").unionByName(rest).drop("row")
