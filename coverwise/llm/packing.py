"""Sum-of-squares online packing of documents into token windows.

Each task takes its documents in turn. A document's full windows stand alone; its
tail goes to the fill level that keeps the sum over levels of (number of partially
filled windows at that level) squared smallest. The counts live in a level array of
one entry per possible fill. Full windows close at once. At the end of the task the
windows still open are evened out: the emptiest are cut up to fill the fullest, so
at most one window per task is padded (to the capacity, or left as it is when its
fill is a power of two).

Packing needs no shuffle: a task's windows are its own, and it holds the ids of open
windows only. Window numbers are (task number << 32) + number within the task.

Defined results: null and empty texts are the end id alone; repeated rows are packed
each for itself; a null id is kept as null; an empty table gives no rows; a very long
text spreads over as many windows as it needs; only the named columns are read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

CAPACITY = 2048
END_ID = 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packer. ``add`` and ``finish`` return the windows that closed: lists of pieces
    (key, start, ids), in order."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # windows open at each fill level
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> int:
        """The level an item of ``size`` is put on: 0 is a new window. Ties go to the fullest."""
        c, cap = self.count, self.capacity
        after = 2 * c[size:] + 1                      # one more at level + size
        after[cap - size] = 0                         # a full window is no longer counted
        before = 1 - 2 * c[:cap - size + 1]           # one less at level
        before[0] = 0
        change = before + after
        possible = c[:cap - size + 1] > 0
        possible[0] = True
        change[~possible] = np.iinfo(np.int64).max
        return cap - size - int(np.argmin(change[::-1]))

    def add(self, key, ids: np.ndarray) -> list[list]:
        cap, closed, n = self.capacity, [], len(ids)
        full = n - n % cap
        closed.extend([(key, at, ids[at:at + cap])] for at in range(0, full, cap))
        if full < n:
            size = n - full
            level = self.place(size)
            window = []
            if level:
                window = self.open[level].pop()
                self.count[level] -= 1
            window.append((key, full, ids[full:].copy()))
            if level + size == cap:
                closed.append(window)
            else:
                self.open[level + size].append(window)
                self.count[level + size] += 1
        return closed

    def finish(self) -> list[list]:
        """Close all windows: the fullest take pieces cut from the emptiest."""
        windows = [(w, fill) for fill in range(self.capacity, 0, -1) for w in self.open[fill]]
        closed, lo, hi = [], 0, len(windows) - 1
        while lo <= hi:
            window, fill = windows[lo]
            while fill < self.capacity and hi > lo:
                donor, left = windows[hi]
                key, start, ids = donor.pop()
                take = min(self.capacity - fill, len(ids))
                keep = len(ids) - take
                if keep:
                    donor.append((key, start, ids[:keep]))
                window.append((key, start + keep, ids[keep:]))
                fill, left = fill + take, left - take
                windows[hi] = (donor, left)
                if not left:
                    hi -= 1
            closed.append(window)
            lo += 1
        self.__init__(self.capacity)
        return closed


def _packer(path: str, capacity: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import blocks, tokenizer
        tok, packer = tokenizer(path), SumOfSquares(capacity)
        number = TaskContext.get().partitionId() << 32
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

        def rows(windows):
            nonlocal number
            cols = [[] for _ in names]
            for window in windows:
                at = 0
                for (doc, total), start, ids in window:
                    for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at)):
                        c.append(v)
                    at += len(ids)
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(names))

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in blocks(texts):
                ids, n = tok.encode(texts.slice(lo, hi - lo))
                closed, at = [], 0
                for doc, size in zip(docs[lo:hi], n.tolist()):
                    closed += packer.add((doc, size + 1), np.append(ids[at:at + size], np.uint32(end_id)))
                    at += size
                yield rows(closed)
        yield rows(packer.finish())
    return pack


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(tidy(_packer(tokenizer_path, capacity, end_id)), SCHEMA)
