"""Document norms from postings that travel packed.

A document's norm needs the document frequency of each of its terms, so every posting meets the others of its
term once. As rows (pos, term, tf) they are shuffled to the vocabulary, shuffled again to meet it, and their weights are
shuffled back: three rows of some twenty bytes for each posting. Here a task packs its postings: a *chunk* of at most ``CHUNK`` postings
is split by the leading bits of the term code into *ranges*, and a range of a chunk is one row of column-wise bytes (code,
number of the document in the chunk, tf). All rows of a range meet in one task, which sorts its codes: a run of equal
codes is a term, its length the document frequency. What goes back is one sum per document of the chunk and task, as an array;
the chunk's documents travel once, in a row of their own. About eight bytes a posting are shuffled, once.

A range holds about ``RANGE`` postings however many there are, so a task's memory is bounded by a few ranges and the sums it has not sent yet
(at most ``PENDING`` documents).
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package on their path

#: Postings packed at a time by a task.
CHUNK = 1 << 21
#: Postings that one range of codes should hold.
RANGE = 1 << 19
#: Postings a task of the second stage should hold.
TASK = 1 << 24
#: Postings in a row, so that the rows which meet in one Arrow batch stay small.
ROW = 512
#: Documents whose sums a task keeps before it sends them.
PENDING = 1 << 22
#: Rows of the last stage hold this many documents at most.
DOCS = 1024

_PACKED = "range int, chunk long, docs int, n int, data binary"
_SUMS = "chunk long, at int, pos array<long>, sums binary"


def _planes(values: np.ndarray) -> bytes:
    """The bytes of ``values`` place by place: leading places are nearly constant and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, at: int, width: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T).view(f"u{width}").ravel()


def _narrow(values: np.ndarray) -> np.ndarray:
    """``values`` in one, two or four bytes each."""
    top = int(values.max())
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _packer(bits: int, limit: int = CHUNK):
    def rows(chunk: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        pos, term, tf = (table.column(i).chunk(0) for i in range(3))
        empty = pos.is_null().to_numpy(zero_copy_only=False)
        key = pos.fill_null(0).to_numpy()
        first = np.ones(len(key), bool)  # of a document: its postings follow each other
        first[1:] = (key[1:] != key[:-1]) | (empty[1:] != empty[:-1])
        doc = (np.cumsum(first) - 1).astype(np.uint32)
        code = term.to_numpy().view(np.uint64)
        docs = int(doc[-1]) + 1
        of = (code >> np.uint64(64 - bits)).astype(np.uint16)
        order = np.argsort(of, kind="stable")
        code, doc, tf, of = code[order], doc[order], tf.to_numpy()[order].astype(np.uint32), of[order]
        ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
        out: list[tuple] = []
        # the documents, as rows of ranges below 0
        where = pos.take(pa.array(np.flatnonzero(first)))
        for at in range(0, docs, DOCS):
            out.append((-1 - (chunk + at // DOCS) % (1 << bits), at, -1, _places(where.slice(at, DOCS))))
        lo = 0
        for hi in ends:
            for a in range(lo, hi, ROW):
                b = min(a + ROW, hi)
                steps, counts = _narrow(np.diff(doc[a:b], prepend=doc[a])), _narrow(tf[a:b])
                head = np.array([doc[a], steps.itemsize, counts.itemsize], np.uint32).tobytes()
                out.append((int(of[a]), docs, b - a, head + _planes(code[a:b]) + _planes(steps) + _planes(counts)))
            lo = hi
        for a in range(0, len(out), 1024):
            r, d, n, data = zip(*out[a:a + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([chunk] * len(r), pa.int64()), pa.array(d, pa.int32()),
                                              pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["range", "chunk", "docs", "n", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                held += batch.num_rows
            if held >= limit:
                yield from rows(chunk, parts)
                chunk, parts, held = chunk + 1, [], 0
        if parts:
            yield from rows(chunk, parts)
    return pack


def _places(pos: pa.Array) -> bytes:
    """Positions with a mark where there is none."""
    empty = pos.is_null().to_numpy(zero_copy_only=False)
    return pos.fill_null(0).to_numpy().astype(np.int64).tobytes() + empty.astype(np.uint8).tobytes()


def _summer(n_docs: float, pending: int = PENDING):
    def flush(start: dict[int, tuple[int, int]], total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for chunk, (base, docs) in start.items():
            for at in range(0, docs, DOCS):
                part = total[base + at:base + min(at + DOCS, docs)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([at], pa.int32()), pa.array([None], pa.list_(pa.int64())),
                                                  pa.array([part.tobytes()], pa.binary())], names=["chunk", "at", "pos", "sums"])

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: dict[int, tuple[int, int]] = {}
        total, used, now, held = np.zeros(1 << 16), 0, None, []

        def close() -> None:
            code, doc, tf = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(code)
            code = code[order]
            first = np.ones(len(code), bool)
            first[1:] = code[1:] != code[:-1]
            at = np.flatnonzero(first)
            df = np.diff(at, append=len(code))
            idf = np.log((1.0 + n_docs) / (df + 1)) + 1
            w = (np.log(tf[order].astype(np.float64)) + 1) * np.repeat(idf, df)
            np.add.at(total, doc[order], w * w)

        for batch in batches:
            for rng, chunk, docs, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if rng < 0:
                    k = len(data) // 9
                    where = pa.array(np.frombuffer(data, np.int64, k), mask=np.frombuffer(data, np.uint8, k, 8 * k).astype(bool))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([docs], pa.int32()),
                                                      pa.ListArray.from_arrays(pa.array([0, k], pa.int32()), where), pa.array([None], pa.binary())],
                                                     names=["chunk", "at", "pos", "sums"])
                    continue
                if rng != now:
                    if held:
                        close()
                        held = []
                    if used > pending:
                        yield from flush(start, total)
                        start, used = {}, 0
                        total[:] = 0
                    now = rng
                if chunk not in start:
                    start[chunk] = (used, docs)
                    used += docs
                    if used > len(total):
                        total = np.concatenate([total, np.zeros(max(used, 2 * len(total)) - len(total))])
                base = start[chunk][0]
                at, doc, tf = np.frombuffer(data, np.uint32, 3).tolist()
                held.append((_unplanes(data, 12, 8, n), np.cumsum(_unplanes(data, 12 + 8 * n, doc, n), dtype=np.int64) + (base + at),
                             _unplanes(data, 12 + (8 + doc) * n, tf, n)))
        if held:
            close()
        yield from flush(start, total)
    return total_up


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pos, sq) of the documents of a chunk's part: its rows follow each other."""
    now, where, total = None, None, 0.0

    def out():
        return pa.RecordBatch.from_arrays([where, pa.array(total)], names=["pos", "sq"])

    for batch in batches:
        for i, (chunk, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if (chunk, at) != now:
                if now is not None:
                    yield out()
                now, where, total = (chunk, at), None, 0.0
            if batch.column(3)[i].is_valid:
                total = total + np.frombuffer(batch.column(3)[i].as_buffer(), np.float64)
            else:
                where = batch.column(2)[i].values
    if now is not None:
        yield out()


def document_norms(tf: DataFrame, n_docs: float) -> DataFrame:
    """(pos, norm) of coded postings (pos, term, tf): the norms of :func:`.retrieval.document_norms`, without a vocabulary."""
    spark = tf.sparkSession
    n = tf.count()
    tasks = max(spark.sparkContext.defaultParallelism, n // TASK)
    bits = min(16, max(3, tasks.bit_length() + 3, (n // RANGE).bit_length()))
    packed = tf.select("pos", "term", "tf").mapInArrow(_packer(bits), _PACKED)
    sums = packed.repartition(tasks, "range").sortWithinPartitions("range").mapInArrow(_summer(n_docs), _SUMS)
    parts = sums.repartition(tasks, "chunk", "at").sortWithinPartitions("chunk", "at").mapInArrow(_joiner, "pos long, sq double")
    # a document cut by the end of a chunk has a sum in each
    return parts.groupBy(F.col("pos").cast(tf.schema["pos"].dataType).alias("pos")).agg(F.sqrt(F.sum("sq")).alias("norm"))
