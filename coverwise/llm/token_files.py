"""Token-id files: an adaptive context-mixing range coder in independent blocks.

Documents are range-sorted by id, tokenised by the task that writes them and stored in
files of whole documents. A file's ids are cut into blocks of ``BLOCK`` ids; every block
starts from a fresh model, has checksums of its own and can be decoded alone.

The model predicts each id from three orders. Order 2 and order 1 remember, per context of the
last two ids and the last id, the id that followed and how sure they are; order 0 is
an adaptive distribution over classes of ids by frequency rank (the file's rank table is in its header)
with the place inside the class coded evenly. For every combination of the two
confidences, adaptive weights mix the orders: an id is coded as "what order 2 says", "what order 1 says", or through
order 0. The arithmetic coder keeps 48 bits; carries run into what it has written when it ends.

A block has three strings of words: the mixed orders' choices; the classes that order 0 codes, dealt to ``LANES``
coders in turn; the places, bit after bit. Order 0 begins at the shares of the classes in the file and learns from the block
every ``WINDOW`` ids. So the reader has all that order 0 says before it follows the contexts from id to id.

A block is a sequential thing; a file's blocks are not. They are coded side by side, one
id of every block per step, with the same few numpy operations whatever the number of blocks.

File: magic, counts, rank table, counts of the classes, document ids and lengths, block headers (ids, ids of order 0, words of each
string), checksums (of the ids, of the words), words, checksum of all before. Files are written
under attempt names and renamed when the manifest of the successful attempts is in.

Defined results: null and empty texts are the end id alone; rows with equal ids are
stored one after the other in an order their texts decide; a null id is stored as such and sorts first; an empty
table gives no files; only the named columns are read; very long texts take more blocks.
"""
from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, save
from .warc import open_folder

END_ID = 2
#: Ids of a block; ids of a file (documents are whole, so the last may go over).
BLOCK = 2048
FILE_IDS = 4 << 20
#: Blocks that are coded side by side at most.
GROUP = 4096
SLOT_BITS = 9
#: Bits of a mixing probability, its rate of change and the least of its three parts.
MIX_BITS, RATE, LEAST = 15, 5, 64
#: Bits of a class probability, coders of a block's classes, ids until order 0 learns, weight of the file's shares.
CLASS_BITS, LANES, WINDOW, PRIOR = 14, 4, 64, 256

MAGIC = b"CWTOKEN2"
_NULL_ID = -(1 << 63)


# ---------------------------------------------------------------- classes of ranks

def _class_of(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, place in the class, bits of the place): 7 single ranks, then 4 classes per octave of rank + 1."""
    r = rank.astype(np.int64) + 1
    octave = np.frexp(r.astype(np.float64))[1].astype(np.int64)  # bit length
    bits = np.maximum(octave - 3, 0)
    cls = np.where(octave <= 3, r - 1, 7 + (octave - 4) * 4 + (r >> bits) - 4)
    return cls, r & ((1 << bits) - 1), bits


# ---------------------------------------------------------------- range coder

_16, _32, _MIX, _CLASS = (np.uint64(k) for k in (16, 32, MIX_BITS, CLASS_BITS))
_M32, _SHORT = np.uint64((1 << 32) - 1), np.uint64(1 << 32)


class _Encoder:
    """``n`` coders side by side; the first ``m`` of them code an interval of their range."""

    def __init__(self, n: int, words: int):
        self.n, self.low, self.range = n, np.zeros(n, np.uint64), np.full(n, 1 << 48, np.uint64)
        self.out, self.at = np.zeros((words, n), np.uint32), np.arange(n)

    def code(self, start, end, m: int):
        self.low[:m] += start
        short = np.flatnonzero(np.subtract(end, start, out=self.range[:m]) < _SHORT)
        if len(short):
            self._shift(short)
            self.range[short] <<= _16

    def _shift(self, k):
        at, low = self.at[k], self.low[k]
        self.out.reshape(-1)[at] = low >> _32  # with a carry
        self.at[k] = at + self.n
        self.low[k] = (low & _M32) << _16

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all coders one after the other, number of words of each). What follows them is no part of the numbers."""
        every = np.arange(self.n)
        self.low += np.uint64(0xFFFF)
        for _ in range(2):
            self._shift(every)
        used = self.at // self.n
        out = self.out[:int(used.max())]
        for k in range(len(out) - 1, 0, -1):  # carries run to the front
            out[k - 1] += out[k] >> 16
        words = (out & 0xFFFF).astype("<u2").T
        return words[np.arange(len(out)) < used[:, None]], used


class _Decoder:
    def __init__(self, words: np.ndarray, used: np.ndarray):
        self.data = np.concatenate([words, np.zeros(3, "<u2")]).astype(np.uint64)
        at = np.cumsum(used) - used
        self.code = (self.data[at] << _32) | (self.data[at + 1] << _16) | self.data[at + 2]
        self.at, self.range = at + 3, np.full(len(used), 1 << 48, np.uint64)

    def take(self, start, end, m: int):
        self.code[:m] -= start
        short = np.flatnonzero(np.subtract(end, start, out=self.range[:m]) < _SHORT)
        if len(short):
            at = self.at[short]
            self.code[short] = (self.code[short] << _16) | self.data.take(at)
            self.at[short] = at + 1
            self.range[short] <<= _16


# ---------------------------------------------------------------- orders 1 and 2, and their mixture

_TOP = 1 << MIX_BITS
_MASK = (1 << SLOT_BITS) - 1
#: Where order 1 and order 0 start, by what was coded: the weights go there.
_TARGET = np.array([[_TOP - 2 * LEAST, _TOP - LEAST], [LEAST, _TOP - LEAST], [LEAST, 2 * LEAST]], np.int16).view(np.int32).reshape(-1)
#: At first: by the confidence of order 2, of order 1, and whether both say the same.
_WEIGHTS = np.array([(int(_TOP * p), int(_TOP * (p + (0.01 if same else (1 - p) * q))))
                     for p in (.12, .45, .65, .85) for q in (.06, .2, .35, .5) for same in (False, True)], np.int16).view(np.int32).reshape(-1)
#: Change of a slot that missed, that hit, by its confidence.
_CHANGE = np.array([0, -1, -1, -1, 1, 1, 1, 0], np.int32)


class _Model:
    """The state of ``n`` blocks, each of its own. A slot is what it says (a rank) and two bits of confidence."""

    def __init__(self, n: int):
        self.slots = np.zeros(2 * n << SLOT_BITS, np.int32)  # order 1 of all blocks, order 2 of all blocks
        self.base = (np.arange(2 * n) << SLOT_BITS).reshape(2, n)
        self.weights, self.row = np.tile(_WEIGHTS, n), np.arange(n) << 5

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """[..., 2, blocks]: slots of the contexts."""
        h = last * 40503
        at = np.stack([h >> 5, (h ^ (before * 30011)) >> 4], axis=-2)
        at &= _MASK
        at += self.base[:, :at.shape[-1]]
        return at

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what order 1 and order 2 say, where order 1 and order 0 start of ``1 << MIX_BITS``)."""
        self.at, self.slot = at, self.slots.take(at)
        say, self.sure = self.slot >> 2, self.slot & 3
        ctx = self.sure[1] << 2
        ctx += self.sure[0]
        ctx <<= 1
        ctx += say[0] == say[1]
        self.ctx = self.row[:len(ctx)] + ctx
        self.weight = self.weights.take(self.ctx)
        return say, self.weight.view(np.int16).reshape(-1, 2).T.astype(np.uint64)

    def update(self, how: np.ndarray, hit: np.ndarray, rank: np.ndarray):
        pair = self.weight.view(np.int16)
        pair += (_TARGET.take(how).view(np.int16) - pair) >> RATE
        self.weights[self.ctx] = self.weight
        kind = hit.view(np.int8) << 2
        kind = kind + self.sure
        self.slot += _CHANGE.take(kind)
        np.copyto(self.slot, rank << 2, where=kind == 0)
        self.slots[self.at] = self.slot


def _interval(starts: np.ndarray, full: np.ndarray, other: np.ndarray, neither: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part of the range of order 2, or of an ``other``: order 1, or order 0 if ``neither`` says it."""
    end = np.where(other, starts[1], starts[0])
    np.copyto(end, full, where=neither)
    start = np.where(neither, starts[1], starts[0])
    start *= other
    return start, end


def _encode_orders(ranks: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[length, blocks] of ranks, the last block with ``last`` ranks only -> (words, their number by block, which
    ranks are left to order 0)."""
    length, n = ranks.shape
    model, coder = _Model(n), _Encoder(n, length + 8)
    left = np.zeros((length, n), bool)
    past = np.zeros((2, n), np.int64)
    for t in range(length):
        if t % 16 == 0:
            past = np.concatenate([past, ranks[t:t + 16]])
            places, past = model.places(past[1:-1], past[:-2]), past[-2:]
        m = n - (t >= last)
        rank = ranks[t, :m]
        say, starts = model.predict(places[t % 16][:, :m])
        starts *= coder.range[:m] >> _MIX
        hit = say == rank
        other = ~hit[1]  # than order 2
        neither = np.greater(other, hit[0], out=left[t, :m])
        coder.code(*_interval(starts, coder.range[:m], other, neither), m)
        model.update(other.view(np.int8) + neither.view(np.int8), hit, rank)
    return *coder.finish(), left


def _decode_orders(words: np.ndarray, used: np.ndarray, others: np.ndarray, counts: np.ndarray, length: int, last: int) -> np.ndarray:
    """The inverse of :func:`_encode_orders`; ``others`` are the ranks of order 0, ``counts`` of them in each block."""
    n = len(used)
    model, coder = _Model(n), _Decoder(words, used)
    out = np.zeros((length, n), np.int32)
    others, at = np.append(others, 0).astype(np.int32), np.cumsum(counts) - counts
    back1 = back2 = np.zeros(n, np.int64)
    for t in range(length):
        m = n - (t >= last)
        say, starts = model.predict(model.places(back1[:m], back2[:m]))
        starts *= coder.range[:m] >> _MIX
        other, neither = coder.code[:m] >= starts
        coder.take(*_interval(starts, coder.range[:m], other, neither), m)
        rank = np.where(other, say[0], say[1])
        np.copyto(rank, others.take(at[:m]), where=neither)
        at[:m] += neither
        out[t, :m] = rank
        model.update(other.view(np.int8) + neither.view(np.int8), say == rank, rank)
        back1, back2 = rank.astype(np.int64), back1
    return out


# ---------------------------------------------------------------- order 0

class _Classes:
    """Order 0 of blocks with ``counts`` ids, and the lanes that code them; the longest come first, so those with more to do are the first ones."""

    def __init__(self, counts: np.ndarray, shares: np.ndarray):
        self.k, self.n = len(shares), len(counts)
        self.stride = 1 << self.k.bit_length()
        order = np.argsort(-counts, kind="stable")
        size = counts[order]
        row, lane = np.repeat(np.arange(self.n), LANES), np.tile(np.arange(LANES), self.n)
        steps = (size[row] - lane + LANES - 1) // LANES
        by = np.argsort(-steps, kind="stable")
        self.row, self.first = row[by] * self.stride, (np.cumsum(counts) - counts)[order][row[by]] + lane[by]
        self.name = order[row[by]] * LANES + lane[by]  # place of the lane in the file
        self.steps = int(steps.max())
        self.active = np.searchsorted(-steps[by], -np.arange(self.steps)).tolist()
        self.rows = np.searchsorted(-size, -np.arange(self.steps) * LANES).tolist()
        self.freq = np.zeros((self.n, self.stride), np.uint32)
        self.freq[:, :self.k] = np.maximum(shares * PRIOR // max(int(shares.sum()), 1), 1)
        self.seen = []

    def step(self, s: int) -> int:
        """Lanes of step ``s``; before it ``cum`` is made anew where a window ends."""
        if s % (WINDOW // LANES) == 0:
            if self.seen:
                self.freq += np.bincount(np.concatenate(self.seen), minlength=self.freq.size).reshape(self.freq.shape).astype(np.uint32)
                self.seen = []
            n = self.rows[s]
            f = np.cumsum(self.freq[:n], axis=1, dtype=np.uint32)
            total = f[:, -1:].copy()
            f *= np.uint32((1 << CLASS_BITS) - self.k)
            f //= total
            cum = np.full((n, self.stride), 1 << CLASS_BITS, np.uint16)
            cum[:, 0] = 0
            cum[:, 1:self.k] = f[:, :self.k - 1] + np.arange(1, self.k, dtype=np.uint32)
            self.cum = cum.reshape(-1)
        return self.active[s]

    def bounds(self, key: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.seen.append(key)
        return r * self.cum.take(key).astype(np.uint64), r * self.cum.take(key + 1).astype(np.uint64)


def _encode_classes(classes: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, their number by block and lane) of the classes of all blocks, block after block."""
    model = _Classes(counts, shares)
    coder = _Encoder(len(model.first), model.steps + 8)
    for s in range(model.steps):
        m = model.step(s)
        key = model.row[:m] + classes.take(model.first[:m] + s * LANES)
        coder.code(*model.bounds(key, coder.range[:m] >> _CLASS), m)
    words, used = coder.finish()
    place = np.argsort(model.name)
    return _gather(words, np.cumsum(used) - used, used, place), used[place]


def _decode_classes(words: np.ndarray, used: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    model = _Classes(counts, shares)
    coder = _Decoder(_gather(words, np.cumsum(used) - used, used, model.name), used[model.name])
    out = np.zeros(int(counts.sum()), np.uint8)
    halves = [model.stride >> k for k in range(1, model.stride.bit_length())]
    for s in range(model.steps):
        m = model.step(s)
        r = coder.range[:m] >> _CLASS
        v = (coder.code[:m] // r).astype(np.uint16)
        key = model.row[:m].copy()
        for half in halves:  # the last class that starts at v or before
            key += (model.cum.take(key + half) <= v) * half
        coder.take(*model.bounds(key, r), m)
        out[model.first[:m] + s * LANES] = key - model.row[:m]
    return out


def _gather(x: np.ndarray, start: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The stretches of ``x`` in another order."""
    start, size = start[order], size[order]
    end = np.cumsum(size)
    return x[np.repeat(start - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


def _bit_places(bits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bit where each place starts, words of each block): every block starts at a word."""
    end = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
    edge = end[np.concatenate([[0], np.cumsum(counts)])]
    words = (np.diff(edge) + 15) >> 4
    return end[:-1] + np.repeat(((np.cumsum(words) - words) << 4) - edge[:-1], counts), words


def _pack_places(places: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, words = _bit_places(bits, counts)
    total = int(words.sum())
    out = np.zeros(total // 2 + 2, np.int64)  # two words each
    if len(at):
        pair = at >> 5
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        value, pair = np.add.reduceat(places << (at & 31), new), pair[new]
        out[pair] += value & 0xFFFFFFFF
        out[pair + 1] += value >> 32
    return out.astype("<u4").view("<u2")[:total], words


def _unpack_places(packed: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at, _ = _bit_places(bits, counts)
    d = np.concatenate([packed, np.zeros(3, "<u2")]).astype(np.int64)
    d = d[:-2] | (d[1:-1] << 16) | (d[2:] << 32)
    return (d.take(at >> 4) >> (at & 15)) & ((1 << bits) - 1)


# ---------------------------------------------------------------- files

def _group(n: int, sizes: np.ndarray):
    """(from, to, length of the longest, ids of the last) of blocks that are coded side by side."""
    for lo in range(0, n, GROUP):
        hi = min(lo + GROUP, n)
        yield lo, hi, int(sizes[lo]), int(sizes[hi - 1])


def _by_word(words: np.ndarray, used: np.ndarray) -> list[np.ndarray]:
    return np.split(words, np.cumsum(used)[:-1])


def pack_file(docs: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One file: documents of ``sizes`` ids each, ``ids`` one after the other."""
    count = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    names = np.flatnonzero(count)
    table = names[np.lexsort((names, -count[names]))].astype("<u4")
    rank = np.zeros(len(count), np.int32)
    rank[table] = np.arange(len(table))
    class_of, place_of, bits_of = _class_of(np.arange(len(table)))
    shares = np.bincount(class_of, count[table]).astype(np.int64)
    n = -(-len(ids) // BLOCK)
    lengths = np.full(n, BLOCK)
    lengths[n - 1:] = len(ids) - (n - 1) * BLOCK
    heads, body = np.zeros((n, 4 + LANES), "<u2"), []
    for lo, hi, length, last in _group(n, lengths):
        ranks = np.zeros((hi - lo) * length, np.int32)
        part = ids[lo * BLOCK:hi * BLOCK]
        ranks[:len(part)] = rank[part]
        ranks = ranks.reshape(hi - lo, length)
        orders, order_words, left = _encode_orders(ranks.T.copy(), last)
        left = left.T.copy()
        counts, others = left.sum(axis=1), ranks[left]
        bits = bits_of[others]
        classes, class_words = _encode_classes(class_of[others], counts, shares)
        places, place_words = _pack_places(place_of[others], bits, counts)
        heads[lo:hi] = np.column_stack([lengths[lo:hi], counts, order_words, place_words, class_words.reshape(-1, LANES)])
        body += [b"".join(w.tobytes() for w in x) for x in zip(
            _by_word(orders, order_words), _by_word(classes, class_words.reshape(-1, LANES).sum(axis=1)), _by_word(places, place_words))]
    plain = memoryview(ids.astype("<u4").tobytes())
    checks = np.array([(zlib.crc32(plain[4 * k * BLOCK:4 * (k + 1) * BLOCK]), zlib.crc32(w)) for k, w in enumerate(body)], "<u4")
    data = (MAGIC + struct.pack("<IQIII", len(docs), len(ids), len(table), len(shares), n) + table.tobytes() + shares.astype("<u8").tobytes()
            + np.array([_NULL_ID if d is None else d for d in docs], "<i8").tobytes() + np.array(sizes, "<u8").tobytes()
            + heads.tobytes() + checks.tobytes() + b"".join(body))
    return data + struct.pack("<I", zlib.crc32(data))


def unpack_file(data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """The inverse of :func:`pack_file`; every checksum is verified."""
    if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a token file, or damaged")
    n_docs, n_ids, n_table, n_classes, n = struct.unpack_from("<IQIII", data, 8)
    at = 32

    def part(kind, n):
        nonlocal at
        x = np.frombuffer(data, kind, n, at)
        at += x.nbytes
        return x

    table, shares, docs, sizes = part("<u4", n_table), part("<u8", n_classes).astype(np.int64), part("<i8", n_docs), part("<u8", n_docs)
    heads, checks = part("<u2", n * (4 + LANES)).reshape(n, 4 + LANES).astype(np.int64), part("<u4", 2 * n).reshape(n, 2).tolist()
    words = part("<u2", (len(data) - 4 - at) // 2)
    class_of, _, bits_of = _class_of(np.arange(n_table))
    first_of = np.flatnonzero(np.diff(class_of, prepend=-1))
    bits = bits_of[first_of]
    class_words = heads[:, 4:].sum(axis=1)
    strings = np.stack([heads[:, 2], class_words, heads[:, 3]], axis=1)  # as they follow each other in a block
    ends = np.cumsum(strings).reshape(n, 3)
    starts = ends - strings
    for a, b, (_, c) in zip(starts[:, 0].tolist(), ends[:, 2].tolist(), checks):
        if zlib.crc32(words[a:b]) != c:
            raise ValueError("damaged block")
    ids = np.zeros(n_ids, "<u4")
    for lo, hi, length, last in _group(n, heads[:, 0]):
        every, counts = np.arange(hi - lo), heads[lo:hi, 1]
        orders, classes, places = (_gather(words, starts[lo:hi, k], strings[lo:hi, k], every) for k in range(3))
        classes = _decode_classes(classes, heads[lo:hi, 4:].reshape(-1), counts, shares) if counts.any() else np.zeros(0, np.uint8)
        others = first_of[classes] + _unpack_places(places, bits[classes], counts)
        ranks = _decode_orders(orders, heads[lo:hi, 2], others, counts, length, last)
        ids[lo * BLOCK:hi * BLOCK] = table[ranks.T].reshape(-1)[:min(hi * BLOCK, n_ids) - lo * BLOCK]
    plain = memoryview(ids.tobytes())
    for k, (c, _) in enumerate(checks):
        if zlib.crc32(plain[4 * k * BLOCK:4 * (k + 1) * BLOCK]) != c:
            raise ValueError("a block did not decode to what was written")
    return [None if d == _NULL_ID else int(d) for d in docs], sizes.astype(np.int64).tolist(), ids


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import blocks, tokenizer
        ctx = TaskContext.get()
        shard, attempt, tok = ctx.partitionId(), ctx.taskAttemptId(), tokenizer(path)
        filesystem, base = open_folder(folder)
        docs, sizes, held, total, rows = [], [], [], 0, []

        def close():
            nonlocal docs, sizes, held, total
            data = pack_file(docs, sizes, np.concatenate(held))
            name = f"_temporary/{shard:06d}-{len(rows):04d}-{attempt}.tok"
            with filesystem.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            rows.append((shard, len(rows), name, len(data), zlib.crc32(data), total))
            docs, sizes, held, total = [], [], [], 0

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in blocks(texts):
                ids, n = tok.encode(texts.slice(lo, hi - lo))
                at = 0
                for doc, size in zip(names[lo:hi], n.tolist()):
                    docs.append(doc)
                    sizes.append(size + 1)
                    held.append(np.append(ids[at:at + size], np.uint32(end_id)))
                    at, total = at + size, total + size + 1
                    if total >= FILE_IDS:
                        close()
        if docs:
            close()
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                         names=["shard", "seq", "temp", "bytes", "crc32", "ids"])
    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID, n_shards: int | None = None) -> tuple[str, DataFrame]:
    """Write token files in ascending id order. Returns the folder and the manifest (file, bytes, crc32, ids, start)."""
    spark = docs.sparkSession
    folder = (folder or new_path(spark, "tokens")).rstrip("/")
    filesystem, base = open_folder(folder)
    filesystem.create_dir(f"{base}/_temporary", recursive=True)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = d.repartitionByRange(n_shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = save(rows.mapInArrow(_writer(folder, tokenizer_path, end_id), "shard int, seq int, temp string, bytes long, crc32 long, ids long"), "token-manifest")
    start, files = 0, []
    for f in sorted(manifest.collect()):  # one row per file
        name = f"part-{f['shard']:06d}-{f['seq']:04d}.tok"
        filesystem.move(f"{base}/{f['temp']}", f"{base}/{name}")
        files.append((name, f["bytes"], f["crc32"], f["ids"], start))
        start += f["ids"]
    filesystem.delete_dir(f"{base}/_temporary")
    with filesystem.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"tokenizer": tokenizer_path.rsplit("/", 1)[-1], "end_id": end_id, "files": files}).encode())
    return folder, spark.createDataFrame(files, "file string, bytes long, crc32 long, ids long, start long")


def _reader(folder: str, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_folder(folder)
        for batch in batches:
            for f in batch.to_pylist():
                with filesystem.open_input_stream(f"{base}/{f['file']}", compression=None) as raw:
                    data = raw.read()
                if zlib.crc32(data) != f["crc32"]:
                    raise ValueError(f"{f['file']} is not the file of the manifest")
                docs, sizes, ids = unpack_file(data)
                ends = np.cumsum(sizes)
                each = [ids[b - n:b] for b, n in zip(ends.tolist(), sizes)]
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in each]
                for lo in range(0, len(docs), 1000):
                    hi = lo + 1000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[lo:hi], pa.int64()), pa.array(f["start"] + ends[lo:hi] - np.array(sizes[lo:hi]), pa.int64()), pa.array(sizes[lo:hi], pa.int64()),
                         pa.array(crcs[lo:hi], pa.int64()), pa.array([x.astype(np.int64) if with_ids else None for x in each[lo:hi]], pa.list_(pa.int64()))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return read


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the manifest's files: (doc_id, start, n_tokens, ids_crc32, ids)."""
    return manifest.select("file", "crc32", "start").repartition(partitions(spark), "file") \
        .mapInArrow(_reader(folder, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")
