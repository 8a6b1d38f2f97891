"""Operator 11: two tokenizers' ids of the same bytes, aligned by composing fragments of byte ranges.

Both tokenizers (A: byte-level BPE, B: sentence pieces) read a space and the text. Where a token of A and one
of B end at the same byte, a group ends; a token of A and one of B whose byte ranges overlap are linked.

A byte range of a text, whatever its borders, yields a :class:`Fragment`: an open prefix (tokens up to the first
common end), closed groups, and an open suffix (tokens after the last common end); without a common end
it is open as a whole. A token belongs to the range that holds its last byte. Two neighbouring fragments compose
by closing the left one's suffix with the right one's prefix into one group. Composition is associative and the fragment of
no bytes is neutral, so the fragments of a very long text are made in different tasks and reduced as a
tree, ``FAN`` neighbours at a time. Texts up to ``CHUNK`` bytes are one range, many of them aligned at a time.

Tokens around a range's borders need some text beyond them: a range is read from the last place before it to the
first place behind it where a space other than the last byte follows a visible character. Neither
tokenizer merges across such a place. A border without one within half a chunk on both sides is left out, so the text read is
bounded by twice the text owned; a text without any such place is one range.

The distinct pairs of each row are written with its groups. How many rows hold a pair is summed over all rows
(:func:`link_support`), then looked up once per block of texts and pair, never once per row: a pair that stands
in every document costs one row a block.

Defined results: a null or empty text, or one whose joined token bytes of A or B differ from the space and the
text, has no tokens: zeros and ''. A null id is kept; rows that repeat an id or a text are documents of
their own; other columns are not read.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, save

#: Bytes of a range. Longer texts are cut into ranges of this size.
CHUNK = 32 << 10
#: Neighbouring fragments composed by one task at each level of the tree.
FAN = 8
#: Bytes of texts aligned together; their pairs are looked up together.
BLOCK = 4 << 20
#: Distinct pieces, and their bytes, that one Python worker remembers between batches.
REMEMBER = 400_000
REMEMBER_BYTES = 32 << 20
#: A pair of ids in one number: the id of A shifted by this many bits, and that of B.
BITS = 21

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


def safe_places(data: np.ndarray) -> np.ndarray:
    """Places of spaces that follow a visible character (ASCII, or U+00C0 to U+00FF), the last byte excluded."""
    before = _VISIBLE[data[:-1]]
    before[1:] |= data[:-2] == 0xC3
    places = np.flatnonzero(before & (data[1:] == 0x20)) + 1
    return places[places < len(data) - 1]


def distinct(*values: np.ndarray) -> np.ndarray:
    """The different values of all arrays, ascending."""
    v = np.sort(np.concatenate(values), kind="stable")  # a few ascending runs merge
    return v[np.concatenate([v[:1] == v[:1], v[1:] != v[:-1]])]


def _byte_chars() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the
    others for 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTokenizer:
    """Ids of A and B for texts that begin with a space. Texts are cut at their safe places; each distinct piece of
    a batch goes through both tokenizers once."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = _byte_chars()
        names = sorted(self.a.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (max(i for _, i in names) + 1)
        for name, i in names:
            self.a_bytes[i] = bytes(chars[c] for c in name) if all(c in chars for c in name) else b""
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_length = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_length = np.fromiter(map(len, self.b_bytes), np.int64)
        # every id followed by the sign after it in a list of groups
        self.signs = pa.array([f"{i}{s}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for s in (",", "|", ";", "")])
        self._forget()

    @staticmethod
    def _piece(name: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", name)
        return bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held = 0
        self.ok = np.zeros(0, bool)
        self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.first = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.flat = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def _number(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.place) + len(pieces) > REMEMBER or self.held > REMEMBER_BYTES:
            self._forget()
        new = [p for p in pieces if p not in self.place]
        if new:
            texts = [p.decode() for p in new]
            ids = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)],
                   self.b.encode([t[1:] for t in texts], num_threads=1))
            self.ok = np.concatenate([self.ok, [b"".join([self.a_bytes[i] for i in x]) == p == b"".join([self.b_bytes[i] for i in y])
                                                for p, x, y in zip(new, *ids)]])
            for k, lists in enumerate(ids):
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                self.first[k] = np.concatenate([self.first[k], len(self.flat[k]) + np.cumsum(size) - size])
                self.size[k] = np.concatenate([self.size[k], size])
                self.flat[k] = np.concatenate([self.flat[k], np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.held += sum(map(len, new))
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """((ids, number per text) of A and of B; per text whether both give its bytes back). Texts are not empty."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        cut = np.zeros(len(data) + 1, bool)
        cut[safe_places(data)] = True
        cut[ends[1:] - 1] = False  # a text's last byte is no cut, but its end is
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        raw = data.tobytes()
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        which = self._number(pieces.dictionary.to_pylist())[np.asarray(pieces.indices)]
        per_text = np.searchsorted(cuts, ends)
        bad = np.concatenate([[0], np.cumsum(~self.ok[which])])
        out = []
        for size, first, flat in zip(self.size, self.first, self.flat):
            n = size[which]
            at = np.concatenate([[0], np.cumsum(n)])
            out.append((flat[np.repeat(first[which] - at[:-1], n) + np.arange(at[-1])], np.diff(at[per_text])))
        return out, np.diff(bad[per_text]) == 0


_loaded: dict[tuple[str, str], PairTokenizer] = {}


def pair_tokenizer(a_path: str, b_path: str) -> PairTokenizer:
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = PairTokenizer(a_path, b_path)
    return _loaded[a_path, b_path]


@dataclass
class Tokens:
    """Ids and last bytes (exclusive) of neighbouring tokens of both kinds."""
    a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    a_end: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    b_end: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("a", "a_end", "b", "b_end")))

    def between(self, low: int, high: int) -> Tokens:
        """The tokens that end after ``low`` and not after ``high``."""
        x = slice(*np.searchsorted(self.a_end, (low, high), "right"))
        y = slice(*np.searchsorted(self.b_end, (low, high), "right"))
        return Tokens(self.a[x], self.a_end[x], self.b[y], self.b_end[y])


def close_groups(t: Tokens, ends: np.ndarray, signs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of stretches that end at ``ends``, each a common end: per stretch the text of its groups and their
    number; and (stretch, pair, links) for its distinct pairs."""
    common = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
    per = np.searchsorted(common, ends, "right")
    n_groups = np.diff(per, prepend=0)
    # where each group's tokens of A and B begin; the last number is their total
    a_first, b_first = (np.concatenate([[0], np.searchsorted(e, common, "right")]) for e in (t.a_end, t.b_end))
    group_a, group_b = np.searchsorted(common, t.a_end), np.searchsorted(common, t.b_end)
    listed = np.empty(len(t.a) + len(t.b), np.int32)
    sign = np.zeros(len(t.a), np.int32)
    sign[a_first[1:] - 1] = 1
    listed[np.arange(len(t.a)) + b_first[group_a]] = t.a * 4 + sign
    sign = np.zeros(len(t.b), np.int32)
    sign[b_first[1:] - 1] = 2
    sign[np.searchsorted(t.b_end, ends, "right")[n_groups > 0] - 1] = 3
    listed[np.arange(len(t.b)) + a_first[group_b + 1]] = t.b * 4 + sign
    strings = signs.take(pa.array(listed)).cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[: len(listed) + 1]
    borders = offsets[np.concatenate([[0], (a_first + b_first)[per]])]
    texts = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.ascontiguousarray(borders)), strings.buffers()[2] or pa.py_buffer(b""))
    # between two neighbouring ends of any kind lies one token of A and one of B
    piece = distinct(t.a_end, t.b_end)
    pair = (t.a[np.searchsorted(t.a_end, piece)].astype(np.int64) << BITS) | t.b[np.searchsorted(t.b_end, piece)]
    both = np.sort((np.searchsorted(ends, piece) << (2 * BITS)) | pair)
    first = np.flatnonzero(np.concatenate([both[:1] == both[:1], both[1:] != both[:-1]]))
    both, links = both[first], np.diff(first, append=len(both))
    return texts, n_groups, both >> (2 * BITS), both & ((1 << 2 * BITS) - 1), links


@dataclass
class Fragment:
    """What a byte range of a text is worth: see the module's head. Without a border all tokens are in ``prefix``."""
    border: bool = False
    prefix: Tokens = field(default_factory=Tokens)
    groups: list[str] = field(default_factory=list)
    n_groups: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    suffix: Tokens = field(default_factory=Tokens)

    @staticmethod
    def of(t: Tokens, signs: pa.Array) -> Fragment:
        common = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
        if not len(common):
            return Fragment(prefix=t)
        last = int(common[-1])
        out = Fragment(True, t.between(-1, int(common[0])), suffix=t.between(last, np.iinfo(np.int64).max))
        return out._closed(t.between(int(common[0]), last), signs)

    def _closed(self, t: Tokens, signs: pa.Array) -> Fragment:
        """With the groups of ``t``, the last of which ends with it, behind its own."""
        if len(t.a):
            texts, n, _, pairs, links = close_groups(t, t.a_end[-1:], signs)
            self.groups = [*self.groups, texts[0].as_py()]
            self.n_groups += int(n[0])
            self.pairs, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.links, links])
        return self

    def then(self, other: Fragment, signs: pa.Array) -> Fragment:
        """This range and the one behind it."""
        if not other.border:
            if not self.border:
                return Fragment(prefix=self.prefix + other.prefix)
            return Fragment(True, self.prefix, self.groups, self.n_groups, self.pairs, self.links, self.suffix + other.prefix)
        if not self.border:
            return Fragment(True, self.prefix + other.prefix, other.groups, other.n_groups, other.pairs, other.links, other.suffix)
        out = Fragment(True, self.prefix, self.groups, self.n_groups, self.pairs, self.links, other.suffix)
        out._closed(self.suffix + other.prefix, signs)
        out.groups = [*out.groups, *other.groups]
        out.n_groups += other.n_groups
        out.pairs, out.links = np.concatenate([out.pairs, other.pairs]), np.concatenate([out.links, other.links])
        return out

    def whole(self, signs: pa.Array) -> Fragment:
        """All groups closed: the fragment of a whole text, which begins and ends at a common border."""
        return Fragment(True).then(self, signs)

    def summed(self) -> Fragment:
        """Each pair once, its links added up."""
        self.pairs, at = np.unique(self.pairs, return_inverse=True)
        self.links = np.bincount(at, self.links, len(self.pairs)).astype(np.int64)
        return self


ROWS = ("rid long, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<long>")
RANGES = "rid long, doc_id long, seq int, low long, high long, at long, text binary"
_PARTS = ("prefix_a", "prefix_a_end", "prefix_b", "prefix_b_end", "suffix_a", "suffix_a_end", "suffix_b", "suffix_b_end")
FRAGMENTS = "rid long, doc_id long, seq int, ok boolean, border boolean, n_a long, n_b long, n_groups long, groups string, pairs array<long>, links array<long>, " \
    + ", ".join(f"{c} array<long>" for c in _PARTS)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _align_short(a_path: str, b_path: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import blocks
        tok = pair_tokenizer(a_path, b_path)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK):
                ids = batch.column(0).slice(lo, hi - lo)
                texts = batch.column(1).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                has = [i for i, t in enumerate(texts) if t]
                n_a, n_b, n_groups, n_links, n_pairs = np.zeros((5, len(texts)), np.int64)
                groups, pairs, links = [""] * len(texts), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if has:
                    spaced = [b" " + texts[i] for i in has]
                    ((a, a_n), (b, b_n)), ok = tok.encode(spaced)
                    good = np.flatnonzero(ok)
                    a, b = a[np.repeat(ok, a_n)], b[np.repeat(ok, b_n)]
                    if len(good):
                        ends = np.cumsum(np.fromiter((len(spaced[i]) for i in good), np.int64))
                        t = Tokens(a, np.cumsum(tok.a_length[a]), b, np.cumsum(tok.b_length[b]))
                        closed, count, where, pairs, links = close_groups(t, ends, tok.signs)
                        rows = np.array(has)[good]
                        n_a[rows], n_b[rows], n_groups[rows] = a_n[good], b_n[good], count
                        n_pairs[rows] = np.bincount(where, minlength=len(good))
                        n_links[rows] = np.bincount(where, links, len(good)).astype(np.int64)
                        for i, g in zip(rows.tolist(), closed.to_pylist()):
                            groups[i] = g
                rid = (number + np.arange(len(texts))) * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), pa.array(np.full(len(texts), number * 2)), ids, *map(pa.array, (n_a, n_b, n_groups, n_links)),
                     pa.array(groups, pa.string()), _lists(pairs, n_pairs), _lists(links, n_pairs)],
                    names=["rid", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "links"])
                number += len(texts)
    return align


def cut_ranges(spaced: bytes, chunk: int) -> list[tuple[int, int, int, bytes]]:
    """(low, high, at, bytes to read from ``at``) of the ranges of a text with its space."""
    data = np.frombuffer(spaced, np.uint8)
    safe = np.concatenate([[0], safe_places(data), [len(data)]])
    border = np.arange(chunk, len(data), chunk)
    left = safe[np.searchsorted(safe, border, "right") - 1]
    right = safe[np.searchsorted(safe, border, "left")]
    near = (border - left <= chunk // 2) & (right - border <= chunk // 2)
    edges = [0, *border[near].tolist(), len(data)]
    starts, stops = [0, *left[near].tolist()], [*right[near].tolist(), len(data)]
    return [(lo, hi, s, spaced[s:e]) for lo, hi, s, e in zip(edges, edges[1:], starts, stops)]


def _cut_long(chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ranges = cut_ranges(b" " + text.as_py(), chunk)
                rid = number * 2 + 1
                number += 1
                for k in range(0, len(ranges), 64):
                    part = ranges[k:k + 64]
                    cols = ([rid] * len(part), [doc] * len(part), range(k, k + len(part)), *zip(*part))
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["rid", "doc_id", "seq", "low", "high", "at", "text"])
    return cut


def _rows(items: list[tuple]) -> pa.RecordBatch:
    """Fragment rows: (rid, doc_id, seq, ok, n_a, n_b, fragment)."""
    out = {c: [] for c in ("rid", "doc_id", "seq", "ok", "border", "n_a", "n_b", "n_groups", "groups", "pairs", "links", *_PARTS)}
    for rid, doc, seq, ok, n_a, n_b, f in items:
        f = f.summed()
        values = [rid, doc, seq, ok, f.border, n_a, n_b, f.n_groups, ";".join(f.groups), f.pairs, f.links]
        values += [getattr(t, c) for t in (f.prefix, f.suffix) for c in ("a", "a_end", "b", "b_end")]
        for c, v in zip(out, values):
            out[c].append(v)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int64()] * 3, pa.string(), *[pa.list_(pa.int64())] * (2 + len(_PARTS))]
    return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int64) if isinstance(x, np.ndarray) else x for x in v], t) for v, t in zip(out.values(), kinds)], names=list(out))


def _fragments(a_path: str, b_path: str):
    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pair_tokenizer(a_path, b_path)
        for batch in batches:
            for row in batch.to_pylist():
                ((a, _), (b, _)), ok = tok.encode([row["text"]])
                if not ok[0]:
                    yield _rows([(row["rid"], row["doc_id"], row["seq"], False, 0, 0, Fragment())])
                    continue
                t = Tokens(a, row["at"] + np.cumsum(tok.a_length[a]), b, row["at"] + np.cumsum(tok.b_length[b])).between(row["low"], row["high"])
                yield _rows([(row["rid"], row["doc_id"], row["seq"], True, len(t.a), len(t.b), Fragment.of(t, tok.signs))])
    return fragments


def _fragment(row: dict) -> Fragment:
    p = [np.array(row[c], np.int64) for c in _PARTS]
    return Fragment(row["border"], Tokens(*p[:4]), [row["groups"]] if row["n_groups"] else [], row["n_groups"],
                    np.array(row["pairs"], np.int64), np.array(row["links"], np.int64), Tokens(*p[4:]))


def _compose(a_path: str, b_path: str, last: bool):
    def compose(table: pa.Table) -> pa.Table:
        signs = pair_tokenizer(a_path, b_path).signs
        rows = sorted(table.drop(["parent"]).to_pylist(), key=lambda r: r["seq"])
        ok = all(r["ok"] for r in rows)
        whole = Fragment()
        for r in rows if ok else []:
            whole = whole.then(_fragment(r), signs)
        if last and ok:
            whole = whole.whole(signs)
        n_a, n_b = (sum(r[c] for r in rows) if ok else 0 for c in ("n_a", "n_b"))
        return pa.Table.from_batches([_rows([(rows[0]["rid"], rows[0]["doc_id"], rows[0]["seq"] // FAN, ok, n_a, n_b, whole)])])
    return compose


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A written table with a row for every document: (rid, block, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, links).

    ``rid`` tells rows apart; ``block`` names the texts aligned together; ``groups`` is ``a1,a2|b1;a3|b2,b3``;
    ``pairs`` are the distinct linked id pairs (id of A << BITS | id of B), ``links`` how often each is linked.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) >= chunk
    short = save(docs.where(~is_long).mapInArrow(_align_short(a_path, b_path), ROWS), "aligned-short")
    ranges = save(docs.where(is_long).mapInArrow(_cut_long(chunk), RANGES), "aligned-ranges")
    left = (ranges.agg(F.max("seq")).first()[0] or 0) + 1
    # the ranges of one text go to different tasks
    parts = ranges.repartition(partitions(spark), "rid", "seq").mapInArrow(_fragments(a_path, b_path), FRAGMENTS)
    while True:
        last = left <= FAN
        parts = parts.withColumn("parent", F.expr(f"seq div {FAN}")).groupBy("rid", "parent").applyInArrow(_compose(a_path, b_path, last), FRAGMENTS)
        left = -(-left // FAN)
        if last:
            break
    long = save(parts.select("rid", F.col("rid").alias("block"), "doc_id", "n_a", "n_b", "n_groups",
                             F.aggregate("links", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_links"), "groups", "pairs", "links"), "aligned-long")
    forget(ranges)
    return short.unionByName(long)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(block, pair, n) for the distinct pairs of every block: n rows of the block hold the pair."""
    return aligned.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n"))


def _support(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over each row's pairs, looked up in its block's counts."""
    key, count, best = (np.asarray(right[c].combine_chunks()) for c in ("pair", "count", "best"))
    order = np.argsort(key)
    key, count, best = key[order], count[order], best[order].astype(np.int64)
    pairs = left["pairs"].combine_chunks()
    links = np.asarray(left["links"].combine_chunks().flatten())
    at = np.searchsorted(key, np.asarray(pairs.flatten()))
    size = np.asarray(pc.list_value_length(pairs)).astype(np.int64)  # at least 1
    first = np.cumsum(size) - size
    n_best, count_sum = np.add.reduceat(links * best[at], first), np.add.reduceat(links * count[at], first)
    return pa.table({"rid": left["rid"], "n_best": pa.array(n_best), "count_sum": pa.array(count_sum)})


def link_support(aligned: DataFrame) -> DataFrame:
    """(rid, n_best, count_sum) of the rows with links: links whose pair is held by as many rows as any pair of
    its id of A, and the sum over links of the rows that hold their pair."""
    asked = save(pair_counts(aligned), "aligned-pairs")
    total = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    total = save(total.withColumn("a", F.shiftright("pair", BITS)), "aligned-totals")
    highest = total.groupBy("a").agg(F.max("count").alias("highest"))
    told = total.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = asked.select("block", "pair").join(told, "pair").select("block", "pair", "count", "best")
    rows = aligned.where("n_links > 0").select("block", "rid", "pairs", "links")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_support, "rid long, n_best long, count_sum long")
