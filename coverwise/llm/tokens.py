"""Token ids of whole texts, by the public tokenizers' own library.

A text is cut before white space that follows a visible character. The
tokenizers used here never merge across such a place, so the ids of the text are the ids of
its pieces in order. Each distinct piece of a batch goes through the tokenizer once and
its ids are then gathered for all its occurrences; natural text repeats its words.

A tokenizer that drops white space and looks at words, digits and signs apart (``WORD_PATTERN``) is given smaller pieces, in lower
case where that is what it would make of them: see :class:`WordTokenizer`.
"""
from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Distinct pieces remembered between batches by one Python worker.
REMEMBER = 1_200_000
#: Pieces that go through the tokenizer as one text.
JOIN = 200
#: Bytes of text handled at a time.
BLOCK = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True


class PieceTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # pieces are encoded many at a time, around a separator that is always one id of its own
        lines = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.joint, self.banned = ("\n", "\n") if len(lines) == 1 else (" 0 ", "0")
        self.mark = self.tokenizer.encode(self.banned, add_special_tokens=False).ids[0]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}  # piece -> its number in the arrays below
        self.flat, self.size, self.first = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _number(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces, after the new ones among them went through the tokenizer."""
        if len(self.place) + len(pieces) > REMEMBER:
            self._forget()
        place = self.place
        new = [p for p in pieces if p not in place]
        if new:
            plain = [p for p in new if self.banned not in p and not p[-1].isspace()]
            size, flat = self._encode(plain)
            if len(plain) < len(new):
                chosen = set(plain)
                odd = [p for p in new if p not in chosen]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
                size = np.concatenate([size, np.fromiter(map(len, ids), np.int32, len(ids))])
                flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
                plain += odd
            n = len(place)
            place.update(zip(plain, range(n, n + len(plain))))
            self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(place.__getitem__, pieces), np.int32, len(pieces))

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids) of pieces without the separator and without trailing space."""
        joined = [self.joint.join(pieces[i:i + JOIN]) for i in range(0, len(pieces), JOIN)]
        size, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
        # a few at a time: their encodings are freed before the next are made
        encoded = chain.from_iterable(self.tokenizer.encode_batch_fast(joined[k:k + 8], add_special_tokens=False) for k in range(0, len(joined), 8))
        for i, e in enumerate(encoded):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            edges = np.concatenate([[-1], marks, [len(ids)]])
            if len(edges) - 1 != len(pieces[i * JOIN:(i + 1) * JOIN]):
                raise AssertionError("the separator did not stay a token of its own")
            size.append((np.diff(edges) - 1).astype(np.int32))
            flat.append(np.delete(ids, marks))
        return np.concatenate(size), np.concatenate(flat)

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes to encode, where pieces start); texts start pieces whatever this says."""
        visible = _VISIBLE[data[:-1]]
        visible[1:] |= data[:-2] == 0xC3  # the second byte of U+00C0 to U+00FF
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = _SPACE[data[1:]] & visible
        return data, start

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null is empty."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        ends = offsets - offsets[0]
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data, start = self._cut(data)
        start[ends] = True
        bounds = np.flatnonzero(start)
        starts = bounds[:-1]
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        which = self._number(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        n = self.size[which]
        at = np.cumsum(n, dtype=np.int64)
        total = int(at[-1])
        shift = self.first[which] - (at - n)
        out = self.flat[np.repeat(shift, n) + np.arange(total)]
        per = np.concatenate([[0], at])[np.searchsorted(starts, ends)]
        return out, np.diff(per)


#: Splits words from digits and signs, single digits from each other, and keeps no white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

_OTHER, _LETTER, _DIGIT, _SIGN, _QUOTE, _BLANK = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _QUOTE
_KIND[[*range(0x09, 0x0E), 0x20]] = _BLANK
#: Whether a piece starts between bytes of two kinds. A quote may go with letters after it ('s, 't).
_EDGE = np.zeros((6, 6), bool)
_EDGE[1:, 1:] = ~np.eye(5, dtype=bool)
_EDGE[_DIGIT, _DIGIT] = True
_EDGE[_QUOTE, [_LETTER, _SIGN]] = _EDGE[_SIGN, _QUOTE] = False
_EDGE[_BLANK, _OTHER] = _EDGE[_OTHER, _BLANK] = True
_EDGE = _EDGE.reshape(-1)


class WordTokenizer(PieceTokenizer):
    """For tokenizers with ``WORD_PATTERN`` after NFC and lower case.

    Texts are cut where ASCII and U+00C0 to U+00FF change between letters, digits, signs and white space: there the pattern cuts
    whatever stands around, and composition (NFC) reaches no further. A letter becomes lower case here unless
    a character that may compose with it follows. Pieces of such letters alone need neither normalizer nor pattern and go to
    the tokenizer's model through a plain split at spaces; all others go through the whole tokenizer."""

    def __init__(self, path: str, parts: dict):
        super().__init__(path)
        from tokenizers import Tokenizer, models, pre_tokenizers
        m = parts["model"]
        # pieces come here once: a cache of theirs would only be filled
        model = models.BPE(m["vocab"], [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]], cache_capacity=0,
                           end_of_word_suffix=m["end_of_word_suffix"])
        self.tokenizer.model = model
        self.plain = Tokenizer(model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch

    @staticmethod
    def fits(parts: dict) -> bool:
        """Whether the tokenizer of this file (read as JSON) may be cut so."""
        m, norm, pre = parts["model"], parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
        split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        return (norm.get("normalizers") == _NORMAL and pre.get("pretokenizers") == [split, _BYTES] and m["type"] == "BPE" and "0" in m["vocab"]
                and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
                and bool(m.get("end_of_word_suffix")))

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, follows = _KIND.take(data), np.append(data[1:], np.uint8(0))
        upper = (data - np.uint8(0x41) < 26) & ((follows < 0x80) | (follows == 0xC3))
        lead = np.flatnonzero(data[:-1] == 0xC3)
        low = data[lead + 1]
        kind[lead] = kind[lead + 1] = np.where((low == 0x97) | (low == 0xB7), _OTHER, _LETTER)
        after = follows[lead + 1]
        upper[lead + 1] = (low < 0x9F) & (low != 0x97) & ((after < 0x80) | (after == 0xC3))
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = _EDGE.take(kind[:-1] * np.uint8(6) + kind[1:])
        return data + (upper.view(np.uint8) << np.uint8(5)), start

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As above; words of plain letters take the shorter way."""
        plain = np.fromiter((self.letters(p) is not None for p in pieces), bool, len(pieces))
        whole = self.tokenizer
        size, flat = np.zeros(len(pieces), np.int32), []
        try:
            for chosen, tokenizer in ((plain, self.plain), (~plain, whole)):
                self.tokenizer = tokenizer
                n, ids = super()._encode([pieces[i] for i in np.flatnonzero(chosen).tolist()])
                size[chosen] = n
                flat.append((np.flatnonzero(chosen), n, ids))
        finally:
            self.tokenizer = whole
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        for which, n, ids in flat:
            out[np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return size, out


def blocks(texts: pa.Array, limit: int = BLOCK):
    """(from, to) ranges of rows with at most ``limit`` bytes of text each, one row at least."""
    if len(texts) == 0:
        return
    size = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64)
    total, lo = 0, 0
    for i, n in enumerate(size):
        if i > lo and total + n > limit:
            yield lo, i
            total, lo = 0, i
        total += n
    yield lo, len(size)


_loaded: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer per file and Python worker; what it remembers serves later tasks too."""
    if path not in _loaded:
        with open(path, "rb") as f:
            parts = json.load(f)
        _loaded[path] = WordTokenizer(path, parts) if WordTokenizer.fits(parts) else PieceTokenizer(path)
    return _loaded[path]
