"""Operator 12: periodic runs of words by a dictionary of basic factors.

The words of a text are named by their rank; at level k equal names stand for equal factors of 2**k
words, made from the pairs of names of level k - 1. At every level an occurrence whose successor
lies within twice the factor's length, and whose successor's successor lies as far again, is part of an
arithmetic progression, which proposes its difference as a period. A run of period q and at least 4 q
words shows at the level with q <= 2**k < 2 q: its factors there recur after q words, not earlier.
Each progression's first place is extended to both sides by comparing names from the highest level
down, so an extension costs the logarithm of its length. Stretches found at several
levels, or under a multiple of their period, are one run: the smallest period of equal ends stays.

Factors that occur once in their document have no successor, and neither have longer ones around
them; they leave the dictionary, which therefore shrinks fast on ordinary prose. Names are
ranks of sorted pairs, not hashes: there is nothing to collide.

A text is handled whole in one task; a task holds the names of ``BLOCK`` bytes of texts at a time (of one
text if that is longer), 4 bytes a word and level. Nothing is shuffled.

Defined results: a null or empty text, or one of white space only, has no words and no runs; a null id is
kept; repeated rows are handled one by one; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has at least this many words and this many periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Bytes of text whose words are named together.
BLOCK = 4 << 20

SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "best struct<start:long,length:long,period:long>, collapsed string")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class BasicFactors:
    """Names of the factors of 1, 2, 4, ... symbols of texts that lie one after the other; a factor never
    crosses a text's end. ``levels[k][i]`` names the factor at ``i``, -1 where it occurs once or does not fit."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        self.n = len(symbols)
        self.levels: list[np.ndarray] = []
        self.proposals: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(self.n, dtype=np.int64)
        key = symbols.astype(np.int64)
        while len(at):
            at, names = self._level(at, key, 1 << len(self.levels))
            half = 1 << (len(self.levels) - 1)
            # a longer factor needs both halves in the dictionary, in the same text
            inside = at + 2 * half <= ends[at]
            at, first = at[inside], names[at[inside]]
            second = names[at + half]
            at, first, second = at[second >= 0], first[second >= 0], second[second >= 0]
            key = first.astype(np.int64) * (len(at) + self.n + 1) + second

    def _level(self, at: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        same = key[1:] == key[:-1]
        new = np.concatenate([[True], ~same])
        repeated = ~new
        repeated[:-1] |= same
        names = np.full(self.n, -1, np.int32)
        names[place[repeated]] = (np.cumsum(new) - 1)[repeated]
        step = np.zeros(self.n + 1, np.int64)  # distance to the successor, 0: none within reach
        gap = place[1:] - place[:-1]
        near = same & (gap <= 2 * length)
        step[place[:-1][near]] = gap[near]
        start = np.flatnonzero(step[:-1])
        d = step[start]
        progression = step[start + d] == d
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1] + 1) | (d[1:] != d[:-1]) | ~progression[:-1]
        chosen = progression & first
        self.levels.append(names)
        self.proposals.append((start[chosen], d[chosen]))
        return np.sort(place[repeated]), names

    def extend(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far equal symbols reach from ``left`` and ``right`` (> left): (backward, from the symbols before them,
        not below ``low``; forward, ``right`` staying under ``high``)."""
        forward, backward = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        # the longest factor as often as it fits, each shorter one at most once after it
        for k in range(len(self.levels) - 1, -1, -1):
            names, length = self.levels[k], 1 << k
            todo = np.arange(len(left))
            while len(todo):
                a, b = left[todo] + forward[todo], right[todo] + forward[todo]
                fits = b + length <= high[todo]
                todo, a, b = todo[fits], a[fits], b[fits]
                equal = (names[a] >= 0) & (names[a] == names[b])
                todo = todo[equal]
                forward[todo] += length
                if k < len(self.levels) - 1:
                    break
            todo = np.arange(len(left))
            while len(todo):
                a, b = left[todo] - backward[todo] - length, right[todo] - backward[todo] - length
                fits = a >= low[todo]
                todo, a, b = todo[fits], a[fits], b[fits]
                equal = (names[a] >= 0) & (names[a] == names[b])
                todo = todo[equal]
                backward[todo] += length
                if k < len(self.levels) - 1:
                    break
        return backward, forward


def find_runs(symbols: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs of texts given as symbols one after the other, ``sizes`` symbols
    each and no symbol in two texts; starts count from the first text. Ordered by start, then period."""
    close = np.cumsum(sizes)
    ends = np.repeat(close, sizes)
    begins = np.repeat(close - sizes, sizes)
    factors = BasicFactors(symbols, ends)
    start = np.concatenate([p[0] for p in factors.proposals] or [np.zeros(0, np.int64)])
    period = np.concatenate([p[1] for p in factors.proposals] or [np.zeros(0, np.int64)])
    if not len(start):
        return start, start, start
    back, ahead = factors.extend(start, start + period, begins[start], ends[start])
    first, length = start - back, back + ahead + period
    found = length >= np.maximum(min_words, min_periods * period)
    first, length, period = first[found], length[found], period[found]
    order = np.lexsort((period, length, first))
    first, length, period = first[order], length[order], period[order]
    once = np.ones(len(first), bool)
    once[1:] = (first[1:] != first[:-1]) | (length[1:] != length[:-1])
    first, length, period = first[once], length[once], period[once]
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _block(texts: list[bytes | None], min_words: int, min_periods: int) -> list[tuple]:
    """Per text: (number of words, its runs, its text without what the runs repeat)."""
    words = [(t or b"").split() for t in texts]  # bytes split at 0x20 and 0x09 to 0x0D
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    symbols, known = np.empty(int(sizes.sum()), np.int64), 0
    at = 0
    for w in words:
        names: dict[bytes, int] = {}
        symbols[at:at + len(w)] = [names.setdefault(x, len(names)) for x in w]
        symbols[at:at + len(w)] += known
        known += len(names)
        at += len(w)
    first, length, period = find_runs(symbols, sizes, min_words, min_periods)
    drop = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(drop, first + period, 1)
    np.add.at(drop, first + length, -1)
    keep = np.cumsum(drop[:-1]) == 0
    offsets = np.cumsum(sizes) - sizes
    cut = np.searchsorted(first, np.append(offsets, len(symbols)))
    out = []
    for i, w in enumerate(words):
        lo, at = offsets[i], slice(cut[i], cut[i + 1])
        runs = list(zip((first[at] - lo).tolist(), length[at].tolist(), period[at].tolist()))
        left = w if not runs else [x for x, k in zip(w, keep[lo:lo + len(w)].tolist()) if k]
        out.append((len(w), runs, b" ".join(left)))
    return out


def _finder(min_words: int, min_periods: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import blocks
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in blocks(texts, BLOCK):
                rows = _block(texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist(), min_words, min_periods)
                runs = [[dict(zip(("start", "length", "period"), r)) for r in x[1]] for x in rows]
                best = [dict(zip(("start", "length", "period"), b)) if (b := best_run(x[1])) else None for x in rows]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array([x[0] for x in rows], pa.int64()), pa.array(runs, pa.list_(_RUN)),
                    pa.array(best, _RUN), pa.array([x[2] for x in rows], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"])
    return find


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed): all runs of each text by start, then period; the run of the
    greatest exponent (null without runs); and the text's words, one space between them, without those that
    a run holds after its first period."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_finder(min_words, min_periods), SCHEMA)


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) in which the words of about every tenth text, chosen by the id's crc32, repeat from a
    place on with a period; the other texts are as they are. A null id is never chosen."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words: Column = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), g.alias("_g"),
                       F.when(h % 10 == 0, words).alias("_words"))
    n = F.size("_words")
    a = F.col("_g") % n
    p = F.lit(1) + F.floor((n - a) / (3 + F.col("_g") % 8))
    turns = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", (a + 1).cast("int"), p.cast("int")), turns)), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), a.cast("int")), tail), " ")
    return docs.select("doc_id", F.when(F.size("_words") > 0, text).otherwise(F.col("text")).alias("text"))


#: The same rows from the definition: for every distance q the stretches of words equal to the word q places on.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT],
                               lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1::BIGINT)))), 4294967295::BIGINT) AS h
  FROM documents),
sized AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM split),
placed AS (
  SELECT doc_id, ws, n, h % 10 = 0 AS chosen,
         CASE WHEN n > 0 THEN g % n ELSE 0 END AS a, 1 + (n - CASE WHEN n > 0 THEN g % n ELSE 0 END) // (3 + g % 8) AS p FROM sized),
w AS (
  SELECT doc_id, n, i, CASE WHEN chosen AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs),
per_doc AS (
  SELECT doc_id, count(*) AS n_runs, max(start) FILTER (place = 1) AS start, max(length) FILTER (place = 1) AS length,
         max(period) FILTER (place = 1) AS period,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM ranked GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS collapsed
  FROM w ANTI JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i GROUP BY w.doc_id)
SELECT s.doc_id, coalesce(r.n_runs, 0)::BIGINT AS n_runs, r.start::BIGINT AS start, r.length::BIGINT AS length, r.period::BIGINT AS period,
       (1000 * r.length // r.period)::BIGINT AS exponent_milli,
       sha256(coalesce(r.lines, '')) AS runs_sha256, sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM sized s LEFT JOIN per_doc r ON s.doc_id = r.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
