"""Language identification with interpolated Kneser-Ney character models.

One character model per language, learned from the labelled rows:

* text is lower-cased, everything but letters becomes one space, and n-grams of
  ``ORDER`` characters are counted over all whole training texts (each task sums its
  own texts before the shuffle);
* Kneser-Ney: the highest order uses counts, lower orders use the number of distinct
  characters an n-gram continues, each order is interpolated with the next lower one,
  down to a uniform distribution;
* each order is a Spark table of all counted n-grams, made from the one above and below it
  by aggregations and joins. The log-probability of a character is a sum of independent
  terms, one per order: what an n-gram adds over its back-off, and the back-off weight of
  a context. The terms are hashed (64 bits) and broadcast in sorted parts of ``PART`` terms;
  a part is looked up on its own and the sums add up, so no part needs another one.

A text's language is the one of lowest cross-entropy per character. ``score`` is
the posterior share of that language when the cross-entropy difference is weighed by
at most ``EVIDENCE`` characters (0 to 1). Rejection is calibrated on the training
rows: a text is rejected when its cross-entropy per character exceeds that of
``1 - REJECT_SHARE`` of the training texts of the predicted language by more than
``MARGIN`` (short texts, below ``MIN_LETTERS`` characters, are never judged by it),
or when it has no letter.

Defined results: a null text or a text without a letter is ``und`` with score 0 and
is rejected; rows with a null language are never learned from; a language whose rows
have no letter is not learned; with no training row at all every text is ``und`` and rejected; ties go to the
language first in the alphabet; ids may be null or repeated; only the named
columns are read. Every n-gram of a training text is in the model, however many there are;
where it has several parts, a worker holds one at a time.
"""
from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, save, tidy
from .tokens import blocks

ORDER = 4
DISCOUNT = 0.75
PART = 2_000_000
KNOWN = 1 << 20
EVIDENCE = 200
MIN_LETTERS = 40
REJECT_SHARE = 0.001
MARGIN = 1.0
BLOCK = 2 << 20

_tables: dict[str, np.ndarray] = {}


def _letter_table(categories: str = "LM") -> np.ndarray:
    """Code point -> whether its Unicode general category is one of these: letters and marks, which models read."""
    if categories not in _tables:
        _tables[categories] = np.fromiter((unicodedata.category(chr(c))[0] in categories for c in range(0x110000)), bool, 0x110000)
    return _tables[categories]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, text number of each): lower case, letters, single spaces; every
    text starts and ends with a space. Texts without a letter have no characters."""
    strings = [(x or "").lower() for x in texts.to_pylist()]
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 2
    points = np.frombuffer((" " + "  ".join(strings) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if strings else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(strings)), size)
    letter = _letter_table()[points]
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    if len(points):
        keep[1:] = letter[1:] | letter[:-1] | (doc[1:] != doc[:-1])
    points, doc, letter = points[keep], doc[keep], letter[keep]
    has = np.zeros(len(strings), bool)
    has[doc[letter]] = True
    keep = has[doc]
    return points[keep], doc[keep]


#: A character is at most 21 bits, so three exact characters fit; the fourth is mixed in by multiplication.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashes(points: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of the ``order`` characters that end at each place (the first ones wrap and must be masked)."""
    h = np.full(len(points), np.uint64(order), np.uint64)
    p = points.astype(np.uint64)
    for k in range(order - 1, -1, -1):
        x = p if k == 0 else np.concatenate([p[:k], p[:-k]]) if k < len(p) else p
        h = (h ^ x) * _STEP
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _counter(order: int, block: int):
    """mapInArrow function: (lang, text) -> (lang, gram, n), summed per task as far as memory is bounded."""
    def emit(lang, codes, n):
        text = codes.astype("<u4").tobytes()
        width = 4 * order
        grams = [text[i:i + width].decode("utf-32-le", "surrogatepass") for i in range(0, len(text), width)]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())],
                                          names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # lang -> (hash, characters, count) sorted by hash

        def add(lang, points, doc):
            if len(points) < order:
                return
            h = hashes(points, order)[order - 1:]
            ok = doc[order - 1:] == doc[:len(doc) - order + 1]
            at = np.flatnonzero(ok)
            u, first, n = np.unique(h[at], return_index=True, return_counts=True)
            grams = points[at[first][:, None] + np.arange(order)]
            if lang in held:
                u0, g0, n0 = held[lang]
                u, first, inverse = np.unique(np.concatenate([u0, u]), return_index=True, return_inverse=True)
                grams = np.concatenate([g0, grams])[first]
                n = np.bincount(inverse, np.concatenate([n0, n])).astype(np.int64)
            held[lang] = (u, grams, n)

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for lang in langs.unique().to_pylist():
                mine = texts.filter(pc.equal(langs, lang))
                for lo, hi in blocks(mine, block):
                    add(lang, *characters(mine.slice(lo, hi - lo)))
                    if lang in held and len(held[lang][0]) > 500_000:
                        u, g, n = held.pop(lang)
                        for i in range(0, len(n), 50_000):
                            yield emit(lang, g[i:i + 50_000], n[i:i + 50_000])
        for lang, (u, g, n) in held.items():
            for i in range(0, len(n), 50_000):
                yield emit(lang, g[i:i + 50_000], n[i:i + 50_000])
    return count


def count_ngrams(train: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all whole texts of the rows with a language."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(tidy(_counter(order, BLOCK)), "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


# ---------------------------------------------------------------- model

class HashArray:
    """Rows of numbers found by 64-bit hash: a sorted array with an index on the leading bits."""

    BITS = 18

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        edges = np.searchsorted(self.keys >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64))
        self.start = edges.astype(np.int32)
        self.longest = int(np.diff(edges).max()) if len(keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row number of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        lead = (h >> np.uint64(64 - self.BITS)).astype(np.int32)
        at, end = self.start[lead], self.start[lead + 1]
        left = np.arange(len(h))
        for _ in range(self.longest):
            inside = at < end
            left, at, end = left[inside], at[inside], end[inside]
            if not len(left):
                break
            hit = self.keys[at] == h[left]
            out[left[hit]] = at[hit]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out


GRAM, CONTEXT = 0, 1


def _term_key(h: np.ndarray, kind) -> np.ndarray:
    return np.where(kind == CONTEXT, ~h, h)


def model_part(keys: np.ndarray, langs: np.ndarray, values: np.ndarray) -> tuple[HashArray, np.ndarray, np.ndarray]:
    """(first and last place of each key, language numbers, values), the terms sorted by key."""
    order = np.argsort(keys, kind="stable")
    u, first = np.unique(keys[order], return_index=True)
    return HashArray(u, np.column_stack([first, np.append(first[1:], len(keys))[:len(u)]])), langs[order], values[order]


class Model:
    """Looks the log-probabilities of characters up in ``parts`` (objects whose ``value`` is a :func:`model_part`).

    The rows of the last ``KNOWN`` n-grams asked for are kept, so the parts are gone through for new ones only.
    """

    def __init__(self, langs: list[str], floor: float, parts: list, order: int = ORDER):
        self.langs, self.floor, self.parts, self.order = langs, floor, parts, order
        self.known = HashArray(np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32))

    def _windows(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        return points[np.maximum(at[:, None] + np.arange(1 - self.order, 1), 0)].reshape(-1)

    def _rows(self, points: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """[places, languages]: log P of the character at each place given the ``width - 1`` ones before it."""
        order, flat = self.order, self._windows(points, at)
        asks = []
        for k in range(1, order + 1):
            row = np.flatnonzero(width >= k)
            asks.append((row, _term_key(hashes(flat, k)[order - 1::order][row], GRAM)))
            if k > 1:  # the context ends one place before
                asks.append((row, _term_key(hashes(flat, k - 1)[order - 2::order][row], CONTEXT)))
        out = np.full((len(at), len(self.langs)), self.floor)
        for part in self.parts:
            table, langs, values = part.value
            for row, keys in asks:
                found = table.find(keys)
                hit = np.flatnonzero(found >= 0)
                first, end = table.rows[found[hit]].T
                n = end - first
                term = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                np.add.at(out, (np.repeat(row[hit], n), langs[term]), values[term])
            if len(self.parts) > 1 and hasattr(part, "_value"):
                del part._value  # a broadcast keeps what it has read
        return out.astype(np.float32)

    def log_probability(self, points: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """[characters, languages]: log P of each character given those before it in its text."""
        n, order = len(points), self.order
        if not n:
            return np.zeros((0, len(self.langs)), np.float32)
        new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        begin = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        keys = hashes(points, order)
        short = np.flatnonzero(begin < order - 1)  # fewer characters of the text lie before
        flat = self._windows(points, short)
        for k in range(1, order):
            mine = begin[short] == k - 1
            keys[short[mine]] = hashes(flat, k)[order - 1::order][mine]
        row = self.known.find(keys)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            u, first = np.unique(keys[miss], return_index=True)
            at = miss[first]
            rows = self._rows(points, at, np.minimum(begin[at] + 1, order))
            if len(self.known.keys) + len(u) > KNOWN:
                old = np.unique(row[row >= 0])
            else:
                old = np.arange(len(self.known.keys))
            self.known = HashArray(np.concatenate([self.known.keys[old], u]), np.concatenate([self.known.rows[old], rows]))
            row = self.known.find(keys)
        return self.known.rows[row]


def build_model(tables: dict[str, dict[str, int]], order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """The model of :func:`train` in plain Python, from the counts of the highest order per language."""
    langs = sorted(tables)
    vocabulary = len({c for t in tables.values() for g in t for c in g}) + 1
    found: list[tuple[int, str, int, float]] = []  # kind, characters, language, value
    letters, rests = set(), []
    for j, lang in enumerate(langs):
        counts = [tables[lang]]
        for _ in range(order - 1):
            below: dict[str, int] = {}
            for g in counts[0]:
                below[g[1:]] = below.get(g[1:], 0) + 1
            counts.insert(0, below)
        lower: dict[str, float] = {}
        for k, level in enumerate(counts, 1):
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for g, n in level.items():
                total[g[:-1]] = total.get(g[:-1], 0) + n
                kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
            rest = {c: discount * kinds[c] / total[c] for c in total}
            under = {g: lower[g[1:]] if k > 1 else 1 / vocabulary for g in level}  # every suffix of a counted n-gram is counted
            lower = {g: max(n - discount, 0) / total[g[:-1]] + rest[g[:-1]] * under[g] for g, n in level.items()}
            found += [(GRAM, g, j, math.log(p / rest[g[:-1]] / under[g])) for g, p in lower.items()]
            if k > 1:
                found += [(CONTEXT, c, j, math.log(r)) for c, r in rest.items()]
            else:
                letters.update(level)
                rests += [(j, math.log(r)) for r in rest.values()]
    found += [(GRAM, g, j, r) for g in letters for j, r in rests]
    keys = [_term_key(hashes(np.array([ord(c) for c in g], np.uint32), len(g))[-1:], kind)[0] for kind, g, _, _ in found]
    part = model_part(np.array(keys, np.uint64), np.array([x[2] for x in found], np.int32), np.array([x[3] for x in found]))
    return Model(langs, -math.log(vocabulary), [SimpleNamespace(value=part)], order)


def model_terms(counts: DataFrame, vocabulary: int, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, list[DataFrame]]:
    """(kind, lang, gram, value) of the model of all counts, and the tables to forget after it.

    An n-gram's value is the log of its probability over what backing off would give, a context's
    the log of its back-off weight. A character that another language knows is backed off to, too.
    """
    level = {order: counts}  # counts, then continuation counts
    for k in range(order - 1, 0, -1):
        level[k] = save(level[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"language-{k}-grams")
    out, made = [], [level[k] for k in range(1, order)]
    for k in range(1, order + 1):
        rest = level[k].groupBy("lang", F.substring("gram", 1, k - 1).alias("context")).agg(
            F.sum("n").alias("total"), (discount * F.count("*") / F.sum("n")).alias("rest"))
        t = level[k].withColumn("context", F.substring("gram", 1, k - 1)).join(F.broadcast(rest) if k == 1 else rest, ["lang", "context"])  # k = 1: one row per language
        if k == 1:
            t = t.withColumn("lower", F.lit(1 / vocabulary))
        else:
            t = t.withColumn("suffix", F.substring("gram", 2, k - 1)).join(made[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("lower")
        made.append(save(t.select("lang", "gram", "context", "rest", "lower", p.alias("p")), f"language-{k}-probabilities"))
        out.append(made[-1].select(F.lit(GRAM).alias("kind"), "lang", "gram", F.log(F.col("p") / F.col("rest") / F.col("lower")).alias("value")))
        if k == 1:
            every = made[-1].select("gram").distinct().crossJoin(F.broadcast(made[-1].select("lang", "rest").distinct()))  # one row per language
            out.append(every.select(F.lit(GRAM).alias("kind"), "lang", "gram", F.log("rest").alias("value")))
        else:
            out.append(rest.select(F.lit(CONTEXT).alias("kind"), "lang", F.col("context").alias("gram"), F.log("rest").alias("value")))
    terms = out[0]
    for t in out[1:]:
        terms = terms.unionByName(t)
    return terms, made


def _packer(langs: list[str]):
    """mapInArrow function: (kind, lang, gram, value) -> (keys, langs, values, n) as bytes of arrays."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs, pa.string())
        for batch in batches:
            kind, lang, gram, value = batch.columns
            size = pc.utf8_length(gram).to_numpy(zero_copy_only=False)
            strings = np.array(gram.to_pylist(), object)
            keys = np.zeros(batch.num_rows, np.uint64)
            for k in np.unique(size):
                points = np.frombuffer("".join(strings[size == k]).encode("utf-32-le"), np.uint32)
                keys[size == k] = hashes(points, int(k))[k - 1::k]
            keys = _term_key(keys, kind.to_numpy())
            number = pc.index_in(lang, names).to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, number, value.to_numpy())] + [pa.array([batch.num_rows], pa.int64())],
                                             names=["keys", "langs", "values", "n"])
    return pack


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> Model:
    """Count over all rows, make each order's table of all n-grams, broadcast their terms part by part."""
    context = rows.sparkSession.sparkContext
    counts = save(count_ngrams(rows, lang_col, text_col, order), "language-ngrams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # one row per language
    letters = F.explode(F.array(*[F.substring("gram", i, 1) for i in range(1, order + 1)]))
    vocabulary = counts.select(letters.alias("c")).distinct().count() + 1
    terms, made = model_terms(counts, vocabulary, order)
    packed = save(terms.repartition("gram").mapInArrow(tidy(_packer(langs)), "keys binary, langs binary, values binary, n long"), "language-terms")
    forget(counts, *made)
    parts, held, n = [], [], 0

    def close():
        part = model_part(*(np.frombuffer(b"".join(bytes(r[c]) for r in held), t) for c, t in (("keys", np.uint64), ("langs", np.int32), ("values", np.float64))))
        parts.append(context.broadcast(part))
        held.clear()

    for r in packed.toLocalIterator():
        if held and n + r["n"] > PART:
            close()
            n = 0
        held.append(r)
        n += r["n"]
    if held:
        close()
    forget(packed)
    return Model(langs, -math.log(vocabulary), parts, order)


# ---------------------------------------------------------------- prediction

def _predictor(langs: list[str], floor: float, parts: list):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(langs, floor, parts)
        ell = len(model.langs)
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            for lo, hi in blocks(texts, BLOCK):
                n = hi - lo
                points, doc = characters(texts.slice(lo, n))
                # marks alone are no letters
                letters = np.bincount(doc[_letter_table("L")[points]], minlength=n) if len(doc) else np.zeros(n, np.int64)
                total = np.zeros((n, max(ell, 1)))
                size = np.bincount(doc, minlength=n)
                if len(points) and ell:
                    lp = model.log_probability(points, doc)
                    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    total[doc[new]] = np.add.reduceat(lp.astype(np.float64), new, axis=0)
                entropy = -total / np.maximum(size, 1)[:, None]
                known = (letters > 0) & (ell > 0)
                best = entropy.argmin(axis=1)
                low = entropy.min(axis=1)
                weight = np.exp(-(entropy - low[:, None]) * np.minimum(size, EVIDENCE)[:, None])
                score = np.where(known, 1 / weight.sum(axis=1), 0.0)
                pred = [model.langs[b] if k else "und" for b, k in zip(best, known)] if ell else ["und"] * n
                rest = [batch.column(i).slice(lo, n) for i, c in enumerate(batch.schema.names) if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(np.where(known, low, 0.0), pa.float64()), pa.array(letters, pa.int64())],
                    names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "entropy", "n_letters"])
    return predict


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text leaves remainder 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             is_held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, entropy, n_letters) for every row.

    Learns from the rows that are not held out, then predicts from the text alone.
    """
    held = held_out(F.col(id_col)) if is_held_out is None else is_held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), held.alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    out = save(rows.select("doc_id", "held_out", "lang", "text").mapInArrow(
        tidy(_predictor(model.langs, model.floor, model.parts)), "doc_id long, held_out boolean, lang string, lang_pred string, score double, entropy double, n_letters long"),
        "language-predictions")
    limits = (out.where(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")) & (F.col("n_letters") >= MIN_LETTERS))
              .groupBy("lang_pred").agg(F.percentile_approx("entropy", 1 - REJECT_SHARE, 10_000).alias("limit")).collect())  # one row per language
    limit = F.lit(None).cast("double")
    for r in limits:
        limit = F.when(F.col("lang_pred") == r["lang_pred"], r["limit"] + MARGIN).otherwise(limit)
    rejected = (F.col("lang_pred") == "und") | (F.coalesce(F.col("entropy") > limit, F.lit(False)) & (F.col("n_letters") >= MIN_LETTERS))
    return out.select("doc_id", "held_out", "lang_pred", "score", rejected.alias("rejected"), "entropy", "n_letters")
