"""Operator 13: near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest of ``m`` reference points (pivots), nearest first. Vectors
at a cosine of 0.9 or more see the reference points in nearly the same order, so two vectors are candidates if
they share at least ``SHARED`` of those pivots. An inverted list per pivot brings candidates together; inside
it the pivots that two vectors share are counted, the pairs with enough of them are verified by their exact
cosine in double precision, and only then count as a link.

* Pivots come from a bounded sample: of the vectors with the ``SAMPLE`` * m smallest id hashes, m at most
  (``MAX_PIVOTS`` ever), each at a cosine under ``SPREAD`` to all chosen before. A group of near copies therefore
  gives one pivot or two, however many rows it holds. m grows with the number of distinct vectors until
  ``MAX_PIVOTS``. The sample only places the lists; every vector is indexed.
* Pivots are ordered by the length of their lists, shortest first. Two sets that share ``SHARED`` of ``PREFIX``
  pivots share one of the first PREFIX - SHARED + 1 of each, so a vector goes to those lists only, and a
  pair counts in the list of the first pivot it shares: once, in whatever lists it meets.
* Equal vectors are one entry with a number of copies; their links among themselves are counted, not formed.
* A list longer than ``CHUNK`` is dealt to chunks by id hash, and each pair of chunks is a group of its own: no group
  holds more than about two chunks, whatever a pivot attracts. Work in a list grows with the square of its distinct
  vectors, pairs never leave the task: a group returns per vector its number of links and one edge to
  the smallest vector of its part of the group.

Recall against brute force (tests/llm/test_pivots.py; queries: ids divisible by 20) is 0.9 at least also for pairs placed
exactly at the threshold; no pair under it is ever linked.

Defined results: a vector that is null, empty, all zero, or holds null or non-finite components links with
nothing; neither does one whose length is not the most frequent one (ties: the greatest). A row with a null id
links with nothing and has no component. Rows that repeat an id are one node of the components, and each counts
as a partner of its own. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save
from .components import components

COSINE = 0.9
#: Pivots that describe a vector, and how many two linked vectors must share.
PREFIX = 8
SHARED = 2
#: Distinct vectors for each pivot, and the bounds of the number of pivots.
PER_PIVOT = 200
MIN_PIVOTS = 64
MAX_PIVOTS = 2048
#: Sampled vectors for each pivot, and the cosine that two pivots stay under.
SAMPLE = 4
SPREAD = 0.8
#: Entries of a list that one group compares with as many others.
CHUNK = 2048
#: Pairs verified at a time.
PAIRS = 1 << 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; scaled by their largest component first, so that no square
    overflows or vanishes."""
    v = vectors.astype(np.float64)
    if not v.size:
        return v
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length without nulls as a matrix."""
    flat = column.flatten()
    return np.asarray(flat).reshape(len(column), len(flat) // max(1, len(column)))


def _valid(col: str):
    """The column where it is a usable vector, null otherwise."""
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite & F.exists(v, lambda x: x != 0), v)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(1)
        # + 0.0 makes -0.0 and 0.0 one value
        key = pa.array([hashlib.sha256((np.asarray(v.values) + 0.0).tobytes()).digest() if v.is_valid else None for v in vectors], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, key], names=["vec_id", "v", "key"])


def choose_pivots(vectors: np.ndarray, m: int, spread: float = SPREAD) -> np.ndarray:
    """At most ``m`` of the unit vectors, in order, each under the cosine ``spread`` to those before."""
    chosen = np.empty((0, vectors.shape[1]))
    for v in vectors:
        if len(chosen) == m:
            break
        if not len(chosen) or (chosen @ v).max() < spread:
            chosen = np.vstack([chosen, v])
    return chosen


def _nearest(pivots: np.ndarray, prefix: int):
    """Every entry's ``prefix`` nearest pivots, nearest first."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = -(unit(_matrix(batch.column("v"))) @ pivots.T)
            k = min(prefix, near.shape[1])
            top = np.argpartition(near, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, k), pa.int32()), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "pivots"])
    return describe


def _post(rank: np.ndarray, chunks: np.ndarray, shared: int):
    """Entries dealt to the lists of their first pivots in the global order, and there to all pairs of chunks
    that hold theirs."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = np.sort(rank[_matrix(batch.column("pivots"))], axis=1).astype(np.int32)
            digest = np.asarray(batch.column("h"))
            which, lists, lows, highs, own = [], [], [], [], []
            for j in range(max(1, ranks.shape[1] - shared + 1)):
                n = chunks[ranks[:, j]]
                mine = digest % n
                for other in range(int(n.max())):
                    at = np.flatnonzero(other < n)
                    which.append(at)
                    lists.append(ranks[at, j])
                    lows.append(np.minimum(mine[at], other))
                    highs.append(np.maximum(mine[at], other))
                    own.append(mine[at])
            which = np.concatenate(which)
            taken = batch.take(pa.array(which))
            sets = pa.ListArray.from_arrays(pa.array(np.arange(0, ranks.size + 1, ranks.shape[1]), pa.int32()), pa.array(ranks.ravel())).take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int32)) for x in (lists, lows, highs, own)]
                + [taken.column(c) for c in ("rid", "node", "copies", "v")] + [sets],
                names=["list", "low", "high", "own", "rid", "node", "copies", "v", "ranks"])
    return post


def _meet(cosine: float, shared: int):
    """The links that one pair of chunks of a list owns: per entry their number and the smallest entry reached."""
    def meet(key: tuple, table: pa.Table) -> pa.Table:
        pivot, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        own = np.asarray(table["own"].combine_chunks())
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        ranks = _matrix(table["ranks"].combine_chunks())
        vectors = unit(_matrix(table["v"].combine_chunks()))
        copies = np.asarray(table["copies"].combine_chunks())
        count = np.zeros((len(a), len(b)), np.uint8)  # shared pivots after this one
        earlier = np.zeros((len(a), len(b)), bool)  # a shared pivot before this one owns the pair
        left, right = _places(ranks[a]), _places(ranks[b])
        for r in left.keys() & right.keys():
            if r < pivot:
                earlier[np.ix_(left[r], right[r])] = True
            elif r > pivot:
                count[np.ix_(left[r], right[r])] += 1
        candidate = (count >= shared - 1) & ~earlier
        if low == high:
            candidate = np.triu(candidate, 1)
        i, j = np.nonzero(candidate)
        kept = np.zeros(len(i), bool)
        for lo in range(0, len(i), PAIRS):
            at = slice(lo, lo + PAIRS)
            kept[at] = np.einsum("ij,ij->i", vectors[a[i[at]]], vectors[b[j[at]]]) >= cosine
        i, j = a[i[kept]], b[j[kept]]
        links = np.bincount(i, copies[j], len(own)) + np.bincount(j, copies[i], len(own))
        node = np.asarray(table["node"].combine_chunks())
        least = node.copy()
        while len(i):  # each vector's smallest id in its part of this group
            before = least.copy()
            np.minimum.at(least, i, before[j])
            np.minimum.at(least, j, before[i])
            if (least == before).all():
                break
        linked = np.flatnonzero(links)
        return pa.table({"rid": table["rid"].combine_chunks().take(pa.array(linked)), "links": pa.array(links[linked].astype(np.int64)),
                         "node": pa.array(node[linked]), "least": pa.array(least[linked])})
    return meet


def _places(ranks: np.ndarray) -> dict[int, np.ndarray]:
    """Rows that hold each pivot."""
    order = np.argsort(ranks.ravel(), kind="stable")
    values, first = np.unique(ranks.ravel()[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order // ranks.shape[1], first[1:])))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 prefix: int = PREFIX, shared: int = SHARED, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: the number of other rows linked directly, the smallest
    id reachable by links (the row's own without any), and whether that is the row's own."""
    element = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    rows = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), _valid("v")).alias("v"))
    common = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    rows = rows.withColumn("v", F.when(F.size("v") == common["d"], F.col("v")))
    keyed = rows.mapInArrow(_digest, f"vec_id long, v array<{element}>, key binary")
    entries = save(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
                   .withColumn("rid", F.monotonically_increasing_id()), "pivot-entries")
    m = min(max_pivots, max(MIN_PIVOTS, 1 << (entries.count() // PER_PIVOT).bit_length()))
    sample = entries.orderBy(F.xxhash64("node", F.lit(13)), "key").limit(SAMPLE * m).select("v").toPandas()  # at most SAMPLE * MAX_PIVOTS rows
    pivots = choose_pivots(unit(np.array(sample["v"].tolist())), m)
    described = save(entries.mapInArrow(_nearest(pivots, prefix), f"{_fields(entries)}, pivots array<int>"), "pivot-lists")
    # one number a pivot
    size = dict(described.select(F.explode("pivots").alias("p")).groupBy("p").count().collect())
    order = sorted(range(len(pivots)), key=lambda p: (size.get(p, 0), p))
    rank = np.empty(len(pivots), np.int64)
    rank[order] = np.arange(len(pivots))
    chunks = np.array([1 + size.get(p, 0) // CHUNK for p in order], np.int64)
    posted = described.withColumn("h", F.pmod(F.xxhash64("rid"), F.lit(1 << 40))).mapInArrow(
        _post(rank, chunks, min(shared, prefix)), f"list int, low int, high int, own int, rid long, node long, copies long, v array<{element}>, ranks array<int>")
    met = save(posted.groupBy("list", "low", "high").applyInArrow(_meet(cosine, shared), "rid long, links long, node long, least long"), "pivot-met")
    links = met.groupBy("rid").agg(F.sum("links").alias("links"))
    parts = components(met.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    told = entries.select("key", "rid", "node", "copies").join(links, "rid", "left").join(parts, "node", "left") \
        .select(F.col("key").alias("_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("_least"))
    told = save(told, "pivot-told")
    forget(described, met)
    least = F.least("_least", "vec_id")
    return keyed.select("vec_id", "key").join(told, F.col("key") == F.col("_key"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"),
        F.coalesce(least == F.col("vec_id"), F.lit(False)).alias("kept"))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


#: Brute force: every pair of vectors, components by walking to smaller ids until nothing changes.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n_links FROM linked GROUP BY a) n ON e.vec_id = n.a
LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON e.vec_id = r.a
"""
