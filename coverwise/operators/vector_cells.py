"""Vector search over inverted cells (R7): approximate candidates, exact scores, all on joins.

Cells are the Voronoi cells of centres fitted by a few rounds of spherical k-means on a bounded sample: the ``SAMPLE``
rows with the smallest id hashes. Their number grows with the square root of the rows, up to ``MAX_CELLS``. Every
row is assigned: to its ``SPILL`` nearest cells, so that a neighbour just across a border is still met. A query visits
the nearest ``PROBE_SHARE`` of the cells; with ``exact`` it visits all and misses nothing.

Queries and rows meet by an equi-join on the cell, never on the driver. A cell with many rows or queries is dealt to a
grid of parts of at most about ``PART_ROWS`` x ``PART_QUERIES``, so no task holds a cell, however
crowded; a part returns the k best of each of its queries (one matrix product, in blocks of at most 64 MB). Scores
are exact cosines, ranked like ``vector_topk``.

How many neighbours a probe share finds depends on how clustered the vectors are: :func:`recall` measures it
against the exact search, tests hold the default above 0.9 on vectors with hardly any structure.
A vector that is null, holds null or non-finite values, is all zero, or is not as long as most rows' is similar to
nothing and left out on either side.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import retrieval as rt

SAMPLE = 8192
ROUNDS = 8
MIN_CELLS, MAX_CELLS = 8, 4096
SPILL = 2
PROBE_SHARE = 0.3
PART_ROWS, PART_QUERIES = 8192, 4096


@dataclass
class VectorCells:
    centres: np.ndarray    # at most MAX_CELLS unit vectors
    rows: DataFrame        # (cell, id, pos, vec): every usable row, in its nearest cells
    sizes: dict[int, int]  # rows of each cell


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _usable(vecs: DataFrame, dims: int | None = None) -> DataFrame:
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    out = vecs.where(ok)
    return out if dims is None else out.where(F.size("vec") == dims)


def fit_centres(sample: np.ndarray, n_cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its centre."""
    x = _unit(sample)
    centres = x[:n_cells].copy()  # the sample comes in hash order
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        long = np.linalg.norm(total, axis=1) > 1e-9
        centres[long] = _unit(total[long])
    return centres


def _to_cells(centres: np.ndarray, n: int, key: str, keep: list[str]):
    """Rows repeated for their ``n`` nearest cells."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _unit(_matrix(batch.column("vec"))) @ centres.T
            cells = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (batch.num_rows, 1))
            taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), *(taken.column(c) for c in [key, *keep])], names=["cell", key, *keep])
    return assign


def build_cells(doc_vecs: DataFrame, n_cells: int | None = None, spill: int = SPILL,
                vec_col: str = "vec", id_col: str = "id", pos_col: str = "pos") -> VectorCells | None:
    """Fit the cells and assign every row; the assignment is written once. None without usable rows."""
    docs = doc_vecs.select(F.col(id_col).cast("long").alias("id"), F.col(pos_col).cast("long").alias("pos"), F.col(vec_col).cast("array<double>").alias("vec"))
    docs = _usable(docs)
    common = docs.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    docs, n = _usable(docs, common["d"]), common["count"]
    sample = docs.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE).select("vec").toPandas()  # bounded
    c = n_cells or min(MAX_CELLS, max(MIN_CELLS, 1 << (n.bit_length() // 2 + 1)))
    centres = fit_centres(np.array(sample["vec"].tolist()), min(c, len(sample)))
    rows = docs.mapInArrow(_to_cells(centres, min(spill, len(centres)), "id", ["pos", "vec"]), "cell int, id long, pos long, vec array<double>")
    rows = materialize(rows, "vector-cells")
    return VectorCells(centres, rows, dict(rows.groupBy("cell").count().collect()))


def _parts(df: DataFrame, counts: dict[int, int], per_part: int, key: str, other: dict[int, int], other_part: int, mine: str, theirs: str) -> DataFrame:
    """Rows with the number of their part of the cell, repeated for every part of the other side."""
    def number(sizes: dict[int, int], part: int):
        many = {c: 1 + n // part for c, n in sizes.items() if n >= part}
        if not many:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("cell")), F.lit(1))  # at most MAX_CELLS entries

    own = F.pmod(F.xxhash64(key), number(counts, per_part)).cast("int")
    return df.select("*", own.alias(mine), F.explode(F.sequence(F.lit(0), number(other, other_part) - 1)).alias(theirs))


def _best(k: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k best rows (left) for each query (right) of a part."""
        left, right = left.combine_chunks(), right.combine_chunks()
        out = {"q_id": [], "id": [], "pos": [], "score_raw": []}
        if left.num_rows and right.num_rows:
            docs = _unit(_matrix(left["vec"].combine_chunks()))
            ids, pos = np.asarray(left["id"].combine_chunks()), np.asarray(left["pos"].combine_chunks())
            asked = _unit(_matrix(right["vec"].combine_chunks()))
            q_ids = np.asarray(right["q_id"].combine_chunks())
            kk, block = min(k, len(docs)), max(1, rt.PRODUCT_VALUES // len(docs))
            for lo in range(0, len(asked), block):
                sims = asked[lo:lo + block] @ docs.T
                at = np.concatenate([np.lexsort((pos, -row))[:kk] for row in np.round(sims, rt.RANK_DIGITS)])
                q = np.repeat(np.arange(len(sims)), kk)
                for c, v in zip(out, (q_ids[lo + q], ids[at], pos[at], sims[q, at])):
                    out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for (c, v), t in zip(out.items(), kinds)})
    return best


def cells_topk(query_vecs: DataFrame, cells: VectorCells, k: int, probe_share: float = PROBE_SHARE, exact: bool = False,
               q_col: str = "q_id", vec_col: str = "vec") -> DataFrame:
    """Top-k rows of every query by cosine: (q_id, rank, id, pos, score)."""
    n = len(cells.centres)
    probes = n if exact else min(n, max(1, int(np.ceil(n * probe_share))))
    asked = _usable(query_vecs.select(F.col(q_col).cast("long").alias("q_id"), F.col(vec_col).cast("array<double>").alias("vec")), cells.centres.shape[1])
    asked = materialize(asked.mapInArrow(_to_cells(cells.centres, probes, "q_id", ["vec"]), "cell int, q_id long, vec array<double>"), "probes")
    q_sizes = dict(asked.groupBy("cell").count().collect())  # at most MAX_CELLS rows
    rows = _parts(cells.rows, cells.sizes, PART_ROWS, "id", q_sizes, PART_QUERIES, "d_part", "q_part")
    asked = _parts(asked, q_sizes, PART_QUERIES, "q_id", cells.sizes, PART_ROWS, "q_part", "d_part")
    keys = ["cell", "d_part", "q_part"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_best(k), "q_id long, id long, pos long, score_raw double")
    once = found.groupBy("q_id", "id", "pos").agg(F.max("score_raw").alias("score_raw"))  # a row may be met in several cells
    return rt.rank_top_k(once, k).select("q_id", "rank", "id", "pos", F.round("score_raw", rt.OUT_DIGITS).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: (n_queries, wanted, hit, recall): how many of the exact rows were found, over the exact list's queries."""
    both = exact.select("q_id", "id").join(found.select("q_id", "id", F.lit(1).alias("_hit")), ["q_id", "id"], "left")
    return both.agg(F.countDistinct("q_id").alias("n_queries"), F.count("*").alias("wanted"), F.count("_hit").alias("hit")) \
        .withColumn("recall", F.col("hit") / F.col("wanted"))
