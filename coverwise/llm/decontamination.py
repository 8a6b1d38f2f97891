"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item leaks into a document when at least 80 % of the item's distinct
five-word shingles occur in the document. Documents are far longer than items,
so set similarity says nothing; containment of the item is what counts.

Search: items are partitioned by size (powers of two of their shingle count).
An item of size partition ``u`` is represented by ``floor(0.2 * u) + 1``
of its shingle hashes, where ``u`` is the upper bound of the partition: a
bottom-k MinHash sketch, which takes hashes that several items hold after those that one holds, so that a stock phrase
of the items makes no candidates. At most ``floor(0.2 * n)`` shingles of a leaked item are
missing from the document, so at least one hash of the sketch is present: the
search loses nothing. All shingles of all documents are probed against the
sketches. Candidates are verified by exact containment of the shingle texts.

Words are runs of letters and digits of the lower-cased text. An item of fewer
than five words is one shingle of all its words, searched among the document's
word runs of that length (its own size partition).

Defined results: null or empty texts, and texts without a word, on either side
match nothing; repeated ids are one document (or item) each with the union of
its rows' shingles, whatever their widths; very long texts are handled whole, a row at a time; empty tables give no rows; only the named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

WIDTH = 5
PERCENT = 80
#: Sketch rows up to this many are broadcast (each is two longs); beyond it the join shuffles on the hash.
BROADCAST_ROWS = 500_000
#: Shingle texts of the items up to this many bytes are broadcast.
BROADCAST_BYTES = 64 << 20

_NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _positions(w: Column, width: int) -> Column:
    return F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, width: int) -> Column:
    return F.transform(_positions(w, width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))


def shingle_texts(w: Column, width: int) -> Column:
    return F.array_distinct(F.transform(_positions(w, width), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(width)])))


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, width, shingle, h): the distinct shingles of every item; ``h`` as in documents."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    out = None
    for width in range(1, WIDTH + 1):
        of = w.where(F.size("w") == width) if width < WIDTH else w.where(F.size("w") >= width)
        part = of.select("item_id", F.lit(width).alias("width"),
                         F.explode(F.arrays_zip(shingle_texts(F.col("w"), width).alias("shingle"))).alias("z")) \
                 .select("item_id", "width", F.col("z.shingle").alias("shingle")).distinct()
        out = part if out is None else out.unionByName(part)
    parts = F.split("shingle", " ")
    hashed = F.when(F.lit(False), F.lit(0).cast("long"))
    for width in range(1, WIDTH + 1):
        hashed = hashed.when(F.col("width") == width, F.xxhash64(*[F.get(parts, F.lit(j)) for j in range(width)]))
    return out.withColumn("h", hashed)


def sketches(shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, width, n, h): the hashes of each item that the fewest items hold, smallest first, as many as its
    size partition asks for. With sketches of every width an item of several widths is found, too: the
    hashes of all its sketches together are more than may be missing."""
    held = shingles.groupBy("h").agg(F.count("*").alias("held"))
    sized = shingles.join(held, "h").groupBy("item_id", "width").agg(F.array_sort(F.collect_set(F.struct("held", "h"))).alias("hs"), F.count("*").alias("n"))
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    k = (F.floor(upper * (100 - percent) / 100) + 1).cast("int")
    return sized.select("item_id", "width", "n", F.explode(F.slice("hs", 1, k)).alias("s")).select("item_id", "width", "n", "s.h")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(item_id, doc_id, n_shingles, n_common, containment): every leak."""
    shingles = save(item_shingles(items, item_id, item_text), "item-shingles")
    sketch = save(sketches(shingles, percent), "item-sketches")
    widths = [r["width"] for r in sketch.select("width").distinct().orderBy("width").collect()]  # at most WIDTH
    small = sketch.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda d: d)
    d = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    found = verified = None
    for width in widths:
        hits = (d.select("doc_id", F.explode(shingle_hashes(F.col("w"), width)).alias("h"))
                .join(hint(sketch.where(F.col("width") == width).select("h", "item_id")), "h")
                .select("doc_id", "item_id"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    pairs = save(found.distinct(), "leak-candidates")
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    total = shingles.agg(F.coalesce(F.sum(F.octet_length("shingle") + 40), F.lit(0))).first()[0]
    held = F.broadcast if total <= BROADCAST_BYTES else (lambda d: d)
    for width in widths:
        # a candidate document is cut into its distinct shingles once, however many items point at it
        texts = (d.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
                 .select("doc_id", F.explode(shingle_texts(F.col("w"), width)).alias("shingle")))
        common = (texts.join(held(shingles.where(F.col("width") == width).select("item_id", "shingle")), "shingle")
                  .join(pairs, ["item_id", "doc_id"], "left_semi")
                  .groupBy("item_id", "doc_id").agg(F.count_distinct("shingle").alias("n_common")))
        verified = common if verified is None else verified.unionByName(common)
    if verified is None:
        verified = pairs.select("item_id", "doc_id", F.lit(0).cast("long").alias("n_common")).limit(0)
    verified = verified.groupBy("item_id", "doc_id").agg(F.sum("n_common").alias("n_common"))
    return (verified.join(held(sizes), "item_id").where(F.col("n_common") * 100 >= F.col("n_shingles") * percent)
            .select("item_id", "doc_id", "n_shingles", "n_common",
                    F.round(F.col("n_common") / F.col("n_shingles"), 6).alias("containment")))


ORACLE = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark
), widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE kind = 'i' AND len(w) > 0
), shingles AS (
  SELECT DISTINCT kind, id, k, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT kind, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, widths
        WHERE len(w) >= k AND (kind = 'd' OR k = least(len(w), 5)))
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id
), common AS (
  SELECT i.id AS item_id, d.id AS doc_id, count(*) AS n_common
  FROM shingles i JOIN shingles d ON i.s = d.s AND i.k = d.k AND i.kind = 'i' AND d.kind = 'd' GROUP BY 1, 2
)
SELECT item_id, doc_id, n AS n_shingles, n_common, round(n_common / n, 6) AS containment
FROM common JOIN sizes ON id = item_id WHERE n_common * 100 >= n * 80
"""
