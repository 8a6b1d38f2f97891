"""N-gram Jaccard join over prefix trees.

A document is the set of its distinct word shingles. Two documents link when
100 * |intersection| >= 85 * |union|. The join finds the components of all links,
without listing the links inside a group of copies.

1. Peeling. All sets are ordered by shingle hash, one global order. A pair that links
   shares at least ``need`` shingles of both sets' prefixes (of length
   n - ceil(0.85 n) + ceil(0.1 n); ``need`` is 10 % of the smallest partner's overlap).
   Postings of the prefixes meet by hash; every document counts its prefix shingles
   that some other set has too, and those below ``need`` can have no partner. Postings
   travel as packed blocks, summed per block of documents first, so a shingle that
   every document has costs one posting per block.
2. Equal sets collapse to the smallest id.
3. What is left is ordered anew, by the number of sets that have a shingle (then hash):
   passages that many documents share come last. Sets sharing a shingle of the
   (n - ceil(0.85 n) + 1)-prefix under this order are candidates; components of candidates
   are the units of work.
4. Within a unit the ordered sets go into a prefix tree. Each set walks the tree; a step
   down an edge adds the edge's overlap once for all sets below it, and a subtree is left as soon as
   the overlap so far plus the shorter of the two remaining lengths cannot reach the
   bound for its smallest set, or when all of it already is in the walker's component.
   Units over ``UNIT_TOKENS`` are cut into chunks by size class and hash and joined chunk
   by chunk; pairs of chunks that the first round has put into one component are not compared again.

Shingles are compared by 64-bit hashes.

Defined results: null or empty texts, and texts without a word, have 0 shingles and are
linked with nothing (component is the id itself); texts of fewer words than the
shingle width are one shingle; rows with the same id are one document in the links
(each row is returned with its own n_shingles); rows with a null id have a null component
and no links; an empty table gives no rows; only the named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, save, tidy
from .components import components
from .texthash import mix, shingle_sets
from .tokens import blocks

WIDTH = 4
PERCENT = 85
#: Shingles of one unit of work, or of one chunk of a larger unit.
UNIT_TOKENS = 500_000
BLOCK = 2 << 20


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def peel_prefix(n: int, percent: int = PERCENT) -> int:
    return n - least_overlap(n, percent) + -(-n // 10)


def peel_need(n: int, percent: int = PERCENT) -> int:
    return -(-least_overlap(n, percent) // 10)


def _binary(values) -> pa.Array:
    return pa.array(values, pa.binary())


def _longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


# ---------------------------------------------------------------- 1. peeling

def _postings(width: int, percent: int, parts: int):
    """(doc_id, text) -> (part, kind, a, b): blocks of postings (kind 0: hashes, ids and after them a byte each
    that is 1 where one document of the block has the hash alone) and of documents (kind 1: ids, n and shingles known to be shared)."""
    shift = np.uint64(64 - parts.bit_length() + 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK):
                valid = np.asarray(batch.column(0).slice(lo, hi - lo).is_valid())
                ids = np.asarray(batch.column(0).slice(lo, hi - lo).fill_null(0)).astype(np.int64)
                sets = shingle_sets(batch.column(1).slice(lo, hi - lo), width)
                n = np.array([len(s) for s in sets], np.int64)
                heads = [s[:peel_prefix(len(s), percent)] if v else s[:0] for s, v in zip(sets, valid)]
                h = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                who = np.repeat(np.arange(len(heads)), [len(x) for x in heads])
                order = np.argsort(h, kind="stable")
                h, who = h[order], who[order]
                new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                many = np.diff(np.append(first, len(h))) > 1
                shared = np.bincount(who[np.repeat(many, np.diff(np.append(first, len(h))))], minlength=len(sets))
                key, owner, alone = h[first], ids[who[first]], ~many
                edges = np.searchsorted((key >> shift).astype(np.int64) if parts > 1 else np.zeros(len(key), np.int64), np.arange(parts + 1))
                rows = [(p, 0, key[a:b].tobytes(), owner[a:b].tobytes() + alone[a:b].tobytes())
                        for p, a, b in zip(range(parts), edges[:-1], edges[1:]) if b > a]
                rows.append((int(mix(ids[:1].view(np.uint64))[0] % np.uint64(parts)), 1,  # any part will do
                             np.where(valid, ids, 0).tobytes(), np.stack([n, shared, valid]).astype(np.int64).tobytes()))
                part, kind, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), _binary(a), _binary(b)],
                                                 names=["part", "kind", "a", "b"])
    return post


def _meet(percent: int):
    """Blocks of one or more whole parts -> (doc_id, n, need, shared): documents, and counts of shared shingles."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("need", pa.int64()), ("shared", pa.int64())]

    def rows(ids, n, need, shared):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((ids, n, need, shared), fields)], names=[k for k, _ in fields])

    def count(held):
        h, owner, alone = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, owner, alone = h[order], owner[order], alone[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        met = owner[np.repeat(times > 1, times) & alone]
        ids, n = np.unique(met, return_counts=True)
        none = [None] * len(ids)
        return rows(ids, none, none, n)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, kind, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    ids = np.frombuffer(a, np.int64)
                    n, shared, valid = np.frombuffer(b, np.int64).reshape(3, -1)
                    need = [peel_need(x, percent) if x else None for x in n.tolist()]
                    yield rows(pa.array(ids, mask=valid == 0), n, need, shared)
                    continue
                if p != part and held:
                    yield count(held)
                    held = []
                part = p
                m = len(a) // 8
                held.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64, m), np.frombuffer(b, bool, m, 8 * m)))
        if held:
            yield count(held)
    return meet


# ---------------------------------------------------------------- 2. sets of the survivors

def _as_sets(width: int):
    """(doc_id, text) -> (doc_id, n, f1, f2, hashes); equal sets of a block keep the hashes of the smallest id only."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in blocks(batch.column(1), BLOCK):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                sets = shingle_sets(batch.column(1).slice(lo, hi - lo), width)
                prints = [(int(np.sum(mix(s))), int(np.bitwise_xor.reduce(mix(s + np.uint64(77))))) if len(s) else (0, 0) for s in sets]
                least: dict = {}
                for k, (i, f) in enumerate(zip(ids, prints)):
                    if f not in least or i < ids[least[f]]:
                        least[f] = k
                signed = lambda x: x - (1 << 64) if x >> 63 else x
                yield pa.RecordBatch.from_arrays(
                    [_longs(ids), _longs([len(s) for s in sets]), _longs([signed(f[0]) for f in prints]), _longs([signed(f[1]) for f in prints]),
                     _binary([s.tobytes() if least[f] == k else None for k, (s, f) in enumerate(zip(sets, prints))])],
                    names=["doc_id", "n", "f1", "f2", "hashes"])
    return make


# ---------------------------------------------------------------- 3. candidates

def _by_part(parts: int):
    """(doc_id, hashes) -> (part, h, ids): all shingles of a block of sets, by part."""
    shift = np.uint64(64 - parts.bit_length() + 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = np.asarray(batch.column(0)), batch.column(1)
            for lo, hi in blocks(sets, 4 * BLOCK):
                each = [np.frombuffer(x, np.uint64) for x in sets.slice(lo, hi - lo).to_pylist()]
                h = np.concatenate(each)
                who = np.repeat(ids[lo:hi], [len(x) for x in each])
                order = np.argsort(h)
                h, who = h[order], who[order]
                edges = np.searchsorted((h >> shift).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64), np.arange(parts + 1))
                cut = [(p, x, y) for p, x, y in zip(range(parts), edges[:-1], edges[1:]) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cut], pa.int32()), _binary([h[x:y].tobytes() for _, x, y in cut]),
                                                  _binary([who[x:y].astype(np.int64).tobytes() for _, x, y in cut])], names=["part", "h", "ids"])
    return spread


def _frequencies(parts: int):
    """Blocks sorted by part -> (part, ids, h, times): all shingles of the part with the number of sets that have each, dealt
    out anew by set."""
    def count(held):
        h, who = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        order = np.argsort(h)
        h, who = h[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        times = np.repeat(times, times).astype(np.int32)
        to = (mix(who.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        h, who, times = h[order], who[order], times[order]
        edges = np.searchsorted(to[order], np.arange(parts + 1))
        cut = [(p, x, y) for p, x, y in zip(range(parts), edges[:-1], edges[1:]) if y > x]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in cut], pa.int32()), *(_binary([c[x:y].tobytes() for _, x, y in cut]) for c in (who, h, times))],
                                          names=["part", "ids", "h", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, h, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield count(held)
                    held = []
                part = p
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(ids, np.int64)))
        if held:
            yield count(held)
    return run


def _prefixes(percent: int):
    """Blocks sorted by part -> (h, doc_id): the prefix of each set, rarest shingle first. A shingle that no other set
    has is left out: it leads to nobody."""
    def cut(held):
        who, h, times = (np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in enumerate((np.int64, np.uint64, np.int32)))
        order = np.lexsort((h, times, who))
        who, h, times = who[order], h[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        n = np.diff(np.append(first, len(who)))
        keep = n - -(-n * percent // 100) + 1
        take = (np.arange(len(who)) - np.repeat(first, n) < np.repeat(keep, n)) & (times > 1)
        return pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(who[take])], names=["h", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield cut(held)
                    held = []
                part = p
                held.append(r)
        if held:
            yield cut(held)
    return run


def prefixes(sets: DataFrame, percent: int, n: int) -> DataFrame:
    """(h, doc_id): the prefixes of all sets in the order of (number of sets that have the shingle, hash)."""
    parts = 1 << (n - 1).bit_length()
    counted = (sets.select("doc_id", "hashes").mapInArrow(tidy(_by_part(parts)), "part int, h binary, ids binary")
               .repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(_frequencies(parts)), "part int, ids binary, h binary, times binary"))
    return counted.repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(_prefixes(percent)), "h long, doc_id long")


# ---------------------------------------------------------------- 4. prefix tree

class Forest:
    """Union-find over ids; the root of a tree is its smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class _Node:
    __slots__ = ("edge", "children", "ends", "least", "most", "member", "mixed")

    def __init__(self, edge: np.ndarray, member: int, n: int):
        self.edge, self.children, self.ends = edge, {}, []
        self.least = self.most = n
        self.member, self.mixed = member, False


class PrefixTree:
    """Path-compressed prefix tree of ordered sets with a similarity search that unions what it finds."""

    def __init__(self, forest: Forest, percent: int = PERCENT):
        self.forest, self.percent = forest, percent
        self.root: _Node | None = None

    def insert(self, key: int, s: np.ndarray) -> None:
        n = len(s)
        if self.root is None:
            self.root = _Node(s[:0], key, n)
        node, at = self.root, 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if not node.mixed and self.forest.find(node.member) != self.forest.find(key):
                node.mixed = True
            if at == n:
                node.ends.append(key)
                return
            child = node.children.get(int(s[at]))
            if child is None:
                child = node.children[int(s[at])] = _Node(s[at:], key, n)
                child.ends.append(key)
                return
            m = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:m] != s[at:at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.edge):
                upper = _Node(child.edge[:same], child.member, child.least)
                upper.most, upper.mixed = child.most, child.mixed
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[int(s[at])] = child = upper
            node, at = child, at + same

    def search(self, key: int, s: np.ndarray) -> None:
        """Union ``key`` with every set of the tree that links with ``s``."""
        if self.root is None or len(s) == 0:
            return
        n, find = len(s), self.forest.find
        bound = 100 + self.percent  # links: bound * overlap >= percent * (n + size)
        stack = [(self.root, 0, 0, 0)]  # node, shingles on the path above it, place in s, overlap so far
        while stack:
            node, depth, at, overlap = stack.pop()
            if not node.mixed and find(node.member) == find(key):
                continue
            if bound * (overlap + min(node.most - depth, n - at)) < self.percent * (n + node.least):
                continue
            edge = node.edge
            if len(edge):
                place = np.searchsorted(s, edge)
                hit = s[np.minimum(place, n - 1)] == edge
                overlap += int(np.count_nonzero(hit))
                at = int(place[-1]) + int(hit[-1])
                depth += len(edge)
                if bound * (overlap + min(node.most - depth, n - at)) < self.percent * (n + node.least):
                    continue
            for other in node.ends:
                if bound * overlap >= self.percent * (n + depth):
                    self.forest.union(key, other)
            if node.children:
                follow = node.children.get(int(s[at])) if at < n else None
                stack.extend((c, depth, at, overlap) for c in node.children.values() if c is not follow)
                if follow is not None:  # taken first: the likeliest link
                    stack.append((follow, depth, at, overlap))


def _tree_join(percent: int):
    """Rows sorted by unit (unit, side, doc_id, label, hashes) -> (doc_id, label): sets of side 0 are joined with each
    other; a unit that has a side 2 joins its sets with those of side 1 instead."""
    def run(rows):
        forest, tree = Forest(), None
        tree = PrefixTree(forest, percent)
        for side, doc, label, s in sorted(rows, key=lambda r: (r[0], len(r[3]), r[1])):
            if label != doc:
                forest.union(doc, label)
            if side != 1:
                tree.search(doc, s)
            if side != 2:
                tree.insert(doc, s)
        ids = list(dict.fromkeys(r[1] for r in rows))
        return pa.RecordBatch.from_arrays([_longs(ids), _longs([forest.find(x) for x in ids])], names=["doc_id", "label"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for u, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit and rows:
                    yield run(rows)
                    rows = []
                unit = u
                rows.append((r[0], r[1], r[2], np.frombuffer(r[3], np.uint64)))
        if rows:
            yield run(rows)
    return join


def _joined(rows: DataFrame, percent: int, n: int) -> DataFrame:
    return (rows.select("unit", "side", "doc_id", "label", "hashes").repartition(n, "unit").sortWithinPartitions("unit")
            .mapInArrow(tidy(_tree_join(percent)), "doc_id long, label long"))


def _chunks(sets: DataFrame, percent: int, unit_tokens: int) -> DataFrame:
    """Adds (kind, k): size class and hashed part of the class, of at most about ``unit_tokens`` each."""
    kind = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    s = sets.withColumn("kind", kind)
    parts = s.groupBy("unit", "kind").agg(F.ceil(2 * F.sum("n") / F.lit(unit_tokens)).cast("int").alias("m"))
    return s.join(parts, ["unit", "kind"]).withColumn("k", F.pmod(F.xxhash64("doc_id"), "m").cast("int")).drop("m")


def _large_units(sets: DataFrame, percent: int, unit_tokens: int, n: int) -> DataFrame:
    """(doc_id, label) edges of the units that are joined chunk by chunk. Sets only meet sets of their own or
    the next size class; the first round joins every chunk with itself and with the first of its class and of the next
    one, the second round the remaining pairs of chunks that are not in one component yet."""
    s = save(_chunks(sets, percent, unit_tokens), "chunks")
    name = lambda *c: F.concat_ws("/", *c)
    own = s.select(name("unit", "kind", "k").alias("unit"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("label"), "hashes")
    first = save(_joined(own, percent, n), "chunk-links")
    labels = components(first.select(F.col("doc_id").alias("a"), F.col("label").alias("b")))
    done = [first]
    for last in (False, True):
        named = s.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left") \
            .withColumn("label", F.coalesce("component", "doc_id")).drop("component")
        named = save(named, "labelled-chunks")
        c = named.groupBy("unit", "kind", "k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        left = c.select("unit", F.col("kind").alias("kind1"), F.col("k").alias("k1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
        right = c.select("unit", F.explode(F.array(F.col("kind"), F.col("kind") - 1)).alias("kind1"), F.col("kind").alias("kind2"),
                         F.col("k").alias("k2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pairs = left.join(right, ["unit", "kind1"]).where("kind2 > kind1 or k2 > k1") \
            .where("not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
        pairs = pairs.where("k1 > 0" if last else "k1 = 0")
        pairs = save(pairs.select("unit", "kind1", "k1", "kind2", "k2", name("unit", "kind1", "k1", "kind2", "k2").alias("pair")), "chunk-pairs")
        sides = [named.join(pairs.select("unit", F.col(f"kind{i}").alias("kind"), F.col(f"k{i}").alias("k"), "pair"), ["unit", "kind", "k"])
                 .select(F.col("pair").alias("unit"), F.lit(i).alias("side"), "doc_id", "label", "hashes") for i in (1, 2)]
        done.append(save(_joined(sides[0].unionByName(sides[1]), percent, n), "chunk-links"))
        edges = done[0]
        for d in done[1:]:
            edges = edges.unionByName(d)
        labels = components(edges.select(F.col("doc_id").alias("a"), F.col("label").alias("b")))
    return labels.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))


# ---------------------------------------------------------------- the join

def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       percent: int = PERCENT, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_tasks = partitions(spark)
    parts = 1 << (n_tasks - 1).bit_length()
    met = (d.mapInArrow(tidy(_postings(width, percent, parts)), "part int, kind int, a binary, b binary")
           .repartition(n_tasks, "part").sortWithinPartitions("part").mapInArrow(tidy(_meet(percent)), "doc_id long, n long, need long, shared long"))
    marks = save(met, "peel")
    alive = (marks.where("doc_id is not null").groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
             .where("shared >= need").select("doc_id"))
    # the texts are dealt by id whatever the number of the others: cost grows evenly with the input
    sets = save(d.join(alive.hint("merge"), "doc_id", "left_semi").mapInArrow(tidy(_as_sets(width)), "doc_id long, n long, f1 long, f2 long, hashes binary")
                .where("n > 0"), "sets")
    same = sets.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    member = save(sets.select("doc_id", "n", "f1", "f2").distinct().join(same, ["n", "f1", "f2"]).select("doc_id", "rep", "n", "f1", "f2"), "equal-sets")
    whole = save(sets.where("hashes is not null").join(member.where("doc_id = rep").select("doc_id", "n", "f1", "f2"), ["doc_id", "n", "f1", "f2"])
                 .dropDuplicates(["doc_id", "f1", "f2"]).select("doc_id", "n", "hashes"), "distinct-sets")
    forget(sets)
    heads = save(prefixes(whole, percent, n_tasks), "prefixes")
    stars = heads.groupBy("h").agg(F.min("doc_id").alias("b"), F.count("*").alias("times")).where("times > 1").drop("times")
    candidate = save(components(heads.join(stars, "h").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()), "candidates")
    unit = save(whole.join(candidate.select(F.col("node").alias("doc_id"), F.col("component").alias("unit")), "doc_id"), "units")
    weight = unit.groupBy("unit").agg(F.sum("n").alias("tokens"))
    large = save(weight.where(F.col("tokens") > unit_tokens).select("unit"), "large-units")
    labelled = unit.withColumn("side", F.lit(0)).withColumn("label", F.col("doc_id"))
    links = _joined(labelled.join(large, "unit", "left_anti"), percent, n_tasks)
    if not large.isEmpty():
        links = links.unionByName(_large_units(unit.join(large, "unit"), percent, unit_tokens, n_tasks))
    links = save(links.where("doc_id <> label"), "links")
    label = F.coalesce("label", "rep")
    known = member.select("doc_id", "rep").join(links.select(F.col("doc_id").alias("rep"), "label"), "rep", "left").select("doc_id", label.alias("label"))
    # rows with one id but several sets tie those sets together
    edges = known.where("doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b"))
    final = components(edges)
    return (marks.where("n is not null").select("doc_id", F.col("n").alias("n_shingles"))
            .join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id, doc_id AS r FROM sets UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id FROM sets
"""
