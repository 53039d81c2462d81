"""Jaccard self-join of word n-gram sets over prefix trees.

A document's set is its distinct word shingles, hashed to 64 bits and ordered by
hash, the same order everywhere.  Sets of equal 128-bit digest are one node.  The
others reach a common tree as follows:

* Sizes fall in classes whose bounds grow by one over the threshold, so two linked
  sets lie in the same class or in neighbouring ones.  For each class a set deals
  its shingles over as many segments, by hash, as two linked sets of that class can
  differ in shingles, plus k: at least k segments of two linked sets are equal, less those
  that are empty, which stay at home.  A segment's digest is the only thing that is
  shuffled.  This is exact for every threshold and needs no frequencies.
* A set that shares fewer segments with any others than two linked sets share is
  dropped.  Of its s shared segments, s - k + 1 stay, those that the fewest sets share:
  two linked sets have one of these in common, as both order segments alike.  So
  passages that many documents share lead no two of them together.
* Documents that still meet, directly or through others, are compared by a byte of each
  of their segments' digests: linked ones have k bytes in common at least.  Those that
  have, directly or through others, form a family.
* Families, or tiles of two chunks of a large one, are joined in one task each: their ordered sets
  go into a path-compressed trie; a probe walks it, sharing the overlap counted so
  far among all sets below a node, and leaves a subtree when the shingles that
  remain on either side can't reach the threshold, or when all sets below are
  already known to be connected with it.  Sets at a leaf are passed over if a bit map of
  their shingles shows too many that the other one lacks.

The join gives a spanning forest of the links, never all pairs of a group.  Each
task settles what meets within its own batch before anything is shuffled.

Shingles are told apart by 64-bit hashes, equal sets by 128 bits: that one of some 1,000
shingles of a compared pair is taken for another has a chance of about 1 in 10**13.

Defined results: a null or blank text has an empty set and no link; fewer words than
the shingle's length are one shingle; rows that share an id are one document, linked
to whatever one of them is linked to; a null id is the least; only the id and the text
are read, so other columns may have any name, and ``keep_first`` gives them back; an
empty table gives no rows.  Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import hashing
from .common import NULL_ID, checkpoint, connected_components, fresh, giving_back, join_summary, table

#: A tile's sets hold at most about twice so many shingles or documents (a single larger document is a chunk of its own).
CHUNK_SHINGLES = 1_000_000
CHUNK_DOCS = 2_000
#: Sets of a chunk when marks are compared; a mark is a byte.
CHUNK_MARKS = 16_000


def shingle_sets(w: hashing.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of a slice, distinct and in order."""
    h, at = w.windows(n)
    row = np.searchsorted(w.offsets, at, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        h = np.concatenate((h, hashing.ranges_hash(w.hashes, w.offsets[short], w.offsets[short + 1])))
        row = np.concatenate((row, short))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _summed(row: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    out = np.zeros(n_docs, dtype=np.uint64)
    np.add.at(out, row, h)
    return out


def set_digests(row: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's set."""
    return _summed(row, hashing.mix(h), n_docs), _summed(row, hashing.mix(h ^ np.uint64(0x9FB21C651E98DF25)), n_docs)


class Threshold:
    """Jaccard similarity of at least ``num / den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def bounds(self, largest: int) -> np.ndarray:
        """The least size of each class."""
        out = [1]
        while out[-1] <= largest:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array([*out, out[-1] * self.den // self.num + 1], dtype=np.int64)

    def segments(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each class the number of segments, and how many of them at least are equal if the smaller set lies in it."""
        a = bounds[1:] - 1
        differ = (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        spare = 1 + differ * (self.den - self.num) // self.den
        return differ + spare, spare


def _segments(row: np.ndarray, h: np.ndarray, n_docs: int, t: Threshold) -> Iterator[tuple[np.ndarray, ...]]:
    """For a document's own class and the one before: (class, segments of each document, digests, which are empty, and least number of equal ones)."""
    size = np.bincount(row, minlength=n_docs)
    bounds = t.bounds(int(size.max(initial=1)))
    count, spare = t.segments(bounds)
    own = np.searchsorted(bounds, size, side="right") - 1
    deal, value = hashing.mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)), hashing.mix(h + np.uint64(0x165667B19E3779F9))
    for back in (0, 1):
        c = own - back
        m = np.where((size > 0) & (c >= 0), count[np.maximum(c, 0)], 0)
        base = np.cumsum(m) - m
        keep = m[row] > 0
        r = row[keep]
        place = base[r] + (deal[keep] % m[r].astype(np.uint64)).astype(np.int64)
        yield c, m, _summed(place, value[keep], int(m.sum())), np.bincount(place, minlength=int(m.sum())) == 0, spare[np.maximum(c, 0)]


def segment_digests(row: np.ndarray, h: np.ndarray, n_docs: int, t: Threshold) -> tuple[np.ndarray, ...]:
    """(document, digest, role, need) of the segments of both classes of a document: role 0 in its own, 1 in the one before.

    Two linked sets have ``need`` of the digests in common at least: empty segments are
    left out and taken off, unless they alone could be the equal ones.
    """
    out = []
    for role, (c, m, total, empty, spare) in enumerate(_segments(row, h, n_docs, t)):
        doc = np.repeat(np.arange(n_docs), m)
        n_empty = np.bincount(doc[empty], minlength=n_docs)
        left_out = n_empty < spare
        sent = ~(empty & left_out[doc])
        doc, seg = doc[sent], (np.arange(len(doc)) - (np.cumsum(m) - m)[doc])[sent]
        digest = hashing.mix(total[sent] + hashing.mix(c[doc].astype(np.uint64) * np.uint64(0x100000001) + seg.astype(np.uint64) + np.uint64(1)))
        out.append((doc, digest, np.full(len(doc), role, np.int8), np.where(left_out, spare - n_empty, spare)[doc].astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*out))


def segment_marks(row: np.ndarray, h: np.ndarray, n_docs: int, t: Threshold) -> list[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """For both classes of a document: (class, how many marks two linked sets have in common at least, one byte for each segment)."""
    out = []
    for c, m, total, _, spare in _segments(row, h, n_docs, t):
        raw, cut = hashing.mix(total).astype(np.uint8).tobytes(), np.concatenate(([0], np.cumsum(m))).tolist()
        out.append((c, spare, [raw[x:y] for x, y in zip(cut[:-1], cut[1:])]))
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_MARKS = pa.list_(pa.struct([("class", pa.int32()), ("role", pa.int32()), ("least", pa.int32()), ("marks", pa.binary())]))


def _sets(n: int, t: Threshold):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, h1, h2 = [], [], []
            marks: list[dict] = []
            for w in hashing.word_slices(_column(batch, "text"), hashing.LOWER):
                row, h = shingle_sets(w, n)
                a, b = set_digests(row, h, w.n_docs)
                sizes.append(np.bincount(row, minlength=w.n_docs))
                h1.append(a)
                h2.append(b)
                both = segment_marks(row, h, w.n_docs, t)
                marks += [[{"class": int(c[d]), "role": role, "least": int(least[d]), "marks": x[d]} for role, (c, least, x) in enumerate(both) if x[d]] for d in range(w.n_docs)]
            if sizes:
                yield pa.RecordBatch.from_arrays([_column(batch, "id"), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(h1).view(np.int64)), pa.array(np.concatenate(h2).view(np.int64)), pa.array(marks, _MARKS)], names=["id", "n", "h1", "h2", "marks"])

    return emit


def _shared_segments(n: int, t: Threshold):
    """(key, node, role, need): the digests of each set's segments; a node is a set's first digest, and equal sets of a slice are one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in hashing.word_slices(_column(batch, "text"), hashing.LOWER):
                row, h = shingle_sets(w, n)
                node, _ = set_digests(row, h, w.n_docs)
                first = np.zeros(w.n_docs, dtype=bool)
                first[np.unique(node, return_index=True)[1]] = True
                mine = first[row]
                doc, key, role, need = segment_digests(row[mine], h[mine], w.n_docs, t)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[doc].view(np.int64)), pa.array(role), pa.array(need)], names=["key", "node", "role", "need"])

    return emit


def meetings(rows: DataFrame, n: int, t: Threshold) -> DataFrame:
    """(a, b): nodes of ``rows`` (text) that may be linked, directly or through others."""
    by_key, by_half = W.partitionBy("key"), W.partitionBy("node", "role")
    met = rows.mapInArrow(giving_back(_shared_segments(n, t)), "key bigint, node bigint, role tinyint, need int").repartition("key")
    met = met.withColumns({"sharing": F.count("*").over(by_key), "several": F.min("node").over(by_key) != F.max("node").over(by_key), "own": F.min("role").over(by_key) == 0})
    # two sets that both come from the next class are compared there
    halves = met.where("several and own").repartition("node", "role").groupBy("node", "role", "key").agg(F.first("need").alias("need"), F.first("sharing").alias("sharing"))
    halves = halves.withColumns({"shared": F.count("*").over(by_half), "rank": F.row_number().over(by_half.orderBy("sharing", "key"))})
    rare = checkpoint(halves.where("shared >= need and rank <= shared - need + 1").select("key", "node"))
    least = rare.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("key", "least")
    return join_summary(rare, least, ["key"]).select(F.col("node").alias("a"), F.col("least").alias("b")).where("a != b")


def _common_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a spanning forest of the pairs of a tile that have enough marks in common.

    Rows come by tile; in it, sets of the class (role 0) meet each other and those of the next class (role 1).
    """
    columns = ("family", "class", "low", "high")
    key, rows = None, []

    def found() -> list[tuple[int, int]]:
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        role, chunk = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        marks = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
        least, label, forest = rows[0][3], np.arange(len(rows)), []

        def join(i: int, others: np.ndarray) -> None:
            others = others[(marks[others] == marks[i]).sum(axis=1) >= least]
            have, at = np.unique(label[others], return_index=True)
            for old, j in zip(have.tolist(), others[at].tolist()):
                if old != label[i]:
                    forest.append((int(ids[i]), int(ids[j])))
                    label[label == old] = label[i]

        hub = None  # of what is most likely a large component: first, so that the rest of it need not be looked at
        for i in np.flatnonzero(role == 0).tolist():
            if hub is not None and label[hub] != label[i] and (key[2] == key[3] or chunk[hub] != chunk[i]):
                join(i, np.array([hub]))
            other = label != label[i]
            if key[2] != key[3]:
                other &= chunk != chunk[i]
            had = len(forest)
            join(i, np.flatnonzero(other))
            if len(forest) > had:
                hub = int(np.flatnonzero(label == label[i])[-1])
        return forest

    def out(forest: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in forest], pa.int64()), pa.array([b for _, b in forest], pa.int64())], names=["a", "b"])

    for batch in batches:
        forest: list[tuple[int, int]] = []
        for now, *r in zip(zip(*(_column(batch, c).to_pylist() for c in columns)), *(_column(batch, c).to_pylist() for c in ("id", "role", "chunk", "least", "marks"))):
            if now != key:
                forest += found() if rows else []
                key, rows = now, []
            rows.append(r)
        yield out(forest)
    yield out(found() if rows else [])


def _family_sets(n: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for w in hashing.word_slices(_column(batch, "text"), hashing.LOWER):
                row, h = shingle_sets(w, n)
                cut = np.searchsorted(row, np.arange(w.n_docs + 1))
                sets += [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([_column(batch, "family"), _column(batch, "chunks"), _column(batch, "id"), pa.array(sets, pa.binary())], names=["family", "chunks", "id", "grams"])

    return emit


class _Node:
    __slots__ = ("grams", "children", "ends", "roots", "least", "most")

    def __init__(self, grams: np.ndarray):
        self.grams = grams  # on the way from the parent
        self.children: dict[int, _Node] = {}
        self.ends: list[int] = []  # sets that end here
        self.roots: set[int] = set()  # of the components of all sets below, some of them maybe joined since
        self.least, self.most = 1 << 62, 0  # sizes of the sets below


class PrefixTree:
    """Ordered sets of at most ``largest`` shingles in a path-compressed trie; ``link`` probes it and then adds the set."""

    def __init__(self, t: Threshold, largest: int):
        self.t, self.root, self.sets, self.parent = t, _Node(np.zeros(0, np.uint64)), [], []
        self.bits = 1 << max(9, min(16, (8 * largest - 1).bit_length()))
        self.maps, self.sizes = np.zeros((16, self.bits // 64), dtype=np.uint64), np.zeros(16, dtype=np.int64)

    def _mapped(self, x: np.ndarray) -> np.ndarray:
        on = np.zeros(self.bits, dtype=bool)
        on[(x & np.uint64(self.bits - 1)).astype(np.int64)] = True
        return np.packbits(on).view(np.uint64)

    def _possible(self, own: np.ndarray, size: int) -> list[bool]:
        """Which earlier sets may be linked: a bit that only one of two maps has is a shingle that only that set has."""
        n = len(self.sets)
        sizes = self.sizes[:n]
        need = -(-self.t.num * (size + sizes) // (self.t.num + self.t.den))
        out = np.bitwise_count(own & ~self.maps[:n]).sum(axis=1, dtype=np.int64) <= size - need
        some = np.flatnonzero(out)
        out[some] = np.bitwise_count(self.maps[some] & ~own).sum(axis=1, dtype=np.int64) <= (sizes - need)[some]
        return out.tolist()

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, x: np.ndarray) -> list[int]:
        """Adds the set; returns earlier sets that it is linked with, one of each component at least."""
        me, own = len(self.sets), self._mapped(x)
        possible = self._possible(own, len(x))
        if me == len(self.maps):
            self.maps, self.sizes = (np.concatenate((a, np.zeros_like(a))) for a in (self.maps, self.sizes))
        self.maps[me], self.sizes[me] = own, len(x)
        self.sets.append(x)
        self.parent.append(me)
        out = []
        t, size = self.t, len(x)
        todo = [(self.root, 0, 0)] if any(possible) else []
        while todo:
            node, depth, shared = todo.pop()
            if not node.children and not any(possible[k] for k in node.ends):
                continue
            if len(node.roots) > 1:
                node.roots = {self.find(r) for r in node.roots}
            if not node.roots or (len(node.roots) == 1 and self.find(next(iter(node.roots))) == self.find(me)):
                continue
            passed = 0
            if len(node.grams):
                at = np.searchsorted(x, node.grams)
                shared += int((x[np.minimum(at, size - 1)] == node.grams).sum())
                depth += len(node.grams)
                passed = int(np.searchsorted(x, node.grams[-1], side="right"))
            # what the sets below can still share: their own rest if they are the largest, this set's rest if the smallest
            if not t.linked(shared + node.most - depth, size, node.most) or not t.linked(shared + size - passed, size, node.least):
                continue
            for other in node.ends:
                if t.linked(shared, size, len(self.sets[other])) and self.find(other) != self.find(me):
                    out.append(other)
                    self.parent[self.find(me)] = self.find(other)
            todo += [(child, depth, shared) for child in node.children.values()]
        self._add(x, me)
        return out

    def _add(self, x: np.ndarray, me: int) -> None:
        node, at, mine = self.root, 0, self.find(me)
        while True:
            node.roots.add(mine)
            node.least, node.most = min(node.least, len(x)), max(node.most, len(x))
            if at == len(x):
                node.ends.append(me)
                return
            child = node.children.get(int(x[at]))
            if child is None:
                child = _Node(x[at:])
                node.children[int(x[at])] = child
                node, at = child, len(x)
                continue
            k = min(len(child.grams), len(x) - at)
            differ = np.flatnonzero(child.grams[:k] != x[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(child.grams):
                upper = _Node(child.grams[:same])
                upper.roots, upper.least, upper.most = set(child.roots), child.least, child.most
                child.grams = child.grams[same:]
                upper.children[int(child.grams[0])] = child
                node.children[int(x[at])] = upper
                child = upper
            node, at = child, at + same


def _tree_join(t: Threshold):
    def join(ids: list[int], grams: list[bytes]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(g, dtype=np.uint64) for g in grams]
        tree, links = PrefixTree(t, max(map(len, sets), default=1)), []
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        for i in order:
            links += [(ids[i], ids[order[k]]) for k in tree.link(sets[i])]
        return links

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come with those of a tile together; a tile may go over several batches."""
        key, ids, grams, links = None, [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for now, i, g in zip(zip(_column(batch, "family").to_pylist(), _column(batch, "low").to_pylist(), _column(batch, "high").to_pylist()), _column(batch, "id").to_pylist(), _column(batch, "grams").to_pylist()):
                if now != key:
                    links += join(ids, grams)
                    key, ids, grams = now, [], []
                ids.append(i)
                grams.append(g)
            if links:
                yield out()
                links = []
        links = join(ids, grams)
        if links:
            yield out()

    return emit


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links reach)."""
    t = Threshold(*threshold)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    sets = checkpoint(rows.mapInArrow(giving_back(_sets(n, t)), "id bigint, n bigint, h1 bigint, h2 bigint, marks array<struct<class:int,role:int,least:int,marks:binary>>"))
    nodes = checkpoint(sets.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "marks"), "id").alias("set")).select("h1", "h2", "rep", "set.*"))

    met_by = connected_components(meetings(rows.where("text is not null").select("text"), n, t)).select(F.col("id").alias("h1"), F.col("component_id").alias("family"))
    marked = nodes.join(met_by, "h1").select("family", F.col("rep").alias("id"), F.explode("marks").alias("m")).select("family", "id", "m.*")
    several = marked.groupBy("family", "class").agg(F.count("*").alias("rows")).where("rows > 1").select("family", "class", F.ceil(F.col("rows") / CHUNK_MARKS).cast("int").alias("chunks"))
    marked = join_summary(marked, several, ["family", "class"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    marked = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    marked = marked.select("family", "class", "low", "high", "id", "role", "chunk", "least", "marks").repartition("family", "class", "low", "high").sortWithinPartitions("family", "class", "low", "high")
    alike = connected_components(marked.mapInArrow(giving_back(_common_marks), "a bigint, b bigint"))
    families = alike.join(nodes.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("n")), "id").select("id", "n", F.col("component_id").alias("family"))
    size = families.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK_DOCS)).cast("int").alias("chunks"))
    families = join_summary(families, size, ["family"]).select("id", "family", "chunks")

    grams = rows.where("text is not null").join(families, "id").select("family", "chunks", "id", "text").mapInArrow(giving_back(_family_sets(n)), "family bigint, chunks int, id bigint, grams binary")
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    tiles = grams.withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select("family", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "id", "grams")
    tiles = tiles.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high", "id")
    links = tiles.mapInArrow(giving_back(_tree_join(t)), "a bigint, b bigint")

    # a document is in the node of each of its rows; what joins nodes are links and documents with several of them
    member = checkpoint(join_summary(sets.where("n > 0").select("id", "h1", "h2"), nodes.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep").distinct())
    twice = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("id")
    bridges = member.join(twice, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(links.unionByName(bridges)).withColumnRenamed("id", "rep")
    label = member.join(component.hint("merge"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    null_again = lambda c: F.when(c != NULL_ID, c)
    out = join_summary(sets.select("id", "n"), label, ["id"], "left")
    return out.select(null_again(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), null_again(F.coalesce("component_id", "id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the least id of each group, with its own columns; rows without a link stay."""
    found = jaccard_components(docs, id_col, text_col, **options)
    name = fresh(docs, "kept")
    kept = found.where(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op9: set size and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
