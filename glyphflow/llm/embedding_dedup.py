"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors become one with a count.  Each vector is scaled to length one and
rounded to int8 with a scale of its own; the length ``e`` of what rounding took away
is kept.  For two unit vectors the product of the rounded ones is off by no more than
``e1 + e2 + e1 * e2``, so a pair whose product with that allowance stays under the
threshold can't be linked.  All others are computed again in double precision from
the given components.

The vectors are dealt into blocks by hash, as many as their whole number needs; a task
multiplies two blocks, strip by strip, so memory is bounded by the block size.  A task returns a count of links for each of its
vectors and a spanning forest of the links, never the pairs themselves.  The products
are whole numbers below 2**24, exact in single precision (double from 1040 dimensions).

Defined results: a vector that is null, empty, of length zero or has a null or
non-finite component links with nothing, as do vectors of different dimensions with
each other; rows that repeat an id are vectors of their own, each a link of the other
if they are similar; a null id is the least and stays null in the result; only the id and
the vector are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, checkpoint, connected_components, table

THRESHOLD = 0.95
#: Vectors of a block, on average; a task holds two blocks.
BLOCK = 4096
_STRIP = 512
#: Far above the rounding errors of the double and single precision steps of the bound.
_SLACK = 1e-5


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _quantise(kind: str):
    """Vectors as bytes of ``kind``, which holds their components exactly, and rounded to int8."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quantised, scales, errors, raws = [], [], [], []
            for v in _column(batch, "vector"):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                raws.append(x.astype(kind).tobytes())
                x = x / np.abs(x).max()  # first, so that squares neither overflow nor vanish
                x /= np.sqrt(x @ x)
                scale = np.abs(x).max() / 127
                q = np.rint(x / scale)
                rest = x - scale * q
                quantised.append(q.astype(np.int8).tobytes())
                scales.append(scale)
                errors.append(np.sqrt(rest @ rest))
            own = [_column(batch, c) for c in ("id", "copies", "dim", "block", "blocks")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(quantised, pa.binary()), pa.array(scales, pa.float64()), pa.array(errors, pa.float64()), pa.array(raws, pa.binary())], names=["id", "copies", "dim", "block", "blocks", "q", "scale", "error", "raw"])

    return emit


class _Block:
    def __init__(self, rows: dict[str, list], kind: str):
        self.ids, self.copies = np.array(rows["id"], dtype=np.int64), np.array(rows["copies"], dtype=np.int64)
        n = len(self.ids)
        q = np.frombuffer(b"".join(rows["q"]), dtype=np.int8).reshape(n, -1)
        self.q = q.astype(np.float32 if q.shape[1] < 1040 else np.float64)
        self.scale, self.error = np.array(rows["scale"]), np.array(rows["error"])
        x = np.frombuffer(b"".join(rows["raw"]), dtype=kind).reshape(n, -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        self.x, self.norm = x, np.sqrt(np.einsum("ij,ij->i", x, x))


def _exact(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold in double precision."""
    out = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 65_536):
        p, q = i[k : k + 65_536], j[k : k + 65_536]
        out[k : k + 65_536] = np.einsum("ij,ij->i", a.x[p], b.x[q]) / (a.norm[p] * b.norm[q]) >= threshold
    return out


def join_blocks(a: _Block, b: _Block | None, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(ids, links of each, forest) of the links between two blocks, or within one if ``b`` is None."""
    other, base = (a, 0) if b is None else (b, len(a.ids))
    ids = a.ids if b is None else np.concatenate((a.ids, b.ids))
    links = np.zeros(len(ids), dtype=np.int64)
    label = np.arange(len(ids))
    forest = []
    for s in range(0, len(a.ids), _STRIP):
        e = min(s + _STRIP, len(a.ids))
        product = a.q[s:e] @ other.q.T
        product *= other.scale.astype(product.dtype)
        least = (threshold - _SLACK - a.error[s:e] - other.error.max() * (1 + a.error[s:e])) / a.scale[s:e]
        i, j = np.nonzero(product >= least.astype(product.dtype)[:, None] * (1 - _SLACK))
        bound = product[i, j] * a.scale[s:e][i] + a.error[s:e][i] + other.error[j] * (1 + a.error[s:e][i])
        near = bound >= threshold - 2 * _SLACK
        i, j = i[near] + s, j[near]
        if b is None:
            i, j = i[j != i], j[j != i]
        if not len(i):
            continue
        hit = _exact(a, other, i, j, threshold)
        i, j = i[hit], j[hit]
        np.add.at(links, i, other.copies[j])
        if b is not None:
            np.add.at(links, base + j, a.copies[i])
        cut = np.flatnonzero(np.diff(i)) + 1
        for row, cols in zip(i[np.concatenate(([0], cut))].tolist() if len(i) else [], np.split(j + base, cut)):
            have, at = np.unique(label[cols], return_index=True)
            for old, c in zip(have.tolist(), cols[at].tolist()):
                if old != label[row]:
                    forest.append((int(ids[row]), int(ids[c])))
                    label[label == old] = label[row]
    return ids, links, forest


def _tiles(threshold: float, kind: str):
    fields = ("id", "copies", "q", "scale", "error", "raw")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by tile, and in it by block; a tile may go over several batches."""
        key, own = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            if key is None or key[1] not in own or key[2] not in own:
                return
            blocks = {k: _Block(v, kind) for k, v in own.items()}
            ids, links, forest = join_blocks(blocks[key[1]], None if key[1] == key[2] else blocks[key[2]], threshold)
            some = np.flatnonzero(links)
            a = np.concatenate((ids[some], np.array([x for x, _ in forest], dtype=np.int64)))
            b = pa.array(np.concatenate((np.zeros(len(some), np.int64), np.array([x for _, x in forest], dtype=np.int64))), mask=np.arange(len(a)) < len(some))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.concatenate((links[some], np.zeros(len(forest), np.int64)))), b], names=["id", "links", "to"])

        for batch in batches:
            keys = list(zip(*(_column(batch, c).to_pylist() for c in ("dim", "low", "high"))))
            blocks = _column(batch, "block").to_pylist()
            values = [_column(batch, c).to_pylist() for c in fields]
            for i, now in enumerate(keys):
                if now != key:
                    yield from out()
                    key, own = now, {}
                rows = own.setdefault(blocks[i], {c: [] for c in fields})
                for c, v in zip(fields, values):
                    rows[c].append(v[i])
        yield from out()

    return emit


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, n_links, component_id (least id that links reach), kept (id is component_id)."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("usable", usable).withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.lit(7), v))
    single = checkpoint(rows.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("dim", F.size("vector")))
    blocks = F.lit(max(1, -(-single.count() // block)))
    dealt = single.select("id", "copies", "dim", blocks.cast("int").alias("blocks"), F.pmod(F.xxhash64("k1", "id"), blocks).cast("int").alias("block"), "vector")
    kind = "<f4" if "array<float>" in vectors.schema[vector_col].dataType.simpleString() else "<f8"
    quantised = dealt.mapInArrow(_quantise(kind), "id bigint, copies bigint, dim int, block int, blocks int, q binary, scale double, error double, raw binary")
    tiles = quantised.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    tiles = tiles.repartition("dim", "low", "high").sortWithinPartitions("dim", "low", "high")
    joined = checkpoint(tiles.mapInArrow(_tiles(threshold, kind), "id bigint, links bigint, to bigint"))
    links = joined.where("to is null").groupBy("id").agg(F.sum("links").alias("links"))
    label = connected_components(joined.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    found = single.select("k1", "k2", F.col("id").alias("rep"), "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    found = found.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("component"))
    out = rows.select("id", "usable", "k1", "k2").join(found.withColumn("usable", F.lit(True)), ["k1", "k2", "usable"], "left")
    component = F.coalesce("component", "id")
    null_again = lambda c: F.when(c != NULL_ID, c)
    return out.select(null_again(F.col("id")).alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), null_again(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op7: links and component of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY 1),
n AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, least(vec_id, coalesce(c, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id LEFT JOIN n ON n.id = vec_id
"""
