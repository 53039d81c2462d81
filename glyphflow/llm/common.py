"""Reading tables, shared-folder checkpoints and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator; it sorts before every other.
NULL_ID = -(1 << 63)
#: So many edges, counted first, may be joined in one task: 16 MB.
ONE_TASK_EDGES = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def giving_back(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, for mapInArrow; at the end of a task the worker gives its free memory back to the system.

    Else the allocators keep it, and workers that wait for their next task, of which an
    executor has more than it has cores, each go on holding what their largest task took.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return emit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage there.

    The folder is the session's ``spark.checkpoint.dir``.  Only where all runs in one
    process, as in tests, a temporary folder stands for it: elsewhere executors couldn't
    see each other's files there.  With ``drop_shuffles`` the shuffle files that led to
    it are deleted as soon as it is written; else they stay until the driver happens to
    collect its garbage.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query takes the setting when it is made
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def without(df: DataFrame, results: tuple[str, ...], *own: str) -> DataFrame:
    """``df`` without the columns that are named, letter case apart, like a result; columns that the operator reads stay."""
    taken = {c.lower() for c in results} - {c.lower() for c in own}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of(column: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as an unsigned long."""
    return F.crc32(F.encode(column, "UTF-8"))


def join_summary(rows: DataFrame, summary: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``summary``, which has one row for each key (longs or ints, never null), so that Spark can split a hot key.

    An adaptive skew join splits a key's rows only if both sides are plain exchanges.  An
    aggregate already dealt by the key would spare its exchange, so the key is made anew.
    """
    own = {k: f"__{k}" for k in keys}
    right = summary.select(*(F.col(k).bitwiseXOR(F.lit(0)).alias(own[k]) if k in own else F.col(k) for k in summary.columns))
    return rows.join(right.hint("merge"), [F.col(k) == F.col(x) for k, x in own.items()], how).drop(*own.values())


def _with_min(edges: DataFrame) -> DataFrame:
    """(a, b, m): each edge with the least neighbour of its end ``a``."""
    return join_summary(edges, edges.groupBy("a").agg(F.min("b").alias("m")), ["a"])


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges that come, by merging the smaller label into the larger's tree."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = list(range(len(ids)))

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            label[max(x, y)] = min(x, y)
    roots = np.array([find(i) for i in range(len(ids))], dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[roots])], names=["id", "component_id"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component_id) for every id that has an edge; component_id is the least id of the component.

    ``edges`` has two long columns, ``a`` and ``b``, in any order, with repeats and
    loops allowed.  Up to ``one_task`` different edges are joined by one executor task,
    whose memory that number bounds.  More alternate large-star and small-star steps,
    whose work per round is in proportion to the edges and whose rounds are
    logarithmic, until a round changes nothing.  No edge or label reaches the driver:
    only a count and a checksum per round do.
    """
    up = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    up = checkpoint(up)
    if up.count() <= one_task:
        return checkpoint(up.coalesce(1).mapInArrow(giving_back(_union_find), "id bigint, component_id bigint"))
    sign = None
    while True:
        both = up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_min(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        small = _with_min(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        up = checkpoint(small)
        now = up.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    roots = up.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return up.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
