"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The words of benchmark items and documents are lower-cased alphanumeric runs.  The
windows of the items (``window`` consecutive words; all words of a shorter item)
become a sorted array of 64-bit hashes that every task gets; the tasks hash the
windows of their documents with prefix sums, look them up, and verify each hit word
by word, so a hash collision never counts.

What is broadcast is bounded: items are taken in blocks of at most
``block_windows`` windows (about 100 MB at the default; a single longer item is a block of
its own), one at a time.  A benchmark of usual size is one block, and its documents are
scanned once, without a shuffle.  Of more blocks each is gathered, broadcast, its
hits written to the checkpoint folder, and freed before the next; then documents fetch
their hits by id and 128 bits of their text.

Defined results: a null text has no words; an item without words has no window and
hits nothing; items with the same id count as one item; repeated documents are
judged row by row; an empty benchmark leaves all documents clean; an empty table gives no
rows; texts are read whole, whatever their length.  ``decontaminate`` gives back the
columns of ``docs`` whatever they are named; in ``find_contamination`` a carried column
that is named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import checkpoint, fresh, giving_back, join_summary

WINDOW = 10
BLOCK_WINDOWS = 1_000_000


class _Index:
    """Windows of one block of items: for each window length, sorted hashes with the words and items they stand for."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        found: dict[int, dict[int, dict[tuple[bytes, ...], set[int]]]] = {}
        for item_id, text in items:
            for w in hashing.word_slices(pa.array([text or ""]), hashing.ALNUM):
                words = [x.lower() for x in w.words(0)]
                length = min(window, len(words))
                if length:
                    for h, at in zip(*(x.tolist() for x in w.windows(length))):
                        found.setdefault(length, {}).setdefault(h, {}).setdefault(tuple(words[at : at + length]), set()).add(item_id)
        self.lengths = {n: (np.array(sorted(x), dtype=np.uint64), x) for n, x in found.items()}

    def hits(self, w: hashing.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words of the slice are in a window of an item, and the items of each document."""
        mark = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        items: dict[int, set[int]] = {}
        for length, (known, meaning) in self.lengths.items():
            hashes, at = w.windows(length)
            if not len(hashes):
                continue
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            hashes, at = hashes[hit], at[hit]
            docs = np.searchsorted(w.offsets, at, side="right") - 1
            for h, a, d in zip(hashes.tolist(), at.tolist(), docs.tolist()):
                raw = w.data[w.starts[a] : w.ends[a + length - 1]].tobytes()
                base = int(w.starts[a])
                words = tuple(raw[s - base : e - base].lower() for s, e in zip(w.starts[a : a + length].tolist(), w.ends[a : a + length].tolist()))
                if ids := meaning[h].get(words):
                    mark[a] += 1
                    mark[a + length] -= 1
                    items.setdefault(d, set()).update(ids)
        return np.cumsum(mark)[:-1] > 0, items


class _Items:
    """Items of one block; a worker makes their index once."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.items, self.window, self._index = items, window, None

    @property
    def index(self) -> _Index:
        if self._index is None:
            self._index = _Index(self.items, self.window)
        return self._index


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_windows: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_windows`` windows, at least one block; an item has at most one window for two characters."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(text) // 2 + 1
        if block and size + n > block_windows:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    yield block


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _ranges(hit: np.ndarray) -> list[dict]:
    own = np.concatenate(([False], hit, [False]))
    edge = np.flatnonzero(own[1:] != own[:-1])
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _scan(rows: DataFrame, items: _Items, hits_only: bool = False) -> DataFrame:
    """``rows`` (record, text) as (record, n_words, spans, n_hit, items)."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.index
        for batch in batches:
            n_words, spans, n_hit, items = [], [], [], []
            for w in hashing.word_slices(batch.column(1), hashing.ALNUM):
                hit, found = index.hits(w)
                n_words += w.counts.tolist()
                for d in range(w.n_docs):
                    own = _ranges(hit[w.offsets[d] : w.offsets[d + 1]]) if d in found else []
                    spans.append(own)
                    n_hit.append(sum(x["end"] - x["start"] for x in own))
                    items.append(sorted(map(str, found.get(d, ()))))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["record", "n_words", "spans", "n_hit", "items"])
            yield out.filter(pa.array([n > 0 for n in n_hit], pa.bool_())) if hits_only else out

    return rows.mapInArrow(giving_back(scan), T.StructType([rows.schema["record"], *_FOUND]))


def _united(spans: list) -> list:
    """Unions of ranges that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_united([s for x in (parts or ()) for s in x]) for parts in batch.column(2).to_pylist()]
        items = [sorted({i for x in (parts or ()) for i in x}) for parts in batch.column(3).to_pylist()]
        n_hit = [sum(x["end"] - x["start"] for x in own) for own in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _ARROW_SPANS), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["record", "n_words", "spans", "n_hit", "items"])


def _contamination(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, block_windows: int, carry: list[str]) -> DataFrame:
    """(record, n_words, spans, n_hit, items); the record has the ``carry`` columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("record"), F.col(f"`{text_col}`").alias("text"))
    blocks = item_blocks(benchmark, item_col, item_text_col, block_windows)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _scan(rows, _Items(block, window))
    # equal texts have equal hits, so these are sent by the text's digest, once for each text and block
    keyed = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    found = []
    while block is not None:
        texts = keyed.select(F.struct("k1", "k2").alias("record"), "text")
        found.append(checkpoint(_scan(texts, _Items(block, window), hits_only=True).dropDuplicates(["record"])))
        block, more = more, next(blocks, None)
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionByName(x)
    hits = hits.groupBy(F.col("record.k1").alias("k1"), F.col("record.k2").alias("k2")).agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    # an empty block counts the words of every text
    counted = _scan(keyed.select(F.struct("record", "k1", "k2").alias("record"), "text"), _Items([], window)).select("record.*", "n_words")
    met = join_summary(counted, hits, ["k1", "k2"], "left").select("record", "n_words", "spans", "items")
    return met.mapInArrow(giving_back(_unite), T.StructType([rows.schema["record"], *_FOUND]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``carry`` columns, n_words, spans (word ranges that are hit), n_hit, items (sorted ids as strings).

    With ``carry`` holding the text column the caller has the text beside its spans.
    """
    results = [f.name for f in _FOUND]
    keep = [c for c in dict.fromkeys((id_col, *carry)) if c == id_col or c.lower() not in results]
    found = _contamination(docs, benchmark, text_col, item_col, item_text_col, window, block_windows, keep)
    return found.select(*(F.col("record").getField(c).alias(c) for c in keep), *results)


def remove_spans(text: str | None, spans: list) -> str | None:
    """The text without the hit words and the characters between them."""
    if not spans or text is None:
        return text
    raw = text.encode()
    w = next(iter(hashing.word_slices(pa.array([text]), hashing.ALNUM, slice_bytes=len(raw) + 1)))
    out, at = [], 0
    for s in spans:
        out.append(raw[at : w.starts[s["start"]]])
        at = int(w.ends[s["end"] - 1])
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_hit_fraction: float = 0.0, how: str = "document", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without contamination, with its own columns.

    how="document": documents go of whose words more than ``max_hit_fraction`` are hit.
    how="span": documents stay, without the hit words.
    """
    if how not in ("document", "span"):
        raise ValueError("how must be 'document' or 'span'")
    names = docs.columns
    found = _contamination(docs, benchmark, text_col, item_col, item_text_col, window, block_windows, names)
    own = [F.col("record").getField(c).alias(c) for c in names]
    if how == "document":
        return found.where(F.col("n_hit") <= F.col("n_words") * max_hit_fraction).select(*own)
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [remove_spans(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = [pa.array(text, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select(*own, F.col("spans").alias(fresh(docs, "spans"))).mapInArrow(giving_back(cut), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op10: counts and digests of every document."""
    from .common import table

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
