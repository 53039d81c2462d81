"""Removal of repeated passages by level-wise doubling of repeated windows.

A word goes if a window of ``window`` consecutive words covers it whose word
sequence also starts earlier (smaller document id, or same document and earlier
start).  Levels of doubled length, from at least ``LEAST`` words up to ``window``, find
those windows without moving one row per window:

1. Each window is stood for by its anchors: of the parts of half its length the one with
   the least hash, of that one's halves again the least, and so on down to the first
   level.  Equal windows have equal anchors at equal places, so no repeat is lost.
   The windows that share their anchors are one context, and only contexts move.
2. At each level contexts are grouped by their anchor of that length.  One whose anchor
   occurs once is dropped; one that occurred whole before is removed at once; the first
   occurrences of several different contexts are extended to anchors of twice the length,
   until none survive or the length is half the window.
3. Survivors are extended to full length: every full window of a surviving context
   is grouped by a 128-bit hash, and those that aren't the first are removed.

Each task first settles what repeats within its own batch, so a passage that a
third of all documents share sends one row per batch, not one per document.  The
levels shuffle hashes and positions; texts are shuffled once, to meet the surviving
contexts and then the removed ranges of their document, by id and 128 bits of the text.
A level's shuffle files are deleted once its survivors are written.

Defined results: a null text has no words and keeps none; a document shorter than
the window loses nothing; a null id sorts before all others; rows with the same id
count as one place in the order, so between them only the start decides, and two
equal starts under one id spare each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import hashing
from .common import NULL_ID, checkpoint, table

WINDOW = 20
#: The first level's windows have so many words or, if the window can't be halved to that, up to twice as many.
LEAST = 5
ROW = ["id", "k1", "k2"]
#: In the sign of a place (first word, end): nothing has to be looked up any more, the range goes.
GONE = np.int64(-1 << 63)


def _later(doc: np.ndarray, start: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which occurrences of equal keys aren't at the least (doc, start) of them."""
    order = np.lexsort((start, doc, *keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), dtype=bool)
    out[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return out


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping ranges of equal length order (sorted by row and lo, hi rising with lo)."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
    at = np.flatnonzero(new)
    return row[at], lo[at], hi[np.append(at[1:], len(row)) - 1]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def level_lengths(window: int) -> list[int]:
    """The lengths of the anchors, shortest first."""
    out = [max(1, window // 2)]
    while out[0] // 2 >= LEAST:
        out.insert(0, out[0] // 2)
    return out


def _anchors(window: int):
    lengths = level_lengths(window)
    half = lengths[-1]
    width = window - half + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _column(batch, "id").to_numpy(), [_column(batch, k).to_numpy() for k in ("k1", "k2")]
            parts = []
            for w in hashing.word_slices(_column(batch, "text"), hashing.PLAIN):
                n = len(w.hashes)
                if n < window:
                    continue
                gram = hashing.ranges_hash(w.hashes, np.arange(n - half + 1), np.arange(half, n + 1))
                best = hashing.sliding_argmin(gram, width)
                row = w.doc_of_word()
                start = np.flatnonzero(w.offsets[row[: len(best)] + 1] - np.arange(len(best)) >= window)
                if not len(start):
                    continue
                anchor, doc = best[start], row[start]
                new = np.ones(len(start), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                lo, hi = start[at], start[np.append(at[1:], len(start)) - 1] + window
                context = hashing.mix(hashing.ranges_hash(w.hashes, lo, hi) + (anchor[at] - lo).astype(np.uint64))
                base = w.offsets[doc[at]]
                place, grams = anchor[at], [gram[anchor[at]]]
                for long, short in zip(lengths[:0:-1], lengths[-2::-1]):
                    gram = hashing.ranges_hash(w.hashes, np.arange(n - short + 1), np.arange(short, n + 1))
                    place = hashing.sliding_argmin(gram, long - short + 1)[place]
                    grams.insert(0, gram[place])
                parts.append((context, doc[at] + w.first_row, lo - base, hi - base, *grams))
            if not parts:
                continue
            context, row, lo, hi, *grams = (np.concatenate(x) for x in zip(*parts))
            gone = _later(ids[row], lo, context)
            r, a, b = _merged(row[gone], lo[gone], hi[gone])
            stay = ~gone
            key = hashing.mix(ids[r].view(np.uint64) + a.astype(np.uint64))  # deals the ranges that need no more look out evenly
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((lo[stay] << 32 | hi[stay], a << 32 | b | GONE))),
                    pa.array(np.concatenate((context[stay], key)).view(np.int64)),
                    *(pa.array(x[np.concatenate((row[stay], r))]) for x in (ids, *keys)),
                    *(pa.array(np.concatenate((g[stay], key)).view(np.int64)) for g in grams),
                ],
                names=["place", "context", *ROW, *(f"anchor{n}" for n in lengths)],
            )

    return emit


def _full_windows(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _column(batch, "id").to_numpy(), [_column(batch, k).to_numpy() for k in ("k1", "k2")]
            ranges = _column(batch, "ranges")
            flat, bounds = ranges.flatten(), ranges.offsets.to_numpy() - ranges.offsets[0].as_py()
            all_lo, all_hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            parts = []
            for w in hashing.word_slices(_column(batch, "text"), hashing.PLAIN):
                a, b = bounds[w.first_row], bounds[w.first_row + w.n_docs]
                row = np.repeat(np.arange(w.n_docs), np.diff(bounds[w.first_row : w.first_row + w.n_docs + 1]))
                count = all_hi[a:b] - all_lo[a:b] - window + 1
                first = np.repeat(np.cumsum(count) - count, count)
                rel = np.repeat(all_lo[a:b], count) + np.arange(count.sum()) - first
                row = np.repeat(row, count)
                at = w.offsets[row] + rel
                second = hashing.mix(w.hashes ^ np.uint64(0x5851F42D4C957F2D))
                parts.append((hashing.ranges_hash(w.hashes, at, at + window), hashing.ranges_hash(second, at, at + window), row + w.first_row, rel))
            h1, h2, row, lo = (np.concatenate(x) for x in zip(*parts))
            gone = _later(ids[row], lo, h1, h2)
            yield pa.RecordBatch.from_arrays([pa.array(gone), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(pa.array(x[row]) for x in (ids, *keys)), pa.array(lo.astype(np.int32)), pa.array((lo + window).astype(np.int32))], names=["gone", "h1", "h2", "id", "k1", "k2", "lo", "hi"])

    return emit


def removed_ranges(rows: DataFrame, window: int) -> DataFrame:
    """(id, k1, k2, lo, hi): word ranges to remove of ``rows`` (id, k1, k2, text); ranges may overlap."""
    lengths = level_lengths(window)
    live = rows.mapInArrow(_anchors(window), "place bigint, context bigint, id bigint, k1 bigint, k2 bigint, " + ", ".join(f"anchor{n} bigint" for n in lengths))
    gone, low = F.col("place") < 0, F.lit(0x7FFFFFFF)
    start, end = F.shiftright("place", 32).bitwiseAND(low).cast("int"), F.col("place").bitwiseAND(low).cast("int")
    settled = []
    for n in lengths:
        anchor = f"anchor{n}"
        live = live.repartition(anchor)
        by_anchor = W.partitionBy(anchor)
        several = F.min("context").over(by_anchor) != F.max("context").over(by_anchor)
        if n == lengths[0]:  # equal contexts have equal anchors of all lengths: they meet here already
            rank = F.rank().over(W.partitionBy(anchor, "context", gone).orderBy("id", start))
            live = live.withColumns({"rank": rank, "several": several}).withColumn("place", F.when(F.col("rank") > 1, F.col("place").bitwiseOR(F.lit(int(GONE)))).otherwise(F.col("place")))
            live = live.where(gone | F.col("several")).drop("rank")
        else:
            live = live.withColumn("several", several).where("several")
        # a spent anchor goes, and so do the level's shuffle files: the next level's need not stand beside them
        live = checkpoint(live.drop("several", anchor), drop_shuffles=True)
        if n == lengths[0]:
            settled.append(live.where(gone).select(*ROW, start.alias("lo"), end.alias("hi")))
            live = live.where(~gone)
    survivors = live.groupBy(*ROW).agg(F.collect_list(F.struct(start.alias("lo"), end.alias("hi"))).alias("ranges"))
    full = rows.join(survivors, ROW).select(*ROW, "text", "ranges").mapInArrow(_full_windows(window), "gone boolean, h1 bigint, h2 bigint, id bigint, k1 bigint, k2 bigint, lo int, hi int")
    later = full.withColumn("rank", F.rank().over(W.partitionBy("h1", "h2", "gone").orderBy("id", "lo"))).where("gone or rank > 1")
    return settled[0].unionByName(later.select(*ROW, "lo", "hi"))


def _cut(carry: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(_column(batch, "text"), _column(batch, "ranges")):
                words = (text.as_py() or "").encode().split()  # bytes.split() knows exactly the six white spaces
                out = words
                if ranges.is_valid:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    own = ranges.values
                    np.add.at(gone, own.field("lo").to_numpy(), 1)
                    np.add.at(gone, own.field("hi").to_numpy(), -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    out = [words[i] for i in np.flatnonzero(stay).tolist()]
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out).decode())
            yield pa.RecordBatch.from_arrays([*(_column(batch, c) for c in carry), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*carry, "n_words", "n_removed", "kept"])

    return cut


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``carry`` columns, n_words, n_removed, kept (the kept words joined by one space)."""
    carry = tuple(c for c in dict.fromkeys(carry) if c != id_col and c not in ("n_words", "n_removed", "kept"))
    keys = F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(7), text_col).alias("k2")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), *keys, F.col(text_col).alias("text"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(carry)))
    # without carried columns the surviving contexts and the removed ranges meet the texts in one and the same exchange
    ranges = removed_ranges(rows.select(*ROW, "text"), window).groupBy(*ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    schema = "id bigint, " + "".join(f"`__{i}` {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(carry)) + "n_words bigint, n_removed bigint, kept string"
    found = rows.join(ranges, ROW, "left").mapInArrow(_cut(["id", *(f"__{i}" for i in range(len(carry)))]), schema)
    return found.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), *(F.col(f"__{i}").alias(c) for i, c in enumerate(carry)), "n_words", "n_removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op2: counts and a digest of the kept words of every document."""
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r),
k AS (SELECT d.doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d) d ANTI JOIN x USING (doc_id, p)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
