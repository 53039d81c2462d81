"""SentencePiece encoding and decoding over a relational lattice.

A text gets a space in front and is cut into units wherever no piece can reach across:
between two characters that stand next to each other in no piece (in front of each word,
for one).  The distinct units of a batch of documents are exploded into their substrings of
bounded length and joined to the piece table; the edges found are grouped by unit again, and
a higher-order ``aggregate`` runs Viterbi over them: the split with the highest sum of piece
scores, the longer last piece among equals.  A character that no piece holds becomes its
UTF-8 bytes' pieces.  Documents then look their units up.

A unit is worked out once however often it occurs.  Batches send their distinct units,
dealt over buckets by hash; buckets send back ids only, in the order the units came in, and
a batch's answers meet its compressed rows in one sorted stream, which is written out some
rows at a time.  The piece table is the vocabulary of one model file, whose size the file
bounds, and is broadcast.  Units are told apart by 64 bits and checked by another 64; on a
collision a batch compares the units themselves.  A unit of more than ``LONG_UNIT``
characters, all of them neighbours in some piece, would be a lattice of unbounded size in
one row; it is split by the same search in the worker that needs it, as are the units of a
batch that a rerun task meets in another order.

Decoding joins the pieces' bytes and drops the first space: it gives back every text
exactly.  Defined results: a null text has null ids; an empty text, and an empty table, has
none; spaces, control characters and characters outside the vocabulary survive the round
trip; special pieces' names in a text are ordinary text; repeated rows are encoded row by
row; columns of ``docs`` stay, but for ones named like a result (``piece_ids``, ``decoded``),
which give way to it.  Ids outside the vocabulary and null ids decode to nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import giving_back, table, without

LONG_UNIT = 1024
#: Least number of buckets, and how many there are for each task of the lattice if that gives more.
BUCKETS, BUCKETS_EACH = 1024, 4
#: Tasks of the lattice for each shuffle partition: a unit has some 25 edges, which are sorted in memory.
_TASKS_EACH = 4
#: Bytes of text in a batch; a longer document is a batch of its own.
BATCH_BYTES = 8 << 20
#: What a character outside the vocabulary costs beyond the rarest piece.
_UNKNOWN_PENALTY = 10.0
_LEAD = 4
#: Joins units on their way to a bucket.  It is in no piece of two characters, so it is always a unit of its own, sent as an empty one.
_MARK = "\0"
_PAIR_BITS = 20


def _pair_places(points: np.ndarray) -> np.ndarray:
    """A place below 2**_PAIR_BITS for each two neighbouring code points."""
    return (points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - _PAIR_BITS)


@dataclass
class Pieces:
    """A vocabulary: pieces with plain spaces, their ids and scores, and the ids of the 256 byte pieces."""

    texts: list[str]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]
    n_ids: int

    def __post_init__(self) -> None:
        self.by_text = {t: (s, i) for t, i, s in zip(self.texts, self.ids, self.scores)}
        self.longest = max(map(len, self.texts), default=1)
        self.unknown = min(self.scores, default=0.0) - _UNKNOWN_PENALTY
        if any(_MARK in t for t in self.texts if len(t) > 1):
            raise ValueError("a piece holds a null character")
        # pairs of neighbours by hash; two pairs in one place only leave a cut out, never make one
        self.neighbours = np.zeros(1 << _PAIR_BITS, dtype=bool)
        inside = "\0\0".join(t for t in self.texts if len(t) > 1)
        if inside:
            points = np.frombuffer(inside.encode("utf-32-le"), dtype=np.uint32)
            self.neighbours[_pair_places(points)[(points[:-1] != 0) & (points[1:] != 0)]] = True

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no pieces for bytes")
        return cls([sp.id_to_piece(i).replace("▁", " ") for i in plain], plain, [sp.get_score(i) for i in plain], byte_ids, n)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Which code points begin a unit, but for the first of a text."""
        out = np.ones(len(points), dtype=bool)
        if len(points) > 1:
            out[1:] = ~self.neighbours[_pair_places(points)] | (points[1:] == 0) | (points[:-1] == 0)
        return out

    def split(self, unit: str) -> list[int]:
        """Ids of one unit: the search that the lattice's fold makes, for units of any length."""
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, len(unit) + 1):
            top = None
            for start in range(max(0, end - self.longest), end):
                found = self.by_text.get(unit[start:end])
                if found is None and start == end - 1:
                    found = (self.unknown, -1)
                if found is not None and (top is None or best[start][0] + found[0] > top[0]):
                    top = (best[start][0] + found[0], start, found[1])
            best.append(top)
        out: list[int] = []
        at = len(unit)
        while at:
            _, start, i = best[at]
            out += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(unit[start:at].encode())]
            at = start
        return out[::-1]

    def reach(self) -> dict[str, int]:
        """For each beginning of _LEAD characters the length of the longest piece that has it."""
        out: dict[str, int] = {}
        for t in self.texts:
            if len(t) >= _LEAD:
                out[t[:_LEAD]] = max(out.get(t[:_LEAD], 0), len(t))
        return out

    def bytes_of_ids(self) -> list[bytes]:
        out = [b""] * self.n_ids
        for t, i in zip(self.texts, self.ids):
            out[i] = t.encode()
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _text_batches(batches: Iterator[pa.RecordBatch], at_column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(key, rows) of at most BATCH_BYTES of text; the key follows from the texts and their order alone."""
    for batch in batches:
        column = batch.column(at_column)
        data, offsets = hashing.text_buffers(column)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
            digest = hashlib.blake2b(data[offsets[at] : offsets[to]], digest_size=8)
            digest.update(np.diff(offsets[at : to + 1]).tobytes() + valid[at:to].tobytes())
            yield int.from_bytes(digest.digest(), "little", signed=True), batch.slice(at, to - at)
            at = to


@dataclass
class _Slice:
    """Some documents' units: byte bounds in ``data``, two hashes of each, lengths in characters, and each document's first unit."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    chars: np.ndarray
    hash: np.ndarray
    check: np.ndarray
    offsets: np.ndarray


def _unit_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of data[start : start + size], eight bytes at a time."""
    words = np.ndarray((len(data),), dtype="<u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    low = np.concatenate(((np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1), [~np.uint64(0)]))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55)
    g = h ^ np.uint64(0x5851F42D4C957F2D)
    some, done = None, 0
    while some is None or len(some):
        s, n = (start, size) if some is None else (start[some], size[some])
        w = words[s + done] & low[np.minimum(n - done, 8)]
        a, b = (h, g) if some is None else (h[some], g[some])
        a, b = hashing.mix(a + w), (b ^ w) * np.uint64(0xD6E8FEB86659FD93)
        b ^= b >> np.uint64(29)
        if some is None:
            h, g = a, b
        else:
            h[some], g[some] = a, b
        done += 8
        some = np.flatnonzero(size > done) if some is None else some[n > done]
    return h, g


def _slices(pieces: Pieces, column: pa.Array) -> Iterator[_Slice]:
    """The units of a string column's rows, some rows at a time; an empty or null text has none."""
    data, offsets = hashing.text_buffers(column)
    row = 0
    while row < len(offsets) - 1:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + hashing.SLICE_BYTES, side="right")) - 1)
        own = offsets[row : to + 1] - offsets[row]
        full = np.diff(own) > 0
        raw = np.insert(data[offsets[row] : offsets[to]], own[:-1][full], 32)  # a space in front of each text
        first = own + np.concatenate(([0], np.cumsum(full)))
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        cut = pieces.cuts(points)
        lead = np.arange(len(raw)) if len(points) == len(raw) else np.flatnonzero((raw & 0xC0) != 0x80)
        cut[np.searchsorted(lead, first[:-1][full])] = True
        char = np.flatnonzero(cut)
        start = lead[char]
        size, chars = np.diff(np.append(start, len(raw))), np.diff(np.append(char, len(points)))
        yield _Slice(raw, start, size, chars, *(_unit_hashes(raw, start, size) if len(start) else (np.zeros(0, np.uint64),) * 2), np.searchsorted(start, first))
        row = to


def _bytes_at(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start : start + size] for each, one after the other, and where each ends up."""
    to = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(start - to[:-1], size) + np.arange(to[-1])], to


def _distinct(slices: list[_Slice]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct units of a batch by hash: (texts, hashes, lengths in characters, the place in them of each slice's units)."""
    h = np.concatenate([s.hash for s in slices]) if slices else np.zeros(0, np.uint64)
    if not len(h):
        return pa.array([], pa.string()), h, np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in slices]
    check = np.concatenate([s.check for s in slices])
    coded = pa.array(h).dictionary_encode()
    inverse, found = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.empty(len(found), dtype=np.int64)
    first[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
    bounds = np.concatenate(([0], np.cumsum([len(s.hash) for s in slices])))
    if not (check[first][inverse] == check).all():  # two units of one hash: by their bytes, then
        seen: dict[bytes, int] = {}
        inverse = np.array([seen.setdefault(s.data[a : a + n].tobytes(), len(seen)) for s in slices for a, n in zip(s.start.tolist(), s.size.tolist())])
        first = np.empty(len(seen), dtype=np.int64)
        first[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
    del coded, check
    order = np.lexsort((first, h[first]))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    parts, lengths = [], []
    for i, s in enumerate(slices):
        own = first[(first >= bounds[i]) & (first < bounds[i + 1])] - bounds[i]
        raw, to = _bytes_at(s.data, s.start[own], s.size[own])
        parts.append((np.flatnonzero((first >= bounds[i]) & (first < bounds[i + 1])), pa.StringArray.from_buffers(len(own), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw)), s.chars[own]))
    texts = pa.concat_arrays([t for _, t, _ in parts])
    back = np.empty(len(first), dtype=np.int64)
    back[np.concatenate([x for x, _, _ in parts])] = np.arange(len(first))
    lengths = np.concatenate([x for _, _, x in parts])
    return texts.take(pa.array(back[order])), h[first][order], lengths[back[order]], [place[inverse[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each unit; rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def unit_ids(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(bucket, unit, ids, seen) of distinct units (bucket, unit, seen), which are and stay partitioned by bucket."""
    spark = units.sparkSession
    unknown = pieces.n_ids  # stands for a character without a piece
    # both are made of the vocabulary of a model file, about 1 MB: pieces, and how far pieces with some beginning reach
    known = F.broadcast(spark.createDataFrame(list(zip(pieces.texts, map(int, pieces.ids))), "piece string, id int"))
    reach = F.broadcast(spark.createDataFrame(list(pieces.reach().items()), "lead string, longest int"))
    # a number that rises from unit to unit, so that the edges come sorted to the aggregation
    numbered = units.withColumn("u", F.monotonically_increasing_id())
    starts = numbered.select("bucket", "u", "unit", "seen", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s")).withColumn("lead", F.substring("unit", F.col("s") + 1, F.lit(_LEAD)))
    far = F.least(F.col("s") + F.coalesce("longest", F.lit(_LEAD - 1)), F.length("unit"))
    spans = starts.join(reach, "lead", "left").select("bucket", "u", "unit", "seen", "s", F.explode(F.sequence(F.col("s") + 1, far)).alias("e"))
    edges = spans.withColumn("piece", F.expr("substring(unit, s + 1, e - s)")).join(known, "piece", "left").where("id is not null or e = s + 1")
    # end, start and id in one long, which sorts by end and then start
    place = F.shiftleft(F.col("e").cast("long"), 48) + F.shiftleft(F.col("s").cast("long"), 32) + F.coalesce("id", F.lit(unknown)).cast("long")
    lattice = edges.select("u", "bucket", "unit", "seen", place.alias("place")).groupBy("u", "bucket").agg(F.first("unit").alias("unit"), F.first("seen").alias("seen"), F.sort_array(F.collect_list("place")).alias("edges"))
    scores = [pieces.unknown] * (pieces.n_ids + 1)
    for i, x in zip(pieces.ids, pieces.scores):
        scores[i] = float(x)
    # one text literal, which folds to an array, is planned faster than thousands of numbers
    score_of = F.split(F.lit(",".join(map(repr, scores))), ",").cast("array<double>")

    def end(x: Column) -> Column:
        return F.shiftright(x, 48).cast("int")

    def start(x: Column) -> Column:
        return F.shiftright(x, 32).bitwiseAND(F.lit(0xFFFF)).cast("int")

    def piece_id(x: Column) -> Column:
        return x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    def step(best: Column, x: Column) -> Column:
        score = F.get(best, start(x))["score"] + F.get(score_of, piece_id(x))
        new = F.array(F.struct(score.alias("score"), start(x).alias("s"), piece_id(x).alias("id")))
        size = F.size(best)
        return F.when(size == end(x), F.concat(best, new)).when(score > F.get(best, size - 1)["score"], F.concat(F.slice(best, F.lit(1), size - 1), new)).otherwise(best)

    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(0).alias("id")))
    solved = lattice.select("bucket", "unit", "seen", F.aggregate("edges", origin, step).alias("best"))

    bytes_of = F.array(*(F.lit(i) for i in pieces.byte_ids))

    def fallback(unit: Column, s: Column) -> Column:
        raw = F.hex(F.encode(F.substring(unit, s + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda k: F.get(bytes_of, F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int")))

    def back(acc: Column, _: Column) -> Column:
        x = F.get(F.col("best"), acc["at"])
        ids = F.when(x["id"] == unknown, fallback(F.col("unit"), x["s"])).otherwise(F.array(x["id"]))
        return F.when(acc["at"] > 0, F.struct(x["s"].alias("at"), F.concat(ids, acc["ids"]).alias("ids"))).otherwise(acc)

    walk = F.aggregate("best", F.struct((F.size("best") - 1).alias("at"), F.expr("cast(array() as array<int>)").alias("ids")), back)["ids"]
    return solved.select("bucket", "unit", walk.alias("ids"), "seen")


def encode(docs: DataFrame, text_col: str = "text", pieces: Pieces | None = None) -> DataFrame:
    """``docs`` with piece_ids, an array of ids."""
    docs = without(docs, ("piece_ids",), text_col)
    spark, columns = docs.sparkSession, docs.columns
    at_text = columns.index(text_col)
    pieces = pieces or Pieces.load(default_model())
    sent = spark.sparkContext.broadcast(pieces)
    partitions = _TASKS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(BUCKETS, BUCKETS_EACH * partitions)
    id_type = np.dtype("<u2" if pieces.n_ids <= 1 << 16 else "<i4")

    def units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _text_batches(batches, 0):
            texts, hashes, lengths, _ = _distinct(list(_slices(sent.value, rows.column(0))))
            short = lengths <= LONG_UNIT
            bucket, at = np.unique(_dealt(hashes[short], buckets), return_index=True)
            texts = pc.replace_substring(texts.filter(pa.array(short)), _MARK, "")
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(texts)).astype(np.int32)), texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), key), pa.int64()), pa.array(bucket, pa.int32()), pc.binary_join(lists, _MARK)], names=["batch", "bucket", "units"])

    dealt = docs.select(text_col).mapInArrow(giving_back(units_of), "batch bigint, bucket int, units string").repartition(partitions, "bucket")
    # the batch goes along so that both readers of the dealt units have the same columns and share one exchange
    unit = F.when(F.col("unit") == "", F.lit(_MARK)).otherwise(F.col("unit")).alias("unit")
    exploded = dealt.select(F.col("bucket").alias("bucket"), F.col("batch").alias("seen"), F.explode(F.split("units", _MARK)).alias("unit")).select("bucket", "seen", unit)
    distinct = exploded.groupBy("bucket", "unit").agg(F.min("seen").alias("seen"))

    def answered_in(left: pa.Table, right: pa.Table) -> pa.Table:
        """The ids of each batch's units of one bucket, in the order they came in."""
        asked = pc.split_pattern(left["units"].combine_chunks(), _MARK)
        units = pc.if_else(pc.equal(asked.flatten(), ""), _MARK, asked.flatten())
        at = pc.index_in(units, value_set=right["unit"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = right["ids"].combine_chunks()
        start, n = ids.offsets.to_numpy()[:-1].astype(np.int64), np.diff(ids.offsets.to_numpy())
        flat, to = _bytes_at(ids.values.to_numpy().astype(id_type), start[at], n[at])
        counts, cut = n[at].astype("<u2"), asked.offsets.to_numpy() - asked.offsets[0].as_py()
        blob = lambda x, a, b: x[a:b].tobytes()
        bounds = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        return pa.table({"batch": left["batch"], "bucket": left["bucket"], "counts": pa.array([blob(counts, a, b) for a, b in bounds], pa.binary()), "ids": pa.array([blob(flat, to[a], to[b]) for a, b in bounds], pa.binary())})

    answers = dealt.groupBy("bucket").cogroup(unit_ids(distinct, pieces).groupBy("bucket")).applyInArrow(answered_in, "batch bigint, bucket int, counts binary, ids binary")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for key, rows in _text_batches(batches, at_text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([None], pa.int32()), pa.array([squeeze.compress(sink.getvalue())], pa.binary()), pa.array([None], pa.binary())], names=["batch", "bucket", "counts", "ids"])

    blobs = docs.mapInArrow(giving_back(packed), "batch bigint, bucket int, counts binary, ids binary")

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by batch: the answers by bucket, then the packed rows."""
        own: Pieces = sent.value
        key, counts, ids = None, {}, {}
        for batch in batches:
            for now, bucket, a, b in zip(*(batch.column(i) for i in range(4))):
                if now.as_py() != key:
                    key, counts, ids = now.as_py(), {}, {}
                if bucket.is_valid:
                    counts[bucket.as_py()], ids[bucket.as_py()] = a.as_py(), b.as_py()
                    continue
                rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(a.as_buffer())).read_next_batch()
                slices = list(_slices(own, rows.column(at_text)))
                texts, _, lengths, places = _distinct(slices)
                offsets = [s.offsets for s in slices]
                del slices
                n = np.frombuffer(b"".join(counts.values()), dtype="<u2").astype(np.int64)
                flat = np.frombuffer(b"".join(ids.values()), dtype=id_type)
                here = lengths > LONG_UNIT if len(n) == (lengths <= LONG_UNIT).sum() else np.ones(len(lengths), dtype=bool)
                size, start = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
                if not here.all():
                    size[~here] = n
                    start[~here] = np.cumsum(n) - n
                if here.any():
                    more = [own.split(t) for t in texts.filter(pa.array(here)).to_pylist()]
                    base = 0 if here.all() else len(flat)
                    flat = np.concatenate((flat[:base], np.array([i for x in more for i in x], dtype=id_type)))
                    size[here] = [len(x) for x in more]
                    start[here] = base + np.cumsum(size[here]) - size[here]
                row = 0
                for place, cut in zip(places, offsets):
                    out, to = _bytes_at(flat, start[place], size[place])
                    part = rows.slice(row, len(cut) - 1)
                    bounds = pa.array(to[cut].astype(np.int32), mask=np.append(part.column(at_text).is_null().to_numpy(zero_copy_only=False), False))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(bounds, pa.array(out.astype(np.int32)))], names=[*columns, "piece_ids"])
                    row += len(cut) - 1

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", piece_ids array<int>"
    met = answers.unionByName(blobs).repartition(partitions, "batch").sortWithinPartitions("batch", F.asc_nulls_last("bucket"))
    return met.mapInArrow(giving_back(looked_up), schema)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", pieces: Pieces | None = None) -> DataFrame:
    """``encoded`` with decoded, the text that the ids stand for."""
    encoded = without(encoded, ("decoded",), ids_col)
    # one text literal, which folds to an array; two characters for each byte
    raw = F.split(F.lit(",".join(b.hex() for b in (pieces or Pieces.load(default_model())).bytes_of_ids())), ",")
    whole = F.array_join(F.transform(F.col(ids_col), lambda i: F.get(raw, i)), "")
    text = F.make_valid_utf8(F.unhex(F.when(F.startswith(whole, F.lit("20")), F.substring(whole, 3, 1 << 30)).otherwise(whole)).cast("string"))
    return encoded.withColumn("decoded", text)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's number of pieces, a digest of its ids, and whether decoding gives the text back."""
    pieces = Pieces.load(default_model())
    found = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces=pieces), pieces=pieces)
    return found.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_xxhash64"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
