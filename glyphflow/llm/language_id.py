"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``SEGMENT`` bytes.  A gated recurrent layer reads each
segment forwards, another backwards, and a softmax over both states labels every
position; a document's probabilities are the means over all its positions.  The whole
text is read.  The network is trained here, in numpy, by backpropagation through time
over every position's label, with a fixed seed.

Training uses a bounded sample: of each label at most ``PER_LANGUAGE`` rows, those with the
least hash (fewer if there are more than ``MOST_ROWS / PER_LANGUAGE`` labels), and of each
row one piece at a hashed place.  Pieces have ``PIECE`` characters, or more if a label has
few rows, so that it still gives ``PER_LANGUAGE * PIECE`` characters if its texts have them.
However large the sample is, ``UPDATES`` steps are made, each on as many segments of every
language.

Defined results: a text that is null or without letters is ``und`` with score 0, and so
is every text if there was nothing to learn from; rows without a label are predicted
like others; equal texts get equal answers; between equally probable languages the first
by name is taken; texts are read whole, whatever their length; an empty table gives no
rows; columns of ``docs`` stay, but for ones named like the results (``lang_pred``,
``score``), which give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import crc32_of, fresh, giving_back, table, without

SEGMENT = 64
HIDDEN = 8
PER_LANGUAGE = 1000
MOST_ROWS = 200_000
PIECE = 200
UPDATES = 400
UNKNOWN = "und"
_BATCH, _RATE = 256, 0.02
_LANES = 2048  # segments that run through the network side by side
_PAD = 0  # fills a last segment; its update gate stays shut, so the state passes it unchanged


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _gates(inputs: np.ndarray, state: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Update gate, reset gate, candidate and the recurrent part of the candidate."""
    k = state.shape[1]
    u = state @ recurrent
    zr = _sigmoid(inputs[:, : 2 * k] + u[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = _sigmoid((inputs[:, 2 * k :] + r * u[:, 2 * k :]) * 2) * 2 - 1  # tanh
    return z, r, n, u[:, 2 * k :]


@dataclass
class Network:
    """inputs and recurrent: for each direction; the input of a byte is a row of a table."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.output, self.bias]

    def states(self, x: np.ndarray, direction: int) -> np.ndarray:
        """States at every position, time first."""
        steps = range(x.shape[1]) if direction == 0 else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((len(x), self.recurrent[0].shape[0]), dtype=np.float32)
        out = np.empty((x.shape[1], *h.shape), dtype=np.float32)
        for t in steps:
            z, _, n, _ = _gates(self.inputs[direction][x[:, t]], h, self.recurrent[direction])
            h = h + z * (n - h)
            out[t] = h
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position of equally long byte rows, time first."""
        both = np.concatenate((self.states(x, 0), self.states(x, 1)), axis=2)
        p = both @ self.output + self.bias
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def document_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Means over the positions of each document; zeros for an empty one."""
        rows, doc = segments(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for a in range(0, len(rows), _LANES):
            x = rows[a : a + _LANES]
            p = self.position_probabilities(x)
            p *= (x.T != _PAD)[:, :, None]
            np.add.at(total, doc[a : a + _LANES], p.sum(axis=0))
        weight = total.sum(axis=1, keepdims=True)
        return total / np.where(weight > 0, weight, 1)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes in rows of SEGMENT bytes, and each row's document."""
    count = -(-np.diff(offsets) // SEGMENT)
    doc = np.repeat(np.arange(len(count)), count)
    at = offsets[doc] + (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * SEGMENT
    place = at[:, None] + np.arange(SEGMENT)
    inside = place < offsets[doc + 1][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], _PAD).astype(np.uint8) if len(doc) else np.zeros((0, SEGMENT), np.uint8), doc


def _backward(net: Network, x: np.ndarray, states: np.ndarray, grad: np.ndarray, direction: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction's input table and recurrent matrix, through time."""
    steps, _ = states.shape[:2]
    recurrent = net.recurrent[direction]
    d_in, d_rec = np.zeros_like(net.inputs[direction]), np.zeros_like(recurrent)
    order = list(range(steps)) if direction == 0 else list(range(steps - 1, -1, -1))
    carried = np.zeros_like(states[0])
    all_da = np.empty((steps, len(x), recurrent.shape[1]), dtype=np.float32)
    for k in range(steps - 1, -1, -1):
        t = order[k]
        h = states[order[k - 1]] if k else np.zeros_like(carried)
        z, r, n, un = _gates(net.inputs[direction][x[:, t]], h, recurrent)
        dh = carried + grad[t]
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        du = np.concatenate((dz, dr, dn * r), axis=1)
        all_da[t] = np.concatenate((dz, dr, dn), axis=1)
        d_rec += h.T @ du
        carried = dh * (1 - z) + du @ recurrent.T
    flat, da = x.T.ravel(), all_da.reshape(-1, recurrent.shape[1])
    by = np.argsort(flat, kind="stable")
    have, first = np.unique(flat[by], return_index=True)
    d_in[have] = np.add.reduceat(da[by], first, axis=0)
    return d_in, d_rec


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, seed: int = 1, updates: int = UPDATES) -> Network:
    """A network fitted to labelled pieces of text."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    table_ = lambda: (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
    square = lambda: (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
    net = Network(languages, [table_(), table_()], [square(), square()], (rng.standard_normal((2 * hidden, len(languages))) * 0.3).astype(np.float32), np.zeros(len(languages), np.float32))

    def shut() -> None:
        for w in net.inputs:
            w[_PAD] = 0
            w[_PAD, :hidden] = -40

    shut()
    if len(languages) < 2:
        return net
    offsets = np.cumsum([0, *map(len, texts)])
    x, doc = segments(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    y = np.searchsorted(languages, labels)[doc]
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    each = -(-_BATCH // len(languages))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, updates + 1):
        pick = np.concatenate([rng.choice(own, each) for own in of])
        xb, yb = x[pick], y[pick]
        states = [net.states(xb, d) for d in (0, 1)]
        both = np.concatenate(states, axis=2)
        logits = both @ net.output + net.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(yb)), yb] -= 1
        real = (xb.T != _PAD)[:, :, None]
        p = (p * real / max(1, real.sum())).astype(np.float32)
        d_both = p @ net.output.T
        grads = [_backward(net, xb, states[d], d_both[:, :, d * hidden : (d + 1) * hidden], d) for d in (0, 1)]
        flat = [grads[0][0], grads[1][0], grads[0][1], grads[1][1], np.tensordot(both, p, axes=([0, 1], [0, 1])), p.sum(axis=(0, 1))]
        rate = _RATE * (1 - (step - 1) / updates)
        for w, g, (m, v) in zip(net.parameters(), flat, moments):  # Adam
            m += (g - m) * 0.1
            v += (g * g - v) * 0.01
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        shut()
    return net


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> tuple[list[bytes], list[str]]:
    """Pieces of at most ``per_language`` rows of each language, those with the least hash."""
    text, h = F.col("text"), F.xxhash64(F.lit(11), "id", "text")
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    labelled = labelled.where(text.rlike(r"\p{L}")).withColumn("unit", F.shiftrightunsigned(h, 11) / float(1 << 53))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return [], []
    per_language = max(1, min(per_language, most_rows // len(counts)))
    # a share of the hashes that holds about twice the rows wanted, so that few rows are sorted
    by_language = lambda of: F.element_at(F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], of(r["count"])))), F.col("lang"))
    few = labelled.where(F.col("unit") < by_language(lambda n: min(1.0, 2 * per_language / n + 1e-3)))
    size = by_language(lambda n: max(PIECE, -(-PER_LANGUAGE * PIECE // min(n, per_language))))
    room = F.greatest(F.length("text") - size, F.lit(0)) + 1
    few = few.select("lang", "unit", F.substring(text, F.pmod(F.xxhash64(F.lit(12), h), room).cast("int") + 1, size).alias("piece"))
    # each language has its own limit, kept in every task before rows move
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "piece"))
    rows = few.withColumn("rank", rank).where(F.col("rank") <= per_language).collect()
    rows = sorted((r for r in rows if r["piece"]), key=lambda r: (r["unit"], r["lang"], r["piece"]))
    return [r["piece"].encode() for r in rows], [r["lang"] for r in rows]


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learnt from."""
    return F.coalesce(F.pmod(crc32_of(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its mean probability, in columns named ``into``."""
    docs = without(docs, into, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    columns = docs.columns
    source = docs.withColumn(fresh(docs, "letters"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Network | None = sent.value
        for batch in batches:
            data, offsets = hashing.text_buffers(batch.column(columns.index(text_col)))
            letters = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(letters), UNKNOWN, dtype=object), np.zeros(len(letters))
            row = 0
            while model is not None and row < len(letters):
                to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + hashing.SLICE_BYTES, side="right")) - 1)
                p = model.document_probabilities(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
                best = p.argmax(axis=1)
                langs[row:to] = np.array(model.languages, dtype=object)[best]
                scores[row:to] = np.clip(p[np.arange(len(p)), best], 0, 1).round(6)  # beyond that the rows beside it would show
                row = to
            langs[~letters], scores[~letters] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, *into])

    schema = T.StructType([*docs.schema, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    return source.mapInArrow(giving_back(emit), schema)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the rows that aren't held out, or None if none has a label."""
    texts, labels = training_sample(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    return train(texts, labels) if texts else None


def query(spark, sf_dir: str) -> DataFrame:
    """The contract of op3: the language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
