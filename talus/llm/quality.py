"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it wholly; the last one is padded by a symbol of
its own. Each byte becomes a learned vector; learned filters look at WINDOW bytes, every STRIDE bytes, and
each keeps its largest value of a chunk. A second layer combines these into units, whose mean and
largest values over all chunks give the document's one probability by a logistic unit.

Training sees whole texts of a sample of labelled documents bounded in rows and characters, in one task: stochastic gradients with Adam,
each class weighing alike; the curve from sums to probabilities is then set on texts held back, by the classes' true shares.
Max-pooling sends a gradient to one window for each chunk and filter, so the backward pass is cheap.

Defined cases: a null or empty text is one chunk of padding; with labels of one class alone every score is 0 or 1, without labels it is
0.5; labels without id or value are ignored, repeated ones count as 1 if any is; rows that repeat a
doc_id are scored each by its text; other columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.buffers import slices, text_view
from talus.llm.toxicity import fold, labelled_sample

CHUNK, OVERLAP, WINDOW, STRIDE = 512, 64, 8, 2
PAD, WIDTH, FILTERS, UNITS = 256, 8, 64, 32
#: Windows of a chunk, chunks that a text of some bytes has, and chunks that are scored at a time.
PLACES = (CHUNK - WINDOW) // STRIDE + 1
GROUP = 128


@dataclass
class Net:
    """The weights; ``slope`` and ``shift`` lead from the last sum to a probability."""

    bytes_: np.ndarray  # a vector for each byte and for padding
    filters: np.ndarray  # (window x width, filters)
    filter_bias: np.ndarray
    units: np.ndarray
    unit_bias: np.ndarray
    out: np.ndarray  # of the units' means and largest values
    out_bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)[:7]]

    @classmethod
    def new(cls, r: np.random.Generator) -> Net:
        draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        return cls(
            draw(257, WIDTH, scale=0.5), draw(WINDOW * WIDTH, FILTERS, scale=0.18), zero(FILTERS), draw(FILTERS, UNITS, scale=0.25), zero(UNITS),
            draw(2 * UNITS, scale=0.2), zero(1),
        )

    def pack(self) -> bytes:
        return np.concatenate([*[a.ravel() for a in self.arrays()], [self.slope, self.shift]]).astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, held: bytes) -> Net:
        flat, like, at = np.frombuffer(held, np.float32), cls.new(np.random.default_rng(0)), 0
        found = []
        for a in like.arrays():
            found.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        return cls(*found, float(flat[at]), float(flat[at + 1]))

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest value in each chunk, after the rectifier, and the place of it."""
        best = np.empty((len(chunks), FILTERS), np.float32)
        place = np.empty((len(chunks), FILTERS), np.int64)
        for lo in range(0, len(chunks), GROUP):
            part = chunks[lo : lo + GROUP]
            vectors = self.bytes_[part]
            step = vectors.strides
            windows = np.lib.stride_tricks.as_strided(vectors, (len(part), PLACES, WINDOW * WIDTH), (step[0], step[1] * STRIDE, step[2]))
            values = windows.reshape(-1, WINDOW * WIDTH) @ self.filters
            values = values.reshape(len(part), PLACES, FILTERS)
            at = values.argmax(axis=1)
            place[lo : lo + GROUP] = at
            best[lo : lo + GROUP] = np.take_along_axis(values, at[:, None], axis=1)[:, 0]
        return np.maximum(best + self.filter_bias, 0), place

    def sums(self, chunks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The last sums of texts whose chunks begin at ``starts``.

        A product's last bits depend on a row's place in the matrix, so equal chunks are worked out once.
        """
        _, first, kind = np.unique(np.ascontiguousarray(chunks).view(f"V{chunks.itemsize * CHUNK}").ravel(), return_index=True, return_inverse=True)
        units = np.maximum(self.pooled(chunks[first])[0] @ self.units + self.unit_bias, 0)[kind]
        count = np.diff(starts, append=len(chunks))[:, None]
        doc = np.concatenate([np.add.reduceat(units.astype(np.float64), starts) / count, np.maximum.reduceat(units, starts)], axis=1)
        return (doc * self.out.astype(np.float64)).sum(axis=1) + float(self.out_bias[0])

    def score(self, chunks: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.sums(chunks, starts) + self.shift, -30, 30)))


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of bytes and padding, each text's first chunk) of texts as bytes."""
    sizes = np.diff(offsets)
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(sizes)), counts)
    at = (np.arange(len(text)) - starts[text]) * step
    place = at[:, None] + np.arange(CHUNK)
    inside = place < sizes[text][:, None]
    held = np.append(data, 0)
    return np.where(inside, held[np.where(inside, offsets[text][:, None] + place, len(data))], PAD).astype(np.int32), starts


def _gradients(net: Net, chunks: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighed cross-entropy, in the order of ``arrays``."""
    pooled, place = net.pooled(chunks)
    units = np.maximum(pooled @ net.units + net.unit_bias, 0)
    counts = np.diff(starts, append=len(chunks))
    mean = np.add.reduceat(units, starts) / counts[:, None].astype(np.float32)
    top = np.maximum.reduceat(units, starts)
    doc = np.concatenate([mean, top], axis=1)
    error = (1 / (1 + np.exp(-np.clip(doc @ net.out + net.out_bias, -30, 30))) - y) * weight
    back = error[:, None] * net.out[None, :]
    text = np.repeat(np.arange(len(counts)), counts)
    # the mean shares its gradient, the largest value sends it to one chunk
    first = units == top[text]
    seen = np.cumsum(first, axis=0)
    first &= seen - np.where(starts[text][:, None] > 0, seen[np.maximum(starts - 1, 0)][text], 0) == 1
    to_units = (back[text, :UNITS] / counts[text][:, None] + back[text, UNITS:] * first) * (units > 0)
    to_pooled = (to_units @ net.units.T) * (pooled > 0)
    to_bytes, to_filters = np.zeros_like(net.bytes_), np.zeros_like(net.filters)
    for f in range(FILTERS):
        rows = np.flatnonzero(to_pooled[:, f])
        if not len(rows):
            continue
        window = chunks[rows[:, None], place[rows, f][:, None] * STRIDE + np.arange(WINDOW)]
        g = to_pooled[rows, f].astype(np.float32)
        to_filters[:, f] = np.einsum("r,rx->x", g, net.bytes_[window].reshape(len(rows), -1))
        spread = np.zeros((WINDOW, len(net.bytes_)), np.float32)
        for k in range(WINDOW):
            spread[k] = np.bincount(window[:, k], g, minlength=len(net.bytes_))
        to_bytes += spread.T @ net.filters[:, f].reshape(WINDOW, WIDTH)
    return [to_bytes, to_filters, to_pooled.sum(axis=0), pooled.T @ to_units, to_units.sum(axis=0), doc.T @ error, np.array([error.sum()])]


def _curve(sums: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through sums, by damped Newton steps; a row counts ``each`` times."""
    x = np.column_stack([sums, np.ones(len(sums))])
    w, each = np.array([1.0, 0.0]), each * len(each) / each.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (each * p * (1 - p) + 1e-6)[:, None]) + 2 * np.eye(2), x.T @ (each * (p - y)) + 2 * (w - [1, 0]))
        w = w - 0.7 * step
    return float(max(w[0], 0.0)), float(w[1])


def excerpts(texts: list[str], labels: np.ndarray, r: np.random.Generator) -> list[str]:
    """The first words of a sentence of every third text labelled 1: a good text stays good where it is short."""
    out = []
    for text in [t for t, y in zip(texts, labels) if y][::3]:
        sentence = text[: 1 << 16].split(". ")
        words = sentence[r.integers(len(sentence))].split(" ")
        out.append(" ".join(words[: r.integers(1, 12)]).rstrip(".,") + ".")
    return out


def train(texts: list[str], labels: np.ndarray, shares: tuple[float, float] = (1.0, 1.0), epochs: int = 24, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Net:
    """Fit on labelled texts held in memory; the caller bounds them. ``shares``: the sampled parts of the classes 0 and 1."""
    r = np.random.default_rng(seed)
    net = Net.new(r)
    own = len(texts)
    if not own or labels.all() or not labels.any():
        net.slope, net.shift = 0.0, 0.0 if not own else 30.0 if labels.all() else -30.0
        return net
    # a sixth of the texts only sets the curve; excerpts of the others are learned too
    order = r.permutation(own)
    held, used = order[: own // 6], order[own // 6 :]
    if not len(held) or labels[held].all() or not labels[held].any() or labels[used].all() or not labels[used].any():
        held = used = order
    short = excerpts([texts[i] for i in used], labels[used], r)
    labels, used = np.append(labels, np.ones(len(short), bool)), np.append(used, own + np.arange(len(short)))
    column = pa.array([*texts, *short], pa.large_string())
    chunks, starts = chunked(*text_view(column))
    counts = np.diff(starts, append=len(chunks))
    y = labels.astype(np.float32)
    weight = np.where(labels, 0.5 / labels[used].mean(), 0.5 / (1 - labels[used].mean())).astype(np.float32)
    state = [(np.zeros_like(a, np.float64), np.zeros_like(a, np.float64)) for a in net.arrays()]
    step = 0
    for epoch in range(epochs):
        shuffled = r.permutation(used)
        for lo in range(0, len(shuffled), batch):
            part = shuffled[lo : lo + batch]
            begin = np.cumsum(counts[part]) - counts[part]
            at = np.repeat(starts[part] - begin, counts[part]) + np.arange(counts[part].sum())
            step += 1
            now = rate * min(1.0, step / 20) * (1 - 0.9 * epoch / epochs)
            for a, g, (m, v) in zip(net.arrays(), _gradients(net, chunks[at], begin, y[part], weight[part] / len(part)), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    at = np.sort(held)
    begin = np.cumsum(counts[at]) - counts[at]
    rows = np.repeat(starts[at] - begin, counts[at]) + np.arange(counts[at].sum())
    net.slope, net.shift = _curve(net.sums(chunks[rows], begin), y[at], np.where(labels[at], 1 / shares[1], 1 / shares[0]))
    return net


def scored(docs: DataFrame, net: Net) -> DataFrame:
    """``row`` (all columns of ``docs``) and score."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.compute.struct_field(batch.column("row"), "text").cast(pa.large_string())
            for part in slices(iter([pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"])]), "text", 1 << 18):
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(net.score(*chunked(*text_view(part.column("text")))))], ["row", "score"])

    return held.mapInArrow(run, T.StructType([held.schema["row"], T.StructField("score", T.DoubleType())]))


def fitted(docs: DataFrame, labels: DataFrame, most: int = 1500, most_chars: int = 5 << 20, **options) -> Net:
    """A network from the labelled documents whose fold of five isn't 0; ``labels`` (doc_id, label), ``options`` of ``train``.

    The sample, of about ``most`` rows a class and ``most_chars`` characters, is gathered in one task.
    """
    allowed = labels.where(fold(F.col("doc_id"), 5) != 0)
    sample, shares = labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), allowed, most, most_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = pa.Table.from_batches(batches).to_pydict() if (batches := list(batches)) else {"doc_id": [], "text": [], "label": []}
        rows = sorted(zip(columns["doc_id"], (t or "" for t in columns["text"]), (y == 1 for y in columns["label"])))
        yield pa.RecordBatch.from_pydict({"net": [train([t for _, t, _ in rows], np.array([y for *_, y in rows], bool), shares, **options).pack()]})

    found = sample.repartition(1).mapInArrow(run, "net binary").first()
    return train([], np.zeros(0, bool)) if found is None else Net.unpack(found.net)
