"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Each chunk is embedded, convolved with learned filters and max-pooled; the
mean and the maximum of the chunks' values give one probability.  Training
is minibatch Adam by hand-written gradients on a bounded sample of labelled
rows (``sample`` documents of at most ``max_chars``), followed by an exact
fit of the last layer.  Scoring is narrow, in blocks of fixed size, so memory
doesn't grow with a text.

Defined results: null or empty text is one chunk of padding; without
labelled rows of both kinds every score is the share of label 1 (0.5 if
there are no labels); repeated rows are scored each; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.toxicity import fit_logistic, remainder, sample_of


@dataclass(frozen=True)
class Network:
    """Shape, training sample and steps; nothing grows with the data."""

    chunk: int = 512
    overlap: int = 64
    dim: int = 8
    width: int = 8
    stride: int = 4
    filters: int = 24
    sample: int = 3000
    max_chars: int = 20_000
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    block: int = 512
    seed: int = 17
    holdout: int = 2
    parts: int = 4


def chunks(text: str | None, m: Network) -> np.ndarray:
    """Overlapping chunks of a text's bytes; zero bytes pad the last."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    step = m.chunk - m.overlap
    n = max(1, -(-(len(raw) - m.overlap) // step))
    padded = np.zeros((n - 1) * step + m.chunk, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, m.chunk)[::step]


@dataclass
class Weights:
    e: np.ndarray
    k: np.ndarray
    b: np.ndarray
    w: np.ndarray

    @staticmethod
    def start(m: Network) -> Weights:
        rng = np.random.default_rng(m.seed)
        e = rng.normal(0, 0.5, (256, m.dim)).astype(np.float32)
        k = rng.normal(0, 0.2, (m.width * m.dim, m.filters)).astype(np.float32)
        return Weights(e, k, np.zeros(m.filters, np.float32), np.zeros(2 * m.filters + 1, np.float32))


def columns(block: np.ndarray, e: np.ndarray, m: Network) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a block of chunks: their bytes and their embeddings."""
    windows = np.lib.stride_tricks.sliding_window_view(block, m.width, axis=1)[:, :: m.stride]
    return windows, e[block][:, (np.arange(windows.shape[1]) * m.stride)[:, None] + np.arange(m.width)].reshape(len(block), windows.shape[1], m.width * m.dim)


def pooled(block: np.ndarray, p: Weights, m: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Max over a chunk's windows of each filter, and where it was."""
    windows, cols = columns(block, p.e, m)
    z = (cols.reshape(-1, cols.shape[2]) @ p.k).reshape(*cols.shape[:2], -1) + p.b
    at = z.argmax(1)
    return np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0), at, windows, cols


def combine(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum of the chunks of each text."""
    n = np.diff(np.append(first, len(values)))[:, None]
    return np.hstack([np.add.reduceat(values, first) / n, np.maximum.reduceat(values, first)])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(block: np.ndarray, first: np.ndarray, y: np.ndarray, p: Weights, m: Network) -> list[np.ndarray]:
    """Gradients of the mean log loss over some whole texts."""
    values, at, windows, cols = pooled(block, p, m)
    x = combine(values, first)
    g = (sigmoid(x @ p.w[1:] + p.w[0]) - y) / len(y)
    n = np.diff(np.append(first, len(values)))
    owner = np.repeat(np.arange(len(y)), n)
    f = m.filters
    back = (g[:, None] * p.w[1 : f + 1] / n[:, None])[owner]
    top = (values == x[owner, f:]) & (values > 0)
    # chunks that share a maximum share its gradient
    ties = np.maximum(np.add.reduceat(top.astype(np.float32), first), 1)
    back = (back + np.where(top, (g[:, None] * p.w[f + 1 :] / ties)[owner], 0)) * (values > 0)
    rows = np.arange(len(block))[:, None]
    chosen = cols[rows, at]
    g_k = np.einsum("nf,nfd->df", back, chosen)
    g_cols = back[:, :, None] * p.k.T[None]
    where = windows[rows, at].ravel()
    g_e = np.stack([np.bincount(where, c, 256) for c in g_cols.reshape(-1, m.dim).T], 1)
    return [x.astype(np.float32) for x in (g_e, g_k, back.sum(0), np.append(g.sum(), g @ x))]


def train(texts: list[str | None], y: np.ndarray, m: Network) -> Weights:
    """Weights fitted to some whole texts and their 0/1 labels."""
    p = Weights.start(m)
    if not len(y) or not 0 < y.sum() < len(y):
        p.w[0] = 0.0 if not len(y) else (30.0 if y.all() else -30.0)
        return p
    p.w[0] = np.log(y.mean() / (1 - y.mean()))
    made = [chunks(t, m) for t in texts]
    rng = np.random.default_rng(m.seed)
    parts = [p.e, p.k, p.b, p.w]
    mean, square = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    p.w[1:] = rng.normal(0, 0.1, len(p.w) - 1)
    step = 0
    for epoch in range(m.epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), m.batch):
            pick = order[a : a + m.batch]
            first = np.cumsum([0, *(len(made[i]) for i in pick[:-1])])
            step += 1
            rate = m.rate * (1 - epoch / m.epochs)
            for x, g, u, v in zip(parts, gradients(np.concatenate([made[i] for i in pick]), first, y[pick], p, m), mean, square, strict=True):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                x -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    x = np.concatenate([document_values([t], p, m) for t in texts])
    p.w = fit_logistic(x.astype(float), y).astype(np.float32)
    return p


def document_values(texts: list[str | None], p: Weights, m: Network) -> np.ndarray:
    """The last layer's inputs of some texts, in blocks of chunks."""
    out, first, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        if held:
            every = np.concatenate(held)
            values = np.concatenate([pooled(every[a : a + m.block], p, m)[0] for a in range(0, len(every), m.block)])
            out.append(combine(values, np.array(first)))
            held.clear()
            first.clear()
            size = 0

    for text in texts:
        c = chunks(text, m)
        first.append(size)
        held.append(c)
        size += len(c)
        if size >= m.block:
            flush()
    flush()
    return np.concatenate(out) if out else np.zeros((0, 2 * m.filters), np.float32)


def fit(docs: DataFrame, labels: DataFrame, m: Network = Network()) -> Weights:
    """A network fitted on a bounded sample of the labelled rows."""
    rows = sample_of(docs, labels, "quality", m).where(F.coalesce(F.length("text"), F.lit(0)) <= m.max_chars).select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text for r in rows], np.array([r.label for r in rows], float), m)


def score(docs: DataFrame, p: Weights, m: Network = Network()) -> DataFrame:
    """``(doc_id, score)`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            texts = batch.column(1)
            x = np.concatenate([document_values([t.as_py() for t in texts[a : a + 64]], p, m) for a in range(0, len(texts), 64)] or [np.zeros((0, 2 * m.filters))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(x @ p.w[1:] + p.w[0]).astype(float), pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, score double")


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, m: Network = Network()) -> DataFrame:
    """The rows of the ``op7`` query."""
    out = score(docs, fit(docs, labels, m), m)
    return out.select("doc_id", (remainder(F.col("doc_id"), m.parts) == m.holdout).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
