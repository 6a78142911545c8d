"""Operator 8: quality probability from a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. Each byte has a learned embedding; learned filters of
``2 * GROUP`` bytes at every ``GROUP``-th byte are rectified and max-pooled over a chunk; mean and maximum over the
chunks of the whole document are combined by a logistic layer into one probability.

Training: Adam on the log loss of a bounded sample of labelled rows (about ``TRAIN_DOCS``, by a hash of the id). Tasks cut
``TRAIN_POOL`` random chunks of a text at most, so the driver gets chunks alone; a training step looks at ``TRAIN_CHUNKS`` of
them, a prediction at all chunks of a text.

Edge cases: a null or empty text is one chunk without bytes and gets the score the network gives it; a text shorter than
a chunk is padded; very long texts take time in proportion; with no training rows every score is 0.5; several labels of
one id vote, ties count as 1; repeated rows give repeated results; an empty table gives an empty result; null ids have
no label; only the columns named are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import resting, slices, turn_of

TRAIN_DOCS, TRAIN_CHUNKS, EPOCHS, BATCH = 3000, 6, 10, 48
#: Chunks of one text that training gets at most: 12 KB of 16-bit values.
TRAIN_POOL = 12
CHUNK, OVERLAP, GROUP, EMBED, FILTERS = 512, 64, 4, 4, 24
PAD = 256


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes, padded at the end: (chunks, CHUNK) of byte values or PAD."""
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(data) - OVERLAP) // step))
    flat = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (flat.strides[0] * step, flat.strides[0]))


def training_chunks(text: str | None) -> np.ndarray:
    """At most ``TRAIN_POOL`` chunks from anywhere in a text, the same ones whenever they are drawn."""
    data = (text or "").encode()
    chunks = chunks_of(data)
    if len(chunks) <= TRAIN_POOL:
        return chunks
    return chunks[np.sort(np.random.default_rng(zlib.crc32(data)).choice(len(chunks), TRAIN_POOL, replace=False))]


@dataclass
class Net:
    embed: np.ndarray  # 257 x EMBED; the last row, for padding, stays zero
    filters: np.ndarray  # 2 * GROUP * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    base: float

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(max over a chunk's positions, where, the embedded groups)."""
        groups = self.embed[chunks].reshape(len(chunks), CHUNK // GROUP, GROUP * EMBED)
        half = GROUP * EMBED
        y = groups[:, :-1] @ self.filters[:half]
        y += groups[:, 1:] @ self.filters[half:]
        at = y.argmax(1) if self.train else None
        return np.maximum(y.max(1) + self.bias, 0), at, groups

    train = False

    def score(self, texts: list[str | None]) -> list[float]:
        parts = [chunks_of((t or "").encode()) for t in texts]
        sizes = np.array([len(p) for p in parts])
        z = np.concatenate([self.pooled(c)[0] for c in _blocks(parts, 256)])
        ends = np.cumsum(sizes)
        mean = np.add.reduceat(z, ends - sizes, axis=0) / sizes[:, None]
        most = np.maximum.reduceat(z, ends - sizes, axis=0)
        x = np.concatenate([mean, most], 1) @ self.out + self.base
        return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).astype(float).tolist()


def _blocks(parts: list[np.ndarray], rows: int) -> Iterator[np.ndarray]:
    """The chunks of all texts in blocks that fit a core's cache."""
    held, count = [], 0
    for p in parts:
        for lo in range(0, len(p), rows):
            held.append(p[lo : lo + rows])
            count += len(held[-1])
            if count >= rows:
                yield np.concatenate(held)
                held, count = [], 0
    if held:
        yield np.concatenate(held)


def gradients(net: Net, chunks: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[np.ndarray, ...], float]:
    """Gradients of the mean weighted log loss (with a small decay of ``out``) by embeddings, filters, bias, out and base, and
    that loss, for texts of ``sizes`` chunks each."""
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    z, at, groups = net.pooled(chunks)
    mean, most = np.add.reduceat(z, starts, axis=0) / sizes[:, None], np.maximum.reduceat(z, starts, axis=0)
    h = np.concatenate([mean, most], 1).astype(z.dtype)
    p = 1 / (1 + np.exp(-np.clip(h @ net.out + z.dtype.type(net.base), -30, 30)))
    g = ((p - y) * weight / len(sizes)).astype(z.dtype)
    gh = g[:, None] * net.out
    tied = z == most[doc]
    tied = tied / np.add.reduceat(tied, starts, axis=0, dtype=np.int64)[doc]  # equal chunks share what goes to the maximum
    gz = gh[doc, :FILTERS] / sizes[doc][:, None] + gh[doc, FILTERS:] * tied
    gz = np.where(z > 0, gz, 0).astype(z.dtype)
    who, which = np.nonzero(gz)
    where, value = at[who, which], gz[who, which]
    window = np.concatenate([groups[who, where], groups[who, where + 1]], 1)
    gf = np.zeros_like(net.filters)
    np.add.at(gf.T, which, value[:, None] * window)
    ge_rows = chunks[who[:, None], where[:, None] * GROUP + np.arange(2 * GROUP)].ravel()
    ge_values = (value[:, None] * net.filters.T[which]).reshape(-1, EMBED)
    ge = np.stack([np.bincount(ge_rows, ge_values[:, k], 257) for k in range(EMBED)], 1)
    ge[PAD] = 0
    loss = -float((weight * np.where(y == 1, np.log(np.maximum(p, 1e-30)), np.log(np.maximum(1 - p, 1e-30)))).mean()) + 0.5e-4 * float((net.out**2).sum())
    return (ge, gf, gz.sum(0), g @ h + 1e-4 * net.out, g.sum(keepdims=True)), loss


def fit(samples: list[tuple[str | None, int]], seed: int = 5) -> Net:
    """Train on (text, 0 or 1) pairs."""
    return fit_chunks([(training_chunks(t), y) for t, y in samples], seed)


def fit_chunks(samples: list[tuple[np.ndarray, int]], seed: int = 5) -> Net:
    """Train on (chunks of a text, 0 or 1) pairs."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(rng.normal(0, 0.5, (257, EMBED)).astype(f32), rng.normal(0, 0.25, (2 * GROUP * EMBED, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.1, 2 * FILTERS).astype(f32), 0.0)
    net.embed[PAD] = 0
    if len({y for _, y in samples}) < 2:
        net.out[:] = 0
        net.base = 0.0 if not samples else 2.0 * (2 * samples[0][1] - 1)
        return net
    net.train = True
    parts = [chunks for chunks, _ in samples]
    ys = np.array([y for _, y in samples], f32)
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean())) ** 0.5  # halfway to balanced classes
    params = [net.embed, net.filters, net.bias, net.out, np.zeros(1, f32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        order = rng.permutation(len(samples))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            own = [parts[r] if len(parts[r]) <= TRAIN_CHUNKS else parts[r][np.sort(rng.choice(len(parts[r]), TRAIN_CHUNKS, replace=False))] for r in rows]
            sizes = np.array([len(p) for p in own])
            chunks = np.concatenate(own)
            net.base = float(params[4][0])
            grads, _ = gradients(net, chunks, sizes, ys[rows], weight[rows])
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(f32)
    net.base, net.train = float(params[4][0]), False
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Net:
    """Fit on about ``train_docs`` rows of ``docs`` that ``labels`` marks; the sample of labels has at most twice as many rows and is
    broadcast, and chunks of at most twice as many texts again reach the driver."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    share = min(1.0, train_docs / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    marks = marks.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).limit(2 * train_docs)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(marks), "id").select(F.col("id").cast("string").alias("id"), "y", "t").limit(4 * train_docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("quality")
        for batch in slices(batches, "t"):
            chunks = [training_chunks(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chunks, pa.binary())], ["id", "y", "chunks"])

    cuts = sorted(sample.mapInArrow(resting(cut), "id string, y int, chunks binary").collect(), key=lambda r: (r.id, bytes(r.chunks)))
    return fit_chunks([(np.frombuffer(r.chunks, np.int16).reshape(-1, CHUNK), r.y) for r in cuts])


def predict(docs: DataFrame, net: Net, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, with (score, predicted)."""
    kind = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_of("quality")
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(batch.column(1).to_pylist()), pa.float64())], ["row", "score"])

    found = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")).mapInArrow(resting(run), f"row {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
