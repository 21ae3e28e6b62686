"""Operator 7: document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, gated attention
weighs the passages, and the weighted mean is scored; only documents have
labels. The model is fitted on a bounded sample of labelled documents and
scores every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of a passage, and buckets of hashed byte trigrams.
PASSAGE, BUCKETS = 512, 512
HIDDEN, GATE = 24, 12
#: Bounds of the labelled sample that a model is fitted on: documents, and passages of all of them together (whole documents only).
SAMPLE, SAMPLE_PASSAGES = 4000, 48_000
EPOCHS, RATE, DECAY = 30, 0.01, 1e-4
#: Bytes that are worked on at once; whole passages.
CHUNK = 1024 * PASSAGE
_CLASSES = np.zeros(256, np.int64)
for _i, _bytes in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:'\"?-()", bytes(range(128, 256)), b"!#$%&*+/<=>@[\\]^_`{|}~"], 1):
    _CLASSES[list(_bytes)] = _i
_KINDS = 9
WIDTH = BUCKETS + _KINDS + 3


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (float32), and the number of passages of each text; an empty text is one empty passage."""
    sizes = np.array([len(t) for t in texts])
    many = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(many) - many
    raw = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = first[doc] + place // PASSAGE
    n = int(many.sum())
    length = np.maximum(1, np.bincount(at, minlength=n))
    out = np.zeros((n, WIDTH), np.float32)
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        tri = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(23)
        same = at[:-2] == at[2:]
        counts = np.bincount((at[:-2] * BUCKETS + tri)[same], minlength=n * BUCKETS).reshape(n, BUCKETS)
        share = counts / length[:, None]
        out[:, :BUCKETS] = np.sqrt(share)
        out[:, -3] = (counts > 0).sum(axis=1) / np.minimum(BUCKETS, length)
        out[:, -2] = 10 * (share**2).sum(axis=1)
    kinds = np.bincount(at * _KINDS + _CLASSES[raw], minlength=n * _KINDS).reshape(n, _KINDS)
    out[:, BUCKETS : BUCKETS + _KINDS] = 3 * kinds / length[:, None]
    out[:, -1] = np.log1p(length) / 6
    return out, many


@dataclass
class Model:
    """x: passage; h = tanh(x W + b); weight ~ exp(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(mean h . c + d)."""

    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple:
        """Of each passage: its encoding, the two sides of its gate, and its attention before it is weighed against the others."""
        m = self.weights
        h = np.tanh(x @ m["W"] + m["b"])
        t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
        return h, t, g, (t * g) @ m["w"]

    def pool(self, h: np.ndarray, s: np.ndarray, many: np.ndarray) -> tuple:
        """Attention weights, weighted mean and score of documents of so many passages each."""
        first = np.cumsum(many) - many
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), many))
        a /= np.repeat(np.add.reduceat(a, first), many)
        z = np.add.reduceat(h * a[:, None], first)
        return a, z, 1 / (1 + np.exp(-np.clip(z @ self.weights["c"] + self.weights["d"], -30, 30)))

    def gradients(self, x: np.ndarray, many: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of these documents."""
        m, first = self.weights, np.cumsum(many) - many
        h, t, g, s = self.encode(x)
        a, z, y = self.pool(h, s, many)
        e = ((y - labels) / len(labels)).astype(x.dtype)
        dz = np.repeat(e[:, None] * m["c"], many, axis=0)
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), many))
        dgate = ds[:, None] * m["w"]
        dt, dg = dgate * g * (1 - t**2), dgate * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ m["V"].T + dg @ m["U"].T) * (1 - h**2)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ e, "d": e.sum(keepdims=True)}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Long texts are encoded piece by piece; of a passage only its encoding and attention are kept."""
        pieces = [t[i : i + CHUNK] for t in texts for i in range(0, max(1, len(t)), CHUNK)]
        found, group, size = [], [], 0
        for k, piece in enumerate(pieces, 1):
            group.append(piece)
            size += len(piece)
            if size >= CHUNK or k == len(pieces):
                h, *_, s = self.encode(passages(group)[0])
                found.append((h, s))
                group, size = [], 0
        many = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts])
        return self.pool(np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found]), many)[-1]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Adam on the log loss of documents; deterministic for one order of bags."""
    random = np.random.default_rng(seed)
    shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    model = Model({k: (random.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()})
    m = model.weights
    if not bags or len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of good ones
        m["c"][:] = 0
        m["d"][:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) if len(labels) else 0
        return model
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(bags))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            x = np.concatenate([bags[j] for j in batch])
            many = np.array([len(bags[j]) for j in batch])
            grads = model.gradients(x, many, labels[batch])
            step += 1
            for k, grad in grads.items():
                grad = grad + DECAY * m[k]
                m1, m2 = moment[k]
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad**2 - m2)
                m[k] -= (RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out() -> Column:
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_PASSAGES) -> Model:
    """Fits on at most ``sample`` labelled documents with at most ``most`` passages together.

    Documents are taken in the order of a hash of their id, each with all its
    passages; one that does not fit any more is passed over. Held-out documents,
    null ids and null labels are left out; of several labels of one id the
    smallest counts, of several texts one. Where fewer than two labels remain,
    every score is the share of good ones.
    """
    shared.prepare(docs.sparkSession)
    place = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(place, "doc_id").limit(sample)
    )
    texts = shared.one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), "quality")
    texts = shared.keep(texts, "labelled-texts")
    sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), place.alias("place")).collect()  # at most `sample` rows of numbers
    chosen, left = [], most
    for r in sorted(sizes, key=lambda r: (r["place"], r["doc_id"])):
        many = max(1, -(-r["size"] // PASSAGE))
        if many <= left:
            chosen.append((r["doc_id"],))
            left -= many

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, quality in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = passages([text or b""])[0].astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([quality], pa.int32()), pa.array([x.tobytes()])], names=["doc_id", "quality", "x"])

    taken = texts.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id").select("doc_id", "text", "quality")
    rows = sorted(((r["doc_id"], r["quality"], bytes(r["x"])) for r in taken.mapInArrow(features, "doc_id long, quality int, x binary").collect()))
    bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH).astype(np.float32) for *_, x in rows]
    return fit(bags, np.array([q for _, q, _ in rows], np.float32))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The rows of docs with a score from 0 to 1 of their whole text; null texts score as empty ones. The new column replaces one of its name."""
    shared.prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out, chunk, size = [], [], 0
        for text in texts:
            chunk.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(chunk[-1])
            if size > CHUNK:
                out.append(model.score(chunk))
                chunk, size = [], 0
        if chunk:
            out.append(model.score(chunk))
        return pd.Series(np.concatenate(out) if out else np.zeros(0), dtype="float64")

    return docs.withColumn(column, scored("text"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains on labels and scores docs: doc_id, held_out, score, predicted.

    Repeated rows are scored each; other columns of docs take no part, whatever
    their names; very long texts are encoded piece by piece; empty tables give an empty one.
    """
    rows = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
