"""Operator 1: mixing to target weights with soft membership.

A classifier learned from a labelled table gives each document a posterior over
domains. Projected-gradient least squares then finds nonnegative rates for the
documents such that the expected tokens of every domain, each document counted
with its posterior, match the targets. The rates live in the cluster; an
iteration sends only sums over all documents to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

#: Bound of the labelled sample that the classifier is fitted on, in documents; each adds at most a bit for every feature.
SAMPLE = 4000
#: Features: a word's CRC-32 modulo WORDS is in the text; then tenths of capitals among ASCII letters, and of different words among all.
WORDS = 1 << 16
FEATURES = WORDS + 22
#: A feature that deviates from independence of the domains by d (chi-square) is scaled by (d / (d + SOFT)) ** 2: none is left out, chance counts little.
SOFT = 20.0
EPOCHS, RATE, DECAY = 150, 0.06, 1e-4
ITERATIONS, ENOUGH, REWRITE = 40, 1e-7, 8
#: Features of so many documents are worked on at once in training.
AT_ONCE = 1_000_000


def features(texts: list[str | None], path: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of each whole text as it is packed (its ids and the closing one), and its different features."""
    many, sums = tokens.tokenizer(path).counts(texts)
    found = []
    for text, words in zip(texts, sums, strict=True):
        mine = np.unique(words % WORDS)
        if len(words):
            codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            capitals = int(np.count_nonzero(codes - np.uint8(65) < 26))
            letters = capitals + int(np.count_nonzero(codes - np.uint8(97) < 26))
            mine = np.concatenate([mine, [WORDS + 10 * capitals // max(1, letters), WORDS + 11 + 10 * len(mine) // len(words)]])
        found.append(mine)
    return many + 1, found


def packed(found: np.ndarray) -> bytes:
    """Numbers or, if that is shorter, a bit for every feature; the first byte says which."""
    if 4 * len(found) < FEATURES // 8:
        return b"\0" + found.astype("<u4").tobytes()
    bits = np.zeros(FEATURES, bool)
    bits[found] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], "<u4") if raw[:1] == b"\0" else np.flatnonzero(np.unpackbits(np.frombuffer(raw[1:], np.uint8), count=FEATURES))


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # (FEATURES, domains)
    bias: np.ndarray
    path: str  # of the tokenizer

    def sums(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """(n, domains) from the features of so many rows."""
        return np.stack([np.bincount(row, self.weights[feature, k], n) for k in range(len(self.domains))], axis=1) + self.bias

    def logits(self, found: list[np.ndarray]) -> np.ndarray:
        return self.sums(np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64), len(found))

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posteriors) of each text."""
        many, found = features(texts, self.path)
        return many, softmax(self.logits(found))


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[bytes], y: np.ndarray, domains: list[str], path: str) -> DomainModel:
    """Adam on the log loss over all features of all documents; gradients are added up a part of the documents at a time."""
    one = np.eye(len(domains))[y]
    model = DomainModel(domains, np.zeros((FEATURES, len(domains))), np.log(one.mean(axis=0) + 1e-6), path)
    held = np.zeros_like(model.weights)
    for raw, k in zip(rows, y, strict=True):
        held[unpacked(raw), k] += 1
    expected = held.sum(axis=1, keepdims=True) * one.mean(axis=0)
    deviation = ((held - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=1, keepdims=True)
    scale = (deviation / (deviation + SOFT)) ** 2
    w, b = np.zeros_like(model.weights), model.bias
    sizes = np.cumsum([len(unpacked(r)) for r in rows])
    edges = np.searchsorted(sizes, np.arange(AT_ONCE, sizes[-1] + AT_ONCE, AT_ONCE), "right")
    cuts = sorted({0, *np.minimum(edges, len(rows)).tolist(), len(rows)})
    moments = [np.zeros_like(v) for v in (w, w, b, b)]

    def part(at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        found = [unpacked(r) for r in rows[at:end]]
        return np.repeat(np.arange(end - at), [len(f) for f in found]), np.concatenate(found)

    whole = part(*cuts) if len(cuts) == 2 else None
    for step in range(1, EPOCHS + 1):
        grads = [np.zeros_like(w), np.zeros_like(b)]
        model.weights = w * scale
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            row, col = whole or part(at, end)
            e = (softmax(model.sums(row, col, end - at)) - one[at:end]) / len(rows)
            for k in range(len(domains)):
                grads[0][:, k] += np.bincount(col, e[row, k], FEATURES)
            grads[1] += e.sum(axis=0)
        grads[0] = scale * grads[0] + DECAY * w
        for k, (v, g) in enumerate(zip((w, b), grads, strict=True)):
            m1, m2 = moments[2 * k], moments[2 * k + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g**2 - m2)
            v -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    model.weights = w * scale
    return model


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, tokenizer: str | None = None) -> DomainModel:
    """Softmax regression on at most ``sample`` labelled documents, chosen by a hash of their id.

    labelled: (doc_id, domain). Null ids and domains are left out; of several
    domains of one id the smallest counts, of several texts one. With one domain,
    its posterior is 1; with none, the model has the single domain ``other``.
    ``tokenizer``: path of the tokenizer file that the corpus is packed with.
    """
    shared.prepare(docs.sparkSession)
    path = tokenizer or tokens.default_tokenizer_path()
    known = (
        labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).where("doc_id is not null and domain is not null")
        .groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64(F.col("doc_id"), F.lit("domains")), "doc_id").limit(sample)
    )
    texts = shared.one_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"), "domain")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [packed(f) for f in features(batch.column(1).to_pylist(), path)[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["doc_id", "domain", "x"])

    # at most `sample` rows of at most FEATURES / 8 bytes
    rows = sorted((r["doc_id"], r["domain"], bytes(r["x"])) for r in texts.mapInArrow(found, "doc_id long, domain string, x binary").collect())
    domains = sorted({d for _, d, _ in rows}) or ["other"]
    if len(domains) < 2:
        return DomainModel(domains, np.zeros((FEATURES, len(domains))), np.zeros(len(domains)), path)
    return fit([x for *_, x in rows], np.array([domains.index(d) for _, d, _ in rows]), domains, path)


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """The rows of docs with ``tokens`` (of the whole text as it is packed, long) and ``posterior`` (array of the model's domains), which replace columns of these names."""
    shared.prepare(docs.sparkSession)

    @F.pandas_udf("tokens long, posterior array<double>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        words, shares = model.posteriors(texts.to_list())
        return pd.DataFrame({"tokens": words, "posterior": list(shares)})

    made = docs.drop("tokens", "posterior").withColumn("__scored", scored("text"))
    return made.select("*", "__scored.tokens", "__scored.posterior").drop("__scored")


def _rate(start: Column, steps: list[list[float]]) -> Column:
    """The rate after these gradient steps: a fold, each step projected to nonnegative rates."""
    if not steps:
        return start
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in s)) for s in steps))
    dot = lambda s: F.aggregate(F.zip_with(s, F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda x, v: x + v)
    return F.aggregate(rows, start, lambda w, s: F.greatest(F.lit(0.0), w - dot(s)))


def fit_rates(scored: DataFrame, targets: list[float], iterations: int = ITERATIONS) -> tuple[float, list[list[float]]]:
    """Projected-gradient least squares on the residuals of the domains' expected tokens.

    The gradient is taken per token (documents of equal posterior keep equal
    rates) and scaled by the inverse of the domains' second moments over
    documents with a positive rate. An iteration is one aggregation; after every
    REWRITE steps the rates are written, so that no iteration folds over more.
    """
    k = len(targets)
    goal = np.array(targets, float)
    p = [F.col("posterior")[i] for i in range(k)]
    total = scored.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if not total:
        return 1.0, []
    start = float(goal.sum() / total)
    steps: list[list[float]] = []
    best, last, damp, written = (np.inf, []), None, 1.0, 0
    scored = scored.withColumn("__from", F.lit(start))
    for _ in range(iterations):
        if len(steps) - written == REWRITE:
            scored, written = shared.keep(scored.withColumn("__from", _rate(F.col("__from"), steps[written:])), "rates"), len(steps)
        moving = scored.withColumn("__rate", _rate(F.col("__from"), steps[written:]))
        sums = [F.sum(F.col("tokens") * F.col("__rate") * x) for x in p]
        moments = [F.sum(F.when(F.col("__rate") > 0, F.col("tokens") * p[i] * p[j])) for i in range(k) for j in range(i, k)]
        row = [float(v or 0) for v in moving.agg(*(c.alias(f"c{n}") for n, c in enumerate(sums + moments))).first()]
        residual = np.array(row[:k]) - goal
        size = float(np.abs(residual).max() / max(1.0, goal.max()))
        if size < best[0]:
            best = (size, list(steps))
        if size < ENOUGH or last is not None and abs(last - size) < ENOUGH / 10:
            break
        damp = max(0.1, damp / 2) if last is not None and size > last else min(1.0, damp * 1.5)
        last = size
        second = np.zeros((k, k))
        second[np.triu_indices(k)] = row[k:]
        second = second + np.triu(second, 1).T
        steps.append((damp * np.linalg.pinv(second, rcond=1e-9) @ residual).tolist())
    return start, best[1]


def mix(scored: DataFrame, targets: list[float]) -> DataFrame:
    """Adds ``rate`` (expected copies) and ``copies`` (the rate rounded up or down by a hash of the row, so that its expectation is the rate).

    scored: rows with tokens and posterior, as of :func:`with_posteriors`; it is read in every iteration,
    so it should be a written table (``shared.keep``). targets: expected tokens of each
    domain. Targets that no rates reach are met as closely as found. Equal rows
    get equal rates and copies; rows without id are told apart by tokens and
    posterior. An empty table gives an empty table.
    """
    start, steps = fit_rates(scored.select("tokens", "posterior"), targets)
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.col("tokens"), F.col("posterior"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return scored.drop("rate", "copies").withColumn("rate", _rate(F.lit(float(start)), steps)).withColumn("copies", F.floor(F.col("rate") + unit).cast("int"))


def domain_tokens(scored: DataFrame, domains: list[str]) -> list[float]:
    """Expected tokens of each domain at rate 1."""
    row = scored.agg(*(F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(len(domains)))).first()
    return [float(v or 0) for v in row]
