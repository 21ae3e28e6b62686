"""Operator 6: Order MinHash fingerprints of documents.

For each of the signature's positions, the k-mers of a text get priorities by a
hash of the k-mer and its occurrence number; the few smallest are put back in
text order and the tuple is hashed. Two texts share a position when they share
these k-mers in the same order, so the likeness falls with edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

KMER, TUPLE, SKETCHES = 8, 2, 32
#: Characters that are worked on at once.
CHUNK = 60_000
#: Expected number of k-mers under the first threshold; when fewer than a tuple are, the text is sorted whole.
UNDER = 14.0
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = 20


def _multipliers(sketches: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20)
    return random.integers(1, 2**32, sketches, np.uint32) | np.uint32(1), random.integers(0, 2**32, sketches, np.uint32)


def _kmers(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for the k-mer at each character (the last ones reach past the end), and the texts' lengths."""
    lengths = np.array([len(t) for t in texts])
    # each text is followed by k - 1 marks that no text holds
    codes = np.full(lengths.sum() + (k - 1) * len(texts) + 1, 0x110000, np.uint64)
    own = np.ones(len(codes), bool)
    ends = np.cumsum(lengths + k - 1)
    for end in ends:
        own[end - k + 1 : end] = False
    own[-1] = False
    codes[own] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = codes * _GOLD
    h ^= h >> np.uint64(29)
    out = np.zeros(len(codes), np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out[: len(codes) - i] += h[i:]
    out ^= out >> np.uint64(32)
    out *= _GOLD
    return out[own], lengths


def _numbered(h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text, its k-mers grouped by k-mer: hash, place in the text, occurrence number."""
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    kmer, place = np.empty_like(h), np.empty(len(h), np.int64)
    at = 0
    for n in lengths:
        part = h[at : at + n]
        if n <= 1 << _PLACE_BITS:  # hash and place in one number: one plain sort
            keys = (part & ~mask) | np.arange(n, dtype=np.uint64)
            keys.sort()
            place[at : at + n] = keys & mask
            kmer[at : at + n] = keys & ~mask
        else:
            order = np.argsort(part & ~mask, kind="stable")
            place[at : at + n] = order
            kmer[at : at + n] = (part & ~mask)[order]
        at += n
    new = np.ones(len(h), bool)
    new[1:] = kmer[1:] != kmer[:-1]
    starts = np.cumsum(lengths)[:-1]
    new[starts[starts < len(h)]] = True
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return kmer, place, np.arange(len(h)) - first


def fingerprints(texts: list[str], k: int = KMER, size: int = TUPLE, sketches: int = SKETCHES) -> np.ndarray:
    """One row of ``sketches`` tuple hashes (uint32) per text; zeros for an empty text."""
    out = np.zeros((len(texts), sketches), np.uint32)
    full = np.flatnonzero([bool(t) for t in texts])
    if not len(full):
        return out
    h, lengths = _kmers([texts[i] for i in full], k)
    kmer, place, nth = _numbered(h, lengths)
    x = kmer + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(31)
    x *= _GOLD
    x = (x >> np.uint64(32)).astype(np.uint32)
    n, total = len(full), len(x)
    doc = np.repeat(np.arange(n), lengths)
    under = np.minimum(2.0**32 - 1, UNDER * size / 2 / lengths * 2.0**32).astype(np.uint32)
    limit = np.repeat(under, lengths)
    a, b = _multipliers(sketches)
    p, q, low = np.empty_like(x), np.empty_like(x), np.empty(total, bool)
    keys, found = [], []
    for j in range(sketches):
        np.bitwise_xor(x, b[j], out=p)
        np.multiply(p, a[j], out=p)
        np.right_shift(p, np.uint32(15), out=q)
        np.bitwise_xor(p, q, out=p)
        np.multiply(p, np.uint32(0x2C1B3C6D), out=p)
        np.less_equal(p, limit, out=low)
        at = np.flatnonzero(low)
        enough = np.bincount(doc[at], minlength=n)
        for i in np.flatnonzero((enough < size) & (lengths > enough)):  # rare: all k-mers of the text
            s = int(lengths[:i].sum())
            at = np.concatenate([at[doc[at] != i], np.arange(s, s + lengths[i])])
        found.append(at)
        keys.append((np.uint64(j * n) + doc[at].astype(np.uint64)) << np.uint64(32) | p[at])
    keys, found = np.concatenate(keys), np.concatenate(found)
    # the smallest of each (sketch, text); equal priorities by hash order
    order = np.lexsort((found, keys))
    group, found = (keys[order] >> np.uint64(32)).astype(np.int64), found[order]
    start = np.searchsorted(group, np.arange(n * sketches))
    many = np.minimum(np.searchsorted(group, np.arange(n * sketches), side="right") - start, size)
    pick = np.minimum(start[:, None] + np.arange(size), len(found) - 1)
    chosen = found[pick]
    there = np.arange(size) < many[:, None]
    in_text = np.argsort(np.where(there, place[chosen], np.iinfo(np.int64).max), axis=1, kind="stable")
    value = np.where(there, kmer[chosen], np.uint64(1))
    mixed = np.zeros(len(value), np.uint64)
    for i in range(size):
        mixed = (mixed ^ np.take_along_axis(value, in_text[:, i : i + 1], 1)[:, 0]) * _GOLD
        mixed ^= mixed >> np.uint64(29)
    out[full] = (mixed >> np.uint64(32)).astype(np.uint32).reshape(sketches, n).T
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (one == other).mean(axis=1)


def next_documents(docs: DataFrame) -> DataFrame:
    """Deals rows into ranges of ids, each followed by the row that comes next.

    Returns (p, ahead, id, doc_id, text), sorted within partitions by p, ahead
    and descending id; ``ahead`` rows only end a range. The range borders are
    ids that occur, so the row after a range is the one at its border; the
    largest id follows the last range. Rows of equal id are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), shared.id_key().alias("id"))
    n = shared.shuffle_partitions(spark)
    found = rows.agg(F.max("id").alias("top"), F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts")).first()
    cuts = sorted({c for c in found["cuts"] or []} - {found["top"]})
    borders = F.array(*(F.lit(c).cast("long") for c in cuts)).cast("array<long>")
    p = F.size(F.filter(borders, lambda c: c < F.col("id")))
    own = F.array(F.struct(p.alias("p"), F.lit(False).alias("ahead")))
    border = F.when(F.array_contains(borders, F.col("id")), F.array(F.struct((p + 1).alias("p"), F.lit(True).alias("ahead"))))
    top = F.when(F.col("id") == F.lit(found["top"]), F.array(F.struct(F.lit(0).alias("p"), F.lit(True).alias("ahead"))))
    none = F.array().cast("array<struct<p:int,ahead:boolean>>")
    dealt = rows.select("*", F.explode(F.concat(own, F.coalesce(border, none), F.coalesce(top, none))).alias("at")).select("at.p", "at.ahead", "id", "doc_id", "text")
    return dealt.repartitionById(len(cuts) + 1, F.col("p")).sortWithinPartitions("p", "ahead", F.desc("id"), F.xxhash64("text"))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_test(docs: DataFrame, k: int = KMER, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints every whole text and an edited copy of it.

    The edited text ends with the beginning of the next document in descending
    doc_id (the first follows the last). Null texts are empty; an empty text's
    fingerprint is zeros and equals only that of empty texts; a null doc_id
    comes after all others; rows of equal doc_id are ordered by a hash of their
    text; every row gives one row. Very long texts are read whole, in
    chunks of texts with about CHUNK characters; other columns are not read,
    whatever their names. Fingerprints are ``sketches`` numbers of eight
    hexadecimal digits.
    """
    shared.prepare(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def write(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All texts but the last, each with the one after it."""
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        both = fingerprints(texts + changed, k, size, sketches)
        plain, after = both[: len(texts)], both[len(texts) :]
        columns = [
            ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            [r.astype(">u4").tobytes().hex() for r in plain[:-1]], [r.astype(">u4").tobytes().hex() for r in after], likeness(plain[:-1], after), likeness(plain[:-1], plain[1:]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars, now, ended = [], [], 0, None, False
        for batch in batches:
            for p, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if p != now:
                    ids, texts, chars, now, ended = [], [], 0, p, False
                if ended:  # more rows with the border's id
                    continue
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                ended = ahead
                if len(texts) > 1 and (ended or chars > CHUNK):
                    yield write(ids, texts)
                    ids, texts, chars = ids[-1:], texts[-1:], len(text)

    return next_documents(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
