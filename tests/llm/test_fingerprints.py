from __future__ import annotations

import hashlib

import numpy as np
import pytest

from sciobs.llm import fingerprints as fp

from .helpers import awkward, documents, empty, sentence


def slow(text, k, size, sketches):
    """The definition, one k-mer at a time, with the same hashes."""
    if not text:
        return [0] * sketches
    h, _ = fp._kmers([text], k)
    mask = np.uint64((1 << 20) - 1)
    kmers = [int(x & ~mask) for x in h]
    seen, a, b, full = {}, *fp._multipliers(sketches), 2**64 - 1
    items = []
    for place, x in enumerate(kmers):
        nth = seen.get(x, 0)
        seen[x] = nth + 1
        v = (x + nth * 0xA0761D6478BD642F) & full
        v ^= v >> 31
        v = (v * int(fp._GOLD)) & full
        items.append((v >> 32, x, place))
    out = []
    for j in range(sketches):
        ranked = []
        for v, x, place in items:
            p = ((v ^ int(b[j])) * int(a[j])) & 0xFFFFFFFF
            p ^= p >> 15
            ranked.append(((p * 0x2C1B3C6D) & 0xFFFFFFFF, x, place))
        chosen = sorted(sorted(ranked)[:size], key=lambda t: t[2])
        values = [x for _, x, _ in chosen] + [1] * (size - len(chosen))
        m = 0
        for x in values:
            m = ((m ^ x) * int(fp._GOLD)) & full
            m ^= m >> 29
        out.append(m >> 32)
    return out


@pytest.mark.parametrize("size", [2, 3])
def test_kernel_against_the_definition(size):
    texts = ["", "a", "ab", "abcabcabcabc", "x" * 200, sentence(1, 30), sentence(2, 120), "日本語 текст 😀", "aaaaaaaaab"]
    got = fp.fingerprints(texts, 5, size, 16)
    assert got.tolist() == [slow(t, 5, size, 16) for t in texts]


def test_a_text_alone_and_among_others_has_one_fingerprint():
    texts = [sentence(k, 60) for k in range(20)]
    assert (fp.fingerprints(texts) == np.concatenate([fp.fingerprints([t]) for t in texts])).all()


def test_order_matters():
    words = sentence(1, 400).split()
    text, swapped = " ".join(words), " ".join(words[200:] + words[:200])
    edited = " ".join(words[:190] + ["new"] * 20 + words[210:])
    f = fp.fingerprints([text, swapped, edited], sketches=256)
    assert fp.likeness(f[:1], f[2:])[0] > fp.likeness(f[:1], f[1:2])[0] + 0.1


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0]), reverse=True)
    out = {}
    for k, (i, text, *_) in enumerate(rows):
        changed = fp.edited(text or "", rows[(k + 1) % len(rows)][1] or "")
        out.setdefault(i, []).append((len(text or ""), hashlib.sha256(changed.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_edits_follow_descending_ids(spark, parts):
    rows = [(k * 7 % 101, sentence(k, k % 13), "en", "s", 1) for k in range(100)] + [(5000, None, "en", "s", 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fp.edit_test(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["doc_id"]: [(r["n_chars"], r["edited_sha256"])] for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_awkward_rows(spark):
    got = fp.edit_test(documents(spark)).collect()
    assert len(got) == len(awkward())
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    texts = {i: t for i, t, *_ in awkward()}
    for r in got:
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_single_and_empty(spark):
    (r,) = fp.edit_test(documents(spark, [(1, "abcdef", "en", "s", 6)])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0
    assert fp.edit_test(empty(spark)).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(k, sentence(k, 60_000 if k % 4 == 0 else 5), "en", "s", 1) for k in range(9)]
    plain = sorted(map(tuple, fp.edit_test(documents(spark, rows)).collect()))
    clash = documents(spark, rows).selectExpr("*", "'x' AS p", "1 AS ahead", "2 AS id", "'y' AS fingerprint", "3 AS at", "4 AS near_next")
    assert sorted(map(tuple, fp.edit_test(clash).collect())) == plain
    assert {r[0]: [tuple(r[1:3])] for r in plain} == brute(rows)
    for i, _, _, mark, *_ in plain:
        alone = fp.fingerprints([rows[i][1]])[0]
        assert mark == alone.astype(">u4").tobytes().hex()
