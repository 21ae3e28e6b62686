from __future__ import annotations

import random

import numpy as np
import pytest

from sciobs.llm import mixing, shared

from .helpers import awkward, documents, empty, sentence


def corpus(n=700):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        domain = "abc"[i % 7 % 3]
        marks = {"a": "alpha apple", "b": "beta banana", "c": "gamma cherry"}[domain].split()
        words = sentence(i, r.randrange(10, 60)).split()
        for _ in range(4):
            words[r.randrange(len(words))] = r.choice(marks)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, domain))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    docs = documents(spark, rows + [(1000, None, None, None, None), (None, "beta banana", "en", "s", 1), (3, rows[3][1], "en", "s", 1)])
    model = mixing.train(docs, spark.createDataFrame(labels[:400], "doc_id long, domain string"))
    return model, shared.keep(mixing.with_posteriors(docs, model), "test"), dict(labels)


def test_held_out_accuracy(scored):
    model, table, truth = scored
    rows = [r for r in table.collect() if r["doc_id"] in truth and r["doc_id"] >= 400]
    right = sum(model.domains[int(np.argmax(r["posterior"]))] == truth[r["doc_id"]] for r in rows)
    assert right >= 0.9 * len(rows)


def test_tokens_are_those_of_packing(scored):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(scored[0].path)
    for r in scored[1].collect():
        assert r["tokens"] == 1 + len(whole.encode(r["text"] or "", add_special_tokens=False).ids)
        assert abs(sum(r["posterior"]) - 1) < 1e-9


@pytest.mark.parametrize("shares", [(0.2, 0.5, 0.3), (0.05, 0.9, 0.05), (0.0, 0.5, 0.5)])
def test_expected_totals_meet_the_targets(scored, shares):
    _, table, _ = scored
    total = sum(r["tokens"] for r in table.collect())
    targets = [total * s for s in shares]
    rows = mixing.mix(table, targets).collect()
    assert min(r["rate"] for r in rows) >= 0
    reached = sum(np.array(r["posterior"]) * r["tokens"] * r["rate"] for r in rows)
    # where a target is zero, posteriors that are nowhere zero keep a little of the domain
    assert np.abs(reached - targets).max() < (1e-4 if min(shares) else 0.02) * total
    assert all(r["copies"] in (int(np.floor(r["rate"])), int(np.floor(r["rate"])) + 1) for r in rows)


def test_against_a_dense_solution(scored):
    """Where no rate reaches zero the solution is 1 start - p . y with one linear solve."""
    _, table, _ = scored
    rows = table.collect()
    p, t = np.array([r["posterior"] for r in rows]), np.array([r["tokens"] for r in rows], float)
    targets = np.array(mixing.domain_tokens(table, ["a", "b", "c"])) * [1.1, 0.9, 1.0]
    start = targets.sum() / t.sum()
    y = np.linalg.solve((p * t[:, None]).T @ p, start * (p * t[:, None]).sum(axis=0) - targets)
    want = start - p @ y
    got = {(r["doc_id"], r["text"]): r["rate"] for r in mixing.mix(table, targets.tolist()).collect()}
    assert np.allclose([got[r["doc_id"], r["text"]] for r in rows], want, atol=1e-5)


def test_clashing_columns_and_rows_without_id(scored):
    _, table, _ = scored
    targets = [t * 0.5 for t in mixing.domain_tokens(table, ["a", "b", "c"])]
    rows = mixing.mix(table.withColumnsRenamed({"lang": "rate", "source": "copies"}), targets).collect()
    assert {r["copies"] for r in rows} == {0, 1}
    nameless = mixing.mix(table.selectExpr("cast(null as long) AS doc_id", "tokens", "posterior"), targets).collect()
    assert {r["copies"] for r in nameless} == {0, 1}  # not one draw for all


def test_rewriting_rates_changes_nothing(scored, monkeypatch):
    _, table, _ = scored
    targets = [t * f for t, f in zip(mixing.domain_tokens(table, ["a", "b", "c"]), (2.0, 0.0, 0.3), strict=True)]
    once = mixing.fit_rates(table, targets, 12)
    monkeypatch.setattr(mixing, "REWRITE", 1)
    again = mixing.fit_rates(table, targets, 12)
    assert len(once[1]) > 1 and np.allclose(once[1], again[1])


def test_features_pack_and_unpack():
    r = np.random.default_rng(1)
    for n in (0, 1, 500, 2047, 2049, 40_000, mixing.FEATURES):
        found = np.sort(r.choice(mixing.FEATURES, n, replace=False))
        raw = mixing.packed(found)
        assert np.array_equal(mixing.unpacked(raw), found) and len(raw) <= 2 + mixing.FEATURES // 8


def test_fit_in_parts_is_the_same(monkeypatch):
    r = np.random.default_rng(2)
    rows = [mixing.packed(np.unique(r.integers(0, 400, 30) + 300 * (k % 3))) for k in range(60)]
    y = np.arange(60) % 3
    one = mixing.fit(rows, y, list("abc"), "")
    monkeypatch.setattr(mixing, "AT_ONCE", 100)
    two = mixing.fit(rows, y, list("abc"), "")
    assert np.allclose(one.weights, two.weights, atol=1e-6) and (one.logits([mixing.unpacked(x) for x in rows]).argmax(axis=1) == y).all()


def test_very_long_text(spark):
    long = sentence(1, 60_000)
    docs = documents(spark, [(1, long, "en", "s", 1), (2, "alpha", "en", "s", 1)])
    model = mixing.train(docs, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string"))
    rows = {r["doc_id"]: r for r in mixing.with_posteriors(docs, model).collect()}
    assert rows[1]["tokens"] > 60_000 and rows[1]["posterior"][0] > 0.5 > rows[2]["posterior"][0]


def test_empty_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    model = mixing.train(empty(spark), none)
    assert model.domains == ["other"]
    table = shared.keep(mixing.with_posteriors(empty(spark), model), "test")
    assert mixing.mix(table, [10.0]).count() == 0
    one = shared.keep(mixing.with_posteriors(documents(spark), model), "test")
    assert {round(r["posterior"][0], 9) for r in one.collect()} == {1.0}


def test_counts_are_those_of_encoding():
    from sciobs.llm import tokens

    path = tokens.default_tokenizer_path()
    texts = [t for _, t, *_ in awkward()] + [sentence(k, 50).upper() for k in range(5)]
    many, sums = tokens.WordTokenizer(path).counts(texts)
    assert many.tolist() == [len(x) // 4 for x in tokens.WordTokenizer(path).encode(texts)]
    assert all((len(s) > 0) == bool((t or "").strip()) for s, t in zip(sums, texts, strict=True))
