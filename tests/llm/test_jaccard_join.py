from __future__ import annotations

import random
from math import comb

import numpy as np
import pytest

from sciobs.llm import jaccard_join as jj
from sciobs.llm.components import components

from .helpers import awkward, documents, empty, sentence


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    order = lambda i: -(2**63) if i is None else i
    sets, parent, links = [shingles(r[1]) for r in rows], list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = sets[a] == sets[b]
            if same or sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k, r in enumerate(rows):
        low[root(k)] = min(low.get(root(k), 2**63), order(r[0]))
    null = lambda i: None if i == -(2**63) else i
    return sorted(((r[0], null(low[root(k)]), links[k]) for k, r in enumerate(rows)), key=str)


def run(spark, rows):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jj.join(documents(spark, rows)).collect()), key=str)


def near_copies(seed=1):
    r = random.Random(seed)
    rows = []
    for g in range(10):
        base = sentence(g, r.choice((6, 40, 150, 400))).split()
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                w[r.randrange(len(w))] = f"other{r.randrange(99)}"
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("block", [768, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "BUCKET_BLOCK", block)
    rows = near_copies()
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    assert run(spark, awkward()) == brute(awkward())


def test_empty_and_clashing_columns(spark):
    assert jj.join(empty(spark)).count() == 0
    assert jj.keep_one(empty(spark)).count() == 0
    docs = documents(spark, near_copies(3)).withColumnsRenamed({"lang": "node", "source": "digest", "n_chars": "id"})
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute(near_copies(3))})


def test_keep_one_of_repeated_rows(spark):
    rows = [(5, "a b c d e f", "en", "s", 1)] * 3 + [(None, None, "en", "s", 1)] * 2 + [(7, "a b c d e f", "en", "s", 1)]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in jj.keep_one(documents(spark, rows)).collect()) == [(False, 5), (True, None)]


def test_posterior_bound():
    for n in (20, 60, 140):
        m = jj.fewest(n, 0.8, 1e-6)
        tail = lambda k, n=n: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


@pytest.mark.parametrize("n", [5, 90])
def test_intersections(n):
    r = np.random.default_rng(0)
    one = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(n)]
    two = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(n)]
    i, j = map(np.ravel, np.meshgrid(np.arange(n), np.arange(n)))
    want = [len(np.intersect1d(one[a], two[b])) for a, b in zip(i, j, strict=True)]
    assert jj.intersections(one, two, i, j).tolist() == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (103, 102), (102, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("broadcast_nodes", [0, 10_000])
def test_components_of_random_graphs(spark, broadcast_nodes):
    """Against label spreading; a hub with the largest number, repeated edges and loops among them."""
    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randrange(300), r.randrange(300)) for _ in range(130)] + [(999, 1000 + k) for k in range(50)] + [(5000, 2000 + k) for k in range(50)] + [(7, 7), (8000, 8000)]
        edges += edges[:20]
        want = {node: node for edge in edges for node in edge}
        for _ in want:
            for a, b in edges:
                want[a] = want[b] = min(want[a], want[b])
        got = components(spark.createDataFrame(edges, "a long, b long"), broadcast_nodes)
        rows = got.collect()
        assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_keep_one_keeps_every_different_text(spark, parts):
    a, b, c, d = (sentence(k, 30) for k in range(4))
    near = c.split()
    near[-1] = "changed"
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (9, a, "en", "s", 1)]  # two texts without id, one of them three times
    rows += [(1, c, "en", "s", 1), (2, " ".join(near), "en", "s", 1), (2, d, "en", "s", 1), (2, d, "fr", "s", 1)]  # a near copy and a text of its own share an id
    rows += [(3, None, "en", "s", 1), (4, "", "en", "s", 1)]
    docs = documents(spark, rows).repartition(parts)
    got = sorted(((r["doc_id"], r["text"]) for r in jj.keep_one(docs).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (2, d), (3, None)], key=str)
    assert {r["lang"] for r in jj.keep_one(docs).where("doc_id = 2").collect()} == {r["lang"] for r in jj.keep_one(documents(spark, rows[::-1])).where("doc_id = 2").collect()}


def ties(spark, texts):
    sigs = jj.signatures(documents(spark, [(k, t, "en", "s", 1) for k, t in enumerate(texts)]), 5, 140).selectExpr("id AS node", "sig")
    return jj.candidate_ties(sigs, 28, 5, 0.8, 1e-6).collect()


def test_a_shared_template_ties_nothing(spark):
    """Texts that share bands but no link: none goes on to the components, however many there are."""
    template = sentence(1, 140)
    alike = [f"{template} {sentence(10 + k, 100)}" for k in range(300)]
    chain = [f"{sentence(5000 + k, 60)} {sentence(5001 + k, 60)}" for k in range(300)]
    assert ties(spark, alike + chain) == []


def test_ties_are_a_forest_that_connects_the_copies(spark):
    base = sentence(3, 300).split()
    texts = [" ".join(base[:k] + [f"changed{k}"] + base[k + 1 :]) for k in range(60)] + [sentence(100 + k, 80) for k in range(20)]
    found = ties(spark, texts)
    assert len({frozenset((r["a"], r["b"])) for r in found}) >= 59 and {x for r in found for x in (r["a"], r["b"])} == set(range(60))
    # each bucket gives at most a tree; of 28 bands buckets with the same members count once
    assert len(found) <= 28 * 59


def test_forest_between_two_blocks():
    r = np.random.default_rng(1)
    one, two = r.integers(0, 256, (2, 140)).astype(np.uint8)
    sigs, block = np.array([one] * 4 + [two] * 4), np.array([0, 1, 0, 1, 0, 0, 0, 1])
    edges = jj.ties_within(sigs, block, 0.8, 1e-6)
    assert len(edges) == 6 and all(block[a] != block[b] and (a < 4) == (b < 4) for a, b in edges)


def test_recall_of_the_bands(spark):
    """True pairs just above the threshold, found by all against all."""
    r = random.Random(4)
    rows = []
    for g in range(150):
        base = sentence(g, 120).split()
        w = list(base)
        for at in r.sample(range(0, 120, 9), 2):
            w[at] = "other"
        rows += [(2 * g, " ".join(base), "en", "s", 1), (2 * g + 1, " ".join(w), "en", "s", 1)]
    want = brute(rows)
    linked = sum(n for *_, n in want)
    assert linked >= 250 and run(spark, rows) == want
