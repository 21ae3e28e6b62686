"""Ranked search against a plain version, and plans of shared sums."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sciobs.llm import lexical, queries

from .helpers import WORDS, awkward, documents, empty, sentence

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search(docs, items, k=20):
    """docs: (doc_id, text), items: (item_id, text) -> rows (item_id, rank, doc_id, score)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, (i is not None, i or 0), i))
        out += [(item_id, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def many_items(n=40):
    r = random.Random(5)
    stock = [" ".join(r.choice(WORDS) + str(r.randrange(4)) for _ in range(6)) for _ in range(5)]
    items = [(i, r.choice(stock) + " " + r.choice(stock) + " " + sentence(i, 5) + r.choice([" the the The", "", " river3"])) for i in range(n)]
    return [*items, (None, "river1 THE Über"), (3, "another text of stone3"), (3, "another text of stone3"), (50, None), (51, ""), (52, "nothinghasthis"), (53, "...")]


@pytest.mark.parametrize("cells, items_at_once, mined", [(lexical.CELLS, 1024, 64), (1, 7, 3), (500, 1, 0)])
def test_search(spark, monkeypatch, cells, items_at_once, mined):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", items_at_once)
    monkeypatch.setattr(lexical, "MINED_SUMMANDS", mined)
    docs = [*awkward(), *((100 + i, sentence(i % 70, 30), "en", "s", 1) for i in range(150)), (-4, sentence(5, 30), "en", "s", 1)]
    clash = documents(spark, docs).selectExpr("*", "1 AS item", "2 AS n", "'x' AS found", "3 AS tf", "4 AS score", "5 AS rank", "6 AS item_id")
    items = spark.createDataFrame(many_items(12 if items_at_once < 1024 else 40), ITEMS).selectExpr("*", "1 AS doc_id", "2 AS terms")
    assert rows(lexical.ranked_search(clash, items)) == search([(i, t) for i, t, *_ in docs], many_items(12 if items_at_once < 1024 else 40))


def test_empty_tables(spark):
    items = spark.createDataFrame(many_items(3), ITEMS)
    assert rows(lexical.ranked_search(empty(spark), items)) == Counter()
    assert rows(lexical.ranked_search(documents(spark), items.limit(0))) == Counter()
    assert rows(lexical.ranked_search(documents(spark, [(1, None, "", "", 1), (2, " ..", "", "", 1)]), items)) == Counter()


def value(plan, symbol, of):
    return of[symbol] if symbol < len(plan.vocabulary) else sum(value(plan, s, of) for s in plan.nodes[symbol - len(plan.vocabulary)])


@pytest.mark.parametrize("seed", range(6))
def test_plans_keep_sums(seed):
    r = random.Random(seed)
    stock = [[f"t{r.randrange(30)}".encode() for _ in range(r.randrange(2, 9))] for _ in range(6)]
    items = [dict(Counter([t for _ in range(3) for t in r.choice(stock)] + [f"t{r.randrange(60)}".encode()] * r.randrange(4))) for _ in range(40)]
    items = [i for i in items if i]
    plan = lexical.mine(items, {f"t{i}".encode(): r.randrange(1, 1000) for i in range(60)})
    assert all(max(n) < i for i, n in enumerate(plan.nodes, len(plan.vocabulary)))
    of = [r.randrange(10**6) for _ in plan.vocabulary]
    want = [sum(of[plan.vocabulary[t]] * n for t, n in item.items()) for item in items]
    assert [sum(n * value(plan, s, of) for s, n in zip(*item, strict=True)) for item in plan.items] == want
    parts = np.array(of, np.int64)[:, None] * np.array([1, 0, 3])
    assert [s.tolist() for s in lexical.accumulate(plan, parts)] == [[w, 0, 3 * w] for w in want]
    # no pair of summands is left that two items share
    pairs = defaultdict(int)
    for symbols, many in plan.items:
        both = sorted(zip(symbols, many, strict=True))
        for i, a in enumerate(both):
            for b in both[i + 1 :]:
                pairs[a, b] += 1
    assert max(pairs.values(), default=1) == 1


def test_plans_save_additions():
    shared = [f"s{i}".encode() for i in range(20)]
    items = [dict.fromkeys([*shared, f"own{i}".encode()], 1) for i in range(100)]
    plan = lexical.mine(items)
    assert plan.additions() == 19 + 100 and len(plan.nodes) == 19  # not 100 * 20


def test_query_and_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    documents(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(many_items(), ITEMS).coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.sql(queries.ORACLE_SQL["op11_ranked_search"])
    got = queries.op11_ranked_search(spark, str(tmp_path))
    assert sorted(want.columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())
