from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sciobs.llm import packing, tokens

from .helpers import awkward, documents, empty


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_tokenizer_path())


def whole(tokenizer, text):
    return np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_word_memo_equals_the_tokenizer(tokenizer):
    r = random.Random(4)
    letters = "aB 'sStré Éß\n\t.,!<|>019_-`~ÿ×µ́ΣİＡ中\x1f\x85\xa0^\\"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)] + ["don't we'll I'M '''s", "a<|endoftext|>b", None, ""]
    found = tokens.WordTokenizer(tokens.default_tokenizer_path()).encode(texts)
    assert found == [whole(tokenizer, t) for t in texts]


def test_memo_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 5)
    w = tokens.WordTokenizer(tokens.default_tokenizer_path())
    for t in ("one two three four", "five six one", "seven eight nine ten", "one two ten"):
        assert w.encode([t]) == [whole(tokenizer, t)]


def check(rows, docs, tokenizer, capacity):
    pieces = defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= capacity
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in pieces.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc_id, text, *_ in docs:
        ids = whole(tokenizer, text) + b"\0\0\0\0"
        want += [(doc_id, i, k // 4, len(p) // 4, zlib.crc32(p)) for i, k in enumerate(range(0, len(ids), 4 * capacity)) for p in [ids[k : k + 4 * capacity]]]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)
    return len(pieces)


def test_pack_awkward_rows(spark, tokenizer):
    n = check(packing.pack(documents(spark)).collect(), awkward(), tokenizer, 2048)
    assert n > 1


def test_pack_small_capacity_and_clashing_columns(spark, tokenizer):
    docs = documents(spark).withColumnsRenamed({"lang": "length", "source": "sequence_id", "n_chars": "salt"})
    check(packing.pack(docs, capacity=16).collect(), awkward(), tokenizer, 16)


def test_pack_empty(spark):
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once_and_is_tight(seed):
    r = random.Random(seed)
    capacity = 256
    low, high = [(1, 256), (120, 256), (1, 20), (60, 130), (86, 128), (1, 255)][seed]
    histogram = {s: r.randrange(1, 60) for s in range(low, high) if r.random() < 0.7}
    table = packing.plan(histogram, capacity, groups=24)
    used = defaultdict(list)
    dealt = defaultdict(list)
    for length, rank, n, first, offset in table.tolist():
        for k in range(n):
            used[first + k].append((offset, length))
            dealt[length].append(rank + k)
    for length, n in histogram.items():
        assert sorted(dealt[length]) == list(range(n))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    # no worse than best fit of the lengths in descending order, give or take the rounding
    rooms: list[int] = []
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            fit = min((x for x in rooms if x >= s), default=None)
            if fit is None:
                rooms.append(capacity - s)
            else:
                rooms.remove(fit)
                rooms.append(fit - s)
    assert len(used) <= len(rooms) * 1.04 + 24


def test_configurations_meet_the_demand():
    sizes, demand = [100, 70, 50, 33], [10, 20, 30, 40]
    found = packing.configurations(sizes, demand, 100)
    total = sum(a * c for a, c in found)
    assert np.allclose(total, demand)
    assert all(c @ np.array(sizes) <= 100 for _, c in found)
