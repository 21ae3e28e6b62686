"""Alignment of two tokenizers against a plain version that encodes every document whole."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from sciobs.llm import alignment, queries  # noqa: E402

from .helpers import awkward, documents, empty  # noqa: E402

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters():
    """The published rule of byte-level vocabularies."""
    kept = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    table, n = {b: chr(b) for b in kept}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + n)
            n += 1
    return {c: b for b, c in table.items()}


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = alignment.default_paths()
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.letters = byte_letters()

    def groups(self, text):
        """[(A ids, B ids)] of a text, or none."""
        if not text:
            return []
        raw = (" " + text).encode()
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return []
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (bytes_a, bytes_b)]
        place = [{end: k + 1 for k, end in enumerate(e)} for e in ends]
        out, i, j = [], 0, 0
        for cut in sorted(place[0].keys() & place[1].keys()):
            x, y = place[0][cut], place[1][cut]
            out.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        return out

    def measures(self, rows):
        """Rows of (doc_id, text) -> one tuple of COLUMNS each."""
        each = [self.groups(t) for _, t in rows]
        links = [Counter((x, y) for a, b in g for x in a for y in b) for g in each]
        count = Counter(p for n in links for p in n)
        highest = defaultdict(int)
        for (a, _), n in count.items():
            highest[a] = max(highest[a], n)
        out = []
        for (i, _), g, n in zip(rows, each, links, strict=True):
            text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            best = sum(k for p, k in n.items() if count[p] == highest[p[0]])
            total = sum(k * count[p] for p, k in n.items())
            out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if g else ""))
        return Counter(out)


@pytest.fixture(scope="module")
def plain():
    return Plain()


PARTS = ["word", "don't", "naïve", "été", "42", "3.14", "日本語", "текст", "😀👩‍👩‍👧", "<|endoftext|>", "<s>", "xxxxxxxxxxxx", "it's", ";", "();", "{", "é", "ﬁ", "\x00", "\x1c", "\x7f", "foo_bar", "<0x0A>"]
SPACES = [" ", " ", " ", " ", "  ", "   ", "\n", "\n\n", " \n", "\n ", "\t", "\t\t x", " " * 17, "\r\n", "\r", ";\r\n", " ", "　 ", "▁", "\x0b"]


def mixed(seed, n, spaces=SPACES):
    r = random.Random(seed)
    return "".join(r.choice(PARTS) + r.choice(spaces) for _ in range(n)) + r.choice(["", " ", "\n", "end"])


TEXTS = [" ", "\n", "  ", "\t", " x", "x ", "\nx", "  x  ", "x\n\n  y", "a▁b", "▁", *(mixed(i, 12) for i in range(150)), *(mixed(i, 40, SPACES[:13]) for i in range(100))]


def test_units_and_whole_texts_agree(plain):
    own = alignment.aligner(*alignment.default_paths())
    assert own.by_units
    texts = [t for t in TEXTS if t]
    for text, got in zip(texts, own.of(texts), strict=True):
        want = plain.groups(text)
        if not want:
            assert got is None, text
            continue
        (n_a, n_b, n_groups, n_links), groups, pairs, links = got
        assert groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want), repr(text)
        assert (n_a, n_b, n_groups) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want))
        count = Counter((x << 32) | y for a, b in want for x in a for y in b)
        assert dict(zip(pairs.tolist(), links.tolist(), strict=True)) == count and n_links == sum(count.values())


@pytest.mark.parametrize("share, hot, at_once, memo", [(alignment.FREQUENT_SHARE, 0.001, alignment.PAIRS_AT_ONCE, alignment.MEMO_UNITS), (0.002, 0.2, 50, 30), (2.0, 2.0, 1, 1)])
def test_documents(spark, plain, monkeypatch, share, hot, at_once, memo):
    """With all pairs broadcast, some, none; the memo forgets in the workers only where the module is patched, so it is tested here in the driver's process too."""
    monkeypatch.setattr(alignment, "FREQUENT_SHARE", share)
    monkeypatch.setattr(alignment.shared, "HOT_SHARE", hot)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(alignment, "MEMO_UNITS", memo)
    rows = [*awkward(), *((100 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS[:120])), *((1000 + i, TEXTS[40], "en", "s", 1) for i in range(60))]
    clash = documents(spark, rows).selectExpr("*", "1 AS digest", "'x' AS pair", "2 AS links", "3 AS n_a", "4 AS number", "5 AS documents", "6 AS count")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(clash).collect())
    assert got == plain.measures([(i, t) for i, t, *_ in rows])


@pytest.mark.parametrize("units, links", [(3, 10_000), (4000, 1)])
def test_units_encoded_together_and_alone_agree(monkeypatch, units, links):
    monkeypatch.setattr(alignment, "UNITS_AT_ONCE", units)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", links)
    own, other = (alignment.Aligner(*alignment.default_paths()) for _ in range(2))
    monkeypatch.setattr(other, "together", lambda units: None)
    texts = [t for t in TEXTS if t]
    for x, y in zip(own.of(texts), other.of(texts), strict=True):
        assert (x is None) == (y is None)
        assert x is None or (x[:2] == y[:2] and (x[2] == y[2]).all() and (x[3] == y[3]).all())


def test_forgetting(monkeypatch, plain):
    monkeypatch.setattr(alignment, "MEMO_UNITS", 5)
    own = alignment.Aligner(*alignment.default_paths())
    for text in TEXTS[-20:]:
        got = next(own.of([text]))
        assert (got[0][2] if got else 0) == len(plain.groups(text))


def test_empty(spark):
    assert alignment.align_documents(empty(spark)).collect() == []


def test_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_aligned_tokenizers(spark, sf)
    assert got.columns == COLUMNS
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain.measures(rows)
