"""Operator 13: alignment of two tokenizers, each distinct text once.

Documents are shuffled by their full text and counted, so that a text that many hold
is encoded and aligned once. Tasks write its measures and its linked pairs of token
ids; pairs are counted over the corpus with the number of the text's documents, and
measures go back to the documents by the text's digest.

A is a byte-level BPE that sees a space before the text, B a piece BPE that adds it.
White space (space, tab, newline) after another character ends a token of both: A's
words begin with white space, and no piece of B has such white space inside. So both
cut a text into the same units, a run of white space with what follows, and each unit is encoded
and aligned once per worker and remembered. Texts with other white space, with U+2581,
or for tokenizers of another kind, are encoded whole; a test compares both ways.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DEFAULT_A, DEFAULT_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units that a worker remembers, and linked pairs that leave it at once.
MEMO_UNITS, PAIRS_AT_ONCE = 800_000, 2_000_000
#: Units that are encoded together, and links of a group up to which its pairs are written one by one.
UNITS_AT_ONCE, LINKS_AT_ONCE = 4000, 10_000
#: Pairs that hold at least this share of all rows of pairs are joined by broadcast: at most 1 / share of them.
FREQUENT_SHARE = 4e-6

_UNIT = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: White space other than space, tab and newline, or the sign that B has for a space.
_WHOLE = re.compile(r"[^\S \t\n]|▁")
NONE = np.zeros(0, np.int64)
_INNER_SPACE = re.compile(r"[^▁\s][▁ \t\n]")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_A), public_tokenizers.path(DEFAULT_B)


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens' byte counts of A and of B over the same bytes -> numbers of A tokens and of B tokens up to each common end."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    common = np.intersect1d(a_ends, b_ends, assume_unique=False)
    return np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right")


class _Numbers(dict):
    """Unit -> number; a new unit gets the next one and waits to be learned."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        i = self[unit] = len(self)
        self.new.append(unit)
        return i


class Aligner:
    """Encodes texts with both tokenizers and aligns them."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, vocabulary = _byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        inner = any(_INNER_SPACE.search(p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        before = any(p != "▁" and re.match("▁*[\t\n]", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.by_units = not inner and not before and type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), np.int64)  # of each unit: tokens of A and B, groups, links
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def aligned(self, a: list[int], b: list[int], raw: bytes) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray] | None:
        """((n_a, n_b, n_groups, n_links), groups, different pairs, links of each) of encoded bytes; None if the tokens' bytes differ from them."""
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return None
        if len(a) == 1 or len(b) == 1:  # one group
            groups = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
            pairs, links = _linked(a, b)
            return (len(a), len(b), 1, len(a) * len(b)), groups, pairs, links
        a_upto, b_upto = align(np.fromiter(map(len, a_bytes), np.int64), np.fromiter(map(len, b_bytes), np.int64))
        parts, found, n_links, i, j = [], [], 0, 0, 0
        for x, y in zip(a_upto.tolist(), b_upto.tolist(), strict=True):
            ga, gb = a[i:x], b[j:y]
            parts.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
            found.append(_linked(ga, gb))
            n_links += len(ga) * len(gb)
            i, j = x, y
        pairs, links = _summed(np.concatenate([p for p, _ in found]), np.concatenate([n for _, n in found]))
        return (len(a), len(b), len(parts), n_links), ";".join(parts), pairs, links

    def whole(self, text: str):
        return self.aligned(self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), b" " + text.encode())

    def learn(self, units: list[str]) -> None:
        """Encodes and aligns new units, many at once: joined, they are cut into themselves again, but for those that are only white space."""
        known: dict[int, tuple] = {}
        joined = [i for i, u in enumerate(units) if u[-1] not in " \t\n"]
        for at in range(0, len(joined), UNITS_AT_ONCE):
            some = joined[at : at + UNITS_AT_ONCE]
            known |= zip(some, self.together([units[i] for i in some]) or map(self.alone, [units[i] for i in some]), strict=True)
        facts, sizes, pairs, links = [], [], [self.pairs], [self.links]
        for i, unit in enumerate(units):
            fact, groups, p, n = (known[i] if i in known else self.alone(unit)) or ((-1, 0, 0, 0), "", NONE, NONE)
            facts.append(fact)
            self.groups.append(groups)
            sizes.append(len(p))
            pairs.append(p)
            links.append(n)
        self.facts = np.concatenate([self.facts, np.array(facts, np.int64).reshape(-1, 4)])
        self.size = np.concatenate([self.size, np.array(sizes, np.int64)])
        self.start = np.cumsum(self.size) - self.size
        self.pairs, self.links = np.concatenate(pairs), np.concatenate(links)

    def alone(self, unit: str):
        """What ``aligned`` gives for one unit. B adds a space to what it gets: a unit's own first space is left out for it, or the added one afterwards."""
        if unit == " ":
            b = [self.space]  # B adds nothing to an empty text
        elif unit[0] == " ":
            b = self.b.encode(unit[1:])
        else:
            b = self.b.encode(unit)
            b = b[1:] if b[:1] == [self.space] else []
        return self.aligned(self.a.encode(unit, add_special_tokens=False).ids, b, unit.encode())

    def together(self, units: list[str]) -> list[tuple] | None:
        """The same for units that begin with white space and end without; None if one of them needs ``alone``."""
        whole = " x" + "".join(units)
        raw = whole.encode()
        a, b = self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(whole[1:])
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return None
        ends = 2 + np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
        a_upto, b_upto = align(np.fromiter(map(len, a_bytes), np.int64, len(a)), np.fromiter(map(len, b_bytes), np.int64, len(b)))
        at = np.cumsum(np.fromiter(map(len, a_bytes), np.int64, len(a)))[a_upto - 1]  # the common ends
        last = np.searchsorted(at, ends)
        in_a, in_b = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
        links = in_a * in_b
        if last[-1] >= len(at) or (at[last] != ends).any() or links.max() > LINKS_AT_ONCE or at[0] != 2:
            return None
        upto = np.cumsum(links)
        group = np.repeat(np.arange(len(links)), links)
        place = np.arange(upto[-1]) - (upto - links)[group]
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        pairs = (ids_a[(a_upto - in_a)[group] + place // in_b[group]] << 32) | ids_b[(b_upto - in_b)[group] + place % in_b[group]]
        words_a, words_b, xs, ys = list(map(str, a)), list(map(str, b)), a_upto.tolist(), b_upto.tolist()
        texts = [f"{','.join(words_a[i:x])}|{','.join(words_b[j:y])}" for i, x, j, y in zip([0, *xs], xs, [0, *ys], ys, strict=False)]
        first = np.concatenate([[1], last[:-1] + 1])
        facts = np.stack([a_upto[last] - a_upto[first - 1], b_upto[last] - b_upto[first - 1], last + 1 - first, upto[last] - upto[first - 1]], axis=1)
        ones = np.ones(upto[-1], np.int64)
        cut = [(x, y, i, j) for x, y, i, j in zip(first.tolist(), (last + 1).tolist(), upto[first - 1].tolist(), upto[last].tolist(), strict=True)]
        return [(tuple(f), ";".join(texts[x:y]), pairs[i:j], ones[i:j]) for f, (x, y, i, j) in zip(facts.tolist(), cut, strict=True)]

    def of(self, texts: list[str]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray] | None]:
        """What ``aligned`` gives for each text that is not empty."""
        if len(self.numbers) > MEMO_UNITS:
            self.clear()
        cut: list[np.ndarray | None] = []
        for text in texts:
            if not self.by_units or _WHOLE.search(text):
                cut.append(None)
                continue
            units = _UNIT.findall(" " + text)
            cut.append(np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units)))
        if self.numbers.new:
            self.learn(self.numbers.new)
            self.numbers.new = []
        for text, index in zip(texts, cut, strict=True):
            if index is None:
                yield self.whole(text)
                continue
            facts = self.facts[index]
            if facts[:, 0].min() < 0:
                yield None
                continue
            each, many = np.unique(index, return_counts=True)
            size = self.size[each]
            upto = np.cumsum(size)
            at = np.repeat(self.start[each] - upto + size, size) + np.arange(upto[-1])
            pairs, links = _summed(self.pairs[at], self.links[at] * np.repeat(many, size))
            yield tuple(facts.sum(axis=0).tolist()), ";".join([self.groups[i] for i in index.tolist()]), pairs, links


def _summed(pairs: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order, with the sums of their links."""
    order = np.argsort(pairs, kind="stable")
    pairs, links = pairs[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.add.reduceat(links, first)


def _linked(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All different pairs (a * 2^32 + b) of a group, and how many of its links are such. A group's size is not bounded; its pairs are made of different ids."""
    if len(a) == 1 and len(b) == 1:
        return np.array([(a[0] << 32) | b[0]], np.int64), np.ones(1, np.int64)
    x, many_x = np.unique(np.array(a, np.int64), return_counts=True)
    y, many_y = np.unique(np.array(b, np.int64), return_counts=True)
    return ((x << 32)[:, None] | y[None, :]).ravel(), (many_x[:, None] * many_y[None, :]).ravel()


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


_ALIGNED = pa.schema([("digest", pa.binary()), ("documents", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])


def digest(text: Column) -> Column:
    """Identity of a text in joins: SHA-256 of its UTF-8."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text, documents: every text that is not empty, once, with the number of its rows. The shuffle is by the full text; copies are counted before it."""
    return docs.where("text is not null and text != ''").groupBy("text").agg(F.count("*").alias("documents"))


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """digest, documents, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * 2^32 + b, each once), links (occurrences of each) of distinct texts;
    zeros, '' and no pairs for texts that a tokenizer doesn't give back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            rows, pairs, links, held = [], [], [], 0
            digests, documents = batch["digest"].to_pylist(), batch["documents"].to_pylist()
            for i, one in enumerate(own.of(batch["text"].to_pylist())):
                facts, groups, p, n = one or ((0, 0, 0, 0), "", NONE, NONE)
                rows.append((digests[i], documents[i], *facts, hashlib.sha256(groups.encode()).hexdigest() if one else ""))
                pairs.append(p)
                links.append(n)
                held += len(p)
                if held > PAIRS_AT_ONCE:
                    yield _batch(rows, pairs, links)
                    rows, pairs, links, held = [], [], [], 0
            if rows:
                yield _batch(rows, pairs, links)

    return texts.select(digest(F.col("text")).alias("digest"), "documents", "text").mapInArrow(work, "digest binary, documents long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>")


def _batch(rows: list[tuple], pairs: list[np.ndarray], links: list[np.ndarray]) -> pa.RecordBatch:
    edges = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ALIGNED, strict=False)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(edges, pa.array(np.concatenate(pairs))), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(links)))], schema=_ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, count (documents that hold it linked), texts (different ones), best (its count is the highest of its a)."""
    pairs = aligned.select("documents", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("documents").alias("count"), F.count("*").alias("texts"))
    pairs = pairs.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    highest = pairs.groupBy("a").agg(F.max("count").alias("highest"))
    return pairs.join(highest, "a").select("pair", "a", "b", "count", "texts", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id long, text string).

    Every row counts as a document, also where ids or rows repeat. Null and empty texts,
    and texts that one of the tokenizers doesn't give back byte for byte, have zeros and ''.
    Ties for the highest count are all best. Texts are encoded whole, whatever their
    length. Other columns take no part, whatever their names; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    default_a, default_b = (path_a, path_b) if path_a and path_b else default_paths()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = shared.keep(aligned_texts(distinct_texts(docs), path_a or default_a, path_b or default_b).withColumn("number", F.monotonically_increasing_id()), "aligned")
    counts = shared.keep(pair_counts(aligned).select("pair", "count", "best", "texts"), "pair-counts")
    rows = counts.agg(F.sum("texts")).first()[0] or 0
    exploded = aligned.select("number", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("number", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    measured = shared.join_spread(exploded, counts, "pair", F.col("texts") >= max(2, rows * FREQUENT_SHARE))
    measured = measured.groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    zeros = {c: F.lit(0).cast("long") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups_sha256": F.lit("")}
    facts = aligned.drop("pairs", "links").join(measured, "number", "left").drop("number").fillna(0, ["n_best", "count_sum"])
    facts = shared.keep(facts, "text-measures")
    documents = facts.agg(F.sum("documents")).first()[0] or 0
    asked = docs.where("text is not null and text != ''").select("doc_id", digest(F.col("text")).alias("digest"))
    matched = shared.join_spread(asked, facts, "digest", F.col("documents") > documents * shared.HOT_SHARE)
    columns = ["doc_id", *zeros]
    return matched.select(*columns).unionByName(docs.where("text is null or text = ''").withColumns(zeros).select(*columns))
