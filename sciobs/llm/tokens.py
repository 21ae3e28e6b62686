"""Token ids of whole texts, with a memo of words.

The default tokenizer normalises character by character, cuts a text into words
(runs of letters, single digits, runs of signs) and merges only inside a word.
So a text's ids are the ids of its words in order, and words repeat: each word
is encoded once and remembered. Texts with characters beyond the plain ones,
for which the cut below is proven by test, are encoded by the tokenizer whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Words that a worker remembers, and words that are encoded at once.
MEMO_WORDS, AT_ONCE = 500_000, 4000
#: Characters outside this set, or a possible special token, send a text to the tokenizer itself.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")


_ANY_WORD = re.compile(r"[^\W\d_]+|[0-9]|[^\w\s]+|\w")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class _Words(dict):
    """Word -> number; a new word gets the next one and waits to be encoded."""

    def __init__(self, words: list[str] = ()):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.waiting.append(word)
        return i


class WordTokenizer:
    """Encodes texts with a word-end BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.words = _Words()
        # ids of word i: ids[start[i] : start[i] + size[i]]; sums: its CRC-32
        self.ids, self.start, self.size, self.uses = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sums = np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self) -> None:
        """Encodes the waiting words together; each ends with the first id that ends a word."""
        waiting, self.words.waiting = self.words.waiting, []
        parts, sizes = [self.ids], [self.size]
        for at in range(0, len(waiting), AT_ONCE):
            part = waiting[at : at + AT_ONCE]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(part) or size.sum() != len(ids):
                each = [self.whole(w) for w in part]
                ids, size = np.concatenate(each), np.array([len(e) for e in each])
            parts.append(ids)
            sizes.append(size)
        self.ids, self.size = np.concatenate(parts), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        self.uses = np.concatenate([self.uses, np.zeros(len(waiting), np.int64)])
        self.sums = np.concatenate([self.sums, np.array([zlib.crc32(w.encode()) for w in waiting], np.int64)])

    def forget(self) -> None:
        """Keeps the words used most, at most half of the memo, none that was used once."""
        order = np.argsort(-self.uses, kind="stable")[: MEMO_WORDS // 2]
        kept = np.sort(order[self.uses[order] > 1])
        names = list(self.words)
        self.words = _Words([names[i] for i in kept])
        self.ids = np.concatenate([self.ids[:0], *(self.ids[self.start[i] : self.start[i] + self.size[i]] for i in kept)])
        self.size, self.uses, self.sums = self.size[kept], self.uses[kept] // 2, self.sums[kept]
        self.start = np.cumsum(self.size) - self.size

    def numbered(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[int]]:
        """(rows, numbers of their words in order) of plain texts, and the rows that go to the tokenizer itself; null and empty ones are in neither."""
        if len(self.words) > MEMO_WORDS:
            self.forget()
        rows, found, others = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if _OTHER.search(text):
                others.append(i)
                continue
            words = _WORD.findall(text.lower())
            rows.append(i)
            found.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        if rows:
            self.learn()
            self.uses += np.bincount(np.concatenate(found), minlength=len(self.uses))
        return rows, found, others

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; null: none."""
        out: list[bytes] = [b""] * len(texts)
        rows, found, others = self.numbered(texts)
        for i in others:
            out[i] = self.whole(texts[i]).tobytes()
        if rows:
            index = np.concatenate(found)
            size = self.size[index]
            upto = np.cumsum(size)
            raw = self.ids[np.repeat(self.start[index] - upto + size, size) + np.arange(size.sum())].tobytes()
            edges = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum([len(f) for f in found])])] * 4
            for i, a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out[i] = raw[a:b]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each text the number of its ids, and the CRC-32 of each of its words (lowered; runs of letters, single digits, runs of signs)."""
        many, sums = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)] * len(texts)
        rows, found, others = self.numbered(texts)
        for i, index in zip(rows, found, strict=True):
            many[i], sums[i] = self.size[index].sum(), self.sums[index]
        for i in others:
            words = _ANY_WORD.findall(texts[i].lower())
            many[i] = len(self.whole(texts[i]))
            sums[i] = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        return many, sums


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def encode(texts: list[str | None], path: str) -> list[bytes]:
    return tokenizer(path).encode(texts)
