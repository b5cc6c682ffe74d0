"""Byte-level BPE encoding and decoding with a given vocabulary."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The pre-tokenizer's pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000
LONGEST_CACHED = 64
SHIFT = 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for themselves,
    the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairCodec:
    """A vocabulary file's merges and symbols. merge() is the encoder proper: a heap of merge ranks over a doubly linked list
    of symbols. An entry whose pair has changed since it was pushed is stale and skipped."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        vocab = data["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.strings = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.specials}
        self.strings |= {i: s.encode() for s, i in self.specials.items()}
        self.first = [0] * 256
        for s, i in vocab.items():
            if len(s) == 1 and s in letters:
                self.first[letters[s]] = i
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in data["model"]["merges"]):
            self.made.append(vocab[a + b])
            self.ranks[vocab[a] << SHIFT | vocab[b]] = rank
        self.words = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else lambda t: [t]
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        first, rank_of = self.first, self.ranks.get
        ids = [first[b] for b in word]
        n = len(ids)
        place = n.bit_length()
        # A heap entry is a rank and the place of its left symbol, in one integer.
        heap = [r << place | i for i in range(n - 1) if (r := rank_of(ids[i] << SHIFT | ids[i + 1])) is not None]
        if not heap:
            return tuple(ids)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, made, mask = heapq.heappop, heapq.heappush, self.made, (1 << place) - 1
        while heap:
            e = pop(heap)
            i = e & mask
            left, j = ids[i], after[i]
            if left < 0 or j >= n or rank_of(left << SHIFT | ids[j]) != e >> place:
                continue  # stale
            ids[i] = new = made[e >> place]
            ids[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank_of(new << SHIFT | ids[j])) is not None:
                    push(heap, r << place | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << SHIFT | new)) is not None:
                push(heap, r << place | h)
        return tuple([x for x in ids if x >= 0])

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        cache, merge = self.cache, self.merge
        for part in self.split(text):
            if part in self.specials:
                ids.append(self.specials[part])
                continue
            for word in self.words(part):
                got = cache.get(word)
                if got is None:
                    got = merge(word.encode("utf-8", "replace"))
                    if len(word) <= LONGEST_CACHED:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        cache[word] = got
                ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One per worker process: reading the vocabulary takes longer than a task of small texts."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids (an array column).

    Null text counts as empty and has no tokens. Special tokens' strings in a text become their ids, as the vocabulary's own
    library does by default. No text is cut: a text is encoded word by word, and a word of any length in n log n. Needs no
    shuffle; the only state is a bounded cache of words per worker. Only two columns are read, so others can't clash.
    """
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            n, a, b, lists = [], [], [], []
            for text in batch["text"]:
                ids = c.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                if with_ids:
                    lists.append(ids)
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": a, "decoded_sha256": b})
            yield out.assign(ids=lists) if with_ids else out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_texts(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
