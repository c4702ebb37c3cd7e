"""Token counts of texts under a byte-level vocabulary, by rank-synchronous merging of arrays.

Pre-tokens that a task has not met are held together as one ragged numpy array of symbols.  A round
finds each sequence's lowest-ranked pair of neighbours and applies it everywhere in that sequence at
once, runs of equal symbols from the left; then only pairs beside a merged symbol get a new rank.
Sequences without a pair that merges leave with their length, which is the count.  That equals
merging one pair at a time, because a merge's symbols are always older than the merge (checked when
the vocabulary is read), so no merge makes a pair of lower rank than its own.

Texts are parted at control strings, which are one token each, and then at single spaces before a
word, where pre-tokens never join; counts of such chunks are remembered up to a bound.  Chunks that
are not plainly one word are cut by the vocabulary's own pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_schema, portions, spark_schema
from .encoding import LATIN
from .encoding import _byte_alphabet as byte_alphabet

#: Chunks a worker remembers before it starts anew, and the length beyond which one is not remembered.
MEMO_ENTRIES, MEMO_CHARS = 1 << 19, 64
#: Symbols merged together; a longer pre-token is merged by itself.
BATCH_SYMBOLS = 1 << 17
#: The rank of a pair that does not merge.
NEVER = np.int32(np.iinfo(np.int32).max)

COUNTS = arrow_schema(doc_id=pa.int64(), n_bytes=pa.int64(), n_tokens=pa.int64())


class Merges:
    """The ranked pairs of a vocabulary, looked up by arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        left, right, self.made = np.array(pairs, np.int64).reshape(-1, 3).T
        born = np.full(max(vocabulary.values()) + 1, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge is ranked before one that makes its symbols")
        self.made = self.made.astype(np.int32)
        self.size = np.int64(len(born))
        # Open addressing: a place for each pair after the multiplied key, the next free one if it is taken.
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        keys = left * self.size + right
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._place(keys).tolist(), strict=True)):
            while self.keys[at] != -1:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for one that does not merge."""
        keys = left * self.size + right
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NEVER)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            out[open_] = np.where(found == keys[open_], self.ranks[at[open_]], NEVER)
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return out

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; symbols holds all sequences in a row, lengths (at least 1) says where they end."""
        out = lengths.copy()
        symbols, name = symbols.astype(np.int64), np.arange(len(lengths))
        starts = np.cumsum(lengths) - lengths
        ranks = np.full(len(symbols), NEVER, np.int32)
        if len(symbols) > 1:
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[starts[1:] - 1] = NEVER  # a sequence's last symbol has no right neighbour
        while len(starts):
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest != NEVER
            if not going.all():  # sequences that are done leave
                stay = np.repeat(going, lengths)
                symbols, ranks = symbols[stay], ranks[stay]
                name, lengths, lowest = name[going], lengths[going], lowest[going]
                starts = np.cumsum(lengths) - lengths
                if not len(starts):
                    break
            hit = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            # Within a run of overlapping pairs every other one merges, from the left.
            fresh = np.ones(len(hit), bool)
            fresh[1:] = np.diff(hit) != 1
            if not fresh.all():
                run = np.cumsum(fresh) - 1
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(fresh)[run]) % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[hit], minlength=len(lengths))
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, ranks = symbols[keep], ranks[keep]
            starts = np.cumsum(lengths) - lengths
            out[name] = lengths
            at = hit - np.arange(len(hit))  # each merge before it has moved it one to the left
            touched = np.concatenate((at, at[at > 0] - 1))
            inner = np.ones(len(symbols), bool)
            inner[starts + lengths - 1] = False
            ranks[at] = NEVER
            touched = touched[inner[touched]]
            ranks[touched] = self.rank(symbols[touched], symbols[touched + 1])
        return out


class Counter:
    """Counts tokens: as many as the vocabulary's tokenizer gives without special tokens of its own."""

    _pair = re.compile(r"\s\s")
    _safe = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        tokenizer = Tokenizer.from_file(path)
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.merges = Merges(model["vocab"], map(tuple, model["merges"]))
        shown = byte_alphabet()
        self.byte_of = {ord(char): chr(byte) for byte, char in shown.items()}
        self.symbol = np.array([model["vocab"][shown[byte]] for byte in range(256)], np.int64)
        control = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.control = re.compile("(?:" + "|".join(map(re.escape, control)) + ")")
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; what is new in any of them is merged together."""
        if len(self.first) + len(self.spaced) > MEMO_ENTRIES:
            self.first.clear()
            self.spaced.clear()
        cut = [[self._chunks(part) for part in self.control.split(text)] for text in texts]
        heads = {head for parts in cut for head, _ in parts}
        rests: set[str] = set()
        for parts in cut:
            for _, rest in parts:
                rests.update(rest)
        self._learn("", heads.difference(self.first), self.first)
        self._learn(" ", rests.difference(self.spaced), self.spaced)
        first, spaced = self.first, self.spaced.__getitem__
        out = [len(parts) - 1 + sum([first[head] + sum(map(spaced, rest)) for head, rest in parts]) for parts in cut]
        for memo in (self.first, self.spaced):
            for chunk in [c for c in (heads if memo is first else rests) if len(c) > MEMO_CHARS]:
                del memo[chunk]
        return out

    def _chunks(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the chunks that each follow a space (or a line break, which they then begin with)."""
        if self._pair.search(text):
            head, *rest = self._safe.split(text)  # runs of white space stay whole
        else:
            head, *rest = text.replace("\n", " \n").split(" ")
        return head, rest

    def _learn(self, before: str, chunks: set[str], memo: dict[str, int]) -> None:
        """Counts of new chunks that follow a space, or stand first."""
        words = [c for c in chunks if c.isalpha() and (c.isascii() or max(c) <= LATIN)]
        others = list(chunks.difference(words))
        pieces = [(before + c).encode() for c in words]
        number = dict(zip(pieces, range(len(pieces)), strict=True))
        owners, parts = [], []
        for k, chunk in enumerate(others):
            for piece in self._pieces(before, chunk):
                owners.append(k)
                parts.append(number.setdefault(piece, len(number)))
        each = self._merged(list(number))
        memo.update(zip(words, each.tolist(), strict=False))
        if others:
            memo.update(zip(others, np.bincount(owners, each[parts], len(others)).astype(np.int64).tolist() if owners else [0] * len(others), strict=True))

    def _pieces(self, before: str, chunk: str) -> list[bytes]:
        """The pre-tokens of a chunk as bytes."""
        if _word(chunk):
            return [(before + chunk).encode()]
        if before and chunk[:1] == "\n" and "\n" not in chunk[1:]:
            return [b"\n", *self._pieces("", chunk[1:])]
        if chunk[-1:] in (".", ",") and _word(chunk[:-1]):
            return [(before + chunk[:-1]).encode(), chunk[-1:].encode()]
        return [piece.translate(self.byte_of).encode("latin-1") for piece, _ in self.cut(before + chunk)]

    def _merged(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        ends, out, at = np.cumsum(lengths), np.empty(len(pieces), np.int64), 0
        while at < len(pieces):
            begin = ends[at] - lengths[at]
            end = max(at + 1, int(np.searchsorted(ends, begin + BATCH_SYMBOLS, side="right")))
            out[at:end] = self.merges.survivors(symbols[begin : ends[end - 1]], lengths[at:end])
            at = end
        return out


def _word(text: str) -> bool:
    """Latin letters alone: one pre-token whatever the pre-tokenizer's tables say of others."""
    return text.isalpha() and (text.isascii() or max(text) <= LATIN)


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """A worker's counter of a vocabulary file."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    Defined results: a null text is empty and has no token; every row gives a row, repeated or
    null doc_ids too; control strings in a text are one token each; further columns are ignored.
    folder: where the vocabulary file lies, if not with the installed public tokenizers.
    """

    def counted(batches):
        count = counter(f"{folder}/{vocabulary}" if folder else public_tokenizers.path(vocabulary)).count
        for batch in portions(batches):
            text = pc.fill_null(batch.column("text"), "")
            tokens = pa.array(count(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), tokens], schema=COUNTS)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, spark_schema(COUNTS))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
