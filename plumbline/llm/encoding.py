"""Texts to token ids with a public tokenizer, memoised by chunks that its pre-tokenizer never joins.

A vocabulary's pre-tokenizer cuts a text at white space before any merge, so ids of a text are the
concatenated ids of such chunks.  Chunks repeat, and each task looks most of them up.  A new chunk
that is one pre-token by itself (Latin letters) goes straight to the tokenizer's model; any other
goes through the whole tokenizer.  The memo is bounded: it has two generations, and when the young one is
full it takes the place of the old, so that chunks in use stay.  Long chunks bypass it.

Control strings of a vocabulary (its added tokens) inside a text become their own ids, as the
tokenizers library does it: they part a text before anything else, and what stands between two of
them is encoded as a text of its own.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

#: Chunks that a generation of a worker's memo remembers, and the length beyond which one is not remembered.
MEMO_ENTRIES, MEMO_CHARS = 1 << 17, 64
#: The last character of which all Latin-1 letters are their own composed form.
LATIN = "ÿ"


def _byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary: as it is if printable, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Memo(dict):
    """Chunk to ids: the young generation; what it lacks comes from the old one, or is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk):
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """ids as little-endian unsigned 32-bit bytes: the same as the vocabulary's tokenizer gives without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.alphabet = _byte_alphabet()
        assert set(self.alphabet.values()) == set(pre_tokenizers.ByteLevel.alphabet())
        self.added = {t.content: self.id_bytes[i] for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.control = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def direct(self, text: str) -> bytes:
        return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def pre_token(self, text: str) -> bytes:
        """The ids of a text that is one pre-token."""
        if text.isascii():
            shown = text.replace(" ", self.alphabet[32])
        else:
            shown = text.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(shown)])

    def encode(self, text: str) -> bytes:
        parts = self.control.split(text)
        if len(parts) == 1:
            return self.plain(text)
        return b"".join([self.added[part] if k % 2 else self.plain(part) for k, part in enumerate(parts)])

    def plain(self, text: str) -> bytes:
        """The ids of a text without control strings."""
        raise NotImplementedError


def _letters(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) <= LATIN)


class WordEncoder(Encoder):
    """For vocabularies that drop white space and case: chunks are what ASCII white space parts."""

    def __init__(self, path: str):
        super().__init__(path)
        self.memo = _Memo(self.chunk)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, text.encode().split()))

    def chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _letters(text):
            return self.pre_token(text.lower())
        if text[-1] in ".," and _letters(text[:-1]):
            return self.memo[chunk[:-1]] + self.memo[chunk[-1:]]
        return self.direct(text)


class SpacedEncoder(Encoder):
    """For byte-level vocabularies whose pre-tokens take one space in front."""

    _pair = re.compile(r"\s\s")
    _safe = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str):
        super().__init__(path)
        self.first, self.spaced = _Memo(lambda c: self.chunk("", c)), _Memo(lambda c: self.chunk(" ", c))
        self.newline = self.direct("\n")

    def plain(self, text: str) -> bytes:
        if self._pair.search(text):
            # A space between two other characters always begins a pre-token; other runs of white space stay whole.
            head, *rest = self._safe.split(text)
            return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))
        # A line's first word goes by the newline before it, any other by its space.
        head, *rest = text.replace("\n", " \n").split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))

    def chunk(self, before: str, text: str) -> bytes:
        if _letters(text):
            return self.pre_token(before + text)
        if before and text[:1] == "\n" and "\n" not in text[1:]:
            return self.newline + self.first[text[1:]]
        if text[-1:] in (".", ",") and _letters(text[:-1]):
            return (self.spaced if before else self.first)[text[:-1]] + self.first[text[-1]]
        return self.direct(before + text)


VOCABULARIES = {"word_bpe_49k.json": WordEncoder, "byte_bpe_50k.json": SpacedEncoder}


@lru_cache(maxsize=2)
def encoder(vocabulary: str, folder: str | None = None) -> Encoder:
    """The encoder of a vocabulary file by name, one a Python worker."""
    path = f"{folder}/{vocabulary}" if folder else public_tokenizers.path(vocabulary)
    return VOCABULARIES[vocabulary](path)
