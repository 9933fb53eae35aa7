"""Token ids of whole texts, with the public tokenizer files.

Splitting first, encoding once: both tokenizers never merge across the boundaries used here
(white space for the word tokenizer; a single space between two other characters for the
byte-level one, where the space belongs to what follows), so a text's ids are those of its
chunks in turn. A chunk that a worker has not met goes through the tokenizers library; chunks
met lately come from a cache of bounded size. A text for which a boundary could be wrong is
encoded as a whole.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata

_GAP = re.compile(r"(?<=\S) (?=\S)")
#: White space to Python but not to the tokenizers.
_ODD = "\x1c\x1d\x1e\x1f\x85"
#: Marks that end a word and form one piece of their own; an apostrophe may start a contraction.
_MARKS = string.punctuation.replace("'", "")
#: Characters of the longest chunk that is cached.
LONGEST = 100


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def lines(chunk: str) -> tuple[str, str]:
    """A chunk before and after its first line feed, if that stands between two other characters; else '' for both."""
    one, _, two = chunk.partition("\n")
    return (one, two) if one and two and not one[-1].isspace() and not two[0].isspace() else ("", "")


class _Adjoining(Exception):
    """A chunk that white space adjoins, so that its ids depend on what stands before or after."""


class _Cache(dict):
    """What `make` returns, in two generations: when the new one is full, it becomes the old one, and what the old one held and nobody used again is forgotten.

    Keys of more than LONGEST characters are made anew each time, so its bytes are bounded too.
    """

    def __init__(self, make, size: int):
        self.make, self.left, self.size, self.old = make, size, size, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST:
            return self.make(key)
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        self.left -= 1
        if self.left < 0:
            self.old, self.left = dict(self), self.size
            self.clear()
        self[key] = ids
        return ids


class Encoder:
    """ids of whole texts as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str, width: int = 4, size: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.by_word = any(k.endswith("</w>") for k in vocab)
        self.raw = [i.to_bytes(width, "little") for i in range(max(vocab.values()) + 1)]
        # Runs of letters and marks, never split before they are merged; for the byte-level
        # tokenizer those with a space before them, by what follows the space, and those without.
        self.pieces = _Cache(self.merged(""), size)
        self.spaced = _Cache(self.merged(byte_letters()[32]), size)
        self.chunks = _Cache(self.word if self.by_word else self.spaced_chunk, size)

    def merged(self, lead: str):
        """A function from a run of letters or marks to its ids."""
        merge, raw, letters, join = self.tokenizer.model.tokenize, self.raw, byte_letters(), "".join

        def ids(piece: str) -> bytes:
            if not piece.isascii():
                piece = join([letters[b] for b in piece.encode()])
            return b"".join([raw[token.id] for token in merge(lead + piece)])

        return ids

    def whole(self, text: str) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def word(self, chunk: str) -> bytes:
        """ids of a word: letters and marks that follow them, or else anything."""
        if chunk.isalpha():
            return self.pieces[chunk]
        word = chunk.rstrip(_MARKS)
        return self.pieces[word] + self.pieces[chunk[len(word) :]] if word.isalpha() else self.whole(chunk)

    def spaced_chunk(self, chunk: str) -> bytes:
        """ids of a chunk with the space before it."""
        if chunk.isalpha():
            return self.spaced[chunk]
        word = chunk.rstrip(_MARKS)
        if word.isalpha():
            return self.spaced[word] + self.pieces[chunk[len(word) :]]
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Adjoining
        one, two = lines(chunk)
        return self.spaced_chunk(one) + self.feed() + self.unspaced_chunk(two) if two else self.whole(" " + chunk)

    def unspaced_chunk(self, chunk: str) -> bytes:
        """ids of a chunk at the start of a line."""
        word = chunk.rstrip(_MARKS)
        if word.isalpha():
            return self.pieces[word] + self.pieces[chunk[len(word) :]] if len(word) < len(chunk) else self.pieces[word]
        one, two = lines(chunk)
        return self.unspaced_chunk(one) + self.feed() + self.unspaced_chunk(two) if two else self.whole(chunk)

    def feed(self) -> bytes:
        """ids of a line feed between two other characters."""
        if "\n" not in self.pieces:
            self.pieces["\n"] = self.whole("\n")
        return self.pieces["\n"]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        for c in _ODD:
            if c in text:
                return self.whole(text)
        ids = self.chunks.__getitem__
        if self.by_word:
            if not text.isascii() and ("Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text)):
                return self.whole(text)
            return b"".join(map(ids, text.lower().split()))
        first, *rest = text.split(" ")
        try:
            if first and not first[0].isspace() and not first[-1].isspace():
                return self.unspaced_chunk(first) + b"".join(map(ids, rest))
        except _Adjoining:
            pass
        first, *rest = _GAP.split(text)
        return self.whole(first) + b"".join([ids(c) if not c[-1].isspace() else self.whole(" " + c) for c in rest])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int = 4) -> Encoder:
    """The encoder of this Python worker."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def encoded(texts: list[str | None], path: str, width: int = 4):
    """ids of each text as bytes."""
    return map(encoder(path, width).encode, texts)
