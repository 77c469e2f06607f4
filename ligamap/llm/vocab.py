"""Public tokenizers with bounded caches of whole words, for use inside Python workers."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Characters whose case mapping, letter class and composition are the same in every Unicode version in use. A text with any other goes whole to the library.
PLAIN = re.compile(r"[^\x00-įı-ɏ‐-‧‰-›€]")

#: The pre-token pattern of byte-level BPE, and the one of the word-end vocabulary (applied to lower case).
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


#: Length of the longest key that a cache keeps.
LONGEST_KEY = 64


class Cache(dict):
    """A dict that fills itself from ``make`` and holds two generations of at most ``most`` entries each.

    Keys over LONGEST_KEY are rare and made anew each time, so that the entries bound the bytes too.
    """

    def __init__(self, make: Callable, most: int, fixed: dict | None = None):
        super().__init__()
        self.make, self.most, self.old, self.fixed = make, most, {}, fixed or {}

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.make(key)
        value = self.fixed.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter of each byte, as a table for str.translate on a Latin-1 view of the bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's without added special tokens.

    Pre-tokens never depend on each other, so each is encoded once and kept in a cache. Texts that hold a special
    string, or characters outside PLAIN, go to the library whole.
    """

    def __init__(self, path: str, words: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = Cache(self.encode_piece, words)

    def encode_piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))

    def whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)

    def odd(self, text: str) -> bool:
        return bool(not text.isascii() and PLAIN.search(text)) or any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if self.odd(text):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, BYTE_LEVEL.findall(text)))


class WordEndIds(Ids):
    """The same for the lower-case word-end vocabulary: runs between spaces and line ends are cached, then their pre-tokens."""

    def __init__(self, path: str, words: int = 400_000):
        super().__init__(path, words // 2)
        self.runs = Cache(self.encode_run, words)

    def encode_run(self, run: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, WORD_END.findall(run)))

    def encode(self, text: str) -> bytes:
        if self.odd(text):
            return self.whole(text)
        return b"".join(map(self.runs.__getitem__, text.replace("\n", " ").lower().split(" ")))
