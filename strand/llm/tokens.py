"""Token ids of a public tokenizer file as little-endian unsigned 32-bit bytes, with a cache of words."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np

from .common import hand_back

#: Words of these characters only (ASCII and Latin-1 letters): no normal form changes them and each of
#: their characters is lower-cased by itself, so they can be cut without the tokenizer's own splitter.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The file's own split pattern (a fixed value), for those characters.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ÿ]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of each of the cache's two generations: about 200 bytes an entry.
_CACHED = 250_000
_LONGEST = 64


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as one printable letter: printable bytes as themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Generations(dict):
    """A bounded cache of ``make(key)``: when it is full all of it becomes the old generation, and what is asked for again is
    young again. A lookup that hits is one step of the dict itself."""

    def __init__(self, size: int, make: Callable[..., bytes]):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= _LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class WordIds:
    """ids(text) of one tokenizer. Memory is bounded by the cache's bound."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        pre = (stored.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        # words are looked up one by one only where the file's rules are those that this class knows
        self.by_word = (
            (pre[0].get("pattern") or {}).get("Regex") == _SPLIT
            and [x.get("type") for x in (stored.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        self.special = [x["content"].encode() for x in stored.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = Generations(_CACHED, self._word)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, part: str) -> bytes:
        """Ids of one part of the file's split, already in lower case."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters: one part
            return self._letters(word.decode().lower())
        text = word.decode()
        if not _PLAIN.fullmatch(text):
            return self._whole(text)
        parts = _PARTS.findall(text.lower())
        if len(parts) == 1:
            return self._letters(parts[0])
        return b"".join([self.words[x.encode()] for x in parts])

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text, 4 bytes each, without special tokens added; those in the text count as such."""
        if not text:
            return b""
        data = text.encode()
        if not self.by_word or any(s in data for s in self.special):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, data.split()))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of ``path``, loaded once a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
        hand_back()  # the file's text is large
    return _LOADED[path]
