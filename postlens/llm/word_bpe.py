"""Cutting a text into the pieces that a lower-casing word BPE tokenizer sees.

The tokenizer file gives everything: special strings, normaliser, piece pattern, merges.
A text is cut at white space first; each such word is looked up in a bounded cache, so
only new words go through the normaliser and the pattern.  That is exact because neither
of the two looks across white space (``fits`` checks the file for it).
"""

from __future__ import annotations

import json
import re

import public_tokenizers
import regex
from tokenizers import Tokenizer

from postlens.llm.byte_chars import BYTE_CHARS

WORD_BPE = "word_bpe_49k.json"
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\s0-9A-Za-z]+", re.A)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = re.compile("[ \t-\r\x85\xa0  -     　]+")


_LATIN_PIECE = regex.compile(_PATTERN)


class WordBpe:
    def __init__(self, file: str = WORD_BPE):
        path = public_tokenizers.path(file)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        if not self.fits():
            raise ValueError(f"{file}: not a lower-casing word BPE that drops white space")

    def fits(self) -> bool:
        norm = [n["type"] for n in self.spec["normalizer"]["normalizers"]]
        split = self.spec["pre_tokenizer"]["pretokenizers"][0]
        return (norm == ["NFC", "Replace", "Lowercase"] and split["pattern"].get("Regex") == _PATTERN
                and split["behavior"] == "Removed" and split["invert"]
                and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]
                            for t in self.spec["added_tokens"]))

    def words(self, text: str | None) -> list[str]:
        """The text cut at white space; lower-cased already where that changes nothing."""
        if not text:
            return []
        if text.isascii() and "<|" not in text:
            text = text.lower()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [w for w in _SPACES.split(text) if w]   # str.split would cut at these four too
        return text.split()

    def pieces(self, word: str) -> list[str | int]:
        """The byte-mapped pieces of a word; a special string gives its id."""
        if "<|" in word and self._cut is not None:
            out: list[str | int] = []
            for part in self._cut.split(word):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(word)

    def _plain(self, word: str) -> list[str]:
        if word.isprintable():
            if word.isascii():
                return _ASCII_PIECE.findall(word.lower())
            if max(word) < "\u0250":             # Latin letters: composed already, lower-cased one by one
                return [p.encode().decode("latin-1").translate(BYTE_CHARS) for p in _LATIN_PIECE.findall(word.lower())]
        norm = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
