"""Encoding texts word by word with a worker's caches in front of the tokenizer.

Both vocabularies split a text into pre-tokens before merging bytes, and no pre-token crosses
from white space into a word, so a text is the sum (or the chain) of its pieces, each of which
needs the tokenizer once. Caches keep short pieces only and stop growing at ``CACHE`` entries;
a piece that finds no place is encoded again, so results never depend on them.
"""

from __future__ import annotations

import re
import sys
from array import array

import regex
from tokenizers import Tokenizer

CACHE = 700_000
LONGEST_CACHED = 48

# The white space of Unicode, and the pre-token pattern of the byte vocabulary.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD = re.compile(f"[^{SPACE}]+")
PRE_TOKEN = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# Words of Latin letters and marks: each run of letters, and each of marks, is one pre-token. The
# marks leave out what starts a contraction or a special string.
LETTER, MARK = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"
PLAIN_PART = re.compile(f"[{LETTER}]+|[{MARK}]+")
PLAIN_WORD = re.compile(f"[{LETTER}{MARK}]+").fullmatch
# What str.split takes for white space though the vocabulary does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


def as_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(LETTERS)


class _Cache(dict):
    def keep(self, key: str, value):
        if len(key) <= LONGEST_CACHED and len(self) < CACHE:
            self[key] = value
        return value


def vocabulary_lengths(path: str) -> dict[str, int]:
    """Tokens of every vocabulary entry that is a whole pre-token: the frequent pre-tokens, as
    merges were learnt from counts. Its size is bounded by the vocabulary's."""
    tokenizer = Tokenizer.from_file(path)
    model, bytes_of = tokenizer.model, {c: b for b, c in LETTERS.items()}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    table = {}
    for entry in tokenizer.get_vocab():
        if entry in special:
            continue
        text = bytes(bytes_of[c] for c in entry).decode("utf-8", "replace")
        if "\ufffd" not in text and PRE_TOKEN.fullmatch(text):
            table[text] = len(model.tokenize(entry))
    return table


class TokenCounter:
    """Token counts of whole texts under a byte-level vocabulary."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        counter = self

        class Pieces(_Cache):
            def __missing__(self, piece: str) -> int:
                found = PRE_TOKEN.findall(piece)
                return self.keep(piece, sum(map(counter.length, found)))

        self.frequent, self.seen, self.pieces = frequent, _Cache(), Pieces()

    def length(self, pre_token: str) -> int:
        known = self.frequent.get(pre_token) or self.seen.get(pre_token)
        if known is None:
            tokens = self.tokenizer.model.tokenize(as_letters(pre_token))
            known = self.seen.keep(pre_token, len(tokens))
        return known

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.pieces.__getitem__, PIECE.findall(text)))


class WordIds:
    """Token ids of whole texts, as little-endian 32-bit numbers, under a vocabulary that drops
    white space and never joins two words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        encoder = self

        class Words(_Cache):
            def __missing__(self, word: str) -> bytes:
                return self.keep(word, encoder.encode_word(word))

        self.words = Words()

    def encode_word(self, word: str) -> bytes:
        if not PLAIN_WORD(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            parts = PLAIN_PART.findall(word)
            if len(parts) > 1:
                return b"".join(map(self.words.__getitem__, parts))
            ids = [t.id for t in self.tokenizer.model.tokenize(as_letters(word.lower()))]
        values = array("I", ids)
        if sys.byteorder == "big":
            values.byteswap()
        return values.tobytes()

    def encode(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return b"".join(map(self.words.__getitem__, WORD.findall(text)))
        return b"".join(map(self.words.__getitem__, text.split()))
