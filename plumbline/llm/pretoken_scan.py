"""Where pre-tokens begin, found by scanning character classes; no regular expression runs over
a text.

The pattern of the rank files is a finite automaton once every character carries a little of what
follows it: an apostrophe whether a contraction does, white space whether it is the last of its
run. A character is then one of nine symbols, and a symbol is a function from the state before it
to the state after it. Composition of functions is associative, so a batch of texts is cut into
blocks of equal length, all blocks are scanned at once, and one more scan over the blocks gives
the state that enters each. The functions that any string of symbols can amount to are few: they
are numbered, and composing two of them is one table lookup.

Class table. Letters, numbers and white space are those of the tokenizer library's Unicode
version. Where the two databases at hand disagree on a code point, the library itself is asked.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex
import tiktoken

OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, END_OF_TEXT = range(7)
CODE_POINTS = 0x110000
BLOCK = 128
# What follows the apostrophe of a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")

# Symbols: a class and what it is followed by.
L, N, O, Q1, Q2, BLANK_LAST, SPACE_LAST, SPACE_ON, END = range(9)
# States: what the character before belongs to. FRESH: the next one begins a pre-token.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
STATES, SYMBOLS = 8, 9


def ask_library(points: list[int], pattern: str) -> dict[int, int]:
    """The class that the tokenizer library gives to code points: whether it keeps each in one
    pre-token with a letter, a number or a mark after it."""
    ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
    texts = [chr(p).encode() for p in points]
    for text in texts:
        for end in range(2, len(text) + 1):
            ranks.setdefault(text[:end], len(ranks))
    for text in texts:
        for follower in (b"a", b"1", b"!"):
            ranks.setdefault(text + follower, len(ranks))
    library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for p in points:
        joined = [len(library.encode_ordinary(chr(p) + f)) == 1 for f in "a1!"]
        out[p] = LETTER if joined[0] else NUMBER if joined[1] else OTHER
    return out


@functools.lru_cache(maxsize=2)
def class_table(pattern: str) -> np.ndarray:
    """Class per code point; the entry after the last is the end of a text."""
    points = np.r_[0:0xD800, 0xE000:CODE_POINTS].astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    table = np.zeros(CODE_POINTS + 1, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(name, text):
            table[points[run.start() : run.end()]] = kind
    older = {"L": LETTER, "N": NUMBER}
    unsure = [
        int(p) for p in points
        if table[p] in (OTHER, LETTER, NUMBER) and older.get(unicodedata.category(chr(p))[0], OTHER) != table[p]
    ]
    for p, kind in ask_library(unsure, pattern).items():
        table[p] = kind
    table[ord(" ")], table[ord("'")], table[CODE_POINTS] = BLANK, QUOTE, END_OF_TEXT
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """``after[state, symbol]`` and ``begins[state, symbol]``."""
    after = np.zeros((STATES, SYMBOLS), np.uint8)
    begins = np.ones((STATES, SYMBOLS), bool)
    for symbol, state in (
        (L, IN_LETTERS), (N, IN_NUMBERS), (O, IN_OTHERS), (Q1, ONE_MORE), (Q2, TWO_MORE),
        (BLANK_LAST, AFTER_BLANK), (SPACE_LAST, FRESH), (SPACE_ON, IN_SPACE), (END, FRESH),
    ):
        after[:, symbol] = state
    for state, symbols in (
        (IN_LETTERS, [L]), (IN_NUMBERS, [N]), (IN_OTHERS, [O, Q1, Q2]), (IN_SPACE, [SPACE_ON]),
        (AFTER_BLANK, [L, N, O, Q1, Q2]), (ONE_MORE, [L]), (TWO_MORE, [L]),
    ):
        begins[state, symbols] = False
    # An apostrophe inside a run of marks, or after a blank, is a mark.
    for state in (IN_OTHERS, AFTER_BLANK):
        after[state, [Q1, Q2]] = IN_OTHERS
    after[TWO_MORE, L], after[ONE_MORE, L] = ONE_MORE, FRESH
    begins[:, END] = False
    return after, begins


AFTER, BEGINS = automaton()


@functools.lru_cache(maxsize=1)
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that strings of symbols amount to: ``apply[f, state]``, ``extend[f, symbol]``
    (f, then the symbol) and ``compose[f, g]`` (f, then g). Number 0 is the identity."""
    known = {tuple(range(STATES)): 0}
    found, extend = [tuple(range(STATES))], []
    for f in found:
        row = []
        for symbol in range(SYMBOLS):
            g = tuple(int(AFTER[s, symbol]) for s in f)
            if g not in known:
                known[g] = len(found)
                found.append(g)
            row.append(known[g])
        extend.append(row)
    apply = np.array(found, np.uint8)
    compose = np.array([[known[tuple(int(x) for x in apply[g][apply[f]])] for g in range(len(found))] for f in range(len(found))])
    return apply, np.array(extend, np.uint16), compose.astype(np.uint16)


def symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of code points in which every text is followed by ``CODE_POINTS``."""
    kind = table[points]
    following = np.append(kind[1:], END_OF_TEXT)
    spaces = (kind == SPACE) | (kind == BLANK)
    on = (following == SPACE) | (following == BLANK) | (following == END_OF_TEXT)
    out = np.array([O, L, N, SPACE_LAST, BLANK_LAST, O, END], np.uint8)[kind]
    out[spaces & on] = SPACE_ON
    at = np.flatnonzero(kind == QUOTE)
    padded = np.append(points, [CODE_POINTS, CODE_POINTS])
    one, two = padded[at + 1], padded[at + 2]
    out[at[np.isin(one, [ord(c) for c in SHORT])]] = Q1
    for a, b in LONG:
        out[at[(one == ord(a)) & (two == ord(b))]] = Q2
    return out


def states_before(sym: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The state before every symbol, from FRESH, by a blocked scan of composed functions."""
    apply, extend, compose = functions()
    n = len(sym)
    blocks = -(-n // block)
    padded = np.full(blocks * block, END, np.uint8)
    padded[:n] = sym
    columns = np.ascontiguousarray(padded.reshape(blocks, block).T)
    before = np.empty((block, blocks), np.uint16)
    flat, current = extend.ravel(), np.zeros(blocks, np.uint16)
    for j in range(block):
        before[j] = current
        current = flat[current.astype(np.int32) * SYMBOLS + columns[j]]
    # Prefixes of whole blocks: each round composes with twice as many blocks before.
    total, reach = current, 1
    while reach < blocks:
        joined = total.copy()
        joined[reach:] = compose[total[:-reach], total[reach:]]
        total, reach = joined, reach * 2
    enters = np.full(blocks, FRESH, np.uint8)
    enters[1:] = apply[total[:-1], FRESH]
    return apply[before, enters[None, :]].T.ravel()[:n]


def boundaries(texts: list[str], table: np.ndarray) -> list[np.ndarray]:
    """For each text the places of the characters that begin a pre-token."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1)
    points = np.full(int(ends[-1]) if len(texts) else 0, CODE_POINTS, np.uint32)
    own = np.ones(len(points), bool)
    own[ends - 1] = False
    points[own] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = symbols(points, table)
    begin = np.flatnonzero(BEGINS[states_before(sym), sym])
    cuts = np.searchsorted(begin, ends)
    starts = ends - lengths - 1
    return [part - s for part, s in zip(np.split(begin, cuts[:-1]), starts)] if len(texts) else []
