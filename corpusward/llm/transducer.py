"""Token counts by finite-state transducers.

Two deterministic machines are compiled from a vocabulary of word-end BPE tokens:

* one over classes of characters parts a text into words. Its transitions note where words start.
  A run of texts is cut into chunks; a chunk's state map tells, for every state that it may begin
  in, the state that it ends in. Maps compose, so a parallel prefix scan gives each chunk's first
  state, and all chunks then run at once.
* one over a word's symbols (bytes, the last one marked) whose transitions note the tokens that
  they emit. BPE has the property that a token sequence is an encoding exactly if each two
  neighbours encode as themselves; so the last token of every prefix follows from the last tokens
  of shorter prefixes. A state keeps these, and the counts, only as far back as a vocabulary entry
  may still reach; what lies before is emitted for good. States are compiled when first entered.
"""

from __future__ import annotations

import unicodedata
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.bpe import Merges
from corpusward.llm.text import column_bytes, hash_words, row_runs

# Classes of characters, after lower-casing.
SPACE, OTHER, APOSTROPHE, NUMBER, LETTER, SHORT, R, V, L, E = range(10)
_LETTERS = (LETTER, SHORT, R, V, L, E)
# States: a word may start; in letters; in other signs; after a first apostrophe; after 'r or 'v; after 'l.
FRESH, IN_LETTERS, IN_SIGNS, AFTER_APOSTROPHE, AFTER_RV, AFTER_L = range(6)
# What a transition notes: a word starts at this character; one started at the character before.
HERE, BEFORE = 1, 2
_CHUNK = 256


def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, note) by state and class: words are 's 't 're 've 'm 'll 'd, runs of letters,
    single numbers, and runs of other signs that aren't white space, in this order."""

    def fresh(c):
        if c == SPACE:
            return FRESH, 0
        if c == NUMBER:
            return FRESH, HERE
        return (IN_LETTERS if c in _LETTERS else AFTER_APOSTROPHE if c == APOSTROPHE else IN_SIGNS), HERE

    def step(state, c):
        if state == IN_LETTERS and c in _LETTERS:
            return IN_LETTERS, 0
        if state in (IN_SIGNS, AFTER_APOSTROPHE) and c in (OTHER, APOSTROPHE):
            return IN_SIGNS, 0
        if state == AFTER_APOSTROPHE and c in (SHORT, R, V, L):
            return {SHORT: FRESH, R: AFTER_RV, V: AFTER_RV, L: AFTER_L}[c], 0
        if state == AFTER_RV and c == E or state == AFTER_L and c == L:
            return FRESH, 0
        if state in (AFTER_RV, AFTER_L):  # no contraction: letters started with the character before
            to, note = (IN_LETTERS, 0) if c in _LETTERS else fresh(c)
            return to, note | BEFORE
        return fresh(c)

    table = [[step(s, c) for c in range(10)] for s in range(6)]
    return np.array([[x[0] for x in row] for row in table], np.uint8), np.array([[x[1] for x in row] for row in table], np.uint8)


#: Letters and numbers of Unicode 16 that this Python's tables (15.1) don't have. Fixed values.
NEW_LETTERS = """1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E
11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"


def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for ends in ranges.split():
            low, _, high = ends.partition("-")
            table[int(low, 16) : int(high or low, 16) + 1] = kind
    table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    for letters, kind in (("'", APOSTROPHE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(x) for x in letters]] = kind
    return table


def scan(maps: np.ndarray) -> np.ndarray:
    """For state maps (chunk, state) -> state, the composition of each with all before it."""
    made, step = maps.copy(), 1
    while step < len(made):
        later = np.take_along_axis(made[step:], made[:-step].astype(np.intp), axis=1)
        made = np.concatenate([made[:step], later])
        step *= 2
    return made


class WordCounts:
    """The transducer over a word's symbols; states are numbers, 0 at a word's start."""

    def __init__(self, merges: Merges, most_states: int = 1 << 18):
        self.merges, self.most = merges, most_states
        self.spell: dict[int, tuple[int, ...]] = {i: (i,) for i in {*merges.byte_ids, *merges.end_ids}}
        for (a, b), (_, new) in sorted(merges.pairs.items(), key=lambda x: x[1][0]):
            self.spell.setdefault(new, self.spell[a] + self.spell[b])
        self.token = {s: i for i, s in self.spell.items() if merges.merge(list(s)) == [i]}
        self.prefixes = {s[:k] for s in self.token for k in range(1, len(s))}
        self.agree: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states = [((), (0,), (-1,))]  # pending symbols; counts, and last tokens, before each of them and at the end
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _agrees(self, a: int, b: int) -> bool:
        """Do two neighbours encode as themselves?"""
        if (a, b) not in self.agree:
            if len(self.agree) > 1 << 20:
                self.agree.clear()
            self.agree[a, b] = a < 0 or self.merges.merge([*self.spell[a], *self.spell[b]]) == [a, b]
        return self.agree[a, b]

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the tokens emitted for good."""
        symbols, counts, last = self.states[state]
        symbols += (symbol,)
        n = len(symbols)
        for k in range(n):  # the longest token that may end here comes first
            token = self.token.get(symbols[k:])
            if token is not None and self._agrees(last[k], token):
                break
        else:
            raise AssertionError("a single symbol always agrees")
        counts += (counts[k] + 1,)
        last += (token,)
        keep = next((k for k in range(n) if symbols[k:] in self.prefixes), n)
        emitted = counts[keep]
        key = symbols[keep:], tuple(c - emitted for c in counts[keep:]), last[keep:]
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], emitted

    def count(self, word: bytes) -> int:
        """A word's tokens."""
        if len(self.states) > self.most:
            self.clear()
        state, total, moves = 0, 0, self.moves
        for symbol in self.merges.start(word):
            key = state << 20 | symbol
            move = moves.get(key)
            if move is None:
                move = moves[key] = self.compile(state, symbol)
            state, emitted = move
            total += emitted
        return total + self.states[state][1][-1]


class TokenCounter:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.words = WordCounts(self.merges)
        self.next, self.note = word_machine()
        self.classes = class_table()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))))
        self.known: dict[int, int] = {}

    @staticmethod
    def _folded(text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # sigma has one small form here

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Where words start, for the classes of characters that begin and end with white space."""
        n = len(classes)
        grid = np.full(-(-n // _CHUNK) * _CHUNK, SPACE, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(-1, _CHUNK).T)  # place in chunk, chunk
        flat_next, flat_note = self.next.ravel(), self.note.ravel()
        ends = np.repeat(np.arange(6, dtype=np.uint8)[:, None], grid.shape[1], axis=1)
        for row in grid:
            ends = flat_next[ends * 10 + row]
        whole = scan(np.ascontiguousarray(ends.T))
        state = np.concatenate([[FRESH], whole[:-1, FRESH]]).astype(np.uint8)
        notes = np.empty_like(grid)
        for k, row in enumerate(grid):
            at = state * 10 + row
            notes[k], state = flat_note[at], flat_next[at]
        notes = notes.T.ravel()[:n]
        begins = notes & HERE > 0
        begins[:-1] |= notes[1:] & BEFORE > 0
        return begins

    def counts(self, texts: list[str]) -> np.ndarray:
        """The tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if "<|" in text and (found := self.special.findall(text)):
                extra[i] = len(found)
                texts[i] = self.special.sub(" ", text)
        folded = [self._folded(t) for t in texts]
        joined = " " + " ".join(folded) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        begins = self.starts(classes)
        start = np.flatnonzero(begins)
        stops = np.flatnonzero(begins | (classes == SPACE))
        stop = stops[np.searchsorted(stops, start, "right")]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        low, high = at[start], at[stop]
        hashes, where, back = np.unique(hash_words(data, low, high), return_index=True, return_inverse=True)
        made = np.empty(len(hashes), np.int64)
        if len(self.known) > 1 << 20:
            self.known.clear()
        for i, (h, a, b) in enumerate(zip(hashes.tolist(), low[where].tolist(), high[where].tolist())):
            n = self.known.get(h)
            if n is None:
                n = self.known[h] = self.words.count(raw[a:b])
            made[i] = n
        total = np.concatenate([[0], np.cumsum(made[back])])
        edges = np.cumsum([1, *(len(t) + 1 for t in folded)])
        cut = total[np.searchsorted(start, edges)]
        return cut[1:] - cut[:-1] + extra


_counters: dict[str, TokenCounter] = {}


def _count_batches(batches, path):
    counter = _counters.get(path) or _counters.setdefault(path, TokenCounter(path))
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        offsets = column_bytes(texts)[1]
        n = [np.empty(0, np.int64)]
        for low, high in row_runs(offsets, 2 << 20):
            n.append(counter.counts(texts[low:high].to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.diff(offsets)), pa.array(np.concatenate(n))], ["doc", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs (all columns in a struct `doc`) with n_bytes (UTF-8) and n_tokens of the whole text.
    path: a vocabulary file of word-end BPE tokens that every executor has.

    Special strings inside a text count as one token. A null or empty text has none. Repeated rows
    come out repeated, no rows give no rows."""
    texts = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].cast("string").alias("text"))
    out = texts.select("doc", F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("n_tokens")).schema
    return texts.mapInArrow(partial(_count_batches, path=path), out)
