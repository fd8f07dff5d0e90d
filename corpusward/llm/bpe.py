"""Byte-pair encoding and decoding.

A word's symbols stand in a doubly linked list; a priority queue holds the merges that are
possible, by rank and then place. An entry whose symbols have meanwhile been merged away is
stale and is skipped. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.text import column_bytes, row_runs

#: Words of byte-level vocabularies. Fixed value.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters are cut into words some at a time.
_LONG_TEXT = 1 << 20
#: Words kept with their ids in a worker; when there are more, it starts afresh.
_WORDS_KEPT = 1 << 18


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is visible in Latin-1, else the next unused one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class Merges:
    """The vocabulary and merges of a tokenizers file of kind BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocabulary[a], self.vocabulary[b]] = rank, self.vocabulary[a + b]
        self.symbols = byte_symbols()
        self.byte_ids = [self.vocabulary[c] for c in self.symbols]
        self.end_ids = [self.vocabulary[c + self.suffix] for c in self.symbols] if self.suffix else self.byte_ids

    def start(self, word: bytes) -> list[int]:
        """A word's first symbols; its last byte bears the end of the word."""
        return [*map(self.byte_ids.__getitem__, word[:-1]), self.end_ids[word[-1]]]

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols that are left when no merge is possible."""
        n, pairs = len(ids), self.pairs
        queue = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        if not queue:
            return ids
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            _, i, new, left, right = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((new, ids[k])):
                    heappush(queue, (found[0], i, found[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((ids[h], new))):
                heappush(queue, (found[0], h, found[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: bytes) -> list[int]:
        return self.merge(self.start(word)) if word else []


class _Words(dict):
    """The packed ids of each word met."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        made = np.array(self.merges.encode_word(word.encode()), "<u4").tobytes()
        if len(word) < 64:
            self[word] = made
        return made


class Codec:
    """Encoding and decoding with a byte-level vocabulary file."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.words = _Words(self.merges)
        self.pattern = regex.compile(BYTE_LEVEL_WORDS)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        back = {c: b for b, c in enumerate(self.merges.symbols)}
        pieces = self.merges.vocabulary | self.merges.special
        self.pieces = [b""] * (max(pieces.values()) + 1)
        for piece, i in pieces.items():
            self.pieces[i] = piece.encode() if piece in self.merges.special else bytes(back[c] for c in piece)

    def _split(self, text: str) -> Iterator[Iterable[str]]:
        if len(text) <= _LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, _LONG_TEXT >> 4)):
            yield some

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        made = []
        for k, part in enumerate(parts):
            if k % 2:
                made.append(self.merges.special[part].to_bytes(4, "little"))
            else:
                made += [b"".join(map(self.words.__getitem__, words)) for words in self._split(part)]
        return b"".join(made)

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids in UTF-8; what is not UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode_batches(batches, path):
    codec = _codec(path)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for low, high in row_runs(column_bytes(texts)[1]):
            ids = [codec.encode(t) for t in texts[low:high].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc")[low:high], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc", "n_tokens", "ids"])


def _decode_batches(batches, path):
    codec = _codec(path)
    for batch in batches:
        for low, high in row_runs(column_bytes(batch.column("ids"))[1]):
            some = [codec.decode(x or b"") for x in batch.column("ids")[low:high].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc")[low:high], batch.column("n_tokens")[low:high], batch.column("ids")[low:high], pa.array(some, pa.binary()).cast(pa.string())], ["doc", "n_tokens", "ids", "decoded"])


def _both_batches(batches, path):
    for batch in _encode_batches(batches, path):
        yield from _decode_batches((batch,), path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (all columns in a struct `doc`) with n_tokens and ids (little-endian unsigned 32-bit
    numbers, one after the other). path: a byte-level vocabulary file that every executor has.

    Special strings inside a text give their own id. A null or empty text has no ids. Repeated rows
    come out repeated, no rows give no rows. Long texts are encoded whole, some words at a time."""
    texts = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].cast("string").alias("text"))
    out = texts.select("doc", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("binary").alias("ids")).schema
    return texts.mapInArrow(partial(_encode_batches, path=path), out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc, n_tokens, ids) with decoded, the ids' text."""
    out = encoded.withColumn("decoded", F.lit(None).cast("string")).schema
    return encoded.mapInArrow(partial(_decode_batches, path=path), out)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """What decode(encode(docs)) gives, in one pass: a task needs one Python worker, not two."""
    texts = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].cast("string").alias("text"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    out = texts.select("doc", null("long", "n_tokens"), null("binary", "ids"), null("string", "decoded")).schema
    return texts.mapInArrow(partial(_both_batches, path=path), out)
