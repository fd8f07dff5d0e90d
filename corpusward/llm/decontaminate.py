"""Benchmark decontamination with training suffix arrays.

Every task cuts its documents into shards of some megabytes. A shard's suffix array holds its
word suffixes in sorted order; each benchmark suffix is searched in it by bisection, which gives
all places where its first `width` words stand. Places that follow each other on one diagonal
make one longest verbatim match.

A suffix whose first words are no benchmark words in a row can't begin a match, so a shard only
sorts suffixes whose first `stem` words stand in a row in a benchmark item; this drops no match.
The benchmark is cut into blocks of bounded size. The driver makes and broadcasts one block's suffixes
at a time; a task takes each batch of documents through the blocks in turn and holds one block's
suffixes at a time, so a larger benchmark takes more time and disk, and no more memory.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.text import ALNUM, FOLD, column_bytes, covered, find_words, hash_words, runs, sums, window_hashes, window_rows

_SIEVE_BITS = 22


class TestSuffixes:
    """The sorted suffixes of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int, stem: int):
        self.width, self.ids = width, [i for i, _ in items]
        data, offsets = column_bytes(pa.array([t for _, t in items], pa.large_string()))
        data = FOLD[data]
        starts, ends, first = find_words(data, offsets, ALNUM)
        words = hash_words(data, starts, ends)
        self.vocabulary = np.unique(words)
        numbers = np.searchsorted(self.vocabulary, words) + 1
        n = np.diff(first)
        item = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(words)) - first[item]
        size = np.minimum(n, width)[item]
        begins = np.flatnonzero(place + size <= n[item])
        keys = np.zeros((len(begins), width), ">u4")
        for j in range(width):
            in_it = j < size[begins]
            keys[in_it, j] = numbers[begins[in_it] + j]
        low = keys.view(f"S{4 * width}").ravel() if len(begins) else np.empty(0, f"S{4 * width}")
        order = np.lexsort((size[begins], low))
        begins, keys = begins[order], keys[order]
        new = np.ones(len(begins), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        self.of_key = np.concatenate([np.flatnonzero(new), [len(begins)]])  # a key's items: these ranges of item, place
        self.item, self.place = item[begins], place[begins]
        self.size = size[begins][new]
        high = keys[new].copy()
        for j in range(width):
            high[j >= self.size, j] = 0xFFFFFFFF
        self.low = np.ascontiguousarray(keys[new]).view(f"S{4 * width}").ravel() if len(begins) else low
        self.high = high.view(f"S{4 * width}").ravel() if len(begins) else low
        self.stems = []
        for k in sorted({min(int(s), stem) for s in self.size}):
            at = begins[np.minimum(size[begins], stem) == k]
            hashes = np.unique(window_hashes(words, k)[at])
            sieve = np.zeros(1 << _SIEVE_BITS, bool)
            sieve[hashes & np.uint64((1 << _SIEVE_BITS) - 1)] = True
            self.stems.append((k, hashes, sieve))

    def matches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, place, length) of the longest verbatim matches in a shard."""
        none = (np.empty(0, np.int64),) * 4
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        some = [np.empty(0, np.int64)]
        for k, hashes, sieve in self.stems:
            h = window_hashes(words, k)
            likely = np.flatnonzero(sieve[h & np.uint64((1 << _SIEVE_BITS) - 1)])
            likely = likely[hashes[np.minimum(np.searchsorted(hashes, h[likely]), len(hashes) - 1)] == h[likely]]
            some.append(likely[row[likely] == row[likely + k - 1]])
        suffix = np.unique(np.concatenate(some))
        if not len(suffix):
            return none
        keys = np.zeros((len(suffix), self.width), ">u4")
        for j in range(self.width):
            at = np.minimum(suffix + j, len(words) - 1)
            number = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
            keys[:, j] = np.where((suffix + j >= len(words)) | (row[at] != row[suffix]), 0, np.where(self.vocabulary[number] == words[at], number + 1, 0xFFFFFFFE))
        keys = keys.view(f"S{4 * self.width}").ravel()
        order = np.argsort(keys)
        array = suffix[order]
        keys = keys[order]
        left, right = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        hit = np.flatnonzero(right > left)
        if not len(hit):
            return none
        times = right[hit] - left[hit]
        key = np.repeat(hit, times)
        at = array[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(left[hit], times)]
        n_items = self.of_key[key + 1] - self.of_key[key]
        which = np.arange(n_items.sum()) - np.repeat(np.cumsum(n_items) - n_items, n_items) + np.repeat(self.of_key[key], n_items)
        at, size = np.repeat(at, n_items), np.repeat(self.size[key], n_items)
        item, diagonal = self.item[which], at - self.place[which]
        by = np.lexsort((at, diagonal, item))
        at, size, item, diagonal = at[by], size[by], item[by], diagonal[by]
        cut = np.ones(len(at), bool)
        cut[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        start = np.flatnonzero(cut)
        end = np.concatenate([start[1:], [len(at)]]) - 1
        return row[at[start]], item[start], at[start] - first[row[at[start]]], at[end] - at[start] + size[end]


_MATCH = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32())])


def _suffixes(block) -> TestSuffixes:
    """A block's suffixes, read from the executor's copy and not kept by this worker."""
    value = block.value
    block.__dict__.pop("_value", None)
    return value


def _search(batches, blocks):
    only = blocks[0].value if len(blocks) == 1 else None
    for batch in batches:
        parts = []  # rows, first words, word hashes of each run of rows, and what is found there
        for low, high, data, offsets in runs(batch.column("text")):
            data = FOLD[data]
            starts, ends, first = find_words(data, offsets, ALNUM)
            parts.append((high - low, first, hash_words(data, starts, ends), []))
        for block in blocks:
            suffixes = only or _suffixes(block)
            for _, first, words, found in parts:
                row, item, place, length = suffixes.matches(words, first)
                if len(row):
                    found.append((row, [suffixes.ids[i] for i in item.tolist()], place, length))
            del suffixes
        n_words, n_hit, matches = [], [], []
        for n, first, words, found in parts:
            at = np.concatenate([np.empty(0, np.int64), *(first[row] + place for row, _, place, _ in found)]).astype(np.int64)
            hit = covered(len(words), at, np.concatenate([np.empty(0, np.int64), *(x[3] for x in found)]).astype(np.int64))
            n_words += np.diff(first).tolist()
            n_hit += sums(hit, first).tolist()
            lists = [[] for _ in range(n)]
            for row, ids, place, length in found:
                for r, i, p, size in zip(row.tolist(), ids, place.tolist(), length.tolist()):
                    lists[r].append({"item_id": i, "start": p, "length": size})
            matches += lists
        new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(matches, pa.list_(_MATCH))]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *new], ["doc", "n_words", "n_hit", "matches"])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13, stem: int = 4, block_bytes: int = 16 << 20) -> DataFrame:
    """docs (all columns in a struct `doc`) with n_words, n_hit (words inside a match) and matches
    (item_id, start, length in words): all longest verbatim matches of at least `width` words, and
    all places of shorter items as a whole.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z folded. A null or
    empty text has no words and no matches; an item without words has none either. Items with the
    same id count as one in what the callers list; an item without an id still hits words. Repeated
    rows come out repeated; no documents give no rows, no items give no hits.

    block_bytes bounds the benchmark text whose suffixes a task or the driver holds at once; an item
    is never parted."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    blocks = []
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        blocks.append(spark.sparkContext.broadcast(TestSuffixes([tuple(r) for r in block], width, stem)))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].cast("string").alias("text"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    out = rows.select("doc", null("long", "n_words"), null("long", "n_hit"), null("array<struct<item_id:string,start:int,length:int>>", "matches")).schema
    return rows.mapInArrow(partial(_search, blocks=blocks), out)


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """find_benchmark with items (the distinct item ids, sorted as strings) and contaminated: words
    are hit, and they are a twentieth of the document's words at least."""
    found = find_benchmark(docs, benchmark, **how)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda x: x.isNotNull())))
    return found.withColumn("items", items).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
