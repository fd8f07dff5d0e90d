"""How the sources of a language differ in their words, by counting behind a sketch of document frequencies.

Tasks add their documents' different terms to count-min sketches, which are merged by adding cells.
A cell is never less than the number of documents of any term in it, so a term with a cell under
the threshold can't be kept: its occurrences go before anything is shuffled. What is left is counted
exactly, by source, and terms that the sketch let through wrongly go by their true numbers.

Pairs of sources meet only at the terms that both have. A source's other terms meet the other
source's value of absent terms, which depends on a term's count alone, so they are taken by counts,
and terms that neither has are all alike.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusward.llm.shared import cut
from corpusward.llm.text import FOLD, column_bytes, find_words, hash_words, mixed, row_runs

SCALE = 1_000_000_000
#: Cells of a sketch that are shuffled together.
_BLOCK = 1 << 14
_LEAST_WIDTH, _MOST_WIDTH = 1 << 16, 1 << 24
#: Counts that a task holds before it adds up those of the same term.
_HELD_ROWS = 1 << 20
#: Tables of sources with more rows than this are joined without a broadcast.
_SMALL = 100_000
#: Bytes of terms, small letters already: letters and all beyond ASCII.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_U = np.uint64


def _terms(batch) -> tuple:
    """For some rows of a batch at a time: (first row, row of each term, bytes, starts, ends)."""
    data, offsets = column_bytes(batch.column("text"))
    for low, high in row_runs(offsets):
        at = offsets[low : high + 1]
        some = FOLD[data[at[0] : at[-1]]]
        starts, ends, first = find_words(some, at - at[0], _LETTERS)
        yield low, np.repeat(np.arange(high - low), np.diff(first)), some, starts, ends


def _cells(keys: np.ndarray, depth: int, width: int) -> list[np.ndarray]:
    """A cell of each key in each row of a sketch. width: a power of two."""
    return [(mixed(keys + _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) & _U(width - 1)).astype(np.int64) + k * width for k in range(depth)]


def _keys(batch, low: int, row: np.ndarray, data, starts, ends) -> np.ndarray:
    """A 64-bit number for the language and term of each occurrence."""
    of = np.array([hash_words(b := np.frombuffer(x.encode() + b"\0", np.uint8), np.array([0]), np.array([len(b)]))[0] for x in batch.column("lang").dictionary_encode().dictionary.to_pylist()], np.uint64)
    lang = of[batch.column("lang").dictionary_encode().indices.to_numpy()]
    return hash_words(data, starts, ends) ^ lang[low + row]


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def _sketch_batches(batches, depth, width):
    cells = np.zeros(depth * width, np.uint8)
    for batch in batches:
        for low, row, *found in _terms(batch):
            key, of = np.unique(_keys(batch, low, row, *found), return_inverse=True)
            docs = np.bincount(_distinct(row * len(key) + of) % max(1, len(key)), minlength=len(key))
            for at in _cells(key, depth, width):
                at, of = np.unique(at, return_inverse=True)
                cells[at] = np.minimum(cells[at] + np.bincount(of, docs, len(at)).astype(np.int64), 255)
    yield from _blocks({k: some for k, some in enumerate(cells.reshape(-1, _BLOCK)) if some.any()})


def _merge_batches(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, some in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
            held[k] = held.get(k, 0) + np.frombuffer(some, np.uint8).astype(np.int32)
    yield from _blocks(held)


def _blocks(held: dict[int, np.ndarray]):
    for k, some in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(some, 255).astype(np.uint8).tobytes()], pa.binary())], ["block", "cells"])


def document_frequency_sketch(docs: DataFrame, depth: int = 3, width: int = 1 << 22) -> np.ndarray:
    """Count-min cells (depth x width bytes, which is all that the driver gets) of the number of
    documents of each (lang, term). Cells hold 255 for 255 and more; none is ever too small."""
    made = docs.select("lang", "text").mapInArrow(partial(_sketch_batches, depth=depth, width=width), "block int, cells binary")
    merged = made.repartition("block").mapInArrow(_merge_batches, "block int, cells binary")
    cells = np.zeros((depth * width // _BLOCK, _BLOCK), np.uint8)
    for row in merged.collect():
        cells[row.block] = np.frombuffer(row.cells, np.uint8)
    return cells.reshape(-1)


def estimates(cells: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """At least the number of documents of each key, up to 255."""
    found = [cells[at] for at in _cells(keys, depth, len(cells) // depth)]
    return np.minimum.reduce(found)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    place = np.arange(at[-1]) - np.repeat(at[:-1] - starts, size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[place])))


def _count_batches(batches, sketch, depth, min_docs):
    cells, groups, held, n_held = np.frombuffer(sketch.value, np.uint8), {}, [], 0

    def summed() -> tuple:
        """What is held, each group's term once: (group, number of the term, terms, n, docs)."""
        terms = pa.concat_arrays([x[2] for x in held]).dictionary_encode()
        number, low, codes = terms.indices.to_numpy().astype(np.int64), 0, []
        for _, code, some, _, _ in held:
            codes.append(number[low : low + len(some)][code])
            low += len(some)
        width = len(terms.dictionary)
        pair = np.concatenate([x[0] for x in held]) * width + np.concatenate(codes)
        order = np.argsort(pair)
        pair = pair[order]
        begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        n, docs = (np.add.reduceat(np.concatenate([x[k] for x in held])[order], begins) for k in (3, 4))
        return pair[begins] // width, pair[begins] % width, terms.dictionary, n, docs

    def told(g, code, terms, n, docs):
        names = list(groups)
        lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        for low in range(0, len(g), 1 << 16):
            some = slice(low, low + (1 << 16))
            at = pa.array(g[some])
            yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), terms.take(pa.array(code[some])).cast(pa.string()), pa.array(n[some]), pa.array(docs[some])], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        of = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
        for low, row, data, starts, ends in _terms(batch):
            key, at = np.unique(_keys(batch, low, row, data, starts, ends), return_inverse=True)
            likely = (estimates(cells, key, depth) >= min_docs)[at]
            row, starts, ends = row[likely], starts[likely], ends[likely]
            if not len(row):
                continue
            folded = _words(data, starts, ends).dictionary_encode()
            code, n_codes = folded.indices.to_numpy().astype(np.int64), len(folded.dictionary)
            in_doc, n = np.unique(row * n_codes + code, return_counts=True)
            pair = of[low + in_doc // n_codes] * n_codes + in_doc % n_codes
            pair, back, docs = np.unique(pair, return_inverse=True, return_counts=True)
            n = np.bincount(back, n, len(pair)).astype(np.int64)
            held.append((pair // n_codes, pair % n_codes, folded.dictionary, n, docs))
            n_held += len(pair)
            if n_held > _HELD_ROWS:
                held = [summed()]
                n_held = len(held[0][0])
                if n_held > _HELD_ROWS // 2:
                    yield from told(*held[0])
                    held, n_held = [], 0
    if held:
        yield from told(*summed())


def term_counts(docs: DataFrame, min_docs: int = 3, depth: int = 3, width: int | None = None) -> DataFrame:
    """lang, source, term, n (occurrences there), total (in the language) and lead (1 in one row of each
    lang and term) of terms that at least min_docs documents of the language have.

    docs: lang, source and text, none null. width: cells of a row of the sketch, by default 16 for each
    document between 2**16 and 2**24, a power of two; with too few of them more is shuffled, and the
    result is the same."""
    if not 0 < min_docs < 256:
        raise ValueError("min_docs must be under 256, as the sketch's cells are bytes")
    if width is None:
        width = min(_MOST_WIDTH, max(_LEAST_WIDTH, 1 << (16 * docs.count()).bit_length()))
    sketch = docs.sparkSession.sparkContext.broadcast(document_frequency_sketch(docs, depth, width).tobytes())
    counted = docs.select("lang", "source", "text").mapInArrow(partial(_count_batches, sketch=sketch, depth=depth, min_docs=min_docs), "lang string, source string, term string, n long, docs long")
    exact = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    lead = (F.row_number().over(of_term.orderBy("source")) == 1).cast("int")
    seen = exact.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("df"), lead.alias("lead"))
    return seen.where(F.col("df") >= min_docs).drop("df")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kinds)), exact."""
    wide = lambda x: x.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + kinds))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact."""
    return F.call_function("div", (p - q) * (p - q), q)


def _checked(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= _SMALL else table


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, depth: int = 3, width: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) group of docs how far it is from
    each other source of the language (part `pair`), and by which terms it differs from the language as a
    whole (part `term`, the first `top`).

    A null lang, source or text counts as ''. Each row is a document, repeated rows too. Groups without
    a term have all their pairs (of value 0 where the language keeps no term) and no terms. Ties go by
    the item's UTF-8. No rows give no rows; other columns play no part. All arithmetic is in whole
    numbers; a pair's sums stay under 2**63 up to some 10**8 kept terms of a language, and raise beyond."""
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    texts = docs.select(text("lang"), text("source"), text("text"))
    kept = cut(term_counts(texts, min_docs, depth, width))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("n_here"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("lead").alias("n_kept"))
    groups = texts.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    some = F.col("n_kept") > 0
    groups = cut(groups.withColumn("p0", F.when(some, share(F.lit(0), F.col("group_n"), F.when(some, F.col("n_kept"))))))
    n_groups = groups.count()
    small = _checked(groups, n_groups)
    p, q = share(F.col("n"), F.col("group_n"), F.col("n_kept")), share(F.col("total"), F.col("lang_n"), F.col("n_kept"))
    rows = kept.join(small.select("lang", "source", "group_n", "lang_n", "n_kept", "p0"), ["lang", "source"]).withColumn("p", p)

    here = rows.select("lang", "term", "source", "p", "p0")
    there = here.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q_, p0, q0 = F.col("p"), F.col("q"), F.col("p0"), F.col("q0")
    both = here.join(there, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(
        F.sum(gap(p, q_) - gap(p, q0) - gap(p0, q_)).alias("to"),
        F.sum(gap(q_, p) - gap(q_, p0) - gap(q0, p)).alias("back"),
        F.count("*").alias("shared"),
    )
    by_count = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("c"))
    others = small.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    alone = by_count.join(others, "lang").where("source <> other").groupBy("lang", "source", "other").agg(
        F.sum(F.col("c") * gap(p, q0)).alias("to"), F.sum(F.col("c") * gap(q0, p)).alias("back"), F.lit(0).cast("long").alias("shared")
    )
    ways = [F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.col(v).alias("v"), F.col("shared").alias("shared")) for a, b, v in (("source", "other", "to"), ("other", "source", "back"))]
    parts = both.unionByName(alone).select("lang", F.explode(F.array(*ways)).alias("x")).select("lang", "x.*")
    parts = parts.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"), F.sum("shared").alias("shared"))
    end = small.select("lang", F.col("source").alias("item"), F.col("n_here").alias("item_here"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "n_kept", "n_here", "p0").join(end, "lang").where("source <> item").join(parts, ["lang", "source", "item"], "left")
    zero = F.lit(0).cast("long")
    neither = F.col("n_kept") - F.col("n_here") - F.col("item_here") + F.coalesce("shared", zero)
    value = F.when(some, F.coalesce("v", zero) + gap(p0, q0) * neither).otherwise(zero)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    terms = rows.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(p, q_).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))).alias("rank")
    ranked = terms.select("*", place).where(F.col("rank") <= top)
    return pairs.select("*", place).unionByName(ranked)
