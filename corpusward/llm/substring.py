"""Removal of token windows that an earlier document has, by Rabin-Karp hashes.

Documents are dealt into groups by ranges of doc_id, of some megabytes of text each, in doc_id
order (rank). A group sends the sorted set of its window hashes, cut into buckets by the leading bits
of a second hash. A bucket finds, for every hash, the first rank that has it, and tells the groups of later ones. A
group then knows each of its windows that an earlier group has, and sees repeats among its own
documents itself. So one hash for each window and group crosses the network, as packed sorted
differences, and a passage in every document costs one hash in each group, not a pair of rows
for each pair of documents.

The driver only plans some thousand ranges; each is cut into groups evenly, by arithmetic, whatever
the size of the input. Rows that share one doc_id have one rank, and may be dealt to many groups.

Windows of different groups are one only if 64 bits of one hash and the bucket agree. Among n different
windows in 2**b buckets n * n / 2**(65 + b) false repeats are to be expected, 10**-4 for 30 GB of text;
within a group of n windows, of which it knows k from others, n * (n / 2 + k) / 2**64.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.llm.text import OTHER_RADIX, VISIBLE, covered, find_words, hash_words, runs, window_hashes, window_rows

_BYTES_A_WORD = 6
#: Ranges of doc_id that the driver plans, at most.
RANGES = 4096
#: Hashes of a bucket, about, and the fewest of a group in a bucket, on the average.
_BUCKET, _LEAST_PACKED = 1 << 20, 8


def packed(h: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as their differences, byte plane by byte plane: the high planes are
    mostly zeros, which Spark's compression of shuffled blocks removes."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _windows(texts, width, bits=0):
    """(rows of the column, word places in the run, buckets, hashes) of the windows of each run of rows.
    Without bits there are no buckets."""
    for low, high, data, offsets in runs(texts):
        starts, ends, first = find_words(data, offsets, VISIBLE)
        places, rows = window_rows(first, width, len(starts))
        words = hash_words(data, starts, ends)
        bucket = (window_hashes(words, width, OTHER_RADIX)[places] >> np.uint64(64 - bits)).astype(np.uint32) if bits else None
        yield low, high, data, offsets, first, places, rows, bucket, window_hashes(words, width)[places]


_SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("rank", pa.int64()), ("hashes", pa.binary())])
_TOLD = pa.schema([("g", pa.int64()), ("hashes", pa.binary())])


def _send(table: pa.Table, width: int, bits: int) -> pa.Table:
    group = table.column("g")[0].as_py() if len(table) else -1
    if group < 0:
        return _SENT.empty_table()
    found = [x[-2:] for x in _windows(table.column("text"), width, bits)]
    h = np.concatenate([np.empty(0, np.uint64), *(x[1] for x in found)])
    if bits:
        bucket = np.concatenate([np.empty(0, np.uint32), *(x[0] for x in found)])
        by = np.lexsort((h, bucket))
        h, bucket = h[by], bucket[by]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
        h, bucket = h[first], bucket[first]
    else:
        h = np.unique(h)
        bucket = np.zeros(len(h), np.uint32)
    some, at = np.unique(bucket, return_index=True)
    blobs = [packed(x) for x in np.split(h, at[1:])] if len(h) else []
    rank = table.column("rank")[0].as_py()
    return pa.table([pa.array(some, pa.int32()), pa.array([group] * len(some), pa.int64()), pa.array([rank] * len(some), pa.int64()), pa.array(blobs, pa.binary())], schema=_SENT)


def _tell(table: pa.Table) -> pa.Table:
    """For each group the hashes of this bucket that a group of an earlier rank has."""
    groups, ranks = table.column("g").to_numpy(), table.column("rank").to_numpy()
    order = np.lexsort((groups, ranks))
    parts = [unpacked(table.column("hashes")[int(i)].as_py()) for i in order]
    h, at = np.concatenate(parts), np.repeat(np.arange(len(order)), [len(x) for x in parts])
    by = np.argsort(h, kind="stable")  # equal hashes stay in the order of ranks
    h, at = h[by], at[by]
    begins = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
    rank = ranks[order][at]
    first = rank[begins][np.cumsum(begins) - 1]
    again = rank > first
    h, g = h[again], groups[order][at[again]]
    by = np.argsort(g, kind="stable")
    h, g = h[by], g[by]
    some, at = np.unique(g, return_index=True)
    blobs = [packed(x) for x in np.split(h, at[1:])] if len(h) else []
    return pa.table([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], schema=_TOLD)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_MADE = [pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("removed", pa.list_(_SPAN)), pa.field("kept", pa.string())]


def _drop(table: pa.Table, told: pa.Table, width: int, whole: bool) -> pa.Table:
    """Each row's counts, removed intervals and kept text."""
    schema = pa.schema([table.schema.field("rest"), *_MADE])
    if not len(table):
        return schema.empty_table()
    ids = table.column("doc_id").to_numpy()
    found = list(_windows(table.column("text"), width))
    h = np.concatenate([x[-1] for x in found])
    by_window = np.concatenate([x[6] + x[0] for x in found])
    if table.column("g")[0].as_py() < 0:
        bad = np.zeros(len(h), bool)
    else:
        earlier = np.unique(np.concatenate([np.empty(0, np.uint64), *(unpacked(x.as_py()) for x in told.column("hashes"))]))
        bad = np.zeros(len(h), bool)
        if len(earlier):
            bad = earlier[np.minimum(np.searchsorted(earlier, h), len(earlier) - 1)] == h
        own = ids[by_window].astype(np.int64)
        order = np.lexsort((own, h))
        begins = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.empty(0, bool)
        least = own[order][np.flatnonzero(begins)[np.cumsum(begins) - 1]] if len(h) else own
        bad[order] |= own[order] > least
    n_words, n_removed, kept, spans, done = [], [], [], [], 0
    there = table.column("text").is_valid().to_pylist()
    for low, high, data, offsets, first, places, rows, _, hashes in found:
        gone = covered(int(first[-1]), places[bad[done : done + len(hashes)]], width)
        done += len(hashes)
        raw = data.tobytes()
        for i in range(high - low):
            text, mask = raw[offsets[i] : offsets[i + 1]], gone[first[i] : first[i + 1]]
            n, out = len(mask), int(mask.sum())
            n_words.append(n)
            n_removed.append(out)
            edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist() if out else []
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
            if whole and not out:
                kept.append(text if there[low + i] else None)
            elif out:
                words = text.split()
                left, at = [], 0
                for a, b in zip(edges[::2], edges[1::2]):
                    left += words[at:a]
                    at = b
                kept.append(b" ".join(left + words[at:]))
            else:
                kept.append(b" ".join(text.split()))
    new = {"n_words": n_words, "n_removed": n_removed, "removed": spans, "kept": kept}
    columns = [table.column(f.name) if f.name not in new else pa.array(new[f.name], pa.binary() if f.name == "kept" else f.type).cast(f.type) for f in schema]
    return pa.table(columns, schema=schema)


def _below(bounds: list[int]):
    """How many of the sorted bounds are below doc_id, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    fine = F.from_json(F.lit(json.dumps([bounds[i : i + step] for i in range(0, len(bounds), step)] + [[]])), "array<array<bigint>>")
    coarse = F.from_json(F.lit(json.dumps(bounds[step - 1 :: step])), "array<bigint>")
    block = F.size(F.filter(coarse, lambda x: x < F.col("doc_id")))
    return block * step + F.size(F.filter(F.get(fine, block), lambda x: x < F.col("doc_id")))


def grouped(source: DataFrame, group_bytes: int, size: int, n: int) -> DataFrame:
    """source (doc_id, text, ...; of `size` bytes and `n` rows with a doc_id) with g and rank. Groups are numbered in the order of their doc_ids;
    rank is g, but one number for all groups of a doc_id that fills more than one by itself. Rows
    without a doc_id have negative groups.

    The driver gets RANGES quantiles of doc_id and the bytes, least and largest doc_id of each range;
    a range is cut into groups of about group_bytes by even steps of doc_id."""
    n_ranges = max(1, min(n, RANGES, -(-size // group_bytes)))
    shares = [i / n_ranges for i in range(1, n_ranges)]
    cuts = source.agg(F.percentile_approx("doc_id", shares, 20 * n_ranges)).first()[0] if shares else []
    bounds = sorted({*cuts, *(a - 1 for a, b in zip(cuts, cuts[1:]) if a == b)})  # a doc_id of many rows is a range of its own
    ranged = source.where("doc_id is not null").select(_below(bounds).alias("r"), "doc_id", F.octet_length("text").alias("bytes"))
    found = {x.r: x for x in ranged.groupBy("r").agg(F.sum("bytes").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}
    low, width, parts, base, total = [], [], [], [], 0
    for r in range(len(bounds) + 1):
        x = found.get(r)
        k = max(1, -(-((x.bytes if x else 0) or 0) // group_bytes))
        span = x.high - x.low + 1 if x else 1
        k = k if span == 1 else min(k, span)
        low.append(x.low if x else 0)
        width.append(0 if span == 1 else -(-span // k))
        parts.append(k)
        base.append(total)
        total += k
    of = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col("r"))
    one = F.col("width") == 0
    step = F.when(one, F.pmod(F.xxhash64("text"), F.col("parts"))).otherwise(F.floor((F.col("doc_id") - F.col("low")) / F.greatest("width", F.lit(1))))
    spread = -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 16))
    planned = source.withColumn("r", _below(bounds)).withColumns({"low": of(low), "width": of(width), "parts": of(parts), "base": of(base)})
    g = F.when(F.col("doc_id").isNull(), spread).otherwise(F.col("base") + F.least(step, F.col("parts") - 1)).cast("long")
    rank = F.when(one & F.col("doc_id").isNotNull(), F.col("base")).otherwise(g)
    return planned.select(*source.columns, g.alias("g"), rank.cast("long").alias("rank"))


def _bucket_bits(size: int, group_bytes: int) -> int:
    """Leading bits of the second hash that make a bucket: buckets of about _BUCKET hashes, but of so many bits
    at most that a group still sends _LEAST_PACKED hashes to each on the average."""
    wanted = math.ceil(math.log2(max(1, size / _BYTES_A_WORD / _BUCKET)))
    return max(0, min(wanted, math.floor(math.log2(max(1, group_bytes / _BYTES_A_WORD / _LEAST_PACKED)))))


def without_repeats(docs: DataFrame, width: int = 13, group_bytes: int = 8 << 20, whole: bool = False) -> DataFrame:
    """docs (all columns but text in a struct `doc`) with n_words, n_removed, removed
    (the maximal intervals [start, end) of removed words) and kept (the other words, joined by one
    space; with `whole`, the text as it is, null too, where nothing is removed).

    A word goes if a window of `width` words of its document covers it that also starts in a
    document with a smaller doc_id. Windows are judged on the input. A null text has no words; a
    text of fewer words than `width` loses none. Rows with the same doc_id don't remove each
    other's words. A row without a doc_id neither loses words nor takes any. No rows give no rows.

    group_bytes: text of a group, about; up to four times that from 16 TB of text on."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest"))
    size, n = (x or 0 for x in source.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first())
    group_bytes = max(group_bytes, min(4 * group_bytes, size >> 21))
    bits = _bucket_bits(size, group_bytes)
    dealt = grouped(source, group_bytes, size, n)
    sent = dealt.groupBy("g").applyInArrow(lambda table: _send(table, width, bits), "bucket int, g long, rank long, hashes binary")
    told = sent.groupBy("bucket").applyInArrow(lambda table: _tell(table), "g long, hashes binary")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.StringType())]
    out = T.StructType([*dealt.select("rest").schema, *new])
    made = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(lambda table, known: _drop(table, known, width, whole), out)
    return made.select(F.col("rest").alias("doc"), "n_words", "n_removed", "removed", "kept")

