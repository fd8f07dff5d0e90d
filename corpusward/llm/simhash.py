"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits wide and are cut into `segments`. Two fingerprints that differ in
at most `distance` bits differ in few bits in at least one segment: with
distance = a * segments + b, in at most `a` bits in one of the first b + 1 segments, or in at
most `a - 1` in one of the others. So each fingerprint is stored under its own value of every
segment, and under the values of the small Hamming ball below it, those with up to the radius of
its set bits cleared. Two values that differ in at most that many bits meet where the bits that
only one of them has are cleared. Rows that meet under a value are compared over all 64 bits.

Nothing here grows with the square of a group: exact copies fold into one fingerprint first,
and a value shared by many fingerprints yields a spanning forest of its links, not all pairs.
Values held by over `block` fingerprints are dealt to several tasks, block against block.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.components import connected
from corpusward.llm.shared import cut, left_join_spread

_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; of no words: 0."""
    tokens = text.lower().split()  # for bytes: A-Z only, and the six ASCII white spaces
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1], ends[width - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for low in range(0, len(starts), _SHINGLES_AT_ONCE):
        some = slice(low, low + _SHINGLES_AT_ONCE)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[some].tolist(), ends[some].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little", signed=True)


def _fingerprint_batches(batches, words, seed):
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        prints = pa.array([fingerprint(t.as_py(), words, seed) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), prints], ["doc_id", "row", "fp"])


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all of a row's columns, nulls told from other values."""
    plain = [F.to_json(F.struct(docs[f.name])) if "map" in f.dataType.simpleString() else docs[f.name] for f in docs.schema]
    return F.xxhash64(F.array(*[docs[c].isNull() for c in docs.columns]), *plain)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, row (row_hash) and fp (the 64 bits as a signed number) of every row. A null text has no words."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), row_hash(docs).alias("row"))
    return rows.mapInArrow(partial(_fingerprint_batches, words=words, seed=seed), "doc_id long, row long, fp long")


def ball_plan(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment that has to be searched; radii are 2 at most."""
    if not 0 <= distance < 3 * segments:
        raise ValueError("segments must be over a third of distance, so that radii are at most 2")
    edges = [64 * i // segments for i in range(segments + 1)]
    radius, rest = divmod(distance, segments)
    plan = [(edges[i], edges[i + 1] - edges[i], radius if i <= rest else radius - 1) for i in range(segments)]
    return [x for x in plan if x[2] >= 0]


def _values(fp: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


def _entries(batches, plan):
    """The table's rows: each fingerprint under the values at which it meets others."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for i, (shift, bits, radius) in enumerate(plan):
            own, tag = _values(fp, shift, bits), np.uint64(i << 56)
            found = [(own | tag, fp)]
            for bits_cleared in (x for r in range(1, radius + 1) for x in combinations(range(bits), r)):
                mask = np.uint64(sum(1 << b for b in bits_cleared))
                up = own & mask == mask
                found.append(((own[up] ^ mask) | tag, fp[up]))
            key, held = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(held.view(np.int64))], ["key", "fp"])


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def group_links(fp: np.ndarray, cleared: np.ndarray, radius: int, distance: int, rows: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints of one table value: at least a spanning forest of them.

    Only pairs with at most `radius` bits cleared between them count. A sparse group gives each of
    its links; where these get to more than four a fingerprint, a search from one to the next
    unreached ones gives one link for each fingerprint reached."""
    n, found, count = len(fp), [], 0
    for low in range(0, n, rows):
        block = slice(low, low + rows)
        near = _near(fp[block, None], fp[None, low:], distance) & (cleared[block, None] + cleared[None, low:] <= radius)
        i, j = np.nonzero(near)
        i, j = (i + low)[i < j], (j + low)[i < j]
        found.append((fp[i], fp[j]))
        count += len(i)
        if count > 4 * n:
            break
    else:
        return found
    found, left = [], np.ones(n, bool)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        edge = np.array([seed])
        while len(edge):
            now, edge = edge[:rows], edge[rows:]
            rest = np.flatnonzero(left)
            near = _near(fp[now, None], fp[None, rest], distance) & (cleared[now, None] + cleared[None, rest] <= radius)
            hit = near.any(axis=0)
            to = rest[hit]
            found.append((fp[now[near[:, hit].argmax(axis=0)]], fp[to]))
            left[to] = False
            edge = np.concatenate([edge, to])
    return found


def _meet(key: np.ndarray, fp: np.ndarray, plan, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups of rows sorted by key (the pair of a table value and a part)."""
    value = key[:, 0]
    seg = (value >> np.uint64(56)).astype(np.int64)
    shift = np.array([x[0] for x in plan], np.uint64)[seg]
    mask = np.array([(1 << x[1]) - 1 for x in plan], np.uint64)[seg]
    cleared = np.bitwise_count(((fp >> shift) & mask) ^ (value & np.uint64((1 << 56) - 1)))
    radius = np.array([x[2] for x in plan], np.uint8)[seg]
    change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    first = np.concatenate([[0], change])
    size = np.diff(np.concatenate([first, [len(fp)]]))
    found = [(fp[:0], fp[:0])]
    for at in np.flatnonzero(size > 32):
        some = slice(first[at], first[at] + size[at])
        if 2 * cleared[some].min() <= radius[first[at]]:
            found += group_links(fp[some], cleared[some], radius[first[at]], distance)
    last = np.repeat(np.where(size > 32, 0, first + size - 1), size)
    here = np.flatnonzero(last > np.arange(len(fp)))
    step = 1
    while len(here):  # each row against the one `step` rows on in its group
        there = here + step
        ok = (cleared[here] + cleared[there] <= radius[here]) & _near(fp[here], fp[there], distance)
        found.append((fp[here[ok]], fp[there[ok]]))
        step += 1
        here = here[last[here] >= here + step]
    a, b = (np.concatenate(x) for x in zip(*found))
    return a[a != b], b[a != b]


def _link_batches(batches, plan, distance):
    held_key, held_fp = np.empty((0, 2), np.uint64), np.empty(0, np.uint64)

    def links(key, fp):
        a, b = _meet(key, fp, plan, distance)
        low, high = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("key", "part")], axis=1)
        held_key = np.concatenate([held_key, key])
        held_fp = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        same = (held_key == held_key[-1]).all(axis=1) if len(held_key) else np.empty(0, bool)
        whole = len(same) - int(same[::-1].argmin() if not same.all() else len(same))  # rows before the last, open group
        if whole:
            yield links(held_key[:whole], held_fp[:whole])
            held_key, held_fp = held_key[whole:], held_fp[whole:]
    if len(held_fp):
        yield links(held_key, held_fp)


def links(unique: DataFrame, distance: int = 4, segments: int = 3, block: int = 1 << 15) -> DataFrame:
    """Links a, b between different fingerprints (column fp, each once) of at most `distance`
    differing bits: enough of them to connect all that such links connect.

    block: fingerprints of one table value that a task compares at once; a value with more is cut
    into blocks, and each pair of blocks is a part of its own."""
    plan = ball_plan(segments, distance)
    table = unique.select("fp").mapInArrow(partial(_entries, plan=plan), "key long, fp long")
    hot = cut(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("long")).select("key", "blocks"))
    n_hot = hot.count()
    if n_hot:
        small = F.broadcast(hot) if n_hot <= 100_000 else hot
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pair = lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other)
        parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair))
        table = table.join(small, "key", "left").select("key", F.explode(parts).alias("part"), "fp")
    else:
        table = table.select("key", F.lit(0).cast("long").alias("part"), "fp")
    dealt = table.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(partial(_link_batches, plan=plan, distance=distance), "a long, b long").distinct()


#: Up to this many different fingerprints three segments are searched, two beyond it.
_THREE_SEGMENTS = 1 << 30


def fingerprint_roots(prints: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """fp, root of each different fingerprint: root is the least fingerprint of its component.

    segments: by default 3 (21 bits and 24 table rows a fingerprint), and 2 (32 bits, some 150 rows)
    from 2**30 different fingerprints on, where the shorter values would be held by thousands."""
    unique = cut(prints.select("fp").distinct())
    if segments is None:
        segments = 3 if unique.count() < _THREE_SEGMENTS or distance >= 6 else 2
    member = connected(links(unique, distance, segments))  # node, root
    return unique.join(member, unique.fp == member.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _sizes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, distance: int = 4, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over
    links of at most `distance` differing bits, itself included), one row for each row of docs.

    A null or empty text, or one without a word, has the fingerprint 0 and links like any other.
    Repeated rows come out repeated. A null doc_id takes part; component_id is null only where all
    of its component's are null. No rows give no rows; other columns of docs play no part.

    Fingerprints that many rows share, and components of many fingerprints, are dealt to many tasks."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), words, seed))
    roots = cut(fingerprint_roots(prints, distance, segments))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("doc")).join(roots, "fp")
    least = firsts.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = left_join_spread(roots, least, "root", _sizes(roots, "root"), roots.count()).select("fp", "component_id")
    made = left_join_spread(prints, named, "fp", _sizes(prints, "fp"), prints.count())
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, seed: int = 42, distance: int = 4, segments: int | None = None) -> DataFrame:
    """One row of docs, all columns, of each component: the one with the smallest doc_id, and among
    rows of that doc_id the one with the smallest row_hash, so that a doc_id that two texts share
    loses neither. Rows without a doc_id are grouped apart: of each component one of them stays as
    well, the one with the smallest row_hash. Rows that are alike in all columns count as one."""
    prints = cut(fingerprints(docs, words, seed))
    roots = fingerprint_roots(prints, distance, segments)
    nameless = F.col("doc_id").isNull().alias("nameless")
    best = F.min(F.struct("doc_id", "row")).alias("best")
    kept = prints.groupBy("fp", nameless).agg(best).join(roots, "fp").select("root", "nameless", "best.*").groupBy("root", "nameless").agg(best)
    kept = cut(kept.select(F.coalesce("best.doc_id", F.lit(0)).alias("_id"), F.col("best.row").alias("_row"), F.col("nameless").alias("_nameless")))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("_id"), row_hash(docs).alias("_row"), docs["doc_id"].isNull().alias("_nameless"))
    chosen = marked.join(kept, ["_id", "_row", "_nameless"], "left_semi")
    twice = prints.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():  # else each chosen row stands alone, and needs no second shuffle
        chosen = chosen.dropDuplicates(["_id", "_row", "_nameless"])
    return chosen.select("doc.*")
