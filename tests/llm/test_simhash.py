import random

import pytest
import xxhash
from pyspark.sql import types as T
from pyspark.sql.functions import spark_partition_id

from corpusward.llm import simhash
from corpusward.llm.components import connected


def brute_print(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


SCHEMA = "doc_id long, text string, fp string, component_id int"


def cases():
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(900)]
    rows = []
    for _ in range(60):
        rows.append(" ".join(rng.choices(words, k=rng.randrange(1, 200))))
    base = rng.choices(words, k=400)
    for _ in range(80):
        near = list(base)
        near[rng.randrange(400)] = rng.choice(words)
        rows.append("\n".join(near))
    rows += [None, "", " \t\n", "One", "one", "ÄÖ ä Ä", "a b c", rows[0], rows[0].upper(), "x" * 100_000 + " y z w q"]
    ids = list(range(100, 100 + len(rows)))
    ids[3] = None
    ids[5] = ids[6]
    order = list(zip(ids, rows))
    rng.shuffle(order)
    return order


def test_against_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components([i for i, _ in rows], prints)
    assert got == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, roots)), key=str)


@pytest.mark.parametrize("segments", [3, 4, 5])
@pytest.mark.parametrize("block", [8, 1 << 15])
def test_links_of_dense_clusters(spark, segments, block):
    rng = random.Random(segments)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(100)} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = connected(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, segments, block)).collect()
    root = {r.node: r.root for r in found}
    want = brute_components(signed, [p & (1 << 64) - 1 for p in signed])
    groups = {}
    for p, c in zip(signed, want):
        groups.setdefault(c, []).append(p)
    for members in groups.values():
        assert {root.get(p, p) for p in members} == {min(members)}


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500)], "a long, b long")
    assert {(r.node, r.root) for r in connected(links).collect()} == {(i, 0) for i in range(201)}


def test_empty(spark):
    docs = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.one_of_each(docs).collect() == []


def test_one_of_each(spark):
    docs = spark.createDataFrame([(2, "a b c d", "k"), (1, "A B C D", "k"), (1, "A B C D", "k"), (None, "a b c d", "k"), (7, "else", "k")], "doc_id long, text string, component_id string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "A B C D", "k"), (7, "else", "k"), (None, "a b c d", "k")]


def test_one_of_each_against_brute_force(spark):
    """Repeated ids with equal and with other texts, missing ids, and columns that make rows differ."""
    rng = random.Random(8)
    texts = [t for _, t in cases()]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice("xy")) for _ in range(300)]
    rows += rng.choices(rows, k=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    roots = brute_components(list(range(len(rows))), [brute_print(t) for _, t, _ in rows])
    groups = {}
    for row, root in zip(rows, roots):
        groups.setdefault((root, row[0] is None), []).append(row)
    got = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert len(got) == len(groups)
    for members in groups.values():
        least = min(i for i, *_ in members) if members[0][0] is not None else None
        assert sum(r in got for r in {m for m in members if m[0] == least}) == 1
    again = simhash.one_of_each(docs.repartition(13, "text").orderBy("_row"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(got, key=str)


def test_two_texts_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (2, "totally other words here now")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == [(1, "a b c d e"), (2, "totally other words here now")]


@pytest.mark.parametrize("segments, distance", [(2, 4), (2, 5), (3, 7)])
def test_balls_of_radius_two(spark, segments, distance):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = [centre ^ sum(1 << b for b in rng.sample(range(64), 2 + k % 7)) for k in range(120)]
    signed = [p - (1 << 64) if p >> 63 else p for p in dict.fromkeys(prints)]
    rows = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r.fp: r.root for r in simhash.fingerprint_roots(rows, distance, segments).collect()}
    parent = {p: p for p in signed}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for p in signed:
        for q in signed:
            if ((p ^ q) & (1 << 64) - 1).bit_count() <= distance:
                a, b = sorted((find(p), find(q)))
                parent[b] = a
    assert got == {p: find(p) for p in signed}


def test_hubs_are_dealt_to_many_tasks(spark):
    """A component of which one node has most links: no task gets all of them."""
    links = spark.range(1, 6001).selectExpr("id as a", "0L as b").unionByName(spark.range(7000, 7600).selectExpr("id as a", "id - 1 as b"))
    from corpusward.llm import components

    star = components._with_least(links, 6600)
    sizes = [r.n for r in star.groupBy(spark_partition_id()).count().withColumnRenamed("count", "n").collect()]
    assert star.count() == 6600 and max(sizes) < 3300
    hub = links.selectExpr("b as a", "a as b").repartition(8)
    dealt = components._with_least(hub, 6600)
    sizes = [r.n for r in dealt.groupBy(spark_partition_id()).count().withColumnRenamed("count", "n").collect()]
    assert dealt.count() == 6600 and max(sizes) < 3300
    assert {r.least for r in dealt.where("a = 0").select("least").distinct().collect()} == {1}
    found = {r.node: r.root for r in connected(links).collect()}
    assert all(found[i] == 0 for i in range(6001)) and all(found[i] == 6999 for i in range(6999, 7600))
