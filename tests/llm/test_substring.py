import random

from corpusward.llm import substring


def brute(rows, width):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if d is not None:
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["wörd%d" % i for i in range(40)] + ["a-very-long-word-of-more-than-eight-bytes", "x" * 3000]
    passage = " ".join(rng.choices(words, k=30))
    rows = []
    for d in range(120):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 80)))
        rows.append((d * 3, text + ("\n" + passage + "\t" if d % 3 == 0 else "") + text[: d * 2]))
    rows += [(7, rows[5][1]), (9, None), (10, ""), (None, passage), (None, passage), (0, passage), (0, passage), (11, " \n "), (12, passage * 200)]
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in rows], "doc_id long, text string, g int, kept string")
    for group_bytes in (2000, 8 << 20):
        got = substring.without_repeats(docs, group_bytes=group_bytes)
        assert sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == brute(rows, 13)
        for r in got.collect():
            assert sum(x.end - x.start for x in r.removed) == r.n_removed
            assert all(x.end < y.start for x, y in zip(r.removed, r.removed[1:]))


def test_unchanged_texts_keep_their_layout(spark):
    docs = spark.createDataFrame([(1, "a\n b  c"), (2, None)], "doc_id long, text string")
    assert {r.kept for r in substring.without_repeats(docs, whole=True).collect()} == {"a\n b  c", None}


def test_empty(spark):
    assert substring.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing():
    import numpy as np

    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (substring.unpacked(substring.packed(h)) == h).all()
    assert len(substring.unpacked(substring.packed(h[:0]))) == 0


def test_groups_follow_doc_ids(spark):
    """Some 10**5 groups from a few thousand planned ranges, and a doc_id with a third of the rows."""
    rng = random.Random(3)
    ids = sorted({rng.randrange(10**6) for _ in range(60_000)} | {10**12 + i for i in range(40_000)})
    docs = spark.createDataFrame([(i, "0123456789abcdef") for i in ids], "doc_id long, text string").repartition(8)
    rows = substring.grouped(docs, 16, 16 * len(ids), len(ids)).collect()
    assert len({r.g for r in rows}) > 60_000 and all(r.rank == r.g for r in rows)
    rows.sort(key=lambda r: r.doc_id)
    assert all(a.g <= b.g for a, b in zip(rows, rows[1:]))
    hot = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(1000, f"text {i} x") for i in range(1000)] + [(None, f"text {i}") for i in range(9)], "doc_id long, text string")
    rows = substring.grouped(hot, 400, 30_000, 3000).collect()
    own = [r for r in rows if r.doc_id == 1000]
    assert len({r.rank for r in own}) == 1 and len({r.g for r in own}) > 10
    assert all(r.g < 0 for r in rows if r.doc_id is None)
    order = sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)
    assert all(a.rank <= b.rank and (a.rank < b.rank or a.g == b.g or a.doc_id == b.doc_id == 1000) for a, b in zip(order, order[1:]))


def test_buckets_are_bounded():
    for size in (0, 10**9, 30 * 10**9, 10**12, 10**14):
        bits = substring._bucket_bits(size, 32 << 20)
        assert size / 6 / 2**bits < 2**26 and bits <= 20


def test_one_doc_id_in_many_groups(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(20)]
    passages = [" ".join(rng.choices(words, k=20)) for _ in range(5)]
    rows = [(rng.choice([3, 3, *range(9)]), rng.choice(passages) + " " + " ".join(rng.choices(words, k=10))) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.without_repeats(docs, group_bytes=300)
    assert sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == brute(rows, 13)


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    """Windows whose first hashes agree are told apart by the second one, in different groups."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    real = substring.window_hashes
    monkeypatch.setattr(substring, "window_hashes", lambda words, width, *radix: real(words, width, *radix) if radix else np.ones(max(0, len(words) - width + 1), np.uint64))
    rng = random.Random(5)
    texts = [" ".join("w%d" % rng.randrange(10**6) for _ in range(13)) for _ in range(8)]
    sent = [substring._send(pa.table({"g": [g], "rank": [g], "text": [texts[g]]}), 13, 30) for g in range(8)]
    sent.append(substring._send(pa.table({"g": [8], "rank": [8], "text": [texts[3]]}), 13, 30))
    rows = pa.concat_tables(sent)
    buckets = rows.column("bucket").to_pylist()
    assert len(buckets) == 9 and len(set(buckets)) == 8
    told = [substring._tell(rows.filter(pc.equal(rows.column("bucket"), b))) for b in set(buckets)]
    assert [g for t in told for g in t.column("g").to_pylist()] == [8]


def test_send_gives_each_window_once():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    text = " ".join(rng.choices(["a", "b", "c"], k=20_000))
    rows = pa.table({"g": [4, 4], "rank": [4, 4], "text": [text, text[:1000]]})
    words = text.split()
    windows = {tuple(words[i : i + 13]) for i in range(len(words) - 12)}
    plain = substring.unpacked(substring._send(rows, 13, 0).column("hashes")[0].as_py())
    dealt = substring._send(rows, 13, 6)
    parts = [substring.unpacked(x.as_py()) for x in dealt.column("hashes")]
    assert len(plain) == len(windows) and len(set(dealt.column("bucket").to_pylist())) == len(parts) == 64
    assert sorted(np.concatenate(parts).tolist()) == plain.tolist()
