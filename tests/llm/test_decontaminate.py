import random
import re

from corpusward.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, width=13):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            v = words(t)
            n = min(width, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    ids |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["ab%d" % i for i in range(30)] + ["Élan", "naïve", "X9"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randrange(13, 60))) for i in range(12)] + [(20, say(5)), (21, "unique short"), (22, "one"), (23, None), (24, "..."), (25, ""), (None, say(20)), (26, "X9")]
    items += [(30, items[0][1]), (31, items[0][1] + " tail " + items[1][1])]
    docs = []
    for d in range(60):
        text = say(rng.randrange(0, 150))
        if d % 2:
            source = words(items[d % 12][1])
            at = rng.randrange(0, len(source))
            text += " " + " ".join(source[at : at + rng.randrange(8, 40)]).upper() + " " + say(10)
        docs.append((d, text))
    docs += [(99, None), (98, ""), (97, "one"), (96, "ONE, and unique-short"), (95, items[-1][1] * 3), (None, items[0][1]), (95, "!")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (16 << 20, 700):
        got = decontaminate.contamination(frame, bench, block_bytes=block_bytes).collect()
        assert sorted(((r.doc.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == brute(docs, items)


def test_longest_matches(spark):
    item = " ".join("w%d" % i for i in range(40))
    docs = spark.createDataFrame([(1, "x " + " ".join("w%d" % i for i in range(5, 30)) + " y " + " ".join("w%d" % i for i in range(20, 40)))], "doc_id long, text string")
    found = decontaminate.find_benchmark(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in found.matches] == [("7", 1, 25), ("7", 27, 20)] and found.n_hit == 45


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contamination(one, bench).collect()] == [(2, 0, False)]


def test_blocks_take_turns_in_one_operator(spark):
    rng = random.Random(9)
    items = [(i, " ".join("v%d" % rng.randrange(400) for _ in range(30))) for i in range(40)]
    docs = [(d, "a b " + items[d][1] + " c " + items[(d + 7) % 40][1]) for d in range(40)] + [(90, None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plans = []
    for block_bytes in (16 << 20, 200):
        found = decontaminate.contamination(frame, bench, block_bytes=block_bytes)
        assert sorted(((r.doc.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()), key=str) == brute(docs, items)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [p.count("MapInArrow") for p in plans] == [1, 1] and abs(len(plans[0]) - len(plans[1])) < 200
