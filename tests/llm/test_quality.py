import math
import random
from collections import Counter

from corpusward.llm import quality


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def cases():
    rng = random.Random(1)
    words = ["a", "bé", "C#", "d&d", "<e>", "日本", "x" * 50]
    out = [None, "", " \n\t\r\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "\n\n", "x\nx\n x\n\nx", "no\xa0break here", "a\x0bb\x0cc d", "| " * 3000]
    out += [rng.choice(["\n", " "]).join(rng.choices(words, k=rng.randrange(60))) for _ in range(200)]
    return out + [" ".join(rng.choices(words, k=20_000))]


def test_statistics(spark):
    docs = spark.createDataFrame(list(enumerate(cases())), "doc_id long, text string")
    got = docs.select("doc_id", quality.statistics(docs.text).alias("s")).collect()
    for r in got:
        assert tuple(r.s)[:5] == brute(cases()[r.doc_id]), cases()[r.doc_id]


def corpus(n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randrange(60, 120))]
        kind = rng.randrange(6)
        if kind == 0:
            words = [w + "$$" for w in words]
        if kind == 1:
            words = [w * 4 for w in words]
        if kind == 2:
            words = words[:20]
        rows.append((i, " ".join(words), i % 3))
        labels.append((i, int(kind > 1), 0))
    return rows, labels


def test_learned_list(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    good = {i for i, q, _ in labels if q}
    got = quality.judged(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == (r.doc_id in good and not r.base_failed)
        assert r.base_failed == (r.s.n_words < 50)
    kept = quality.good_rows(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_native(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plan = quality.good_rows(docs, marks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (2, "w%d " * 60)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted((r.doc_id or 0, r.kept) for r in quality.judged(docs, marks).collect()) == [(0, False), (1, False), (2, False)]
    assert quality.judged(docs.limit(0), marks).collect() == []


def covering(rows, names, most_rules, most_conditions, least_precision, least_rows):
    """Sequential covering by trying every threshold between two values on every row."""
    cuts = [[(a + b) / 2 for a, b in zip(v, v[1:])] for v in (sorted({r[0][f] for r in rows}) for f in range(len(names)))]
    tests = [(f, above, t) for f in range(len(names)) for t in cuts[f] for above in (False, True)]
    holds = lambda c, r: (r[0][c[0]] > c[2]) == c[1]
    left, rules = list(rows), []

    def bad_good(some):
        return sum(r[1] for r in some), sum(not r[1] for r in some)

    while len(rules) < most_rules:
        grown, inside = [], [r for r in left if r[2] < 2]
        while len(grown) < most_conditions:
            p0, n0 = bad_good(inside)
            if not p0 or not n0:
                break
            best, choice = 1e-9, None
            for c in tests:
                p, n = bad_good([r for r in inside if holds(c, r)])
                if p >= least_rows and p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) > best:
                    best, choice = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), c
            if choice is None:
                break
            grown.append(choice)
            inside = [r for r in inside if holds(choice, r)]
        worth = []
        for k in range(1, len(grown) + 1):
            p, n = bad_good([r for r in left if r[2] == 2 and all(holds(c, r) for c in grown[:k])])
            worth.append(((p - n) / max(1, p + n), -k, p, n))
        if not worth:
            break
        _, k, p, n = max(worth)
        if p + n < least_rows or p < least_precision * (p + n):
            break
        rules.append([(names[f], above, t) for f, above, t in grown[:-k]])
        left = [r for r in left if not all(holds(c, r) for c in grown[:-k])]
    return rules


def test_learner_against_brute_search(spark):
    """With more quantiles than rows every threshold is tried, so the list must be the brute one."""
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_capitals n_marks".split()
    schema = "s struct<" + ",".join(f"{f}:long" for f in fields) + ">, bad boolean, part int"
    lengths = set()
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        made = []
        for i in range(110):
            n = rng.randrange(60, 300)
            s = (n, n * rng.randrange(3, 9), rng.randrange(n // 3), rng.randrange(6), rng.randrange(n // 3), rng.randrange(6, 20), rng.randrange(n // 2, n), rng.randrange(n), rng.randrange(n // 4))
            made.append((s, (s[2] / n > 0.2 and s[8] / n > 0.1) or n > 250 or rng.random() < 0.04, i % 3))
        numbers = lambda s: [float(s[0]), s[1] / s[0], s[2] / s[0], s[3] / s[5], s[4] / s[0], s[6] / s[0], s[7] / s[1], s[8] / s[0]]
        how = {"most_rules": 3, "most_conditions": 3, "least_precision": 0.7, "least_rows": 2}
        got = quality.learn(spark.createDataFrame(made, schema), intervals=250, **how)
        got = [[(c.feature, c.above, c.threshold) for c in rule.conditions] for rule in got]
        assert got == covering([(numbers(s), bad, part) for s, bad, part in made], list(quality.FEATURES), **how)
        lengths |= {len(rule) for rule in got}
    assert len(lengths) > 1  # rules of one condition and of more
