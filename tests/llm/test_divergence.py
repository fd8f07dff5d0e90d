import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusward.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, top=200):
    docs = [tuple(x or "" for x in r) for r in rows]
    groups, df, counts = {(la, so) for la, so, _ in docs}, defaultdict(Counter), defaultdict(Counter)
    for la, so, text in docs:
        terms = TERM.findall(text.translate(SMALL))
        df[la].update({*terms})
        counts[la, so].update(terms)
    out = []
    for la in {g[0] for g in groups}:
        kept = [t for t, n in df[la].items() if n >= 3]
        here = [so for x, so in groups if x == la]
        n = {so: {t: counts[la, so][t] for t in kept} for so in here}
        share = lambda of: {t: 1 + 10**9 * (of[t] + 1) // (sum(of.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {so: share(n[so]) for so in here}
        q = share({t: sum(n[so][t] for so in here) for t in kept})
        for so in here:
            pairs = [(sum((p[so][t] - p[x][t]) ** 2 // p[x][t] for t in kept), x) for x in here if x != so]
            terms = [((p[so][t] - q[t]) ** 2 // q[t], t) for t in kept if n[so][t] and p[so][t] > q[t]]
            for part, made, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(la, so, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(made, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def rows():
    rng = random.Random(8)
    words = ["the", "The", "a", "éa", "ÉA", "x1y", "日本", "rare", "don't", "[b]", "zz"] + [f"w{chr(97 + i)}" for i in range(26)]
    made = [(rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "é", None]), " ".join(rng.choices(words, k=rng.randrange(0, 20)))) for _ in range(300)]
    made += [("en", "empty", None), ("en", "empty2", "12 34"), ("xx", "s0", "only two documents"), ("xx", "s1", "only two documents"), ("fr", "alone", "un un un"), ("fr", "alone", "un"), ("fr", "alone", "un deux")]
    return made + [("en", "long", "the " * 30_000 + "y" * 5000)] + [made[0]] * 5


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in rows()], "lang string, source string, text string, value int, term string")


@pytest.mark.parametrize("width", [None, 1 << 14])
def test_against_brute_force(docs, width):
    made = divergence.audit(docs, width=width)
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, made.collect())) == by_hand(rows())


def test_sources_beyond_a_broadcast(docs, monkeypatch):
    monkeypatch.setattr(divergence, "_SMALL", 0)
    assert sorted(map(tuple, divergence.audit(docs, top=3).collect())) == by_hand(rows(), 3)


def test_a_sketch_is_never_too_small(docs):
    some = docs.select("lang", "text").na.fill("")
    cells = divergence.document_frequency_sketch(some, 2, 1 << 14)
    df = Counter()
    for la, _, text in rows():
        df.update({(la or "", t) for t in TERM.findall((text or "").translate(SMALL))})
    import pyarrow as pa

    for (la, term), n in df.items():
        raw = np.frombuffer(term.encode(), np.uint8)
        key = divergence._keys(pa.record_batch({"lang": [la]}), 0, np.array([0]), raw, np.array([0]), np.array([len(raw)]))
        assert divergence.estimates(cells, key, 2)[0] >= min(n, 255)


def test_terms_that_cannot_be_kept_are_not_shuffled(docs, spark):
    some = docs.select("lang", "source", "text").na.fill("")
    sketch = spark.sparkContext.broadcast(divergence.document_frequency_sketch(some, 3, 1 << 16).tobytes())
    from functools import partial

    sent = some.mapInArrow(partial(divergence._count_batches, sketch=sketch, depth=3, min_docs=3), "lang string, source string, term string, n long, docs long")
    assert not {"only", "two", "deux", "y" * 5000} & {r.term for r in sent.collect()}


def test_oddities(docs):
    assert divergence.audit(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        divergence.term_counts(docs, min_docs=256)
