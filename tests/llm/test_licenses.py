import random
import re

from corpusward.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_matching_statistics():
    rng = random.Random(7)
    sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(6)]
    automaton = licenses.Automaton(sequences)
    inside = lambda run: any(s[i : i + len(run)] == run for s in sequences for i in range(len(s)))
    for _ in range(300):
        text = [rng.randrange(5) for _ in range(rng.randrange(25))]
        want = []
        for end in range(1, len(text) + 1):
            n = max((k for k in range(end + 1) if inside(text[end - k : end])), default=0)
            if n >= 2 and not (end < len(text) and inside(text[end - n : end + 1])):
                want.append((end, n))
        got = automaton.longest(text, 2)
        assert [(e, n) for _, e, n in got] == want
        for state, end, n in got:
            assert automaton.ends[state] == sorted((t, i + n) for t, s in enumerate(sequences) for i in range(len(s) - n + 1) if s[i : i + n] == text[end - n : end])


TEXTS = [
    None,
    "",
    "Nothing here of the and to",
    "Released under the MIT License.",
    "cc by CC-BY, General Public License; all rights reserved ALL RIGHTS RESERVED",
    "This work is licensed under the GNU General Public License, version 2.",
    "licensed under the terms of something",
    "x " * 30_000 + "Licensed under CC BY-NC 4.0",
    "all rights",
    "reserved cc",
    "by",
]


def test_scan(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "All rights reserved", "x"), (3, TEXTS[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words(r.doc.text)
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == sorted({x for _, x in places}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    by_id = {r.doc.doc_id: r for r in got}
    assert by_id[3].labels == ["mit"] and by_id[3].score == 1.0 and tuple(by_id[3].spans[0]) == ("mit", 0, 5, 1.0)
    assert by_id[5].labels == ["gpl"] and by_id[5].score > 0.9
    assert by_id[6].labels == by_id[2].labels == []
    assert by_id[7].labels == ["cc-by", "cc-by-nc"]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_whole_templates_with_changes():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES, 4, 0.8, 50)
    import pyarrow as pa

    text = licenses.TEMPLATES[5][1]
    changed = text.replace("free of charge", "FREE of any charge").replace("modify,", "modify and")
    found = scanner.scan(pa.array([text, changed, "filler " * 20 + text + " filler" * 20 + changed]))
    assert [len([s for s in f[5] if s[0] == "mit"]) for f in found] == [1, 1, 2]
    assert all(s[3] > 0.8 for f in found for s in f[5])


def test_whole_licences(spark):
    """Every template is found in a text around it, wrapped and commented as in sources, and a text that
    only has half of one isn't labelled by it."""
    words_of = lambda t: t.split()
    wrapped = ["\n * ".join(" ".join(words_of(t)[i : i + 9]) for i in range(0, len(words_of(t)), 9)) for _, t in licenses.TEMPLATES]
    docs = spark.createDataFrame([(i, f"/* Copyright 2020 somebody\n * {t}\n */ code here") for i, t in enumerate(wrapped)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        label, text = licenses.TEMPLATES[r.doc.doc_id]
        assert label in r.labels and r.score == 1.0, label
    half = spark.createDataFrame([(0, " ".join(words_of(dict(licenses.TEMPLATES)["zlib"])[:60]))], "doc_id long, text string")
    assert licenses.scan(half).first().labels == []
