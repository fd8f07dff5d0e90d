import hashlib

import corpus_pipeline
from corpusward.llm import bpe, queries
from test_decontaminate import brute as brute_contamination
from test_simhash import brute_components, brute_print
from test_substring import brute as brute_substring

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in queries.op7_quality_rules(spark, FOLDER).collect() if r.kept}
    now = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    want = [now]
    ids, prints = [i for i, _ in now], [brute_print(t) for _, t in now]
    now = [row for row, root in zip(now, brute_components(ids, prints)) if row[0] == root]
    want.append(now)
    text = dict(now)
    now = sorted((i, kept_text if gone else text[i]) for i, n, gone, kept_text in brute_substring(now, 13) if not gone or gone < n)
    want.append(now)
    bad = {i for i, *_, contaminated in brute_contamination(now, bench) if contaminated}
    want.append([row for row in now if row[0] not in bad])
    frame = docs
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        frame = stage(spark, frame, FOLDER)
        assert frame.columns == docs.columns and frame.dtypes == docs.dtypes, name
        frame = spark.createDataFrame(frame.collect(), docs.schema)
        assert sorted((r.doc_id, r.text) for r in frame.collect()) == rows, name
        assert all(r.n_chars == len(r.text) for r in frame.collect()), name
    last = corpus_pipeline.encode(spark, frame, FOLDER).collect()
    codec = bpe.Codec(queries.vocabulary("byte_bpe_50k.json"))
    assert {r.doc_id: bytes(r.ids) for r in last} == {i: codec.encode(t) for i, t in want[-1]}
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in last)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in whole} == {(r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in last}


def test_extra_columns_and_nulls(spark):
    rows = [(1, "w1 " * 60 + "end", "en", "s", 5, 1.5, "x"), (None, None, None, None, None, None, None), (2, " ".join("v%d" % i for i in range(80)), None, "s", 9, None, "y"), (2, " ".join("v%d" % i for i in range(80)), None, "s", 9, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words double, doc string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == docs.columns, name
        made.collect()
        assert stage(spark, docs.limit(0), FOLDER).collect() == [], name
    assert [r.n_tokens for r in corpus_pipeline.encode(spark, docs, FOLDER).collect()].count(0) == 1
    assert corpus_pipeline.encode(spark, docs.limit(0), FOLDER).collect() == []

