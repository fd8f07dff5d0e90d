import zlib

import numpy as np

from corpusward.llm import langid

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_learns_from_text_and_lang_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    changed = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, langid.identify(changed).collect()))


def test_odd_rows(spark):
    rows = [(i, text, lang, 1) for i, (text, lang) in enumerate([("der die das und", "de"), ("the and of that", "en")] * 30)]
    rows += [(100, None, "de", 1), (101, "", "de", 1), (102, "123 !?", "en", 1), (None, "und das", None, 1), (103, "the " * 200_000, None, 1), (0, "der die das und", "de", 1), (104, "ß", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert by_id[None].lang_pred == "de" and not by_id[None].held_out and by_id[100].score == 0
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_temperature_and_sparsity():
    class Row:
        def __init__(self, lang, at):
            self.lang, self.at, self.share = lang, at, [1 / len(at)] * len(at)

    rng = np.random.default_rng(0)
    rows = [Row("ab"[i % 2], sorted({*rng.integers(0, 50, 5).tolist(), 100 + i % 2})) for i in range(400)]
    model = langid.train(rows, np.ones(langid.BUCKETS))
    assert model.temperature > 0 and (model.weights != 0).mean() < 0.01
    assert model.weights[100, 0] > 0 > model.weights[100, 1]


def test_order_of_rows_changes_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.limit(40).unionByName(docs.limit(1).selectExpr("doc_id", "'zwei Texte' as text", "'de' as lang", "source", "n_chars"))
    docs = docs.unionByName(odd)
    for sample in (4000, 100):
        want = sorted(map(tuple, langid.identify(docs, sample).collect()), key=str)
        again = docs.repartition(11, "n_chars").sortWithinPartitions("text")
        assert sorted(map(tuple, langid.identify(again, sample).collect()), key=str) == want
