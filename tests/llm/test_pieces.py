import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusward.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'s", " ", "  ", "\n", "\t", "▁", "▁▁", "a", "ab", "the", "Hello", " the", "ing", "日本語", "😀", "é", "́", "\x00", "123", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "ß", "İ", "word", "aaa", "\U0010ffff", "ꙮ", "zzz"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(16))) for _ in range(4000)]
    made += ["".join(rng.choices("abcdefgh etaoin", k=rng.randrange(1, 60))) for _ in range(4000)]
    return made + ["z" * 20_000, "ab" * 3000, "", " ", "▁", "word " * 5000, "aab" * 999, "".join(rng.choices("etaoinshr", k=20_000))]


def test_encoding_is_the_librarys(model, library):
    some = texts()
    ids, first = model.encode(pa.array(some))
    want = library.encode(some, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want
    assert model.decode(ids, first).to_pylist() == [library.decode(x) for x in want]
    for k in (0, 17, 4000):  # alone a text gives what it gives among others
        assert model.encode(pa.array(some[k : k + 1]))[0].tolist() == want[k]


def test_decoding_any_ids(model, library):
    rng = random.Random(2)
    lists = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 259) for _ in range(8)] for _ in range(3000)]
    lists += [[0, 1, 2], [1, 29871, 5], [2], [], [0], [29871], [29871, 29871]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert model.decode(np.concatenate([np.array(x, int) for x in lists]), first).to_pylist() == [library.decode(x) for x in lists]


def one_after_another(pairs, rank_of, word):
    """The definition: the best pair, the leftmost of these, again and again."""
    word = list(word)
    while True:
        found = [(rank_of[a + b], i) for i, (a, b) in enumerate(zip(word, word[1:])) if a + b in pairs]
        if not found:
            return word
        i = min(found)[1]
        word[i : i + 2] = [word[i] + word[i + 1]]


def test_merges_in_rounds_are_merges_one_by_one():
    """Made-up vocabularies, in which parts are often worse than what they are part of."""
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(3)
    for trial in range(60):
        made = {"a", "b", "c"}
        while len(made) < 24:
            made.add("".join(rng.choices("abc", k=rng.randrange(2, 6))))
        order = rng.sample(sorted(made), len(made))
        kinds = [("<unk>", 0, pieces.UNKNOWN)] + [(f"<0x{b:02X}>", 0, pieces.BYTE) for b in range(256)] + [(p, -float(r // 2), pieces.NORMAL) for r, p in enumerate(order)]
        fake = sentencepiece_model_pb2.ModelProto()
        for piece, score, kind in kinds:
            x = fake.pieces.add()
            x.piece, x.score, x.type = piece, score, kind
        fake.trainer_spec.model_type, fake.trainer_spec.byte_fallback = 2, True
        fake.normalizer_spec.remove_extra_whitespaces = fake.normalizer_spec.add_dummy_prefix = False
        model = pieces.Pieces(model=fake)
        rank_of = {p: r // 2 for r, p in enumerate(order)}
        words = ["".join(rng.choices("abc", k=rng.randrange(1, 14))) for _ in range(60)] + ["".join(rng.choices("abc", k=400))]
        ids, first = model.encode(pa.array(words))
        names = [k[0] for k in kinds]
        assert [[names[i] for i in ids[a:b]] for a, b in zip(first, first[1:])] == [one_after_another(made, rank_of, w) for w in words]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    (tmp_path / "x.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="not a BPE model"):
        pieces.Pieces(str(tmp_path / "x.model"))


def test_a_long_word_ends(model, library):
    word = "".join(random.Random(4).choices("etaoinshrdlu", k=200_000))
    began = time.time()
    ids, _ = model.encode(pa.array([word]))
    assert time.time() - began < 30 and ids.tolist() == library.encode(word)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1) for i, t in enumerate(["One two.", None, "", "One two.", "ä" * 5000, "a <s> b", "  "])] + [(None, "no id", 2), (0, "One two.", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def test_rows(docs, library):
    for made in (pieces.encode_decode(docs, PATH), pieces.decode(pieces.encode(docs, PATH), PATH)):
        rows = made.withColumn("told", pieces.joined(F.col("ids"))).collect()
        assert len(rows) == 9
        for row in rows:
            want = library.encode(row.doc.text or "")
            assert row.ids == want and row.n_tokens == len(want) and row.told == ",".join(map(str, want))
            assert row.decoded == library.decode(want)
    assert pieces.encode_decode(docs.limit(0), PATH).count() == 0


def test_digests(spark, library):
    from corpusward.llm import queries

    rows = {r.doc_id: r for r in queries.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for doc in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(doc.text or "")
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
