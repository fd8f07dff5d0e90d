import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusward.llm import bpe, transducer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["'s", "'S", "'re", "'r", "'l", "'ll", "'v", "'ve", "don't", " ", "  ", "\n", "\t\n", " ", "　", "\x1c", "\x85", "​", "Σ", "ΟΔΟΣ", "İ", "é", "ﬁ", "½", "٣", "123", "!?", "''", "'", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "日本語", "😀", "word", "Hello", "the", "ß", "́", "\x00", "ing", "x're", "'rx", "'l l", "'vee", "Ᲊ", "_"]


def texts(n=3000):
    rng = random.Random(3)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(0, 14))) for _ in range(n)]
    return made + ["word " * 5000 + "'r", "z" * 20_000, "", " ", "'"]


def test_codec_is_the_librarys():
    codec, library = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False)):
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert codec.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False) == text


def test_decoding_broken_utf8():
    codec, library = bpe.Codec(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_counts_are_the_librarys():
    counter, library = transducer.TokenCounter(WORD), Tokenizer.from_file(WORD)
    got = counter.counts(texts())
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]


def test_word_transducer_is_the_merge_queue():
    merges = bpe.Merges(WORD)
    words, rng = transducer.WordCounts(merges, most_states=500), random.Random(6)
    for _ in range(5000):
        word = "".join(rng.choices("aeinorstht", k=rng.randrange(1, 14))).encode()
        assert words.count(word) == len(merges.encode_word(word))


def test_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 6, (37, 6)).astype(np.uint8)
    made, want = transducer.scan(maps), np.arange(6)
    for k, one in enumerate(maps):
        want = one[want]
        assert (made[k] == want).all()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1) for i, t in enumerate(["One two.", None, "", "One two.", "ä" * 5000, "a <|endoftext|> b"])] + [(None, "no id", 2), (0, "One two.", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def test_queries_rows(docs):
    library = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert len(got) == 8
    for row in got:
        want = library.encode(row.doc.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == want and row.n_tokens == len(want)
        assert row.decoded == (row.doc.text or "")
    library = Tokenizer.from_file(WORD)
    for row in transducer.count_tokens(docs, WORD).collect():
        assert (row.n_bytes, row.n_tokens) == (len((row.doc.text or "").encode()), len(library.encode(row.doc.text or "", add_special_tokens=False).ids))
    assert bpe.decode(bpe.encode(docs.limit(0), BYTE), BYTE).count() == transducer.count_tokens(docs.limit(0), WORD).count() == 0


def test_digests(spark):
    from corpusward.llm import queries

    library = Tokenizer.from_file(BYTE)
    rows = {r.doc_id: r for r in queries.op5_bpe_encode_decode(spark, "/root/testdata/sf0.001").collect()}
    for doc in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = np.array(library.encode(doc.text, add_special_tokens=False).ids, "<u4").tobytes()
        assert rows[doc.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert rows[doc.doc_id].decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()
