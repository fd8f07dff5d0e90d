"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all learning documents. The weights are trained with
follow-the-regularised-leader and an elastic-net penalty, which leaves most of them at zero, on a
bounded sample; a temperature fitted on a part of the sample that the weights have not seen makes
the scores probabilities. All documents are then judged over their whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
#: Characters handled at once; a longer text is cut into such parts, whose n-grams add up.
_AT_ONCE = 1 << 20
UNDETERMINED = "und"


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_letters: list[np.ndarray] = []


def _parts(texts: list[str]):
    """Runs of (row, part of a text) of about _AT_ONCE characters."""
    run, size = [], 0
    for i, text in enumerate(texts):
        for low in range(0, len(text), _AT_ONCE):
            part = text[low : low + _AT_ONCE].lower()
            run.append((i, part))
            size += len(part)
            if size >= _AT_ONCE:
                yield run
                run, size = [], 0
    if run:
        yield run


def grams(texts: list[str]):
    """(rows, buckets) arrays, some for each n-gram size and run, and which rows have a letter are
    told by a bucket of -1. N-grams are of lower-cased letters; other signs count as a space."""
    if not _letters:
        _letters.append(letter_table())
    for run in _parts(texts):
        points = np.frombuffer("".join(p for _, p in run).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.array([i for i, _ in run], np.int32), [len(p) for _, p in run])
        letter = _letters[0][points]
        yield row[letter][:0], np.empty(0, np.int64), np.unique(row[letter])
        code = np.where(letter, points, 32).astype(np.uint64)
        h = np.zeros(len(code), np.uint64)
        for n in range(1, max(SIZES) + 1):
            h = (h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            if n in SIZES and len(h):
                one = row[: len(h)] == row[n - 1 :]
                yield row[: len(h)][one], (h[one] >> np.uint64(64 - 16)).astype(np.int64), None


def _frequencies(batches):
    """How many texts have each bucket; under -1, how many there are."""
    total, n, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
    for batch in batches:
        n += batch.num_rows
        for text in pc.fill_null(batch.column("text"), ""):
            had = [b for _, b, _ in grams([text.as_py()]) if len(b)]
            for b in had:
                seen[b] = True
            total += seen
            for b in had:
                seen[b] = False
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["bucket", "n"])


def _sparse(batches):
    for batch in batches:
        kept = []
        for text in pc.fill_null(batch.column("text"), ""):
            counts = np.zeros(BUCKETS)
            for _, b, _ in grams([text.as_py()]):
                counts += np.bincount(b, minlength=BUCKETS)
            at = np.flatnonzero(counts)
            kept.append((at, counts[at] / max(1.0, counts.sum())))
        lists = [pa.array([a.tolist() for a, _ in kept], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in kept], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("lang"), *lists], ["order", "lang", "at", "share"])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket, language (each language's side by side); inverse document frequencies are in it
    temperature: float

    def scores(self, rows: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, which rows have a letter)."""
        k = len(self.languages)
        logits, total, letters = np.zeros((rows, k)), np.zeros(rows), np.zeros(rows, bool)
        for row, bucket, has in grams(texts):
            if has is not None:
                letters[has] = True
                continue
            for c in range(k):  # one language at a time, so that memory doesn't grow with their number
                logits[:, c] += np.bincount(row, weights=self.weights[:, c][bucket], minlength=rows)
            total += np.bincount(row, minlength=rows)
        return logits / np.maximum(1, total)[:, None], letters


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list, idf: np.ndarray, rounds: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, scale: float = 30.0) -> Model | None:
    """A model of rows (lang, at, share); a fifth of them only serves to fit the temperature.

    The same rows in the same order give the same model."""
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    sparse = [(np.array(r.at, np.int64), np.array(r.share) * idf[r.at] * scale if len(r.at) else np.empty(0), number[r.lang]) for r in rows]
    rng = np.random.default_rng(0)
    order = rng.permutation(len(sparse))
    held, used = (order[::5], np.setdiff1d(order, order[::5])) if len(order) >= 20 else (order, order)
    z, n = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(rounds):
        for i in rng.permutation(used):
            at, x, y = sparse[i]
            if not len(at):
                continue
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = nn + g * g
            z[at] = zz + g - (np.sqrt(more) - np.sqrt(nn)) / alpha * w
            n[at] = more
    w = weights(z, n)
    logits = np.array([x @ w[at] if len(at) else np.zeros(len(languages)) for at, x, _ in (sparse[i] for i in held)])
    truth = np.array([sparse[i][2] for i in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    return Model(languages, np.asfortranarray((w * idf[:, None] * scale).astype(np.float32)), float(temperature))


def _predict(batches, model):
    m: Model | None = model.value
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        if m is None:
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        else:
            logits, letters = m.scores(len(texts), texts)
            p = _softmax(logits / m.temperature)
            lang = [m.languages[i] if ok else UNDETERMINED for i, ok in zip(p.argmax(axis=1), letters)]
            score = np.where(letters, p.max(axis=1), 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id as text leaves 1 when divided by 3), lang_pred and score.

    Learned from text and lang of rows that have a lang and aren't held out: document frequencies
    from all of them, weights from about `sample` of them, chosen by a hash of the row (twice that at
    most) and put in its order, so that the order in which rows arrive changes nothing. A null text, or one without a letter, is `und` with score 0; so is every text if there is
    nothing to learn from. A row without a doc_id isn't learned from, nor held out. Repeated rows come
    out repeated; ties go to the language that sorts first. No rows give no rows."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("held_out", held)
    learn = rows.where("doc_id is not null and lang is not null and text is not null and not held_out")
    counts = learn.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(BUCKETS)
    total = 0
    for r in counts:  # one for each bucket
        if r.bucket < 0:
            total = r.n
        else:
            frequency[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + frequency)) + 1
    share = min(1.0, sample / max(1, total))
    by = F.xxhash64("doc_id", "text", "lang", F.lit(7))
    some = learn.withColumn("order", by).where(F.pmod(by, F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True))
    made = some.select("order", "lang", "text").mapInArrow(_sparse, "order long, lang string, at array<int>, share array<float>").orderBy("order").limit(2 * sample).collect() if total else []
    model = spark.sparkContext.broadcast(train(made, idf))
    return rows.select("doc_id", "text", "held_out").mapInArrow(partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")
