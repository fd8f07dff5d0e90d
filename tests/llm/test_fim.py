import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusward.llm import fim

WHITE = " \t\n\x0b\f\r"
PARTS = ["a", "béta", "<P>", "<", "P>", "<S", "<M>", " ", "  ", "\n", "\t", "　", " ", "\x1c", "😀", "é", "x" * 40, "\\", "$1"]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(0, 30)))) for i in range(400)]
    rows += [(i, "".join(rng.choices([p for p in PARTS if "<P>" != p != "<M>"], k=40))) for i in range(400, 700)]
    rows += [(1000 + i, t) for i, t in enumerate(["", " \n", "one", " one ", None, "word " * 60_000, "z" * 100_000, "<P", "S><"])]
    rows += [(None, "no id here"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (3, "another text of one id"), (2000, "same"), (2001, "same"), (2002, None)]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")


def test_against_brute_force(docs):
    made = fim.transform(docs).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((r.doc_id, r.text, *by_hand(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert sorted(((r.doc.doc_id, r.doc.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr) == want
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    assert all(r.restored == (r.doc.text or "") and r.doc.output == "x" for r in made)


def test_no_rows(docs):
    assert fim.transform(docs.limit(0)).count() == 0


def test_texts_are_shuffled_once_and_units_never(docs):
    plan = fim.transform(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    below_generate = plan.split("Generate posexplode")[1]
    assert "Exchange" in below_generate and "Exchange" not in plan.split("Generate posexplode")[0].split("SortMergeJoin")[-1]
