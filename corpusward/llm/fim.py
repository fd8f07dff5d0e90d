"""Fill-in-middle: texts are cut at two units and put together as prefix, suffix and middle in another order.

Cuts are found relationally. A document's units (the matches of a pattern) are exploded to rows with
their ordinals; a window's running sum of their lengths gives each unit's end in code points; cut
requests meet the units by ordinal; an aggregation gives each document its two offsets, at which
the text is cut by substring.

Documents are told apart by doc_id and text, so repeated ones are cut once, and nothing depends on
the order of rows. Plain texts are never shuffled. Units are shuffled as arrays of lengths and
exploded where their document's partition is; the window, the meeting with the requests and the
aggregation all work on that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space and the word behind it, or white space at the end. Fixed value.
UNIT = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four 32-bit numbers of a document: 8-digit groups of the SHA-256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def form(text: Column, h: list[Column], fim_percent: int = 50, spm_percent: int = 80) -> Column:
    """plain, spm or psm. Empty texts, and those in which a mark stands, are plain."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h[2] % 100 >= fim_percent)
    return F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")


def cut_offsets(units: DataFrame, requests: DataFrame, key: list[str]) -> DataFrame:
    """key, n, first, second: where a document is cut, in code points.

    units: key and `sizes`, its units' lengths in order, one row a key. requests: key, h1 and h2; the
    cuts are behind h1 % (n + 1) and h2 % (n + 1) units, the smaller first. A cut behind no unit is at 0."""
    rows = units.select(*key, F.size("sizes").cast("long").alias("n"), F.posexplode("sizes").alias("pos", "size"))
    so_far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select(*key, "n", (F.col("pos") + 1).cast("long").alias("ordinal"), F.sum("size").over(so_far).alias("end"))
    asked = requests.select(*[F.col(k).alias(f"_{k}") for k in key], "h1", "h2")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    low, high = F.least(one, two), F.greatest(one, two)
    same = (F.col("ordinal") == low) | (F.col("ordinal") == high) | (F.col("ordinal") == F.col("n"))
    for k in key:
        same &= F.col(k) == F.col(f"_{k}")
    met = ends.hint("merge").join(asked, same)  # what is exploded is larger than its estimate: never broadcast
    at = lambda ordinal: F.coalesce(F.max(F.when(F.col("ordinal") == ordinal, F.col("end"))), F.lit(0).cast("long"))
    return met.groupBy(*key).agg(F.max("n").alias("n"), at(low).alias("first"), at(high).alias("second"))


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs (all columns in a struct `doc`) with n (units), form, prefix_chars, middle_chars (code
    points; null if plain) and output.

    A null text counts as an empty one, which has no units and stays plain; a null doc_id draws as an
    empty string. Repeated rows come out repeated, no rows give no rows, and other columns, whatever
    their names, play no part. White space is that of ASCII. A text is one row and is cut whole."""
    text, h = _text(docs), draws(docs["doc_id"], seed)
    told = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text.alias("_text"), form(text, h, fim_percent, spm_percent).alias("form"), *[x.alias(f"h{k + 1}") for k, x in enumerate(h[:2])])
    none = F.lit(None).cast("long")
    plain = told.where("form = 'plain'").select("doc", F.regexp_count("_text", F.lit(UNIT)).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("_text").alias("output"))

    named = F.concat_ws(":", F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("-")), "_text")
    keyed = told.where("form <> 'plain'").select("*", F.xxhash64(named).alias("a"), F.xxhash64(F.lit(1), named).alias("b"))
    key = ["a", "b"]
    sizes = F.transform(F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)), lambda u: F.length(u))
    units = keyed.select(*key, sizes.alias("sizes")).groupBy(*key).agg(F.any_value("sizes").alias("sizes"))
    requests = keyed.groupBy(*key).agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    offsets = cut_offsets(units, requests, key)
    rows = keyed.join(offsets, key)
    part = lambda low, size=None: F.substring("_text", low + 1, size if size is not None else F.length("_text"))
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    parts = [part(F.lit(0), first), part(first, second - first), part(second)]
    marked = rows.select("doc", "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), *[p.alias(c) for p, c in zip(parts, "pms")])
    joined = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")).otherwise(F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m"))
    return plain.unionByName(marked.select("doc", "n", "form", "prefix_chars", "middle_chars", joined.alias("output")))


def restore(output: Column, form: Column) -> Column:
    """The text of an output. A mark can't begin or end inside another one or inside a text without
    marks, so the first of each is the one that was put there."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = (1, 3, 2), (2, 3, 1)
    told = lambda order: F.concat(*[F.get(parts, F.lit(k)) for k in order])
    return F.when(form == "psm", told(psm)).when(form == "spm", told(spm)).otherwise(output)
