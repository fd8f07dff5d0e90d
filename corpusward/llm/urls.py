"""URL filters: an ordered rule list, and gradient-boosted trees on lexical features for the rest.

The trees learn from labelled URLs, those with a rule's verdict and a short list (LABELLED), by
second-order boosting of the logistic loss over quantile bins. URLs without a label teach nothing.
Features are lengths, depths, digit ratios, entropies, parameter counts, and how many pages and hosts
share the URL's top suffix, counted over all pages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.llm.shared import cut, left_join_spread

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in small letters; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "(?s)^([^/?#]*)", 1), _CAPITALS, _SMALL), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host, its subdomains, and paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def first_rule(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls. One conditional expression, for
    rule lists of up to some hundreds."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = rule.fits(host, path)
        name = (F if name is None else name).when(fits, F.lit(rule.name))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(rule.verdict))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


FEATURES = ("url length", "host length", "path length", "host labels", "path depth", "digits", "host digits", "host hyphens", "host entropy", "path entropy", "parameters", "fragment", "suffix pages", "suffix hosts")


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def lexical(url: str, host: str, path: str, pages: float, hosts: float) -> list[float]:
    """The features of one URL, in the order of FEATURES."""
    query = url.partition("#")[0].partition("?")[2]
    digits = lambda x: sum(c.isdigit() for c in x) / max(1, len(x))
    return [len(url), len(host), len(path), host.count(".") + 1, path.count("/"), digits(url), digits(host), host.count("-"), _entropy(host), _entropy(path), query.count("&") + 1 if query else 0, float("#" in url), np.log1p(pages), np.log1p(hosts)]


@dataclass
class Trees:
    """Each tree: feature, threshold, left, right and value by node; a leaf's feature is -1."""

    base: float
    trees: list[tuple[np.ndarray, ...]]
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.maximum(feature[node], 0)
                node = np.where(inner, np.where(x[np.arange(len(x)), f] <= threshold[node], left[node], right[node]), node)
            score += value[node]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 10.0) -> Trees:
    """Trees for the probability of y = 1."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    mean = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        nodes: list[list[float]] = []
        step = np.zeros(len(y))

        def grow(rows, level):
            here = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, 0, 0, -rate * gs / (hs + ridge)])
            best, choice = 1e-6, None
            for f in range(x.shape[1]) if level < depth else ():
                n = len(edges[f]) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
                cl = np.cumsum(np.bincount(binned[rows, f], weight[rows], n))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(cl < least) | (weight[rows].sum() - cl < least)] = 0
                if len(gain) and gain.max() > best:
                    best, choice = gain.max(), (f, int(gain.argmax()))
            if choice is None:
                step[rows] = nodes[here][4]
                return here
            f, k = choice
            low = binned[rows, f] <= k
            left, right = grow(rows[low], level + 1), grow(rows[~low], level + 1)
            nodes[here][:4] = [f, edges[f][k], left, right]
            return here

        grow(np.arange(len(y)), 0)
        score += step
        a = np.array(nodes)
        trees.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Trees(base, trees, 2.0)


#: Invented URLs outside of any rule, of the forms that block lists and directories hold. The rules
#: speak about few suffixes; these show both kinds under each.
LABELLED = [
    *(("block", u) for u in (f"http://{host}.{suffix}/{path}" for host, path in (
        ("best-casino-777", "play/slots?bonus=100&ref=9381"), ("cheap-meds-4u", "order?id=88213"), ("win-free-bets", "bet/now"), ("www.hot-date-24", "profile/99812?aff=31"),
        ("ads-click-track", "c?u=8123&s=7&k=aa91"), ("www.loan-fast-cash", "apply"), ("x7-q9-stream4", "watch/48213"), ("replica-watch-shop", "p/1-2-3"),
        ("m.spam-link-farm", "a/b/c/9912"), ("crypto-double-2x", "join?ref=7731"), ("free-iphone-win", "claim"), ("poker-bonus-88", "en/12"),
    ) for suffix in ("com", "org", "net", "info"))),
    *(("allow", u) for u in (f"http://{host}.{suffix}/{path}" for host, path in (
        ("www.library", "catalogue/8123"), ("gardening.example", "en/1570?page=2"), ("blog.mountains", "2019/04/walks"), ("m.citynews", "de/4410"),
        ("museum.example", "fr/visit#hours"), ("www.bakery.example", "recipes/rye"), ("docs.compiler", "manual/index.html?v=3"), ("weather", ""),
        ("m.recipes.example", "es/901?page=1&ref=x"), ("university", "research/papers/2021"), ("blog.trains.example", "en/77"), ("www.choir", "concerts"),
    ) for suffix in ("com", "org", "net", "info"))),
]


def train(rows: list, precision: float = 0.9, least_blocked: int = 20) -> Trees | None:
    """Trees from rows (features, verdict; listed: from the list; held: out of the learning part).

    Rows without a verdict play no part. The list weighs as much as the rules' rows, and then both
    verdicts weigh the same among the rows of a suffix. The held-out
    rows (a quarter, if they don't say) set the threshold: the lowest at which at least `precision`
    of what is blocked there is labelled so, by weight and among listed rows alone; if there is
    none, nothing is blocked. No rows blocked by a rule give no trees."""
    rows = [r for r in rows if r.verdict]
    listed = np.array([getattr(r, "listed", False) for r in rows], bool)
    x = np.array([r.features for r in rows], float)
    y = np.array([r.verdict == "block" for r in rows], float)
    if not (y > 0)[~listed].any():
        return None
    each = (~listed).sum() / max(1, listed.sum())
    weight = np.where(listed, each, 1.0)
    suffix = np.unique(x[:, -2:], axis=0, return_inverse=True)[1].reshape(-1)
    for g in np.unique(suffix) if listed.any() else ():  # a rule for all of a suffix doesn't say that the suffix is bad
        here = [(suffix == g) & (y == c) for c in (0, 1)]
        if here[0].any() and here[1].any():
            half = weight[suffix == g].sum() / 2
            for some in here:
                weight[some] *= half / weight[some].sum()
    held = np.array([getattr(r, "held", k % 4 == 3) for k, r in enumerate(rows)], bool)
    if held.all() or not held.any():
        held = np.arange(len(y)) % 4 == 3
    model = boost(x[~held], y[~held], weight[~held], least=max(10.0, each if listed.any() else 0.0))
    p, truth, w, known = model.probability(x[held]), y[held], weight[held], listed[held]
    for t in np.unique(p):
        hit = p >= t
        alone = truth[hit & known]
        if hit.sum() >= least_blocked and np.average(truth[hit], weights=w[hit]) >= precision and (not len(alone) or alone.mean() >= precision):
            model.threshold = float(t)
            break
    return model


_NEEDED = ("url", "host", "path", "pages", "hosts")


def _featured(batch: pa.RecordBatch) -> list[list[float]]:
    return [lexical(*row) for row in zip(*(batch.column(c).to_pylist() for c in _NEEDED))]


def _feature_batches(batches):
    kept = ["url", "verdict", "listed", "held"]
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(_featured(batch), pa.list_(pa.float64()))], [*kept, "features"])


def _judge_batches(batches, model):
    m: Trees | None = model.value
    for batch in batches:
        x = np.array(_featured(batch), float).reshape(batch.num_rows, len(FEATURES))
        p = m.probability(x) if m else np.zeros(len(x))
        blocked = p >= (m.threshold if m else 2.0)
        verdict = [v or ("block" if b else "allow") for v, b in zip(batch.column("verdict").to_pylist(), blocked.tolist())]
        new = {"verdict": pa.array(verdict, pa.string()), "probability": pa.array(p, pa.float64())}
        names = [c for c in batch.schema.names if c not in _NEEDED] + ["host", "path", "probability"]
        yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)


def judge(pages: DataFrame, rules: list[UrlRule], sample: int = 20_000, labelled: list[tuple[str, str]] = LABELLED, most_broadcast: int = 500_000) -> DataFrame:
    """page_id, rule, verdict, host, path, probability (of being blocked, by the trees) of each page.

    The trees learn from about `sample` different URLs with a rule's verdict, chosen by a hash, and
    from `labelled` (verdict, URL); suffixes are counted over all pages. A null URL, or one without ://,
    has an empty host and path and no rule. If no page is blocked by a rule the trees allow everything.
    Repeated rows come out repeated, no rows give no rows; the order of rows changes nothing.

    The counts of up to most_broadcast suffixes are broadcast, and pages stay where they are; with more,
    pages are joined by suffix, and those of a frequent one dealt to many tasks."""
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    name, verdict = first_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", name).withColumn("verdict", verdict).withColumn("suffix", F.substring_index("host", ".", -1))
    by_host = rows.groupBy("suffix", "host").agg(F.count("*").alias("n"))
    suffixes = cut(by_host.groupBy("suffix").agg(F.sum("n").cast("double").alias("pages"), F.count("*").cast("double").alias("hosts")))
    if suffixes.count() <= most_broadcast:
        suffixes = F.broadcast(suffixes)
        rows = rows.join(suffixes, "suffix").drop("suffix")
    else:
        n_pages = suffixes.agg(F.sum("pages").cast("long")).first()[0]
        rows = left_join_spread(rows, suffixes, "suffix", suffixes.select("suffix", F.col("pages").alias("n")), n_pages).drop("suffix")
    ruled = rows.where("verdict is not null")
    n = ruled.agg(F.approx_count_distinct("url").alias("n")).first().n
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(1 << 30))
    some = ruled.where(part(1) < int(min(1.0, sample / max(1, n)) * (1 << 30))).dropDuplicates(["url"]).withColumn("listed", F.lit(False))
    more = spark.createDataFrame(labelled, "verdict string, url string").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    more = more.withColumn("suffix", F.substring_index("host", ".", -1)).join(suffixes, "suffix", "left").fillna(0.0, ["pages", "hosts"]).withColumn("listed", F.lit(True))
    names = ["url", "host", "path", "pages", "hosts", "verdict", "listed"]
    rows_of = some.select(names).unionByName(more.select(names)).withColumn("held", part(2) % 4 == 3)
    learned = rows_of.mapInArrow(_feature_batches, "url string, verdict string, listed boolean, held boolean, features array<double>").collect()
    learned.sort(key=lambda r: (r.listed, r.url))
    model = spark.sparkContext.broadcast(train(learned))
    return rows.mapInArrow(partial(_judge_batches, model=model), "page_id long, rule string, verdict string, host string, path string, probability double")
