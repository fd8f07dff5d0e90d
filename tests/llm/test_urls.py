import random

import numpy as np

from corpusward.llm import urls
from corpusward.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return host.translate({c: c + 32 for c in range(65, 91)}), rest[:stop]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


URLS = [None, "", "net/", "http://", "://net/", "HTTP://A.EXAMPLE.Net/en/x?q#f", "http://net", "http://net/", "http://internet/", "http://a.net?x=/en/", "http://x.org/fr/1", "http://x.org/fr", "https://example.com/de/?a=1&b=2", "https://example.com/DE/", "http://É.org/fr/", "a://b://c/d", "http://x.com/\nline#", "http://h.com/p?x://y", "http://" + "a" * 50_000 + ".net/"]


def test_parts_and_rules(spark):
    rng = random.Random(1)
    more = [f"http://{rng.choice(['a', 'b-c', 'www.d'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(999)}" for _ in range(400)]
    rows = [(i, u, "clash") for i, u in enumerate(URLS + more)] + [(None, URLS[5], "x"), (5, URLS[5], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = urls.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    source = dict((i, u) for i, u, _ in rows)
    for r in got:
        host, path = split(source[r.page_id])
        assert (r.host, r.path) == (host, path)
        want = rule(host, path)
        assert r.rule == (want.name if want else None)
        assert r.verdict == want.verdict if want else r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), URL_RULES).collect() == []
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    model = urls.boost(x[:2000], y[:2000], np.ones(2000))
    assert ((model.probability(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.97


def test_filter_blocks_what_is_alike():
    rng = random.Random(2)

    class Row:
        def __init__(self, features, verdict):
            self.features, self.verdict = features, verdict

    def features(bad):
        host = "".join(rng.choices("abc0123456789-" if bad else "abcdefghij", k=20)) + ".com"
        return urls.lexical(f"http://{host}/x", host, "/x", 5, 5)

    model = urls.train([Row(features(i % 3 == 0), "block" if i % 3 == 0 else "allow") for i in range(1500)])
    hit = [model.probability(np.array([features(bad)]))[0] >= model.threshold for bad in (True, False) for _ in range(100)]
    assert sum(hit[:100]) > 90 and sum(hit[100:]) < 10
    assert urls.train([Row(features(False), "allow") for _ in range(50)]) is None


def test_unlisted_urls_teach_nothing(spark):
    rng = random.Random(3)
    bad = lambda: "-".join("".join(rng.choices("abc0123456789", k=5)) for _ in range(4))
    good = lambda: "".join(rng.choices("abcdefghij", k=8))
    rules = [urls.UrlRule("block", "bad.net"), urls.UrlRule("allow", "good.net")]
    made = [f"http://{bad()}.bad.net/x" for _ in range(300)] + [f"http://{good()}.good.net/x" for _ in range(300)]
    made += [f"http://{bad()}.new.net/x" for _ in range(900)] + [f"http://{good()}.site.net/x" for _ in range(900)]
    made += [made[0]] * 1000  # one URL of a third of the rows
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()}
    assert sum(got[i] == "block" for i in range(600, 1500)) > 800
    assert sum(got[i] == "block" for i in range(1500, 2400)) < 90


def test_order_of_rows_changes_nothing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted(map(tuple, urls.judge(pages, URL_RULES).collect()))
    again = pages.repartition(7, "html").sortWithinPartitions("url")
    assert sorted(map(tuple, urls.judge(again, URL_RULES).collect())) == want
    assert sorted(map(tuple, urls.judge(again, URL_RULES, most_broadcast=0).collect())) == want
