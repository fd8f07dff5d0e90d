"""Operators against brute force and properties."""

import math
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusward.functions import names, text
from corpusward.operators import ranges, references, regexscan, registry, scope, scoring, similar
from corpusward.sources.commands import installed_by, npm_name, pypi_name


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def runs(lines):
    out = []
    for x in sorted(lines):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(x) for x in out]


def test_ranges_against_lines(spark):
    rng = random.Random(3)
    rows, base, cut = [], {}, {}
    for key in range(40):
        for kind in ("b", "c"):
            for _ in range(rng.randrange(6)):
                a = rng.randrange(1, 60)
                b = a + rng.randrange(0, 12)
                rows.append((key, kind, a, b))
                (base if kind == "b" else cut).setdefault(key, set()).update(range(a, b + 1))
    df = spark.createDataFrame(rows, "key int, kind string, start long, end long")
    b, c = df.where("kind = 'b'"), df.where("kind = 'c'")
    merged = sorted(map(tuple, ranges.merge(b, "key").select("key", "start", "end").collect()))
    assert merged == sorted((k, *r) for k, lines in base.items() for r in runs(lines))
    left = sorted(map(tuple, ranges.subtract(b, c, "key").select("key", "start", "end").collect()))
    assert left == sorted((k, *r) for k, lines in base.items() for r in runs(lines - cut.get(k, set())))


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    known = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(40)]
    some = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(60)] + ["", "é", "reqct"]
    got = {tuple(r) for r in similar.similar_pairs(spark.createDataFrame([(x,) for x in some], "name string"), spark.createDataFrame([(x,) for x in known], "known string")).collect()}
    want = {(a, b, d) for a in some for b in known if 1 <= (d := edit_distance(a, b)) <= (2 if len(a) >= 6 else 1)}
    assert got == want


def test_a_key_of_many_ranges_is_swept_in_parts(spark, monkeypatch):
    rng = random.Random(15)
    one = lambda key, most, n: [(key, s := rng.randrange(1, most), s + int(rng.paretovariate(0.7))) for _ in range(n)]
    base, cut_ = one("hot", 4000, 600) + one(None, 900, 300) + one("cold", 50, 8), one("hot", 4000, 200) + one(None, 900, 60) + one("cold", 50, 2)
    schema = "key string, start long, end long"

    def runs(lines):
        out = []
        for x in sorted(lines):
            if out and x == out[-1][1] + 1:
                out[-1][1] = x
            else:
                out.append([x, x])
        return out

    lines = lambda rows, key: {x for k, s, e in rows if k == key for x in range(s, e + 1)}
    base = [(k, s, min(e, 9000)) for k, s, e in base]
    cut_ = [(k, s, min(e, 9000)) for k, s, e in cut_]
    want = sorted((str(k), *r) for k in ("hot", None, "cold") for r in runs(lines(base, k)))
    less = sorted((str(k), *r) for k in ("hot", None, "cold") for r in runs(lines(base, k) - lines(cut_, k)))
    frames = [spark.createDataFrame(x, schema) for x in (base, cut_)]
    for rows, hot_keys in ((1 << 20, 1000), (40, 1000), (7, 0)):
        monkeypatch.setattr(ranges, "ROWS", rows)
        monkeypatch.setattr(ranges, "HOT_KEYS", hot_keys)
        assert sorted((str(r.key), r.start, r.end) for r in ranges.merge(frames[0], "key").collect()) == want
        assert sorted((str(r.key), r.start, r.end) for r in ranges.subtract(*frames, "key").collect()) == less
    hot = ranges._hot(frames[0], ["key"])
    parted = ranges._parted(frames[0].select("key", "start").distinct(), ["key"], "start", hot).groupBy("key", "_part").count()
    assert max(r["count"] for r in parted.collect()) < 20 and parted.where("key = 'hot'").count() > 20


def test_registry_as_of(spark):
    rng = random.Random(16)
    when = lambda h: datetime(2025, 1, 1) + timedelta(minutes=round(60 * h))
    seen = [("npm", rng.choice("abc"), when(rng.uniform(0, 200)), rng.choice([True, False, None]), k) for k in range(60)]
    seen += [("npm", "a", None, True, 99), (None, "a", when(5), True, 98), ("npm", "a", when(30), True, 7), ("npm", "a", when(30), True, 5)]
    asked = [("npm", rng.choice("abcd"), when(rng.uniform(-10, 240))) for _ in range(200)] + [("npm", "a", when(30)), ("npm", "a", None), (None, "a", when(6)), ("npm", "a", when(54)), ("npm", "a", when(30))]
    observations = spark.createDataFrame(seen, "ecosystem string, name string, fetched_at timestamp, exists boolean, downloads int")
    refs = spark.createDataFrame(asked, "ecosystem string, name string, scanned_at timestamp")

    def by_hand(eco, name, at, ttl):
        if at is None or eco is None:
            return None, None
        known = [x for x in seen if x[:2] == (eco, name) and x[2] and x[3] is not None and x[2] <= at]
        best = max((x[2] for x in known), default=None)
        if best is None or at - best > timedelta(hours=ttl):
            return None, None
        return min(((x[3], x[4]) for x in known if x[2] == best))

    for ttl in (24, 3):
        made = registry.as_of(refs, observations, ["ecosystem", "name"], "scanned_at", ttl)
        assert made.columns == ["ecosystem", "name", "scanned_at", "fetched_at", "exists", "downloads"]
        got = Counter((r.ecosystem, r.name, r.scanned_at, r.exists, r.downloads) for r in made.collect())
        assert got == Counter((*a, *by_hand(*a, ttl)) for a in asked)
    releases = spark.createDataFrame([("a", when(3)), ("a", when(2)), ("a", None), ("b", None)], "name string, released_at timestamp")
    assert [tuple(r) for r in registry.earliest_release(releases, "name").collect()] == [("a", when(2))]


def test_long_names(spark):
    """Names with long parts in common, and some that are longer than any known one."""
    rng = random.Random(14)
    stem = "".join(rng.choices("ab", k=60))

    def changed(x):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(x))
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "c" + x[k:], x[:k] + "c" + x[k + 1 :]])
        return x

    known = [changed(stem[: rng.randrange(28, 60)]) for _ in range(30)]
    some = [changed(k) for k in known] + [changed(stem) for _ in range(20)]
    got = {tuple(r) for r in similar.similar_pairs(spark.createDataFrame([(x,) for x in some], "name string"), spark.createDataFrame([(x,) for x in known], "known string")).collect()}
    assert got == {(a, b, d) for a in some for b in known if 1 <= (d := edit_distance(a, b)) <= 2} and got
    long, lodash = spark.createDataFrame([("x" * 10_000,), (None,)], "name string"), spark.createDataFrame([("lodash",), (None,)], "known string")
    similar.similar_pairs(long, lodash).collect()
    began = time.time()
    assert similar.similar_pairs(long, lodash).collect() == [] and time.time() - began < 20
    also = lodash.unionByName(spark.createDataFrame([("x" * 9_999,)], "known string"))
    began = time.time()
    assert [r.distance for r in similar.similar_pairs(long, also).collect()] == [1] and time.time() - began < 20


def test_nearest_takes_the_first_of_equals(spark):
    known = spark.createDataFrame([("lodash", 0), ("lodasx", 1), ("react", 2)], "known string, ord int")
    names_ = spark.createDataFrame([("lodas",), ("lodasy",), ("react",), ("zzz",)], "name string")
    assert {tuple(r) for r in similar.nearest(names_, known).collect()} == {("lodas", "lodash", 1), ("lodasy", "lodash", 1)}


def test_scan_is_finditer(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["ab", "x", "\n", "\r\n", "a\nb", " "], k=40)) for _ in range(60)] + ["", "ab", "\n"]
    pattern = r"a\s?b|x+"
    got = regexscan.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), pattern).select("i", "line", "match").collect()
    want = [(i, t[: m.start()].count("\n") + 1, m.group()) for i, t in enumerate(texts) for m in re.finditer(pattern, t)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_scan_takes_time_by_text_and_matches(spark):
    text = "token = a; createHash('md5') " * 100_000
    began = time.time()
    found = list(regexscan.found_in(text, {"a": regexscan.compiled(r"createHash\('md5'\)")}, regexscan.compiled(r"\btoken\b")))
    assert time.time() - began < 2 and len(found) == 100_000 and all(f[2:] == (1, True) for f in found)
    lines = text.replace("; ", ";\n")
    began = time.time()
    found = list(regexscan.found_in(lines, {"a": regexscan.compiled(r"createHash\('md5'\)")}))
    assert time.time() - began < 2 and [f[2] for f in found] == list(range(2, 100_002))
    files = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, "no")], "i int, text string")
    assert regexscan.scan_all(files, {"a": r"createHash", "b": r"\bmd5\b"}).groupBy("i", "rule").count().orderBy("rule").collect() == [(0, "a", 100_000), (0, "b", 100_000)]


def test_patterns_mean_what_they_mean_in_the_jvm(spark):
    """Dots, classes, escapes and flags, against the built-in functions."""
    texts = ["a.b\rc\r\nd", "x\u2028y.z", "[.]\\.", "\u212a K k \u017f S s", "\u0663 3", "a\x0bb\x85c", "É é"]
    for pattern in (r".+", r"[.]", r"\.", r"(?i)k|s", r"\d+", r"\s", r"[^\].]+", r"(?i)é", r"\w+"):
        got = regexscan.scan(spark.createDataFrame([(t,) for t in texts], "text string"), pattern).select("text", "match").collect()
        rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, rows)), pattern


def test_near_is_told_by_lines(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices(["hit\nhit", "hit", "Word", "\n", "sword", " "], k=12)) for _ in range(200)]
    for t in texts:
        for _, match, line, near in regexscan.found_in(t, {"": re.compile(r"hit\s?hit|hit")}, re.compile(r"\bWord\b")):
            lines = t.split("\n")[max(0, line - 2) : line + match.count("\n")]
            assert near == bool(re.search(r"\bWord\b", "\n".join(lines)))


def test_entropy_and_masks(spark):
    rng = random.Random(6)
    values = ["", "aabbccdd", "a", "日本日"] + ["".join(rng.choices("abcdefXYZ019-.*$", k=30)) for _ in range(50)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.shannon_entropy(F.col("v")).alias("h"), text.masked(F.col("v")).alias("m")).collect()
    for r in rows:
        want = -sum(n / len(r.v) * math.log2(n / len(r.v)) for n in Counter(r.v).values()) if r.v else 0
        assert abs(r.h - want) < 1e-9
        assert r.m == ("****" if len(r.v) <= 8 else r.v[:4] + "…" + r.v[-4:])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/.", max_size=8), st.text(alphabet="ab*?/", max_size=6))
def test_globs(path, glob):
    def fits(p, g):
        if not g:
            return not p
        if g.startswith("**"):
            return any(fits(p[i:], g[2:]) for i in range(len(p) + 1))
        if g[0] == "*":
            return any(fits(p[i:], g[1:]) for i in range(len(p) + 1) if "/" not in p[:i])
        return bool(p) and (g[0] == p[0] or g[0] == "?" and p[0] != "/") and fits(p[1:], g[1:])

    pattern = text.glob_pattern(glob).replace(r"\z", r"\Z")
    assert bool(re.search(pattern, path, re.S)) == fits(path, re.sub(r"^\./", "", glob))


def test_names(spark):
    cases = {"./x": None, "../x": None, "fs": None, "node:test": None, "#db/x": "#db", "@s/n/x": "@s/n", "@/lib": "@/lib", "@s": None, "a/b": "a", "lodash": "lodash", "C:\\x": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", names.package_of_specifier(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in rows} == cases
    specs = {"^1": "k", "git+https://x": None, "npm:real@2": "real", "npm:@s/n@1": "@s/n", "workspace:*": None, "../x": None, None: "k", "npm:": None}
    rows = spark.createDataFrame([("k", s) for s in specs], "k string, s string").select("s", names.registry_name(F.col("k"), F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in rows} == specs
    patterns = [("@a/*", "@a/b", True), ("@a/*", "@a/", True), ("a*z", "az", False), ("a*z", "abz", True), ("x", "x", True), ("x", "xy", False), ("*", "q", True)]
    rows = spark.createDataFrame([(p, s) for p, s, _ in patterns], "p string, s string").select("p", "s", names.matches_pattern(F.col("p"), F.col("s")).alias("m")).collect()
    assert [tuple(r) for r in rows] == patterns


def test_install_commands():
    assert installed_by("npm install --save lodash@4 ./local @s/p@next -r x") == ("npm", ["lodash", "@s/p"])
    assert installed_by("npx create-thing my-app") == ("npm", ["create-thing"]) and installed_by("npx <name>") == ("npm", [None])
    assert installed_by("pip install -r requirements.txt flask[async]>=2 your-package") == ("pypi", ["flask"])
    assert installed_by("uv pip install a") == ("pypi", ["a"]) and installed_by("uv add b") == ("pypi", ["b"]) and installed_by("poetry add c") == ("pypi", ["c"])
    assert installed_by("npm run build") is None and installed_by("echo npm install x") is None and installed_by("") is None
    assert npm_name("https://x/y.tgz") is None and npm_name("1.2.3") is None and pypi_name("a==1") == "a"


def test_scores_and_scope(spark):
    repos = spark.createDataFrame([("a",), ("b",)], "repo_id string")
    found = spark.createDataFrame([("a", "critical"), ("a", "critical"), ("a", "low"), ("x", "high"), ("a", "odd")], "repo_id string, severity string")
    assert {tuple(r) for r in scoring.trust_scores(repos, found, "repo_id").collect()} == {("a", 48), ("b", 100)}
    issues = spark.createDataFrame([(None,), ("src",), ("src/a.py",), ("lib",), (".",), ("sr",)], "file string")
    changed = spark.createDataFrame([("src/a.py",)], "path string")
    assert sorted(str(r.file) for r in scope.issues_in_changed(issues, changed).collect()) == [".", "None", "src", "src/a.py"]


def test_first_by(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 0)], "k int, v string, o int")
    assert {r.v for r in references.first_by(rows, ["k"], [F.col("o")]).collect()} == {"a", "c"}


def test_changed_paths_belong_to_their_repository(spark):
    changed = spark.createDataFrame([("a", "src/x.py")], "repo_id string, path string")
    found = spark.createDataFrame([("a", "./src/x.py"), ("b", "src/x.py"), ("a", None)], "repo_id string, file string")
    assert [tuple(r) for r in scope.in_changed(found, changed).collect()] == [("a", "./src/x.py")]
    issues = spark.createDataFrame([("a", "src"), ("b", "src"), ("b", ".")], "repo_id string, file string")
    assert sorted(map(tuple, scope.issues_in_changed(issues, changed).collect())) == [("a", "src"), ("b", ".")]
