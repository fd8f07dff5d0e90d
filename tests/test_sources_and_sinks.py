"""Sources that answer filters, git on executors, reports as files, policies as a table, resumable runs."""

import builtins
import json
import os
import subprocess
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringStartsWith

from corpusward import corpus, scan
from corpusward import policy as policies
from corpusward.__main__ import main, parser, with_options
from corpusward.detectors import crypto, ghost_deps
from corpusward.operators import scope
from corpusward.policy import Policy
from corpusward.schemas import FINDING, ISSUE, Tables
from corpusward.sinks import files, reports
from corpusward.sinks.rules import slug
from corpusward.sources import git, tree

FILES = {"package.json": "{}", "src/a.ts": "createCipher(a)", "src/b.py": "x = 1", "docs/long.md": "x" * 5000, ".env": "A=1", ".agent-trace/t.jsonl": "{}", "src/logo.png": "x"}


def write_files(root, given=FILES):
    for path, said in given.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(said)


def test_only_wanted_files_are_opened(tmp_path, monkeypatch):
    repos = {}
    for repo in ("one", "two"):
        write_files(tmp_path / repo)
        repos[repo] = str(tmp_path / repo)
    opened = []
    real = builtins.open
    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: (opened.append(os.path.relpath(p, tmp_path)), real(p, *a, **k))[1])

    def read(*filters):
        opened.clear()
        reader = tree.SourceTree({"repos": json.dumps(repos)}).reader(None)
        rest = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        return sorted(f"{r[0]}/{r[1]}" for r in rows), sorted(opened), rest

    everything = read()[0]
    assert everything == read()[1] and len(everything) == 14
    assert read(EqualTo(("basename",), "package.json")) == (["one/package.json", "two/package.json"], ["one/package.json", "two/package.json"], [])
    assert read(EqualTo(("repo_id",), "two"), In(("ext",), (".ts", ".py")))[:2] == (["two/src/a.ts", "two/src/b.py"],) * 2
    assert read(LessThanOrEqual(("size",), 100), StringStartsWith(("path",), "docs/"))[:2] == ([], [])
    assert read(EqualTo(("in_text_walk",), True), EqualTo(("repo_id",), "one"))[1] == ["one/.env", "one/docs/long.md", "one/package.json", "one/src/a.ts", "one/src/b.py"]
    left = [IsNotNull(("text",)), GreaterThan(("content",), b"")]
    assert read(*left)[2] == left and read(EqualTo(("path",), ".agent-trace/t.jsonl"))[1] == ["one/.agent-trace/t.jsonl", "two/.agent-trace/t.jsonl"]


def test_filters_reach_the_source(spark, tmp_path):
    write_files(tmp_path / "r")
    rows = tree.read_trees(spark, {"r": str(tmp_path / "r"), "q": str(tmp_path / "none")})
    some = rows.where((F.col("repo_id") == "r") & F.col("ext").isin(".ts", ".md") & (F.col("size") < 1000))
    assert [tuple(r) for r in some.select("path", "content").collect()] == [("src/a.ts", b"createCipher(a)")]
    assert rows.where("issue_code is not null").count() == 2 and rows.where("repo_id = 'r'").count() == 7


def _git(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)


def test_executors_ask_git(spark, tmp_path, monkeypatch):
    one, plain = tmp_path / "one", tmp_path / "plain"
    write_files(one, {"a.js": "1", "é b.js": "2", ".env": "A", ".env.local": "B", ".env.x": "C", ".gitignore": ".env*\n!.env.x\n"})
    write_files(plain, {".env": "A"})
    _git(one, "init", "-q")
    _git(one, "add", "-f", "a.js", ".env", ".gitignore")
    _git(one, "commit", "-q", "-m", "first\n\nMade-with: Cursor")
    (one / "a.js").write_text("changed")
    monkeypatch.setattr(subprocess, "run", lambda *a, **k: pytest.fail("git on the driver"))
    repos = {"one": str(one), "plain": str(plain)}
    assert {(r.repo_id, r.body.strip()) for r in git.commits(spark, repos).collect()} == {("one", "first\n\nMade-with: Cursor")}
    paths = spark.createDataFrame([("one", p) for p in (".env", ".env.local", ".env.x")] + [("plain", ".env")], "repo_id string, path string")
    assert {tuple(r) for r in git.env_files(spark, repos, paths).collect()} == {("one", ".env", True, True), ("one", ".env.local", False, True), ("one", ".env.x", False, False), ("plain", ".env", False, None)}
    changed = git.changed_files(spark, repos)
    assert {(r.repo_id, r.path, r.failed is None) for r in changed.collect()} == {("one", "a.js", True), ("one", "é b.js", True), ("one", ".env.x", True), ("plain", None, False)}
    with pytest.raises(ValueError, match="no git repository"):
        git.comparable(changed)
    assert git.comparable(git.changed_files(spark, {"one": str(one)}, "HEAD")).count() == 3


def findings_of(spark, rows):
    made = [(repo, f"d:{rule}:{file}", "d", severity, f"title {rule}", "why <b>", "do", file, line, 1, "e", None) for repo, rule, severity, file, line in rows]
    return spark.createDataFrame(made, FINDING)


@pytest.fixture(scope="module")
def result(spark):
    rows = [(f"r{k % 40}", f"x{k % 3}", ["critical", "high", "low", "info"][k % 4], None if k % 7 == 0 else f"./src/f{k}.ts", k) for k in range(400) if k % 40 != 5]
    repos = spark.createDataFrame([(f"r{k}",) for k in range(40)], "repo_id string")
    issues = spark.createDataFrame([(f"r{k % 40}", "d", "c", f"m{k}", f"src/f{k}.ts") for k in range(100)], ISSUE)
    stats = repos.withColumn("detector_id", F.lit("d")).withColumn("status", F.lit("ran")).withColumn("findings", F.lit(0)).withColumn("analysed", F.lit(1))
    return scan.Result(repos, findings_of(spark, rows), issues, stats)


def test_report_files(spark, result, tmp_path):
    """A file for each repository, those without findings too, the same as alone; nothing else stays."""
    gated = result.gated(Policy())
    rows = reports.file_rows(result, gated)
    for kind, name in (("sarif", "s.json"), ("html", "p.html"), ("badge", "b.svg")):
        files.write(rows, kind, str(tmp_path / name), True)
    assert sorted(os.listdir(tmp_path)) == sorted(f"{stem}-r{k}{end}" for k in range(40) for stem, end in (("s", ".json"), ("p", ".html"), ("b", ".svg")))
    scores = {r.repo_id: r.trust_score for r in gated.collect()}
    for repo in ("r3", "r5"):
        made = json.loads((tmp_path / f"s-{repo}.json").read_text())
        assert made == reports.sarif(result, repo) and (repo != "r5" or made["runs"][0]["results"] == [])
        assert (tmp_path / f"p-{repo}.html").read_text() == reports.page(result, repo, scores[repo])
        assert (tmp_path / f"b-{repo}.svg").read_text() == files.badge(scores[repo])
    one = json.loads((tmp_path / "s-r3.json").read_text())["runs"][0]
    assert [r["id"] for r in one["tool"]["driver"]["rules"]] == sorted({r["ruleId"] for r in one["results"]} | {r["id"] for r in one["tool"]["driver"]["rules"]})
    assert slug("a/b") != slug("a b") and slug("a-b") == "a-b"


def test_a_failed_write_leaves_nothing(spark, result, tmp_path):
    rows = reports.file_rows(result, result.gated(Policy()))
    broken = rows.withColumn("title", F.when(F.col("repo_id") == "r9", F.raise_error(F.lit("no"))).otherwise(F.col("title")))
    with pytest.raises(PySparkException):
        files.write(broken, "sarif", str(tmp_path / "s.json"), True)
    assert os.listdir(tmp_path) == []


def test_policies_are_a_table(spark, result):
    """What one policy after the other leaves and how it judges; the plan doesn't grow with their number."""
    kinds = [Policy(), Policy(90, ("critical",), True), Policy(ignore_detectors=("d",)), Policy(ignore_paths=("src/f1*.ts", "**/f2?.ts")), Policy(10, ("low", "high"), ignore_findings=("d:x1:./src/f25.ts",))]
    given = {f"r{k}": kinds[k % 5] for k in range(40)}
    together = scan.with_policy(result, given)
    judged = {r.repo_id: (r.reasons, r.passed, r.status) for r in together.gated(given).collect()}
    for k, policy in enumerate(kinds):
        mine = [r for r, p in given.items() if p is policy]
        only = lambda rows, mine=mine: sorted(map(repr, rows.where(F.col("repo_id").isin(mine)).collect()))
        alone = scan.with_policy(result, policy)
        assert only(together.findings) == only(alone.findings) and only(together.issues) == only(alone.issues), k
        assert {r.repo_id: (r.reasons, r.passed, r.status) for r in alone.gated(policy).collect() if r.repo_id in mine} == {r: judged[r] for r in mine}
    size = lambda p: together.findings.sparkSession and scope.without_ignored_by(result.findings, policies.table(spark, p))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(given) == size({f"r{k}": Policy(ignore_paths=(f"x{k}/**",)) for k in range(500)})


def test_terminal_text_of_all_repositories(spark, result):
    told = {r.repo_id: reports.terminal_text(r) for r in reports.terminals(result, result.gated(Policy()), most_issues=2).collect()}
    assert len(told) == 40 and "and 1 more" in told["r3"] and told["r5"].startswith("READY  trust score 100/100") and told["r0"].count("[critical]") == 5


def test_a_corpus_run_goes_on_where_it_stopped(spark, tmp_path):
    repos = {}
    for k in range(7):
        write_files(tmp_path / f"r{k}", {"a.js": "createDecipher(k)" if k % 2 else "ok()"})
        repos[f"r{k}"] = str(tmp_path / f"r{k}")
    repos["gone"] = str(tmp_path / "gone")
    out, tried = str(tmp_path / "out"), []

    def fragile(bad):
        def one(spark_, some):
            tried.append(sorted(some))
            if bad & {*some}:
                raise ValueError("breaks its batch")
            return scan.scan_folders(spark_, some, {"insecure-crypto": crypto.detect})

        return one

    rows = {r.repo_id: r for r in corpus.run_corpus(spark, repos, out, 4, fragile({"r3"})).collect()}
    assert {k for k, r in rows.items() if r.status == corpus.FAILED} == {"gone", "r3"} and len(rows) == 8
    assert "breaks" in rows["r3"].error and "enumerate" in rows["gone"].error and rows["r1"].trust_score == 75
    assert {r.repo_id for r in corpus.found_rows(spark, out).collect()} == {"r1", "r5"}
    scan.scan_folders(spark, {"r1": repos["r1"]}, {"insecure-crypto": crypto.detect}).findings.withColumn("batch", F.lit("stopped")).write.mode("append").partitionBy("batch").parquet(f"{out}/findings")
    tried.clear()
    corpus.run_corpus(spark, repos, out, 4, fragile(set()))
    assert tried == [["gone", "r3"]] and sorted(r.repo_id for r in corpus.found_rows(spark, out).collect()) == ["r1", "r3", "r5"]
    report = {r.status: (r.scanned, r.affected) for r in corpus.corpus_report(spark, out).collect()}
    assert report == {corpus.SCANNED: (7, 0), corpus.FAILED: (1, 0)}
    assert main([repos["r0"], repos["r1"], "--corpus", str(tmp_path / "new"), "--only", "insecure-crypto", "--batch", "1"]) == 0


def test_options_of_detectors():
    args = parser().parse_args(["--min-age-days", "3", "--registry-ttl", "1", "--no-entropy"])
    made = with_options(scan.select(["ghost-deps", "secrets", "insecure-crypto"]), args)
    assert made["ghost-deps"].keywords == {"min_age_days": 3.0, "ttl_hours": 1.0} and made["secrets"].keywords == {"entropy": False} and made["insecure-crypto"] is crypto.detect


def test_registry_answers_expire(spark):
    refs = spark.createDataFrame([("npm", "a"), ("npm", "b"), ("npm", "c")], "ecosystem string, norm string")
    seen = [("npm", "A ", datetime(2025, 1, 9, 12), True, 5), ("npm", "a", datetime(2025, 1, 9, 18), False, 6), ("npm", "b", datetime(2025, 1, 5), True, 7), ("npm", "a", datetime(2025, 2, 1), True, 8)]
    registry = spark.createDataFrame([(e, n, at, x, None, d) for e, n, at, x, d in seen], "ecosystem string, name string, fetched_at timestamp, exists boolean, created_at timestamp, weekly_downloads long")
    tables = Tables(spark.range(0), spark.range(0), registry, now=F.lit("2025-01-10 00:00:00").cast("timestamp"))
    assert {(r.norm, r.exists, r.weekly_downloads) for r in ghost_deps.looked_up(refs, tables).collect()} == {("a", False, 6), ("b", None, None), ("c", None, None)}
    assert {(r.norm, r.exists) for r in ghost_deps.looked_up(refs, tables, 24 * 30).collect()} == {("a", False), ("b", True), ("c", None)}
