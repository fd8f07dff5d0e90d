"""python -m corpusward: scan folders, report, and exit 0 (passed), 1 (policy failed) or 2 (error)."""

from __future__ import annotations

import argparse
import os
import sys
from functools import partial

from corpusward import __version__
from corpusward import policy as policies


def _score(text: str) -> int:
    value = int(text)
    if not 0 <= value <= 100:
        raise argparse.ArgumentTypeError("an integer from 0 to 100 is needed")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusward", description="Scans source repositories.", allow_abbrev=False)
    p.add_argument("folders", nargs="*", default=["."])
    p.add_argument("--version", "-V", action="version", version=__version__)
    p.add_argument("--repos", help="a text file: one folder a line, # begins a comment")
    p.add_argument("--limit", type=int, help="only so many of the folders")
    p.add_argument("--only", help="detectors to run, with commas")
    p.add_argument("--skip", help="detectors to leave out, with commas")
    p.add_argument("--ghosts", action="store_true", help="only package references")
    p.add_argument("--registry", help="a Parquet table: ecosystem, name, exists, created_at, weekly_downloads")
    p.add_argument("--offline", action="store_true", help="without the registry: every name is unknown")
    p.add_argument("--changed", "--since", dest="since", nargs="?", const="", help="only what changed, since this commit if one is given")
    p.add_argument("--policy", help="a policy file for all folders; else each folder's own")
    p.add_argument("--fail-below", "--min-score", dest="min_score", type=_score, metavar="0..100")
    p.add_argument("--fail-on", help="severities, with commas")
    p.add_argument("--fail-on-incomplete", dest="fail_on_incomplete", action="store_true", default=None)
    p.add_argument("--allow-incomplete", dest="fail_on_incomplete", action="store_false")
    p.add_argument("--sarif", nargs="?", const="corpusward.sarif")
    p.add_argument("--html", nargs="?", const="corpusward.html")
    p.add_argument("--no-html", dest="html", action="store_const", const=None)
    p.add_argument("--badge", nargs="?", const="corpusward.svg")
    p.add_argument("--no-badge", dest="badge", action="store_const", const=None)
    p.add_argument("--out", help="a folder for the findings as Parquet")
    p.add_argument("--report", help="a folder for the figures over all folders, as JSON")
    p.add_argument("--corpus", help="a folder that keeps the results of many repositories: only those that it lacks are scanned")
    p.add_argument("--batch", type=int, default=200, help="repositories that --corpus scans together")
    p.add_argument("--min-age-days", type=float, help="a package younger than this is very new")
    p.add_argument("--min-downloads", type=int, help="fewer downloads a week are few")
    p.add_argument("--mature-days", type=float, help="from this age on few downloads don't count")
    p.add_argument("--registry-ttl", dest="ttl_hours", type=float, help="hours that an answer in a registry table with fetched_at counts")
    p.add_argument("--no-entropy", dest="entropy", action="store_const", const=False, help="only credentials in a provider's format")
    p.add_argument("--least-entropy", type=float, help="bits a character of a value that counts as a secret")
    p.add_argument("--verbose", "--debug", "-v", action="store_true")
    return p


def repo_folders(folders: list[str], listed: str | None = None, limit: int | None = None) -> dict[str, str]:
    """Ids and absolute folders, each folder once. The id is the folder's name; further folders of that
    name get a number."""
    if listed:
        with open(listed, encoding="utf-8") as f:
            folders = [x for x in (line.partition("#")[0].strip() for line in f) if x]
    found: dict[str, str] = {}
    for folder in dict.fromkeys(os.path.abspath(f) for f in folders):
        name = id_ = os.path.basename(folder) or "root"
        n = 1
        while id_ in found:
            n += 1
            id_ = f"{name}-{n}"
        found[id_] = folder
    return dict(list(found.items())[:limit])


#: Arguments that detectors take, by detector.
OPTIONS = {"ghost-deps": ["min_age_days", "min_downloads", "mature_days", "ttl_hours"], "secrets": ["entropy", "least_entropy"]}


def with_options(detectors: dict, args: argparse.Namespace) -> dict:
    """detectors with the options that were given."""
    given = {d: {k: v for k in OPTIONS.get(d, []) if (v := getattr(args, k)) is not None} for d in detectors}
    return {d: partial(f, **given[d]) if given[d] else f for d, f in detectors.items()}


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from corpusward import scan
    from corpusward.sinks import files, reports
    from corpusward.sources import git

    words = lambda s: [x.strip() for x in s.split(",") if x.strip()] if s else []
    chosen = scan.select(["ghost-deps"] if args.ghosts else words(args.only), words(args.skip))
    chosen = with_options(chosen, args)
    folders = repo_folders(args.folders, args.repos, args.limit)
    if not folders:
        raise ValueError("There is no folder to scan.")
    over = {"minimum_score": args.min_score, "fail_on": tuple(words(args.fail_on)) or None, "fail_on_incomplete": args.fail_on_incomplete}
    rules = {repo: policies.load(root, args.policy).merged(**over) for repo, root in folders.items()}
    spark = SparkSession.builder.appName("corpusward").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    registry = spark.read.parquet(args.registry) if args.registry and not args.offline else None
    if args.corpus:
        from corpusward.corpus import FAILED, corpus_report, run_corpus

        rows = run_corpus(spark, folders, args.corpus, max(1, args.batch), lambda s, some: scan.scan_folders(s, some, chosen, registry, git.commits(s, some) if "ai-presence" in chosen else None))
        corpus_report(spark, args.corpus).orderBy("status").show(truncate=False)
        return 0 if rows.where(rows.status == FAILED).isEmpty() else 1
    result = scan.scan_folders(spark, folders, chosen, registry, git.commits(spark, folders) if "ai-presence" in chosen else None)
    if args.since is not None:
        result = scan.changed_only(result, git.comparable(git.changed_files(spark, folders, args.since or None)))
    result = scan.with_policy(result, rules)
    result.findings, result.issues = result.findings.persist(), result.issues.persist()
    gated = result.gated(rules).persist()
    for row in reports.terminals(result, gated).orderBy("repo_id").toLocalIterator():
        print(f"== {row.repo_id}\n{reports.terminal_text(row)}")
    wanted = {kind: path for kind, path in (("sarif", args.sarif), ("html", args.html), ("badge", args.badge)) if path}
    for kind, path in wanted.items():
        files.write(reports.file_rows(result, gated), kind, path, len(folders) > 1)
    if args.verbose:
        result.stats.orderBy("repo_id", "detector_id").show(1000, False)
        reports.patterns(result.findings).show(1000, False)
    if args.out:
        result.findings.write.mode("overwrite").partitionBy("repo_id").parquet(args.out)
    if args.report:
        reports.corpus(result).write.mode("overwrite").json(args.report)
    return 0 if gated.where("not passed").isEmpty() else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
