"""Reports as files, one for each repository, written by executors.

A data source with a transaction: tasks write under a folder of the run's own, a file only counts
when the driver has moved it to its place, and a run that fails leaves nothing. Rows come sorted by
repository and finding, so a task holds one row at a time."""

from __future__ import annotations

import html
import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusward.operators.scoring import BANDS, WEIGHTS
from corpusward.sinks.rules import LEVELS, rule_id, slug

#: Columns of a finding that reports show.
SHOWN = ["id", "detector_id", "severity", "title", "explanation", "fix_prompt", "file", "line", "col"]


def sarif_text(rows: Iterable[Row]) -> Iterator[str]:
    """SARIF 2.1.0 of a repository's findings, in pieces; those without a file are informational signals."""
    yield '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"results": ['
    rules, signals, first = {}, [], True
    for f in rows:
        rule = {"id": f.rule, "shortDescription": {"text": f.title}, "fullDescription": {"text": f.explanation}}
        rules[f.rule] = min(rules.get(f.rule, ((f.id, f.file or "", f.line or 0), rule)), ((f.id, f.file or "", f.line or 0), rule), key=lambda x: x[0])
        if not f.file:
            signals.append({"id": f.id, "message": f.title})
            continue
        region = {"startLine": max(1, f.line or 1), "startColumn": max(1, f.col or 1)}
        place = {"physicalLocation": {"artifactLocation": {"uri": f.file}, "region": region}}
        yield ("" if first else ", ") + json.dumps({"ruleId": f.rule, "level": LEVELS.get(f.severity, "note"), "message": {"text": f"{f.title}. {f.explanation}"}, "locations": [place]}, ensure_ascii=False)
        first = False
    named = [rules[k][1] for k in sorted(rules)]
    yield '], "tool": ' + json.dumps({"driver": {"name": "corpusward", "rules": named}}, ensure_ascii=False)
    yield ', "properties": ' + json.dumps({"informationalSignals": signals}, ensure_ascii=False) + "}]}\n"


def page_text(repo_id: str, score: int, rows: Iterable[Row]) -> Iterator[str]:
    """All findings of one repository as HTML, in pieces."""
    filters = " ".join(f'<label><input type="checkbox" checked onchange="document.querySelectorAll(\'tr.{s}\').forEach(r=>r.hidden=!this.checked)">{s}</label>' for s in WEIGHTS)
    yield f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(repo_id)}</title><h1>{html.escape(repo_id)}: {score}/100</h1><p>{filters}</p><table>"
    for f in rows:
        place = html.escape(f.file or "") + (f":{f.line}" if f.line else "")
        yield f'<tr class="{f.severity}"><td>{f.severity}</td><td>{html.escape(f.title)}</td><td>{place}</td><td>{html.escape(f.explanation)}<br><em>{html.escape(f.fix_prompt)}</em></td></tr>'
    yield "</table>"


def badge(score: int) -> str:
    """An SVG badge in the colour of the score's band."""
    name, colour = next((b[1], b[2]) for b in BANDS if score >= b[0])
    hues = {"brightgreen": "#4c1", "green": "#97ca00", "yellow": "#dfb317", "orange": "#fe7d37", "red": "#e05d44"}
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="150" height="20" role="img" aria-label="trust score: {score} {name}"><rect width="80" height="20" fill="#555"/><rect x="80" width="70" height="20" fill="{hues[colour]}"/><g fill="#fff" font-family="Verdana,sans-serif" font-size="11" text-anchor="middle"><text x="40" y="14">trust score</text><text x="115" y="14">{score} {name}</text></g></svg>'


def _text(kind: str, rows: Iterator[Row]) -> Iterator[str]:
    """A repository's report. A repository without findings has one row, which has no id."""
    head = next(rows)
    found = (r for r in chain([head], rows) if r.id is not None)
    return {"sarif": lambda: sarif_text(found), "html": lambda: page_text(head.repo_id, head.trust_score, found), "badge": lambda: iter([badge(head.trust_score)])}[kind]()


def place_of(path: str, repo_id: str, several: bool) -> str:
    """path itself, or where there are several repositories a path for each of them. A name that had to
    be changed bears a hash, so that no two are the same."""
    stem, ending = os.path.splitext(path)
    return f"{stem}-{slug(repo_id)}{ending}" if several else path


class _Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.kind, self.path, self.several = options["kind"], options["path"], options["several"] == "true"
        self.run = os.path.join(os.path.dirname(os.path.abspath(self.path)), f"_temporary-{uuid.uuid4().hex}")
        os.makedirs(self.run)  # not by tasks: one that still runs when the others have failed must not bring it back

    def write(self, rows: Iterator[Row]) -> _Written:
        moves = []
        for repo, some in groupby(rows, key=lambda r: r.repo_id):
            here = os.path.join(self.run, uuid.uuid4().hex)  # a task that is run again takes another name
            with open(here, "w", encoding="utf-8") as f:
                f.writelines(_text(self.kind, some))
            moves.append((here, place_of(self.path, repo, self.several)))
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        for here, there in (m for told in messages if told for m in told.moves):
            os.replace(here, there)
        shutil.rmtree(self.run, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.run, ignore_errors=True)


class ReportFiles(DataSource):
    """Options kind (sarif, html or badge), path and several. The folder of path is one that the driver
    and all executors see."""

    @classmethod
    def name(cls):
        return "reportfiles"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def report_rows(sorted_findings: DataFrame, gated: DataFrame, order: list) -> DataFrame:
    """The rows of report files: the findings of each repository of `gated` in their order and with its
    score, or one row without a finding; the rows of a repository are in one partition, together."""
    shown = sorted_findings.select("repo_id", *SHOWN, rule_id().alias("rule"))
    made = gated.select("repo_id", "trust_score").join(shown, "repo_id", "left")
    return made.repartition("repo_id").sortWithinPartitions("repo_id", *order, "id")


def write(rows: DataFrame, kind: str, path: str, several: bool) -> None:
    """rows: of report_rows."""
    rows.sparkSession.dataSource.register(ReportFiles)
    rows.write.format("reportfiles").option("kind", kind).option("path", path).option("several", str(several).lower()).mode("append").save()
