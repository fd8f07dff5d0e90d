"""Secrets: provider token formats, and high-entropy values bound to secret-like names."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from corpusward.functions.text import PLACEHOLDER, is_placeholder, masked, shannon_entropy
from corpusward.operators.regexscan import scan_all
from corpusward.schemas import Found, Tables, findings

ID = "secrets"
#: A secret-like name bound to a quoted value. Fixed value.
NAMED = r"(?i)(?:^|[\s.{,])(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|passwd|password|auth[_-]?token|access[_-]?token|refresh[_-]?token|private[_-]?key|client[_-]?secret|credentials?)\s*[:=]\s*[\"'`][A-Za-z0-9+/=_\-.]{20,}[\"'`]"
SHORTEST, LEAST_ENTROPY = 24, 4.2
_BOUND = ""  # stands for NAMED among the rules of formats
#: Published formats of providers' tokens: rule, pattern.
FORMATS = [
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})\b"),
    ("gitlab-token", r"\bglpat-[A-Za-z0-9_\-]{20,}\b"),
    ("slack-token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("stripe-key", r"\b[rs]k_live_[A-Za-z0-9]{16,}\b"),
    ("google-api-key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("sendgrid-key", r"\bSG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}\b"),
    ("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    ("connection-string", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:@/'\"]+:[^\s@/'\"]+@[^\s'\"]+"),
]


#: What a rule's level means. Fixed values.
SEVERITIES, OTHER_SEVERITY = {"error": "critical", "warning": "high"}, "medium"


def severity_of(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, v) for k, v in SEVERITIES.items()], F.lit(OTHER_SEVERITY))


def label(rule: Column) -> Column:
    """A rule's name as words, without the part before its last slash."""
    return F.replace(F.substring_index(rule, "/", -1), F.lit("-"), F.lit(" "))


def detect(tables: Tables, entropy: bool = True, shortest: int = SHORTEST, least_entropy: float = LEAST_ENTROPY, formats: dict[str, str] | None = None, levels: dict[str, str] | None = None, named: str = NAMED, placeholder: str | None = PLACEHOLDER) -> Found:
    """formats: patterns by rule, in place of FORMATS. levels: error, warning or info by rule; those that
    aren't named are errors. named: a pattern in place of NAMED, which ends with the quoted value.
    placeholder: of values that are no secrets; None if only few different characters tell."""
    files = tables.files.where("in_text_walk and issue_code is null and text is not null")
    level = F.coalesce(*[F.when(F.col("rule") == k, F.lit(v)) for k, v in (levels or {}).items()], F.lit("error"))
    patterns = dict(FORMATS) if formats is None else formats
    rows = scan_all(files, patterns | ({_BOUND: named} if entropy else {})).select("repo_id", "path", "match", "line", "rule")
    bound = F.col("rule") == _BOUND
    if entropy:  # of a line's bound values the first that looks like a secret counts, if no format is met there
        value = F.regexp_extract("match", r"[\"'`]([^\"'`]+)[\"'`]$", 1)
        of_line = Window.partitionBy("repo_id", "path", "line")
        rows = rows.withColumn("value", F.when(bound, value)).withColumn("bits", F.when(bound, shannon_entropy(F.col("value"))))
        likely = bound & (F.length("value") >= shortest) & ~is_placeholder(F.col("value"), placeholder) & (F.col("bits") >= least_entropy)
        rows = rows.withColumn("likely", F.coalesce(likely, F.lit(False))).withColumn("met", F.bool_or(~bound).over(of_line))
        rows = rows.withColumn("place", F.row_number().over(of_line.orderBy(F.col("likely").desc(), "value"))).where(~bound | (F.col("likely") & ~F.col("met") & (F.col("place") == 1)))
    else:
        rows = rows.withColumn("value", F.lit("")).withColumn("bits", F.lit(0.0))
    either = lambda named, format_: F.when(bound, named).otherwise(format_)
    said = lambda named, format_: either(F.lit(named), F.lit(format_))
    bits = F.format_string("%.2f", "bits")
    hits = findings(
        rows,
        id=either(F.concat_ws(":", F.lit(f"{ID}:entropy"), "path", "line"), F.concat_ws(":", F.lit(ID), "rule", "path", "line")),
        detector_id=ID,
        severity=either(F.lit("high"), severity_of(level)),
        title=either(F.lit("High-entropy value under a secret-like name"), F.concat(F.lit("Credential in the source: "), label(F.col("rule")))),
        explanation=either(F.concat(F.lit("A value of "), bits, F.lit(" bits a character is bound to a name like a secret's.")), F.lit("Text in a provider's credential format stands in a file.")),
        fix_prompt=said("If it is a secret, revoke it and read it from the environment.", "Revoke the credential, take it out of the file and its history, and read it from the environment."),
        file=F.col("path"),
        evidence=masked(either(F.col("value"), F.col("match"))),
        metadata=either(F.to_json(F.struct(F.round("bits", 2).alias("entropy"))), F.to_json(F.struct(F.col("rule").alias("ruleId")))),
    )
    return Found(hits, analysed=files.select("repo_id", "path"))
