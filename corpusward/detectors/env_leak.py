"""Environment files that git doesn't ignore, or that it tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.schemas import Found, Tables, findings

ID = "env-leak"
TEMPLATE = r"(?i)^\.env\.(?:example|sample|template)(?:\.|$)"


def _rule_regex(pattern):
    """A regular expression for one line of .gitignore, without its ! and leading /."""
    quoted = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    quoted = F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\0")), F.lit("*"), F.lit("[^/]*")), F.lit("\0"), F.lit(".*"))
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("?"), F.lit("[^/]")), F.lit("$"))


def locally_ignored(envs, files):
    """repo_id, path, ignored by the last matching line of the repository's own .gitignore."""
    lines = files.where("path = '.gitignore' and text is not null").select("repo_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).withColumn("line", F.trim("raw")).where("line <> '' and line not like '#%'")
    negated = F.col("line").startswith("!")
    bare = F.regexp_replace(F.replace(F.trim(F.when(negated, F.substring("line", 2, 10_000)).otherwise(F.col("line"))), F.lit("\\"), F.lit("/")), "^/", "")
    rules = lines.select("repo_id", "pos", negated.alias("negated"), bare.alias("pattern"))
    rules = rules.withColumn("regex", _rule_regex(F.col("pattern")))
    met = envs.select("repo_id", "path", "basename").join(rules, "repo_id")
    met = met.where(F.expr("rlike(CASE WHEN contains(pattern, '/') THEN path ELSE basename END, regex)"))
    return met.groupBy("repo_id", "path").agg(F.max_by(~F.col("negated"), "pos").alias("ignored"))


def env_paths(files: DataFrame) -> DataFrame:
    """The environment files among files, without templates."""
    name = F.col("basename")
    return files.where("in_text_walk and issue_code is null").where(((name == ".env") | name.startswith(".env.")) & ~name.rlike(TEMPLATE))


def detect(tables: Tables) -> Found:
    envs = env_paths(tables.files)
    state = envs.join(locally_ignored(envs, tables.files).withColumnRenamed("ignored", "by_rules"), ["repo_id", "path"], "left")
    if tables.git_files is not None:
        state = state.join(tables.git_files.select("repo_id", "path", "tracked", F.col("ignored").alias("by_git")), ["repo_id", "path"], "left")
    else:
        state = state.withColumn("tracked", F.lit(False)).withColumn("by_git", F.lit(None).cast("boolean"))
    state = state.withColumn("ignored", F.coalesce("by_git", "by_rules", F.lit(False))).withColumn("tracked", F.coalesce("tracked", F.lit(False)))
    open_ = state.where("not ignored or tracked")
    said = F.when(F.col("tracked"), "tracked by git").otherwise("not ignored by git")
    made = findings(
        open_,
        id=F.concat(F.lit(f"{ID}:present:"), F.col("path")),
        detector_id=ID,
        severity="critical",
        title=F.concat(F.col("path"), F.lit(" is "), said),
        explanation=F.when(F.col("tracked"), "Git has the file in its history; every credential in it counts as known.").otherwise("The next commit could take the file along, with the credentials in it."),
        fix_prompt=F.when(F.col("tracked"), "Remove the file from the index and the history, ignore it, and replace its credentials.").otherwise("Add a rule for it to .gitignore, and keep only a template in git."),
        file=F.col("path"),
        evidence=said,
        metadata=F.to_json(F.struct("tracked", "ignored")),
    )
    return Found(made, analysed=envs.select("repo_id", "path"))
