"""References to packages that a registry doesn't have, or that only look like known ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions import names
from corpusward.functions.text import days_between
from corpusward.operators import references, registry, similar
from corpusward.schemas import Found, Tables, findings
from corpusward.sources.packages import alias_patterns, blind_repos, package_references, workspace_names

ID = "ghost-deps"
# Widely used names, in the order that settles ties. Fixed values.
POPULAR = {
    "npm": [
        "react", "react-dom", "next", "vue", "angular", "svelte", "express", "fastify", "koa", "hono", "lodash",
        "underscore", "axios", "node-fetch", "got", "chalk", "debug", "commander", "yargs", "dotenv", "zod", "joi",
        "yup", "uuid", "nanoid", "moment", "dayjs", "date-fns", "rxjs", "redux", "zustand", "mobx", "webpack",
        "vite", "esbuild", "typescript", "ts-node", "eslint", "prettier", "jest", "vitest", "mocha", "chai",
        "sinon", "mongoose", "prisma", "sequelize", "typeorm", "pg", "mysql2", "redis", "ioredis", "socket.io",
        "ws", "jsonwebtoken", "bcrypt", "bcryptjs", "passport", "cors", "helmet", "body-parser", "multer",
        "nodemailer", "aws-sdk", "@aws-sdk/client-s3", "firebase", "stripe", "graphql", "apollo-server",
        "@apollo/client", "tailwindcss", "postcss", "autoprefixer", "sass", "styled-components", "emotion",
        "three", "chart.js", "d3", "cheerio", "puppeteer", "playwright", "sharp", "fs-extra", "glob", "rimraf",
        "cross-env", "concurrently", "nodemon", "pm2", "winston", "pino", "morgan", "express-validator",
        "class-validator", "reflect-metadata", "inversify", "tsyringe",
    ],
    "pypi": [
        "requests", "httpx", "urllib3", "aiohttp", "flask", "django", "fastapi", "starlette", "uvicorn",
        "gunicorn", "numpy", "pandas", "scipy", "scikit-learn", "matplotlib", "seaborn", "pillow", "opencv-python",
        "tensorflow", "torch", "transformers", "openai", "anthropic", "langchain", "pydantic", "sqlalchemy",
        "alembic", "psycopg2-binary", "asyncpg", "redis", "celery", "boto3", "botocore", "beautifulsoup4", "lxml",
        "pyyaml", "toml", "click", "typer", "rich", "pytest", "black", "ruff", "mypy", "poetry", "pipenv",
        "virtualenv", "python-dotenv", "cryptography", "pyjwt", "passlib", "bcrypt", "httpcore", "anyio",
        "tenacity", "tqdm", "jinja2", "markupsafe", "werkzeug", "itsdangerous",
    ],
}


def resolved(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs that a registry has to know, with blind (an alias may stand behind an import) and
    resolvers; what the project resolves itself goes."""
    spec, npm = F.col("specifier"), F.col("ecosystem") == "npm"
    own = names.is_local_specifier(spec) | spec.startswith("@/") | spec.startswith("~/") | spec.startswith("#")
    builtin = (npm & names.is_runtime_module(spec)) | (~npm & F.col("name").isin(names.PYTHON_MODULES))
    left = refs.where(~own & ~builtin)
    aliased = references.aliased(left, alias_patterns(files), "repo_id").select("repo_id", "specifier").distinct()
    left = left.join(aliased, ["repo_id", "specifier"], "left_anti")
    local = workspace_names(files).withColumn("ecosystem", F.lit("npm"))
    left = left.join(local, ["repo_id", "ecosystem", "name"], "left_anti").join(blind_repos(files), "repo_id", "left")
    blind = F.col("configs").isNotNull() & (F.col("source") == "import")
    return left.withColumn("blind", blind).withColumn("resolvers", F.when(blind, "blind-bundler-alias").otherwise("external-registry"))


def near_popular(refs: DataFrame) -> DataFrame:
    """ecosystem, norm, typo_of: the nearest widely used name; names that are such have none."""
    rows = [(ecosystem, name, i) for ecosystem, popular in POPULAR.items() for i, name in enumerate(popular)]
    known = refs.sparkSession.createDataFrame(rows, "ecosystem string, known string, ord int")
    found = similar.nearest(refs.select("ecosystem", F.col("norm").alias("name")), known, keys=("ecosystem",))
    return found.select("ecosystem", F.col("name").alias("norm"), F.col("candidate").alias("typo_of"))


def looked_up(refs: DataFrame, tables: Tables, ttl_hours: float = registry.TTL_HOURS) -> DataFrame:
    """refs with what the registry knows of them: of a table of observations (with fetched_at) the last
    before the scan, if it isn't older than ttl_hours; of a table without times its row."""
    spark, key = refs.sparkSession, ["ecosystem", "norm"]
    known = tables.registry if tables.registry is not None else spark.createDataFrame([], "ecosystem string, name string, exists boolean, created_at timestamp, weekly_downloads long")
    known = known.withColumn("norm", names.normalize_name(F.col("name"), F.col("ecosystem"))).drop("name")
    if "fetched_at" in known.columns:
        return registry.as_of(refs.withColumn("_now", tables.now), known, key, "_now", ttl_hours).drop("_now", "fetched_at")
    order = [~F.coalesce("exists", F.lit(False)), F.col("exists").isNull(), F.col("created_at"), F.col("weekly_downloads")]
    return references.with_registry(refs, references.first_by(known, key, order), key)


def detect(tables: Tables, ttl_hours: float = registry.TTL_HOURS, **thresholds) -> Found:
    """thresholds: min_age_days, min_downloads, mature_days of references.decisions."""
    refs = resolved(package_references(tables.files), tables.files).persist(StorageLevel.MEMORY_AND_DISK)  # names, findings and issues all read them
    looked = looked_up(refs.join(near_popular(refs), ["ecosystem", "norm"], "left"), tables, ttl_hours).persist(StorageLevel.MEMORY_AND_DISK)
    age = days_between(F.col("created_at"), tables.now)
    flags = references.decisions(F.col("exists"), F.col("blind"), F.col("typo_of").isNotNull(), age, F.col("weekly_downloads"), F.col("ecosystem") == "npm", **thresholds)
    rows = looked.withColumn("flag", F.explode(flags))
    title = (
        F.when(F.col("flag.kind").startswith("nonexistent"), F.concat(F.lit("Package does not exist: "), F.col("name")))
        .when(F.col("flag.kind") == "typosquat", F.concat(F.lit("Name close to "), F.col("typo_of"), F.lit(": "), F.col("name")))
        .when(F.col("flag.kind") == "very-new", F.concat(F.lit("Very new package: "), F.col("name")))
        .when(F.col("flag.kind") == "low-downloads", F.concat(F.lit("Hardly downloaded package: "), F.col("name")))
        .otherwise(F.concat(F.lit("Unverified name, possibly an unresolved alias: "), F.col("name")))
    )
    made = findings(
        rows,
        id=F.concat_ws(":", F.lit(ID), F.col("flag.kind"), F.col("ecosystem"), F.col("norm")),
        detector_id=ID,
        severity=F.col("flag.severity"),
        title=title,
        explanation=F.concat(F.lit("A name nobody has published can be registered by anyone who sees it. Resolvers applied: "), F.col("resolvers"), F.lit(".")),
        fix_prompt=F.concat(F.lit("Check every reference to "), F.col("name"), F.lit(" and replace it with the package that is meant.")),
        evidence=F.col("name"),
        metadata=F.to_json(F.struct(F.col("name").alias("package"), "ecosystem", "source", "specifier", "command", F.col("typo_of").alias("typosquatOf"), "blind", F.array("resolvers").alias("resolversApplied"))),
    )
    unknown = looked.where("exists is null")
    issues = unknown.select("repo_id", F.lit(ID).alias("detector_id"), F.lit("registry-lookup-unknown").alias("code"), F.concat(F.lit("Could not verify "), F.col("ecosystem"), F.lit(' package "'), F.col("name"), F.lit('".')).alias("message"), "file")
    return Found(made, issues, tables.files.where("in_package_walk and issue_code is null").select("repo_id", "path"), kept=[refs, looked])
