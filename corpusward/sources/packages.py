"""References to packages in manifests, imports and docs, and what a project resolves itself."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.detectors.supply_chain import entries, line_of
from corpusward.functions import names
from corpusward.operators.references import first_by, source_rank
from corpusward.operators.regexscan import scan
from corpusward.sources.commands import install_references, is_doc

MANIFEST_SECTIONS = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
# Fixed values.
JS_IMPORT = r"(?:import\s+(?:[\s\S]*?\s+from\s+)?|export\s+[\s\S]*?\s+from\s+|require\s*\(\s*|import\s*\(\s*)['\"][^'\"]+['\"]"
PY_FROM, PY_IMPORT = r"^\s*from\s+([A-Za-z_][\w.]*)\s+import", r"^\s*import\s+([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*)"
#: Distributions of imports that are named otherwise. Fixed values.
DISTRIBUTIONS = {
    "attr": "attrs", "bs4": "beautifulsoup4", "Bio": "biopython", "Crypto": "pycryptodome",
    "Cryptodome": "pycryptodomex", "cairo": "pycairo", "concurrent_log_handler": "concurrent-log-handler",
    "confluent_kafka": "confluent-kafka", "cpuinfo": "py-cpuinfo", "cv2": "opencv-python",
    "dateutil": "python-dateutil", "discord": "discord.py", "dns": "dnspython", "docx": "python-docx",
    "dotenv": "python-dotenv", "fitz": "PyMuPDF", "flask_cors": "Flask-Cors",
    "flask_jwt_extended": "Flask-JWT-Extended", "flask_login": "Flask-Login", "flask_migrate": "Flask-Migrate",
    "flask_sqlalchemy": "Flask-SQLAlchemy", "git": "GitPython", "github": "PyGithub", "gitlab": "python-gitlab",
    "gi": "PyGObject", "grpc": "grpcio", "grpc_tools": "grpcio-tools", "IPython": "ipython", "jose": "python-jose",
    "jwt": "PyJWT", "kafka": "kafka-python", "magic": "python-magic", "MySQLdb": "mysqlclient",
    "mpl_toolkits": "matplotlib", "multipart": "python-multipart", "nacl": "PyNaCl", "OpenGL": "PyOpenGL",
    "OpenSSL": "pyOpenSSL", "PIL": "Pillow", "pkg_resources": "setuptools", "pptx": "python-pptx",
    "psycopg2": "psycopg2-binary", "pythonjsonlogger": "python-json-logger",
    "requests_toolbelt": "requests-toolbelt", "serial": "pyserial", "skimage": "scikit-image",
    "sklearn": "scikit-learn", "slack_sdk": "slack-sdk", "slugify": "python-slugify", "socks": "PySocks",
    "telegram": "python-telegram-bot", "usb": "pyusb", "win32api": "pywin32", "win32com": "pywin32",
    "win32con": "pywin32", "win32file": "pywin32", "wx": "wxPython", "yaml": "PyYAML",
    "zoneinfo": "backports.zoneinfo",
}
#: Import roots that many distributions share. Fixed values.
SHARED_ROOTS = [
    "azure", "backports", "google", "jaraco", "mypy_extensions", "paste", "pkgutil", "repoze", "ruamel",
    "sphinxcontrib", "zc", "zope",
]
#: Bundler configurations whose aliases aren't evaluated. Fixed values.
BUNDLERS = [
    "vite.config.ts", "vite.config.js", "vite.config.mjs", "vite.config.cjs", "vite.config.mts",
    "webpack.config.js", "webpack.config.ts", "webpack.config.mjs", "webpack.config.cjs", "rspack.config.js",
    "rspack.config.ts", "rollup.config.js", "rollup.config.ts", "rollup.config.mjs",
]
ALIASES = r"resolve\s*:\s*\{[\s\S]{0,400}?alias\s*:|alias\s*:\s*\{|alias\s*:\s*\[|\.alias\s*="

_NAME = r"^([A-Za-z0-9][A-Za-z0-9._-]*)"
_COLUMNS = ["repo_id", "name", "ecosystem", "file", "line", "source", "specifier", "command", "phase"]


def _refs(rows: DataFrame, ecosystem: str, source: str, phase: int) -> DataFrame:
    new = {"ecosystem": F.lit(ecosystem), "source": F.lit(source), "phase": F.lit(phase), "file": F.col("path")}
    if "command" not in rows.columns:
        new["command"] = F.lit(None).cast("string")
    if "ecosystem" in rows.columns:
        del new["ecosystem"]
    return rows.withColumns(new).select(*_COLUMNS)


def _is_requirements(basename):
    return (basename == "requirements.txt") | basename.rlike(r"(?i)^requirements[-_.].+\.txt$")


def pyproject_dependencies(text: str) -> list[dict]:
    """name, evidence of the dependencies in the tables that list them; not a TOML parser, and a
    list ends at its first ]."""
    tables: dict[str, list[str]] = {}
    now = None
    for line in re.split(r"\r?\n", text):
        if re.match(r"\s*\[", line):
            head = re.match(r"\[([^\[\]]+)\]\s*$", line)
            now = head.group(1) if head and head.group(1) not in tables else None
            if now is not None:
                tables[now] = []
        elif now is not None:
            tables[now].append(line)
    block = lambda name: "\n".join(tables.get(name, []))
    listed = re.search(r"dependencies\s*=\s*\[(.*?)\]", block("project"), re.S)
    said = re.findall(r"[\"']([^\"']+)[\"']", (listed.group(1) if listed else "") + "\n" + block("project.optional-dependencies"))
    for table in ("tool.poetry.dependencies", "tool.poetry.dev-dependencies", "tool.poetry.group.dev.dependencies"):
        keys = re.findall(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*=", block(table))
        said += [k for k in keys if k.lower() != "python"]
    out, seen = [], set()
    for raw in said:
        m = re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", re.sub(r"^['\"]|['\"]$", "", raw.strip()))
        if m and m.group().lower() not in seen:
            seen.add(m.group().lower())
            out.append({"name": m.group(), "evidence": raw})
    return out


def json_without_comments(text: str) -> str:
    """JSON with comments and trailing commas taken out, strings left alone."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?(?:\*/|\Z)', lambda m: m.group(1) or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", kept, flags=re.S)


def alias_keys(text: str) -> list[str]:
    try:
        return [str(k) for k in (json.loads(json_without_comments(text)).get("compilerOptions") or {}).get("paths") or {}]
    except (ValueError, AttributeError):
        return []


def _array_udf(function, kind: str):
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: function(t or ""))

    return F.pandas_udf(apply, kind)


def package_references(files: DataFrame) -> DataFrame:
    """repo_id, name, ecosystem, file, line, source, specifier, command, phase: one row for each
    package of each repository, from its most trusted source; ties go to the first path and line."""
    files = files.where("in_package_walk and issue_code is null and text is not null").select("repo_id", "path", "basename", "text")
    base = F.col("basename")
    npm = entries(files.where(base == "package.json"), MANIFEST_SECTIONS)
    npm = npm.withColumn("name", names.registry_name(F.col("key"), F.when(F.col("is_string"), F.col("value")))).where("name is not null")
    npm = npm.withColumn("line", line_of(F.col("text"), F.concat(F.lit('"'), F.col("key"), F.lit('"')))).withColumn("specifier", F.col("name"))
    lines = lambda some: some.select("repo_id", "path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "said")).withColumn("line", F.col("pos") + 1)
    required = lines(files.where(_is_requirements(base))).withColumn("name", F.regexp_extract(F.trim("said"), _NAME, 1)).where("name <> ''").withColumn("specifier", F.col("name"))
    listed = files.where(base == "pyproject.toml").withColumn("d", F.explode(_array_udf(pyproject_dependencies, "array<struct<name:string,evidence:string>>")("text")))
    listed = listed.withColumn("line", F.coalesce(line_of(F.col("text"), F.col("d.evidence")), line_of(F.col("text"), F.col("d.name")))).withColumn("name", F.col("d.name")).withColumn("specifier", F.col("d.name"))
    js = scan(files.where(base.rlike(r"(?i)\.(?:m?js|cjs|jsx|tsx|ts)$") & ~base.endswith(".d.ts")), JS_IMPORT).withColumn("specifier", F.regexp_extract("match", r"['\"]([^'\"]+)['\"]$", 1))
    js = js.withColumn("name", names.package_of_specifier(F.col("specifier"))).where("name is not null and name <> ''")
    said = F.concat(F.filter(F.array(F.regexp_extract("said", PY_FROM, 1)), lambda x: x != ""), F.filter(F.split(F.regexp_extract("said", PY_IMPORT, 1), ","), lambda x: x != ""))
    py = lines(files.where(base.endswith(".py"))).withColumn("specifier", F.explode(F.transform(said, lambda x: F.get(F.split(F.trim(x), r"\."), F.lit(0)))))
    py = py.where(~F.col("specifier").isin(names.PYTHON_MODULES + SHARED_ROOTS))
    known = F.create_map(*[F.lit(x) for kv in DISTRIBUTIONS.items() for x in kv])
    py = py.withColumn("name", F.coalesce(F.try_element_at(known, F.col("specifier")), F.col("specifier")))
    docs = install_references(files.where(is_doc(base) & ~_is_requirements(base)), "repo_id", "path").withColumn("specifier", F.col("name"))
    every = [_refs(npm, "npm", "manifest", 0), _refs(required, "pypi", "manifest", 0), _refs(listed, "pypi", "manifest", 0), _refs(js, "npm", "import", 1), _refs(py, "pypi", "import", 1), _refs(docs, "", "docs", 2)]
    refs = reduce(lambda a, b: a.unionByName(b), every)
    refs = refs.withColumn("norm", names.normalize_name(F.col("name"), F.col("ecosystem")))
    return first_by(refs, ["repo_id", "ecosystem", "norm"], [-source_rank(F.col("source")), F.col("phase"), F.col("file"), F.col("line")])


def alias_patterns(files: DataFrame) -> DataFrame:
    """repo_id, pattern, resolver: of the root's package imports and of its first configuration with paths."""
    root = files.where("text is not null and path in ('package.json', 'tsconfig.json', 'jsconfig.json')")
    imports = entries(root.where("path = 'package.json'"), ["imports"]).select("repo_id", F.col("key").alias("pattern"), F.lit("package-imports").alias("resolver"))
    keys = root.where("path <> 'package.json'").select("repo_id", "path", _array_udf(alias_keys, "array<string>")("text").alias("keys")).where(F.size("keys") > 0)
    first = first_by(keys, ["repo_id"], [F.col("path") != "tsconfig.json"])
    return imports.unionByName(first.select("repo_id", F.explode("keys").alias("pattern"), F.lit("tsconfig-paths").alias("resolver")))


def workspace_names(files: DataFrame) -> DataFrame:
    """repo_id, name of the packages in the workspace folders of each repository."""
    here = files.where("text is not null and issue_code is null")
    root = here.where("path = 'package.json'").withColumn("_v", F.try_parse_json("text")).where("_v is not null")
    plain = F.try_variant_get("_v", "$.workspaces", "array<string>")
    globs = root.select("repo_id", F.explode(F.coalesce(plain, F.try_variant_get("_v", "$.workspaces.packages", "array<string>"))).alias("glob"))
    yaml = here.where("path = 'pnpm-workspace.yaml'").select("repo_id", F.regexp_extract("text", r"(?m)^packages\s*:\s*$((?:\r?\n(?:[ \t].*)?)*)", 1).alias("block"))
    listed = F.regexp_extract_all("block", F.lit(r"(?m)^\s*-\s+['\"]?([^'\"\r\n]+)['\"]?\s*$"), F.lit(1))
    globs = globs.unionByName(yaml.select("repo_id", F.explode(listed).alias("glob"))).distinct()
    part = lambda p: F.when(p == "**", F.lit("(?:[^/]+/)*")).when(p == "*", F.lit("[^/]+/")).otherwise(F.concat(F.lit("\\Q"), p, F.lit("\\E/")))
    regex = F.concat(F.lit("^"), F.array_join(F.transform(F.split(F.regexp_replace(F.replace("glob", F.lit("\\"), F.lit("/")), "/$", ""), "/"), part), ""), F.lit("package\\.json$"))
    manifests = here.where("basename = 'package.json'").select("repo_id", "path", F.try_variant_get(F.try_parse_json("text"), "$.name", "string").alias("name")).where("name is not null")
    met = manifests.join(globs.select("repo_id", regex.alias("regex")), "repo_id").where(F.expr("rlike(path, regex)"))
    return met.select("repo_id", "name").distinct()


def blind_repos(files: DataFrame) -> DataFrame:
    """repo_id, configs: repositories with bundler aliases that nothing here evaluates."""
    folder = F.regexp_extract("path", "^(.*?)/?[^/]*$", 1)
    named = F.col("basename").isin(BUNDLERS)
    configs = files.where(((folder == "") & named) | (folder.isin("config", "configs") & (named | F.col("basename").rlike(r"vite\.config\."))))
    return configs.where(F.col("text").rlike(ALIASES)).groupBy("repo_id").agg(F.sort_array(F.collect_set("path")).alias("configs"))
