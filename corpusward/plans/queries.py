"""The operators on the star-schema tables, each with SQL for the same rows.

Stand-ins: o_orderpriority for severities, c_mktsegment for detectors, p_name for package names,
event_type for sources of references and for contributors of line ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward import scan
from corpusward.functions import names, text
from corpusward.operators import ranges, references, regexscan, registry, scope, scoring, similar
from corpusward.sinks import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SEVERITY_SQL = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END"
_WEIGHT_SQL = "CASE left(o_orderpriority, 1) WHEN '1' THEN 25 WHEN '2' THEN 12 WHEN '3' THEN 5 WHEN '4' THEN 2 ELSE 0 END"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _severity(priority: Column) -> Column:
    first = F.left(priority, F.lit(1))
    return F.when(first == "1", "critical").when(first == "2", "high").when(first == "3", "medium").when(first == "4", "low").otherwise("info")


def _findings(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", _severity(orders.o_orderpriority).alias("severity"))


def _minutes(ts: Column, kind: str) -> Column:
    """Whole minutes since the start of 2024, whatever the session's time zone."""
    if kind == "timestamp_ntz":
        return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', {ts})") / 60_000_000)
    return F.floor((F.unix_micros(F.col(ts)) - 1_704_067_200_000_000) / 60_000_000)


def _event_ranges(spark, folder) -> DataFrame:
    events = table(spark, folder, "events")
    start = _minutes("ts", dict(events.dtypes)["ts"]).cast("long")
    return events.select("user_id", "event_type", start.alias("start"), (start + F.floor(F.col("value") / 10)).cast("long").alias("end"))


_RANGES_SQL = "SELECT user_id, event_type, CAST(floor(epoch_us(ts - TIMESTAMP '2024-01-01' + TIMESTAMP '1970-01-01') / 60000000.0) AS BIGINT) AS s, CAST(floor(epoch_us(ts - TIMESTAMP '2024-01-01' + TIMESTAMP '1970-01-01') / 60000000.0) AS BIGINT) + CAST(floor(value / 10) AS BIGINT) AS e FROM events"


@query(
    f"""SELECT c_custkey, CAST(greatest(0, least(100, 100 - coalesce(sum({_WEIGHT_SQL}) FILTER (WHERE o_orderkey IS NOT NULL), 0))) AS BIGINT) AS trust_score
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""
)
def trust_score_by_customer(spark, folder):
    return scoring.trust_scores(table(spark, folder, "customer").select("c_custkey"), _findings(spark, folder), "c_custkey")


@query(
    """SELECT n_nationkey, n_name, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium, count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS low, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS info
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name"""
)
def severity_counts_by_nation(spark, folder):
    by_nation = _findings(spark, folder).join(table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    nation = table(spark, folder, "nation")
    return scoring.severity_counts(nation, by_nation, "n_nationkey").join(nation.select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT c_mktsegment, count(*) AS findings FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def findings_by_detector(spark, folder):
    rows = _findings(spark, folder).join(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return scan.counted(rows, "c_mktsegment").select("c_mktsegment", F.col("n").alias("findings"))


@query(
    f"""WITH s AS ({ORACLES["trust_score_by_customer"]})
SELECT CASE WHEN trust_score >= 90 THEN 'excellent' WHEN trust_score >= 70 THEN 'good' WHEN trust_score >= 50 THEN 'fair' WHEN trust_score >= 30 THEN 'poor' ELSE 'critical' END AS band,
count(*) AS customers, min(trust_score) AS lowest FROM s GROUP BY 1"""
)
def score_bands(spark, folder):
    scores = trust_score_by_customer(spark, folder)
    return scores.groupBy(scoring.band(F.col("trust_score")).alias("band")).agg(F.count("*").alias("customers"), F.min("trust_score").alias("lowest"))


@query(
    f"""WITH c AS (
  SELECT c_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
    count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium, coalesce(sum({_WEIGHT_SQL}) FILTER (WHERE o_orderkey IS NOT NULL), 0) AS w
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
s AS (SELECT *, greatest(0, least(100, 100 - w)) AS score FROM c)
SELECT c_custkey, CAST(score AS BIGINT) AS trust_score, score >= 85 AND critical = 0 AS passed,
  concat_ws('; ', CASE WHEN score < 85 THEN 'Trust Score ' || CAST(score AS BIGINT) || '/100 is below the 85/100 threshold' END,
    CASE WHEN critical > 0 THEN critical || ' critical-severity ' || CASE WHEN critical = 1 THEN 'finding' ELSE 'findings' END END) AS reasons,
  CASE WHEN critical > 0 OR score < 85 THEN 'BLOCKED' WHEN high > 0 OR medium > 0 THEN 'REVIEW' ELSE 'READY' END AS status
FROM s"""
)
def policy_gate(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    found = _findings(spark, folder)
    counted = scoring.severity_counts(customers, found, "c_custkey").join(scoring.trust_scores(customers, found, "c_custkey"), "c_custkey").withColumn("issues", F.lit(0))
    judged = scoring.gate(counted, 85, ("critical",))
    return judged.select("c_custkey", "trust_score", "passed", F.array_join("reasons", "; ").alias("reasons"), "status")


@query(
    f"""SELECT o_orderkey, {_SEVERITY_SQL} AS severity, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY left(o_orderpriority, 1), list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD'], c_mktsegment) NULLS LAST, o_orderkey LIMIT 5"""
)
def priority_topk(spark, folder):
    stand_in = F.when(F.col("c_mktsegment") == "MACHINERY", "ghost-deps").when(F.col("c_mktsegment") == "BUILDING", "secrets").when(F.col("c_mktsegment") == "HOUSEHOLD", "env-leak").otherwise("")
    rows = _findings(spark, folder).join(table(spark, folder, "customer"), "c_custkey")
    order = scoring.finding_order(F.col("severity"), stand_in, F.lit(None).cast("string"), F.col("o_orderkey"))
    return rows.orderBy(*order).limit(5).select("o_orderkey", "severity", "c_mktsegment")


@query(
    """SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END DESC, event_id) AS n FROM events) WHERE n = 1"""
)
def dedupe_by_source_priority(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    source = F.when(F.col("event_type") == "purchase", "manifest").when(F.col("event_type") == "signup", "docs").when(F.col("event_type") == "view", "import").otherwise("")
    return references.first_by(events, ["user_id"], [-references.source_rank(source), F.col("event_id")])


@query(
    f"""WITH r AS ({_RANGES_SQL}), lines AS (SELECT DISTINCT user_id, unnest(range(s, e + 1)) AS line FROM r),
runs AS (SELECT user_id, line, line - row_number() OVER (PARTITION BY user_id ORDER BY line) AS island FROM lines)
SELECT user_id, min(line) AS range_start, max(line) AS range_end FROM runs GROUP BY user_id, island"""
)
def merge_line_ranges(spark, folder):
    return ranges.merge(_event_ranges(spark, folder), "user_id").select("user_id", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


@query(
    f"""WITH r AS ({_RANGES_SQL}), ai AS (SELECT DISTINCT user_id, unnest(range(s, e + 1)) AS line FROM r WHERE event_type = 'click'),
human AS (SELECT DISTINCT user_id, unnest(range(s, e + 1)) AS line FROM r WHERE event_type = 'view'),
kept AS (SELECT user_id, line FROM ai ANTI JOIN human USING (user_id, line)),
runs AS (SELECT user_id, line, line - row_number() OVER (PARTITION BY user_id ORDER BY line) AS island FROM kept)
SELECT user_id, min(line) AS range_start, max(line) AS range_end FROM runs GROUP BY user_id, island"""
)
def subtract_reviewed_ranges(spark, folder):
    r = _event_ranges(spark, folder)
    left = ranges.subtract(r.where("event_type = 'click'"), r.where("event_type = 'view'"), "user_id")
    return left.select("user_id", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


@query(
    f"""WITH r AS ({_RANGES_SQL}), ai AS (SELECT DISTINCT user_id, unnest(range(s, e + 1)) AS line FROM r WHERE event_type = 'click'),
n AS (SELECT user_id, count(*) AS lines FROM ai GROUP BY user_id)
SELECT user_id, lines, CASE WHEN lines >= 80 THEN 'medium' WHEN lines >= 20 THEN 'low' ELSE 'info' END AS severity FROM n"""
)
def range_line_counts(spark, folder):
    merged = ranges.merge(_event_ranges(spark, folder).where("event_type = 'click'"), "user_id")
    n = merged.groupBy("user_id").agg(ranges.line_count(F.col("start"), F.col("end")).alias("lines"))
    return n.withColumn("severity", F.when(F.col("lines") >= 80, "medium").when(F.col("lines") >= 20, "low").otherwise("info"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def changed_scope(spark, folder):
    orders = table(spark, folder, "orders").withColumn("file", F.concat(F.lit("./"), F.col("o_orderkey").cast("string")))
    changed = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("path"))
    return scope.in_changed(orders, changed).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE') AND o_orderkey NOT IN (1, 2, 3) AND NOT (c_name LIKE '%7')")
def ignore_scope(spark, folder):
    rows = _findings(spark, folder).join(table(spark, folder, "customer"), "c_custkey")
    rows = rows.select("o_orderkey", "c_mktsegment", F.col("c_mktsegment").alias("detector_id"), F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("file"))
    return scope.without_ignored(rows, ["BUILDING", "FURNITURE"], ["1", "2", "3"], ["*7"]).select("o_orderkey", "c_mktsegment")


@query(
    """WITH registry AS (SELECT l_partkey, count(*) AS uses, max(l_quantity) >= 50 AS known FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey)
SELECT p_partkey, known AS exists_there, coalesce(uses, 0) AS uses, CASE WHEN known IS NULL THEN 'unknown' WHEN known THEN 'found' ELSE 'missing' END AS state
FROM part LEFT JOIN registry ON l_partkey = p_partkey"""
)
def registry_left_join(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'A'")
    registry = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"), (F.max("l_quantity") >= 50).alias("exists_there"))
    refs = references.with_registry(table(spark, folder, "part").select("p_partkey"), registry, ["p_partkey"])
    state = F.when(F.col("exists_there").isNull(), "unknown").when(F.col("exists_there"), "found").otherwise("missing")
    return refs.select("p_partkey", "exists_there", F.coalesce("uses", F.lit(0)).alias("uses"), state.alias("state"))


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS name, b.p_name AS candidate, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM n a, n b
WHERE levenshtein(a.p_name, b.p_name) BETWEEN 1 AND CASE WHEN length(a.p_name) >= 6 THEN 2 ELSE 1 END"""
)
def typosquat_pairs(spark, folder):
    names_ = table(spark, folder, "part").select(F.col("p_name").alias("name"))
    return similar.similar_pairs(names_, names_.select(F.col("name").alias("known")))


_DECIDED = """SELECT p_partkey, p_size % 5 = 0 AS blind, p_brand IN ('Brand#1', 'Brand#2') AS typo, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 3 > 0 END AS known,
CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 5.0 END AS age, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_retailprice AS BIGINT) - 850 END AS downloads FROM part"""


@query(
    f"""WITH d AS ({_DECIDED}), f AS (
  SELECT p_partkey, CASE WHEN known IS NULL AND blind THEN 'ambiguous-blind:high' WHEN known = FALSE AND typo THEN 'nonexistent-typosquat:critical' WHEN known = FALSE AND blind THEN 'nonexistent-blind:high' WHEN known = FALSE THEN 'nonexistent:critical'
    WHEN known AND typo AND (coalesce(age < 180, FALSE) OR coalesce(downloads < 100, FALSE)) THEN 'typosquat:critical' END AS one,
    CASE WHEN known AND age < 14 THEN 'very-new:medium' END AS new, CASE WHEN known AND downloads < 100 AND age < 180 THEN 'low-downloads:low' END AS rare FROM d)
SELECT p_partkey, coalesce(one, concat_ws(',', new, rare)) AS flags FROM f"""
)
def package_decision_table(spark, folder):
    key = F.col("p_partkey")
    exists = F.when(key % 7 == 0, F.lit(None).cast("boolean")).otherwise(key % 3 > 0)
    age = F.when(key % 11 != 0, F.col("p_size") * 5.0)
    downloads = F.when(key % 13 != 0, F.round("p_retailprice").cast("long") - 850)
    made = references.decisions(exists, F.col("p_size") % 5 == 0, F.col("p_brand").isin("Brand#1", "Brand#2"), age, downloads, F.lit(True))
    flags = F.array_join(F.transform(made, lambda d: F.concat(d["kind"], F.lit(":"), d["severity"])), ",")
    return table(spark, folder, "part").select("p_partkey", flags.alias("flags"))


@query("SELECT p_partkey, lower(trim(p_brand || '_' || p_name)) AS npm_name, regexp_replace(lower(trim(p_brand || '_.' || p_name)), '[-_.]+', '-', 'g') AS pypi_name FROM part")
def normalize_names(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        names.normalize_name(F.concat_ws("_", "p_brand", "p_name"), F.lit("npm")).alias("npm_name"),
        names.normalize_name(F.concat_ws("_.", "p_brand", "p_name"), F.lit("pypi")).alias("pypi_name"),
    )


_TOKEN = 'token = "([0-9a-f]{40})"'


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract(text, '{_TOKEN}', 1) AS v FROM documents WHERE regexp_matches(text, '{_TOKEN}')),
c AS (SELECT doc_id, v, unnest(string_split(v, '')) AS ch FROM t), n AS (SELECT doc_id, v, ch, count(*) / 40.0 AS p FROM c GROUP BY doc_id, v, ch)
SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy, v[1:4] || '…' || v[37:40] AS masked FROM n GROUP BY doc_id, v"""
)
def token_entropy(spark, folder):
    value = F.regexp_extract("text", _TOKEN, 1)
    rows = table(spark, folder, "documents").where(F.col("text").rlike(_TOKEN)).select("doc_id", value.alias("v"))
    return rows.select("doc_id", F.round(text.shannon_entropy(F.col("v")), 6).alias("entropy"), text.masked(F.col("v")).alias("masked"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}', 1)) AS v FROM documents), m AS (SELECT doc_id, v, count(*) AS times FROM t GROUP BY ALL),
c AS (SELECT doc_id, v, times, unnest(string_split(v, '')) AS ch FROM m), n AS (SELECT doc_id, v, times, ch, count(*) / 40.0 AS p FROM c GROUP BY ALL)
SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy, v[1:4] || '…' || v[37:40] AS masked, times FROM n GROUP BY doc_id, v, times"""
)
def every_token_entropy(spark, folder):
    """As token_entropy, of every token of a text and not only of its first."""
    docs = table(spark, folder, "documents").where(F.col("text").rlike(_TOKEN))
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(1))).alias("v")).groupBy("doc_id", "v").agg(F.count("*").alias("times"))
    return rows.select("doc_id", F.round(text.shannon_entropy(F.col("v")), 6).alias("entropy"), text.masked(F.col("v")).alias("masked"), "times")

@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
m AS (SELECT doc_id, line, unnest(regexp_extract_all(s, 'Released under the|All rights reserved')) AS matched FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, matched, count(*) AS times FROM m GROUP BY ALL"""
)
def license_lines(spark, folder):
    found = regexscan.scan(table(spark, folder, "documents").select("doc_id", "text"), "Released under the|All rights reserved")
    return found.groupBy("doc_id", "line", F.col("match").alias("matched")).agg(F.count("*").alias("times"))


@query(
    r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS s, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line FROM pages)
SELECT page_id, CAST(line AS INTEGER) AS line, unnest(regexp_extract_all(s, '\btrack\(\s*\d+\s*\)')) AS matched FROM l"""
)
def script_calls(spark, folder):
    found = regexscan.scan(table(spark, folder, "pages").select("page_id", "html"), r"\btrack\(\s*\d+\s*\)", "html")
    return found.select("page_id", "line", F.col("match").alias("matched"))


@query(
    r"""SELECT page_id, url, regexp_full_match(url, 'https://[^/]*/en/.*') AS english, regexp_full_match(url, '.*[.]html') AS static_page, regexp_full_match(url, 'http.?://.*/[^/]') AS short_path FROM pages"""
)
def path_globs(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", "url", text.in_globs(url, ["https://*/en/**"]).alias("english"), text.in_globs(url, ["**.html"]).alias("static_page"), text.in_globs(url, ["http://**/?", "http?://**/?"]).alias("short_path"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json(spark, folder):
    return table(spark, folder, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')").alias("k"))


@query("SELECT p_partkey, 'npm' AS ecosystem, replace(p_name, ' ', '-') AS name, 2 AS line FROM part UNION ALL SELECT p_partkey, 'pypi', lower(p_type), 3 FROM part")
def install_commands(spark, folder):
    from corpusward.sources.commands import install_references

    docs = table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit("# setup\n$ npm install --save "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@1 ./local\nRUN pip install -r req.txt "), F.lower("p_type"), F.lit("==2.0 && echo done # note\n")).alias("text"),
    )
    return install_references(docs, "p_partkey").select("p_partkey", "ecosystem", "name", "line")


@query(
    """WITH a AS (SELECT DISTINCT left(s_name, 8) || '*' || right(s_name, 1) AS pattern FROM supplier),
s AS (SELECT s_suppkey, s_name FROM supplier)
SELECT s_suppkey, pattern FROM s JOIN a ON s_name LIKE replace(pattern, '*', '_%')"""
)
def workspace_alias_patterns(spark, folder):
    supplier = table(spark, folder, "supplier")
    patterns = supplier.select(F.concat(F.left(F.col("s_name"), F.lit(8)), F.lit("*"), F.right(F.col("s_name"), F.lit(1))).alias("pattern")).distinct()
    return references.aliased(supplier.select("s_suppkey", F.col("s_name").alias("specifier")), patterns).select("s_suppkey", "pattern")


@query(
    """WITH o AS (SELECT user_id, ts AS fetched_at, max(value) AS value FROM events WHERE event_type <> 'view' GROUP BY user_id, ts),
r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
m AS (SELECT event_id, r.user_id, r.ts - o.fetched_at <= INTERVAL 24 HOURS AS fresh, o.value FROM r ASOF LEFT JOIN o ON r.user_id = o.user_id AND r.ts >= o.fetched_at)
SELECT event_id, user_id, fresh IS NOT NULL AND fresh AS known, CASE WHEN fresh THEN value END AS value FROM m"""
)
def registry_as_of(spark, folder):
    """What was last known of each viewed user at the time, if that is at most a day old."""
    events = table(spark, folder, "events")
    seen = events.where("event_type <> 'view'").groupBy("user_id", F.col("ts").alias("fetched_at")).agg(F.max("value").alias("value")).withColumn("exists", F.lit(True))
    made = registry.as_of(events.where("event_type = 'view'").select("event_id", "user_id", "ts"), seen, ["user_id"], "ts")
    return made.select("event_id", "user_id", F.col("exists").isNotNull().alias("known"), "value")


@query("SELECT user_id, min(ts) AS created_at, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15 00:00:00') > 0 AS old FROM events WHERE event_type <> 'view' GROUP BY user_id")
def earliest_releases(spark, folder):
    events = table(spark, folder, "events").where("event_type <> 'view'").select("user_id", F.col("ts").alias("released_at"))
    return registry.earliest_release(events, "user_id").withColumn("old", F.col("created_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("SELECT o_orderpriority, min(o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY o_orderpriority")
def rule_first_seen(spark, folder):
    """The rules of a report, each told by its first finding: priorities stand for rules, orders for findings."""
    id_ = F.concat_ws(":", F.translate("o_orderpriority", ":", ""), F.lit("order"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"))
    told = F.concat_ws("|", "o_orderkey", "o_orderstatus").alias("explanation")
    rows = table(spark, folder, "orders").select(id_.alias("id"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.col("o_orderpriority").alias("title"), told)
    first = F.split("explanation", r"\|")
    return reports.sarif_rules(rows).select(F.col("title").alias("o_orderpriority"), F.get(first, F.lit(0)).cast("long").alias("first_order"), F.get(first, F.lit(1)).alias("first_status"))


@query(
    """WITH i AS (SELECT DISTINCT event_type, user_id, CAST(floor(value) AS BIGINT) AS code FROM events)
SELECT event_type, count(*) AS issues, count(DISTINCT user_id) AS files, count(*) > 0 AS incomplete FROM i GROUP BY event_type"""
)
def diagnostics_rollup(spark, folder):
    none = F.lit(None).cast("string")
    issues = table(spark, folder, "events").select(none.alias("repo_id"), F.col("event_type").alias("detector_id"), F.floor("value").cast("string").alias("code"), none.alias("message"), F.col("user_id").cast("string").alias("file"))
    return scan.incomplete(issues, "detector_id").withColumnRenamed("detector_id", "event_type")


@query(
    """SELECT n_name, count(DISTINCT c_custkey) AS scanned, count(DISTINCT c_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS affected,
round(100.0 * count(DISTINCT c_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') / count(DISTINCT c_custkey), 1) AS rate,
count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS ghosts, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS in_docs
FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name"""
)
def corpus_report(spark, folder):
    """Customers stand for repositories, their urgent orders for ghost packages."""
    ghosts = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("repo_id"), (F.col("o_orderstatus") == "F").alias("in_docs"))
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    repos = table(spark, folder, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("repo_id"), "n_name")
    return reports.corpus_counts(repos, ghosts, "n_name")


from corpusward.plans import detector_queries  # noqa: E402, F401: registers its queries with the same tables
