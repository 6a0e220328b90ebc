"""Queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no nested records, so each query first folds rows into source files with a nested summary, and then applies the operator to these.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import scalars as X
from ..functions import vocab as V
from ..functions.jsonrepair import columns as J
from ..operators import aggregates as A
from ..operators import batching as B
from ..operators import completion as C
from ..operators import graphs as G
from ..operators import nested as N
from ..operators import providers as P
from ..operators import responses
from ..operators import retrieval as R
from ..operators import select as S
from ..operators import vector_index
from ..operators import windows as W
from ..operators.nearest import nearest_of_many
from ..scratch import Scratch
from ..sources import ingest as I
from ..sources import store
from ..sources.keyed import KeyIndex
from ..sources.tree import write_files
from . import report as O
from .json_forms import FORMS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(*columns: str) -> dict[str, Column]:
    """Arrays as texts, so that both engines' results compare as plain values."""
    return {c: F.array_join(c, ",") for c in columns}


def literal(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def values(rows: list[tuple], names: str) -> str:
    """A literal table in SQL."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


# Source files from documents: project = source, extension = lang

DOC_FILES = "SELECT source AS project, lang AS ext, doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS lines, lang <> 'de' AS code FROM documents"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("projectName"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("filepath"), F.col("lang").alias("fileExtension"), X.count_lines(F.col("text")).alias("linesCount"), (F.col("lang") != "de").alias("isCode"))


@query(f"SELECT count(*) AS \"fileCount\", CAST(coalesce(sum(lines), 0) AS BIGINT) AS \"linesOfCode\" FROM ({DOC_FILES}) WHERE code AND project = 'src0'")
def file_line_stats(spark, sf_dir):
    return A.file_line_stats(doc_files(spark, sf_dir), "src0")


@query(f'SELECT ext AS "fileExtension", count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM ({DOC_FILES}) WHERE code GROUP BY ext')
def file_extension_stats(spark, sf_dir):
    return A.extension_stats(doc_files(spark, sf_dir))


@query(f"SELECT 'd/' || doc_id AS filepath, CAST(lines AS BIGINT) AS lines FROM ({DOC_FILES})")
def count_lines(spark, sf_dir):
    return doc_files(spark, sf_dir).select("filepath", F.col("linesCount").alias("lines"))


@query(
    f"""WITH s AS (SELECT project, ext, lines, l.doc_id IS NOT NULL AS done FROM ({DOC_FILES}) f LEFT JOIN labels l USING (doc_id))
    SELECT project AS "projectName", count(*) AS "fileCount", CAST(sum(lines) AS BIGINT) AS "linesOfCode", string_agg(DISTINCT ext, ',' ORDER BY ext) AS "fileExtensions",
    count(*) FILTER (done) AS "summarizedFileCount", count(*) FILTER (done) > 0 AS "hasSummaries", CAST(floor(100.0 * count(*) FILTER (done) / count(*) + 0.5) AS BIGINT) AS "summarizedPct" FROM s GROUP BY project"""
)
def project_stats(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("filepath"), F.struct("quality").alias("summary"))
    return A.project_stats(doc_files(spark, sf_dir).join(labels, "filepath", "left")).withColumns(joined("fileExtensions"))


@query(f'SELECT count(DISTINCT project) AS projects, count(*) AS "fileCount", CAST(sum(lines) AS BIGINT) AS "linesOfCode" FROM ({DOC_FILES})')
def project_totals(spark, sf_dir):
    return A.project_totals(A.project_stats(doc_files(spark, sf_dir).withColumn("summary", F.lit(None).cast("string"))))


@query(f"SELECT 'd/' || doc_id AS filepath FROM ({DOC_FILES}) WHERE project = 'src3'")
def file_paths(spark, sf_dir):
    return S.file_paths(doc_files(spark, sf_dir), "src3")


@query(
    """WITH s AS (SELECT lang AS ext, count(*) FILTER (true) AS files, 0 AS n FROM documents WHERE lang <> 'de' GROUP BY lang),
    l AS (SELECT lang AS ext, sum(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END) AS lines FROM documents WHERE lang <> 'de' GROUP BY lang),
    r AS (SELECT ext, files, sum(files) OVER (ORDER BY files DESC, lines DESC, ext ROWS UNBOUNDED PRECEDING) AS run, sum(files) OVER () AS total, row_number() OVER (ORDER BY files DESC, lines DESC, ext) - 1 AS i FROM s JOIN l USING (ext))
    SELECT ext AS label, files AS value, round(files / total * 100, 6) AS percentage, round((run - files) / total * (2 * pi()) - pi() / 2, 6) AS "startAngle", round(run / total * (2 * pi()) - pi() / 2, 6) AS "endAngle", CAST(i AS INTEGER) AS "index", files / total * 100 >= 3 AS "showLabel" FROM r"""
)
def pie_slices(spark, sf_dir):
    r = W.pie_slices(A.extension_stats(doc_files(spark, sf_dir)))
    return r.select("label", "value", *(F.round(c, 6).alias(c) for c in ("percentage", "startAngle", "endAngle")), "index", "showLabel")


# Source files from orders: functions = lines, complexity = quantity


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct(
        F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("cyclomaticComplexity"), F.when(F.col("l_partkey") % 9 != 0, (F.col("l_partkey") % 90).cast("double")).alias("linesOfCode"), F.array("l_linestatus").alias("codeSmells")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("f"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderstatus").alias("projectName"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("filepath"),
        F.struct(
            F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ns"), F.col("o_custkey").cast("string"))).alias("namespace"), F.col("f").alias("publicFunctions"), F.struct(F.array("o_orderstatus").alias("fileSmells")).alias("codeQualityMetrics"),
            F.filter(F.coalesce("f", F.array().cast("array<struct<name:string,cyclomaticComplexity:double,linesOfCode:double,codeSmells:array<string>>>")), lambda x: x["cyclomaticComplexity"] > 40).alias("storedProcedures"),
            F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.col("o_orderpriority").alias("name")))).alias("triggers"),
        ).alias("summary"),
    )


FUNCTIONS = "SELECT 'o' || o_orderkey AS filepath, CASE WHEN o_orderkey % 2 = 0 THEN 'ns' || o_custkey ELSE 'o' || o_orderkey END AS ns, o_orderstatus AS project, 'l' || l_linenumber AS name, l_quantity AS cc, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey % 90 AS DOUBLE) END AS loc, l_linestatus AS smell FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(f'SELECT ns || \'::\' || name AS "functionName", filepath AS "filePath", cc AS complexity, coalesce(loc, 0.0) AS "linesOfCode", smell AS "codeSmells" FROM ({FUNCTIONS}) WHERE cc <> 7 ORDER BY cc DESC, 1, 2 LIMIT 10')
def top_complex_functions(spark, sf_dir):
    return A.top_complex_functions(order_files(spark, sf_dir)).withColumns(joined("codeSmells"))


@query(
    f"""WITH pairs AS (SELECT DISTINCT 0 AS level, smell, filepath FROM ({FUNCTIONS}) UNION ALL SELECT DISTINCT 1, o_orderstatus, 'o' || o_orderkey FROM orders)
    SELECT smell AS "smellType", count(*) AS occurrences, count(DISTINCT filepath) AS "affectedFiles" FROM pairs GROUP BY smell"""
)
def code_smell_statistics(spark, sf_dir):
    return A.code_smells(order_files(spark, sf_dir))


@query(
    f"""SELECT count(*) AS "totalFunctions", round_even(sum(cc) / count(*), 2) AS "averageComplexity", count(*) FILTER (cc > 10) AS "highComplexityCount", count(*) FILTER (cc > 20) AS "veryHighComplexityCount",
    round_even(sum(coalesce(loc, 0)) / count(*), 2) AS "averageFunctionLength", count(*) FILTER (loc > 50) AS "longFunctionCount" FROM ({FUNCTIONS}) WHERE cc <> 7 AND project = 'O'"""
)
def code_quality_statistics(spark, sf_dir):
    return A.code_quality(order_files(spark, sf_dir), "O")


@query(f'SELECT (SELECT count(*) FROM ({FUNCTIONS}) WHERE cc > 40) AS "totalProcedures", (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS "totalTriggers"')
def database_statistics(spark, sf_dir):
    return A.database_statistics(order_files(spark, sf_dir))


@query(f"SELECT 'o' || o_orderkey AS filepath, coalesce(p.n, 0) AS procedures, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS triggers FROM orders LEFT JOIN (SELECT filepath, count(*) AS n FROM ({FUNCTIONS}) WHERE cc > 40 GROUP BY 1) p ON p.filepath = 'o' || o_orderkey WHERE p.n IS NOT NULL OR o_orderkey % 3 = 0")
def procs_or_triggers(spark, sf_dir):
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return S.stored_objects(order_files(spark, sf_dir)).select("filepath", size("storedProcedures").alias("procedures"), size("triggers").cast("int").alias("triggers"))


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures and functions from orders of status F and O, triggers from P; the priority's rank stands for the complexity."""
    rank = F.substring("o_orderpriority", 1, 1)
    complexity = F.when(rank == "1", "high").when(rank == "2", "MEDIUM").when(rank == "3", "INVALID").when(rank == "4", None).otherwise("odd")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.struct(F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "FUNCTION").otherwise("PROCEDURE").alias("objectType"), complexity.alias("complexity"), F.lit(1.0).alias("linesOfCode")).alias("o"))
    trigger = F.col("o_orderstatus") == "P"
    rows = o.groupBy("o_custkey").agg(F.collect_list(F.when(~trigger, F.col("o"))).alias("storedProcedures"), F.collect_list(F.when(trigger, F.col("o"))).alias("triggers"))
    return rows.select(F.col("o_custkey").cast("string").alias("filepath"), F.struct("storedProcedures", "triggers").alias("summary"))


@query(
    """WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'FUNCTION' WHEN 'O' THEN 'PROCEDURE' ELSE 'TRIGGER' END AS k, left(o_orderpriority, 1) AS r FROM orders)
    SELECT v.k AS "objectType", count(o.k) AS total, count(*) FILTER (r IN ('4', '5')) AS low, count(*) FILTER (r = '2') AS medium, count(*) FILTER (r = '1') AS high FROM (VALUES ('PROCEDURE'), ('FUNCTION'), ('TRIGGER')) AS v(k) LEFT JOIN o USING (k) GROUP BY v.k"""
)
def proc_complexity_tally(spark, sf_dir):
    return P.complexity_tally(P.stored_object_list(stored_files(spark, sf_dir)))


# Databases and integrations from events and conversations


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    operations = F.when(kind == "click", F.array(F.lit("READ"), F.lit("WRITE"))).when(kind == "view", F.array(F.lit("READ"))).when(kind == "purchase", F.array(F.lit("WRITE"), F.lit("INVALID"))).otherwise(F.array().cast("array<string>"))
    mechanism = F.when(F.col("user_id") % 4 == 0, "JPA").when(F.col("user_id") % 4 == 1, "NONE").when(F.col("user_id") % 4 == 2, "MQL")
    di = F.struct(mechanism.alias("mechanism"), kind.alias("description"), F.array(F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))).alias("tablesAccessed"), operations.alias("operationType"))
    return e.select(F.lit("p").alias("projectName"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("filepath"), F.struct(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("namespace"), F.when(kind != "error", di).alias("databaseIntegration")).alias("summary"))


MECHANISM = "CASE user_id % 4 WHEN 0 THEN 'JPA' WHEN 1 THEN 'NONE' WHEN 2 THEN 'MQL' END"


@query(f"SELECT CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id ELSE 'e' || event_id END AS path, CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END AS namespace, {MECHANISM} AS mechanism, event_type AS description FROM events WHERE event_type <> 'error' AND ({MECHANISM}) IS DISTINCT FROM 'NONE'")
def db_integrations(spark, sf_dir):
    return S.database_integrations(event_files(spark, sf_dir)).select("path", "namespace", "mechanism", "description")


@query(
    f"""WITH e AS (SELECT coalesce({MECHANISM}, 'UNKNOWN') AS mechanism, event_type AS k, event_id % 5 AS t FROM events WHERE event_type <> 'error')
    SELECT mechanism, count(*) AS total, count(*) FILTER (k IN ('click', 'view')) AS "READ", count(*) FILTER (k IN ('click', 'purchase')) AS "WRITE", CAST(0 AS BIGINT) AS "READ_WRITE", CAST(0 AS BIGINT) AS "DDL", CAST(0 AS BIGINT) AS "ADMIN", CAST(0 AS BIGINT) AS "OTHER", count(DISTINCT t) AS tables FROM e GROUP BY mechanism"""
)
def mechanism_operation_crosstab(spark, sf_dir):
    return P.mechanism_crosstab(event_files(spark, sf_dir))


@query("SELECT 'c' || conv_id AS namespace, CAST(conv_id AS VARCHAR) AS filepath, upper(role) AS mechanism, 't' || turn AS name, CASE WHEN turn % 2 = 0 THEN 'PRODUCER' ELSE 'CONSUMER' END AS direction FROM conversations")
def integration_points(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    point = F.struct(F.upper("role").alias("mechanism"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"), F.when(F.col("turn") % 2 == 0, "PRODUCER").otherwise("CONSUMER").alias("direction"))
    rows = c.groupBy("conv_id").agg(F.collect_list(point).alias("p")).select(F.col("conv_id").cast("string").alias("filepath"), F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("namespace"), F.col("p").alias("integrationPoints")).alias("summary"))
    return S.integration_points(rows)


@query("SELECT 'd/' || doc_id AS filepath, source AS namespace, length(text) AS purpose FROM documents WHERE lang IN ('en', 'fr')")
def summaries_by_extension(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("filepath"), F.col("lang").alias("fileExtension"), F.struct(F.col("source").alias("namespace"), F.char_length("text").cast("long").alias("purpose")).alias("summary"))
    return S.summaries_of(d, "fileExtension", ["en", "fr"])


@query("SELECT 'd/' || doc_id AS filepath, source AS namespace FROM documents")
def summaries_without_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("filepath"), F.col("lang").alias("canonicalType"), F.struct(F.col("source").alias("namespace")).alias("summary"))
    return S.summaries_of(d, "canonicalType", [])


# Module coupling: files of customers, by nation; references to other nations in four forms


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 nations
    n = n.select("n_nationkey", F.replace("r_name", F.lit(" "), F.lit("")).alias("r"), F.replace("n_name", F.lit(" "), F.lit("")).alias("n"))
    c = table(spark, sf_dir, "customer").withColumn("other", F.col("c_custkey") * 7 % 25)
    a, b = n.select(*(F.col(x).alias(f"a_{x}") for x in n.columns)), n.select(*(F.col(x).alias(f"b_{x}") for x in n.columns))
    c = c.join(F.broadcast(a), F.col("c_nationkey") == F.col("a_n_nationkey")).join(F.broadcast(b), F.col("other") == F.col("b_n_nationkey"))
    k = F.col("c_custkey") % 4
    ref = F.when(k == 0, F.concat_ws("/", "b_r", "b_n", F.lit("X.java"))).when(k == 1, F.concat_ws(".", "b_r", "b_n", F.lit("X"))).when(k == 2, F.concat(F.lit("../"), F.col("b_n"), F.lit("/./X.java"))).otherwise(F.lit("X"))
    path = F.concat_ws("/", "a_r", "a_n", F.concat(F.lit("F"), (F.col("c_custkey") % 5).cast("string"), F.lit(".java")))
    return c.groupBy(path.alias("filepath")).agg(F.collect_list(ref).alias("r")).select("filepath", F.struct(F.col("r").alias("internalReferences")).alias("summary"))


COUPLING = """WITH n AS (SELECT n_nationkey AS k, replace(r_name, ' ', '') AS r, replace(n_name, ' ', '') AS n FROM nation JOIN region ON n_regionkey = r_regionkey),
    refs AS (SELECT a.r || '/' || a.n AS f, CASE c_custkey % 4 WHEN 0 THEN b.r || '/' || b.n WHEN 1 THEN b.r || '.' || b.n WHEN 2 THEN a.r || '/' || b.n END AS t FROM customer JOIN n a ON c_nationkey = a.k JOIN n b ON c_custkey * 7 % 25 = b.k),
    pairs AS (SELECT f, t, count(*) AS n FROM refs WHERE t IS NOT NULL AND t <> f GROUP BY f, t)"""


@query(COUPLING + """ SELECT f AS "fromModule", t AS "toModule", n AS "referenceCount", CASE WHEN n / m >= 0.7 THEN 'Very High' WHEN n / m >= 0.4 THEN 'High' WHEN n / m >= 0.2 THEN 'Medium' ELSE 'Low' END AS "couplingLevel" FROM pairs, (SELECT max(n) AS m FROM pairs)""")
def module_coupling(spark, sf_dir):
    return P.module_coupling(customer_files(spark, sf_dir))


@query(COUPLING + """ SELECT count(*) AS "totalCouplings", CAST(sum(n) AS BIGINT) AS "totalReferences", max(n) AS "highestCouplingCount", (SELECT count(*) FROM (SELECT f FROM refs UNION SELECT t FROM pairs)) AS "totalModules" FROM pairs""")
def module_coupling_stats(spark, sf_dir):
    return P.coupling_stats(customer_files(spark, sf_dir))


# Bill of materials: parts in seven build files


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    d = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 != 1, F.col("p_brand")).alias("groupId"), F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 3).cast("string")).alias("version"), F.col("p_type").alias("scope"))
    path = F.concat(F.lit("pom"), (F.col("p_partkey") % 7).cast("string"), F.lit(".xml"))
    return p.groupBy(path.alias("filepath")).agg(F.collect_list(d).alias("d")).select("filepath", F.when(F.col("filepath") == "pom6.xml", "java").otherwise("maven").alias("canonicalType"), F.struct(F.col("filepath").alias("namespace"), F.col("d").alias("dependencies")).alias("summary"))


BOM = """WITH d AS (SELECT p_name AS name, CASE WHEN p_size % 4 > 1 THEN p_brand END AS g, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size % 3 AS VARCHAR) END AS v, p_type AS s, 'pom' || (p_partkey % 7) || '.xml' AS f FROM part WHERE p_partkey % 7 <> 6),
    bom AS (SELECT name, g, coalesce(string_agg(DISTINCT v, ',' ORDER BY v), '') AS versions, count(DISTINCT v) > 1 AS conflict, string_agg(DISTINCT s, ',' ORDER BY s) AS scopes, string_agg(DISTINCT f, ',' ORDER BY f) AS files FROM d GROUP BY name, g)"""


@query(BOM + ' SELECT name, g AS "groupId", versions, conflict AS "hasConflict", scopes, files AS locations FROM bom')
def bill_of_materials(spark, sf_dir):
    return P.bill_of_materials(part_files(spark, sf_dir)).withColumns(joined("versions", "scopes", "locations"))


@query(BOM + ' SELECT count(*) AS "totalDependencies", count(*) FILTER (conflict) AS "conflictCount", (SELECT count(DISTINCT f) FROM d) AS "buildFiles" FROM bom')
def bom_totals(spark, sf_dir):
    return P.bom_totals(P.bill_of_materials(part_files(spark, sf_dir)))


# Jobs

TRIGGERS = [("cron: 0 2 * * *", "cron"), ("Crontab entry", "cron"), ("task scheduler", "task-scheduler"), ("SCHTASKS /create", "task-scheduler"), ("schedule: nightly", "scheduled"), ("Manual start", "manual"), ("event bus", "event-driven"), ("systemd unit", "systemd-timer"), ("timer x", "systemd-timer"), ("  ", "unknown"), ("custom : v", "custom"), ("startup, then", "startup"), ("boot", "boot")]


@query(f'SELECT e.event_id, v.expected AS "triggerType" FROM events e JOIN {values([(k, t, x) for k, (t, x) in enumerate(TRIGGERS)], "k, trigger, expected")} ON e.event_id % {len(TRIGGERS)} = v.k')
def trigger_types(spark, sf_dir):
    items = F.array(*(F.lit(t) for t, _ in TRIGGERS))
    return table(spark, sf_dir, "events").select("event_id", X.trigger_type(F.get(items, (F.col("event_id") % len(TRIGGERS)).cast("int"))).alias("triggerType"))


@query(f"""WITH j AS (SELECT user_id, expected FROM events e JOIN {values([(k, t, x) for k, (t, x) in enumerate(TRIGGERS)], "k, trigger, expected")} ON e.event_id % {len(TRIGGERS)} = v.k WHERE user_id % 3 < 2)
    SELECT count(*) AS "totalJobs", string_agg(DISTINCT expected, ',' ORDER BY expected) AS "triggerTypes", count(DISTINCT user_id) AS "jobFiles" FROM j""")
def scheduled_jobs(spark, sf_dir):
    items = F.array(*(F.lit(t) for t, _ in TRIGGERS))
    e = table(spark, sf_dir, "events").select("user_id", F.struct(F.col("event_id").cast("string").alias("jobName"), F.get(items, (F.col("event_id") % len(TRIGGERS)).cast("int")).alias("trigger")).alias("j"))
    kind = F.when(F.col("user_id") % 3 == 0, "jcl").when(F.col("user_id") % 3 == 1, "shell-script").otherwise("java")
    rows = e.groupBy("user_id").agg(F.collect_list("j").alias("j")).select(F.col("user_id").cast("string").alias("filepath"), kind.alias("canonicalType"), F.struct(F.col("j").alias("scheduledJobs")).alias("summary"))
    return P.job_summary(P.scheduled_jobs(rows)).select("totalJobs", F.array_join("triggerTypes", ",").alias("triggerTypes"), F.size("jobFiles").cast("long").alias("jobFiles"))


# User interfaces: pages


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    count = lambda s: ((F.char_length("html") - F.char_length(F.replace("html", F.lit(s), F.lit("")))) / len(s)).cast("long")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    tags = F.array(F.struct(F.left(host, F.lit(3)).alias("prefix"), host.alias("uri")), F.struct(F.lit("x").alias("prefix"), host.alias("uri")), F.struct(F.lit("c").alias("prefix"), F.when(F.col("page_id") % 2 == 0, "http://java.sun.com/jsp/jstl/core").otherwise("/WEB-INF/t.tld").alias("uri")))
    return p.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("filepath"),
        F.struct(
            F.struct(count("<p>").alias("scriptletCount"), count("<b>").alias("expressionCount"), count("<li>").alias("declarationCount"), tags.alias("customTags")).alias("jspMetrics"),
            F.when(F.col("page_id") % 5 == 0, F.struct(F.left(host, F.lit(2)).alias("name"), F.when(F.col("page_id") % 2 == 0, "1").alias("version"))).alias("uiFramework"),
        ).alias("summary"),
    )


PAGES = "SELECT 'p' || page_id AS f, page_id AS id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, (length(html) - length(replace(html, '<p>', ''))) // 3 AS s, (length(html) - length(replace(html, '<b>', ''))) // 3 AS e, (length(html) - length(replace(html, '<li>', ''))) // 4 AS d FROM pages"


@query(f"SELECT left(host, 2) AS name, CASE WHEN id % 2 = 0 THEN '1' ELSE 'unknown' END AS version, string_agg(f, ',' ORDER BY f) AS \"configFiles\" FROM ({PAGES}) WHERE id % 5 = 0 GROUP BY 1, 2")
def ui_frameworks(spark, sf_dir):
    return P.ui_frameworks(page_files(spark, sf_dir)).withColumns(joined("configFiles"))


@query(
    f"""SELECT CAST(sum(s) AS BIGINT) AS "totalScriptlets", CAST(sum(e) AS BIGINT) AS "totalExpressions", CAST(sum(d) AS BIGINT) AS "totalDeclarations", count(*) FILTER (s + e + d > 10) AS "filesWithHighScriptletCount", sum(s) / count(*) AS "averageScriptletsPerFile",
    CASE WHEN sum(s) = 0 THEN '{V.NO_SCRIPTLETS}' WHEN sum(s) / count(*) < 5 THEN printf('{V.SCRIPTLET_ADVICE[0][1]}', sum(s) / count(*)) WHEN sum(s) / count(*) < 10 THEN printf('{V.SCRIPTLET_ADVICE[1][1]}', sum(s) / count(*)) ELSE printf('{V.SCRIPTLET_ADVICE[2][1]}', sum(s) / count(*)) END AS insight FROM ({PAGES})"""
)
def jsp_metrics(spark, sf_dir):
    return P.jsp_metrics(page_files(spark, sf_dir))


@query(f"""SELECT f AS filepath, CAST(s AS BIGINT) AS "scriptletCount", CAST(e AS BIGINT) AS "expressionCount", CAST(d AS BIGINT) AS "declarationCount", CAST(s + e + d AS BIGINT) AS "totalBlocks", CASE WHEN s + e + d > 20 THEN 'Very High' WHEN s + e + d > 10 THEN 'High' WHEN s + e + d > 5 THEN 'Moderate' ELSE 'Low' END AS "debtLevel" FROM ({PAGES}) WHERE s + e + d > 0 ORDER BY 5 DESC, f LIMIT 10""")
def jsp_top_files(spark, sf_dir):
    return P.top_scriptlet_files(page_files(spark, sf_dir))


@query(f"""WITH t AS (SELECT left(host, 3) AS prefix, host AS uri FROM ({PAGES}) UNION ALL SELECT 'c', CASE WHEN id % 2 = 0 THEN 'http://java.sun.com/jsp/jstl/core' ELSE '/WEB-INF/t.tld' END FROM ({PAGES}))
    SELECT prefix, uri, count(*) AS "usageCount", CASE WHEN uri LIKE '%java.sun.com/jsp/jstl%' THEN 'JSTL' WHEN uri LIKE '%springframework.org%' THEN 'Spring' WHEN uri LIKE '%/WEB-INF/%' OR uri LIKE '%custom%' THEN 'Custom' ELSE 'Other' END AS "tagType" FROM t GROUP BY prefix, uri""")
def tag_libraries(spark, sf_dir):
    return P.tag_libraries(page_files(spark, sf_dir))


# Domain models and diagrams


def domain_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    by = p.groupBy("p_brand", "p_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.struct(x["p_name"].alias("name"), x["p_partkey"].cast("string").alias("description"))).alias("entities"))
    aggregates = by.groupBy("p_brand").agg(F.transform(F.sort_array(F.collect_list(F.struct("p_type", "entities"))), lambda x: F.struct(x["p_type"].alias("name"), F.lit("d").alias("description"), F.struct(F.concat(x["p_type"], F.lit("Repo")).alias("name"), F.lit("r").alias("description")).alias("repository"), x["entities"].alias("entities"))).alias("a"))
    return aggregates.agg(F.transform(F.sort_array(F.collect_list(F.struct("p_brand", "a"))), lambda x: F.struct(x["p_brand"].alias("name"), F.lit("c").alias("description"), x["a"].alias("aggregates"))).alias("boundedContexts")).withColumn("projectName", F.lit("p"))


@query("SELECT p_name AS entity, p_brand AS context, p_type AS aggregate, CAST(p_partkey AS VARCHAR) AS description FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_type, p_partkey) = 1")
def domain_model_entities(spark, sf_dir):
    return N.domain_entities(domain_summaries(spark, sf_dir)).select("entity", "context", "aggregate", "description")


@query("SELECT p_brand AS context, p_name AS entity, p_type AS aggregate FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_type, p_partkey) = 1")
def entity_aggregates(spark, sf_dir):
    s = domain_summaries(spark, sf_dir)
    aggregates = N.domain_aggregates(s).select("context", "pos", "aggregate", F.transform("entities", lambda e: e["name"]).alias("entities"))
    return W.entity_aggregates(N.domain_entities(s, within_context=True).select("context", "entity"), aggregates).select("context", "entity", "aggregate")


@query("SELECT DISTINCT p_brand AS context, p_type || 'Repo' AS name FROM part")
def domain_repositories(spark, sf_dir):
    return N.domain_repositories(domain_summaries(spark, sf_dir)).select("context", "name")


@query("SELECT * FROM (SELECT conv_id AS process, turn AS pos, role || turn AS source, lead(role || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL")
def activity_edges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return W.activity_edges(c.select(F.col("conv_id").alias("process"), F.col("turn").alias("pos"), F.concat("role", F.col("turn").cast("string")).alias("activity")))


@query("""WITH s AS (SELECT n_regionkey AS project, n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS i FROM nation),
    p AS (SELECT *, i // 3 AS r, i % 3 AS c, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || i AS node FROM s)
    SELECT project, name, i AS "index", CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, node, CASE WHEN lead(r) OVER w = r THEN lead(node) OVER w END AS "rightNode", CASE WHEN c = 0 THEN lead(node, 3) OVER w END AS "downNode" FROM p WINDOW w AS (PARTITION BY project ORDER BY i)""")
def service_grid(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"))
    return W.service_grid(n)


@query("""WITH i AS (SELECT n_name AS name, 0 AS kind, n_nationkey AS pos, 'int_' AS p FROM nation), x AS (SELECT CASE WHEN r_regionkey = 0 THEN (SELECT min(n_name) FROM nation) ELSE r_name END AS name, 1 AS kind, r_regionkey AS pos, 'ext_' AS p FROM region),
    n AS (SELECT name, trim(regexp_replace(lower(p || name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || pos AS node FROM (SELECT * FROM i UNION ALL SELECT * FROM x) QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind DESC, pos DESC) = 1),
    e AS (SELECT n_name AS source, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'nowhere' FROM nation)
    SELECT source, target, a.node AS "sourceNode", b.node AS "targetNode" FROM e JOIN n a ON source = a.name JOIN n b ON target = b.name""")
def architecture_edges(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    least = n.agg(F.min("n_name").alias("least"))
    external = r.join(F.broadcast(least)).select(F.when(F.col("r_regionkey") == 0, F.col("least")).otherwise(F.col("r_name")).alias("name"), F.col("r_regionkey").alias("pos"))
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target")).unionByName(n.select(F.col("n_name").alias("source"), F.lit("nowhere").alias("target")))
    return W.architecture_edges(edges, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos")), external)


@query("SELECT n_regionkey AS graph, 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, CAST(n_nationkey AS INTEGER) AS pos, 'solid' AS kind FROM nation WHERE n_nationkey % 2 = 1")
def dangling_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nodes = n.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("graph"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")).unionByName(n.select(F.col("n_regionkey").alias("graph"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id")).distinct())
    edges = n.select(F.col("n_regionkey").alias("graph"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target"), F.col("n_nationkey").alias("pos"), F.lit("solid").alias("kind"))
    return G.dangling_edges(nodes, edges)


@query("""WITH l AS (SELECT n_regionkey AS graph, 0 AS part, n_nationkey AS pos, '    n' || n_nationkey || '["' || n_name || '"]' AS line FROM nation UNION ALL
    SELECT n_regionkey, 1, n_nationkey, '    n' || n_nationkey || ' --> n' || lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) FROM nation)
    SELECT graph, 'flowchart TB' || chr(10) || string_agg(line, chr(10) ORDER BY part, pos) AS chart FROM l WHERE line IS NOT NULL GROUP BY graph""")
def flowcharts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.lit("rectangle").alias("shape"))
    steps = W.activity_edges(n.select(F.col("graph").alias("process"), "pos", F.col("id").alias("activity")))
    return G.mermaid(n, steps.select(F.col("process").alias("graph"), "pos", "source", "target", F.lit("solid").alias("kind")))



@query("""WITH n AS (SELECT * FROM nation), u AS (SELECT s_suppkey AS k, s_nationkey AS n, s_name AS name FROM supplier), i AS (SELECT '    ' AS t),
    l AS (SELECT n_regionkey AS graph, 0 AS part, n_nationkey AS a, 0 AS b, 0 AS c, t || 'subgraph n' || n_nationkey || '["' || n_name || '"]' AS line FROM n, i
    UNION ALL SELECT n_regionkey, 0, n_nationkey, 1, 0, t || t || 'direction LR' FROM n, i
    UNION ALL SELECT n_regionkey, 0, n_nationkey, 2, 0, t || t || 'subgraph s' || n_nationkey || '["Suppliers"]' FROM n, i
    UNION ALL SELECT n_regionkey, 0, n_nationkey, 3, k, t || t || t || 'u' || k || '("' || name || '")' FROM n JOIN u ON n = n_nationkey, i
    UNION ALL SELECT n_regionkey, 0, n_nationkey, 4, 0, t || t || 'end' FROM n, i
    UNION ALL SELECT n_regionkey, 0, n_nationkey, 5, 0, t || 'end' FROM n, i
    UNION ALL SELECT n_regionkey, 1, k, 0, 0, t || 'u' || k || ' -.-> n' || n FROM n JOIN u ON n = n_nationkey, i)
    SELECT graph, 'flowchart TB' || chr(10) || string_agg(line, chr(10) ORDER BY part, a, b, c) AS chart FROM l GROUP BY graph""")
def nested_flowcharts(spark, sf_dir):
    """A chart per region: nations as subgraphs, in each a subgraph of its suppliers, and an edge from each supplier to its nation."""
    n, u = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    outer = n.select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("pos"), name("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), none.alias("parent"), F.lit("LR").alias("direction"), none.alias("style"))
    inner = n.select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("pos"), name("s", "n_nationkey").alias("id"), F.lit("Suppliers").alias("label"), name("n", "n_nationkey").alias("parent"), none.alias("direction"), none.alias("style"))
    placed = u.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = placed.select(F.col("n_regionkey").alias("graph"), F.col("s_suppkey").alias("pos"), name("u", "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("rounded").alias("shape"), name("s", "n_nationkey").alias("subgraph"))
    edges = placed.select(F.col("n_regionkey").alias("graph"), F.col("s_suppkey").alias("pos"), name("u", "s_suppkey").alias("source"), name("n", "n_nationkey").alias("target"), F.lit("dotted").alias("kind"))
    return G.nested_mermaid(nodes, edges, outer.unionByName(inner))


def nation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per region: its nations are services, components and activities."""
    n = table(spark, sf_dir, "nation")
    items = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    by = n.groupBy("n_regionkey").agg(items.alias("x"))
    named = lambda x: F.struct(x["n_name"].alias("name"), x["n_nationkey"].cast("string").alias("description"))
    service = lambda x: F.struct(x["n_name"].alias("name"), F.lit("s").alias("description"), F.array(F.struct(F.concat(x["n_name"], F.lit("E")).alias("name"), F.lit("e").alias("description"), F.when(x["n_nationkey"] % 2 == 0, F.array(F.lit("a"))).alias("attributes"))).alias("entities"))
    activities = F.transform("x", lambda x: F.struct(x["n_name"].alias("activity"), F.lit("d").alias("description")))
    architecture = F.struct(F.transform("x", named).alias("internalComponents"), F.transform("x", lambda x: F.struct(x["n_name"].alias("from"), F.when(x["n_nationkey"] % 3 > 0, F.lit("db")).alias("to"), F.lit("d").alias("description"))).alias("dependencies"))
    return by.select(F.col("n_regionkey").cast("string").alias("projectName"), F.concat(F.lit("about "), F.col("n_regionkey").cast("string")).alias("appDescription"), F.lit("m").alias("llmModels"), F.transform("x", service).alias("potentialMicroservices"), F.array(F.struct(F.lit("main").alias("name"), activities.alias("keyBusinessActivities"))).alias("businessProcesses"), F.array(architecture).alias("inferredArchitecture"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS "projectName", CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_name AS name, n_name || 'E' AS entity, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS attributes FROM nation""")
def microservices(spark, sf_dir):
    m = N.microservices(nation_summaries(spark, sf_dir))
    return m.select("projectName", "pos", "name", F.col("entities")[0]["name"].alias("entity"), F.size(F.col("entities")[0]["attributes"]).alias("attributes"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS "projectName", CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, 'main' AS process, n_name AS activity FROM nation""")
def business_activities(spark, sf_dir):
    return N.business_activities(nation_summaries(spark, sf_dir)).select("projectName", "pos", "process", "activity")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS "projectName", n_name AS source, 'db' AS target FROM nation WHERE n_nationkey % 3 > 0""")
def inferred_dependencies(spark, sf_dir):
    return N.inferred_architecture(nation_summaries(spark, sf_dir), "dependencies").select("projectName", F.col("from").alias("source"), F.col("to").alias("target"))


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS "projectName", ord, category, label, empty FROM region, (VALUES (0, 'technologies', 'Technologies', true), (1, 'businessProcesses', 'Business Processes', false), (2, 'boundedContexts', 'Bounded Contexts', true), (3, 'potentialMicroservices', 'Potential Microservices', false), (4, 'inferredArchitecture', 'Inferred Architecture', false)) AS v(ord, category, label, empty)""")
def category_rows(spark, sf_dir):
    return N.categories(nation_summaries(spark, sf_dir)).select("projectName", "ord", "category", "label", (F.col("data") == "[]").alias("empty"))


@query(f"""SELECT '1' AS "projectName", 'about 1' AS "appDescription", 'm' AS "llmModels", count(*) AS "fileCount", CAST(sum(lines) AS BIGINT) AS "linesOfCode" FROM ({DOC_FILES}) WHERE code AND project = 'src1'""")
def overview(spark, sf_dir):
    own = S.fields_of(nation_summaries(spark, sf_dir), "1", ["projectName", "appDescription", "llmModels"])
    return O.overview(S.of_project(doc_files(spark, sf_dir), "src1"), own)["app-stats"]


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND user_id = 3")
def interactive_filter(spark, sf_dir):
    return O.filtered(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), {"event_type": "click", "user_id": 3}, [("event_id", True)]).select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM events")
def guarded_categories(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"name": "'), "event_type", F.lit('"}]'))).when(F.col("event_id") % 3 == 1, "broken")
    return table(spark, sf_dir, "events").select("event_id", F.size(N.guarded(text, "array<struct<name:string,description:string>>")).alias("n"))


# Retrieval


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, v), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))), 6) AS distance FROM embeddings, q WHERE label < 5 ORDER BY distance, vec_id LIMIT 6""")
def vector_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    return R.nearest(e.where("label < 5"), q, "embedding", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM
    (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 6""")
def vector_search_many(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return nearest_of_many(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "embedding", "vec_id", "query_id").select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id AS query_id, vec_id AS nearest, 6 AS results, true AS in_project, true AS recalled FROM embeddings WHERE vec_id % 50 = 0 AND label < 5")
def vector_index_recall(spark, sf_dir):
    """An index over all vectors, searched by every vector whose id is divisible by 50, within the labels under 5: the nearest row found, the number of results, whether the filter held, and whether the results of all queries hold at least nine tenths of the exact ones."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0 AND label < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    with Scratch(spark, "vector_index") as tmp:
        path = tmp.claim("index")
        vector_index.build(e, path, "vec_id", "embedding", ("label",))
        found = tmp.save(vector_index.search(spark, path, asked, "query_id", "embedding", where="label < 5"), "found", keep=True)
    exact = nearest_of_many(e.where("label < 5"), asked, "embedding", "vec_id", "query_id").select("query_id", F.col("vec_id").alias("key"), F.lit(1).alias("right"))
    both = found.join(exact, ["query_id", "key"], "left").join(e.select(F.col("vec_id").alias("key"), "label"), "key")
    each = both.groupBy("query_id").agg(F.min_by("key", "rank").alias("nearest"), F.count(F.lit(1)).cast("int").alias("results"), F.bool_and(F.col("label") < 5).alias("in_project"), F.count("right").alias("right"))
    whole = each.agg((F.sum("right") >= 0.9 * F.sum("results")).alias("recalled"))
    return each.drop("right").join(F.broadcast(whole))


@query("SELECT string_agg('```' || lang || chr(10) || text || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY doc_id) AS context FROM documents WHERE doc_id < 6")
def markdown_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id < 6")
    return R.markdown_context(d, "lang", "text", "doc_id")


# Batching

TOKENS = "least(length(text) / 4.0, 64.0)"


@query(f"""WITH RECURSIVE i AS (SELECT role, text, {TOKENS} AS n, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations),
    b AS (SELECT role, k, n AS used, 0 AS batch, 0 AS item FROM i WHERE k = 1 UNION ALL
    SELECT i.role, i.k, CASE WHEN b.used + i.n > 64 THEN i.n ELSE b.used + i.n END, CASE WHEN b.used + i.n > 64 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used + i.n > 64 THEN 0 ELSE b.item + 1 END FROM b JOIN i ON i.role = b.role AND i.k = b.k + 1)
    SELECT b.role, b.batch, b.item, left(i.text, 256) AS text FROM b JOIN i USING (role, k)""")
def token_batches(spark, sf_dir):
    return B.token_batches(table(spark, sf_dir, "conversations"), "role", ["conv_id", "turn"], "text", max_tokens=128, ratio=0.5, chars_per_token=4.0)


@query(f"""SELECT conv_id, CASE WHEN sum({TOKENS}) <= 64 THEN 'single-pass' ELSE 'map-reduce' END AS strategy FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def batch_strategies(spark, sf_dir):
    """Conversations that fit one batch, and others."""
    b = B.token_batches(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", max_tokens=128, ratio=0.5, chars_per_token=4.0)
    return B.strategies(b, "conv_id").select("conv_id", "strategy")


@query("SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, pos) - 1 AS position, w AS element FROM (SELECT role, conv_id, turn, pos, words[pos] AS w FROM (SELECT *, string_split(text, ' ') AS words FROM conversations), range(1, 100000) t(pos) WHERE pos <= len(words))")
def combined_elements(spark, sf_dir):
    """The words of all texts of a role, one list after the other, each with its position."""
    c = table(spark, sf_dir, "conversations").select("role", F.struct("conv_id", "turn").alias("o"), F.split("text", " ").alias("words"))
    return B.combined_elements(c, "role", "o", "words")


@query("SELECT role, string_agg(text, '|' ORDER BY conv_id, turn) AS words FROM conversations WHERE text <> '' GROUP BY role")
def combine_partials(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("o"), F.when(F.col("text") != "", F.array("text")).alias("words"))
    return B.combine_arrays(c, "role", "o", "words").select("role", F.array_join("words", "|").alias("words"))


@query("SELECT role, count(*) AS n, string_agg(text, '|' ORDER BY conv_id, turn) AS texts FROM conversations WHERE text <> '' GROUP BY role")
def combine_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 100 + F.col("turn")).alias("o"), "text")
    return B.combine_texts(c, "role", "o", "text").select("role", F.size("text").cast("long").alias("n"), F.array_join("text", "|").alias("texts"))


# Ingestion and tables

NAMES = ["A.java", "b.min.js", "c.png", "d_pb2.py", "E.TAR", "readme.md", "g.generated.ts", "h.go"]


FOLDERS = ["src", "node_modules", "src/deep/er", ".git", "lib/docs/x", "web"]


@query("""SELECT CASE page_id % 6 WHEN 0 THEN 'src' WHEN 2 THEN 'src/deep/er' ELSE 'web' END || '/page' || page_id || '.html' AS filepath, strlen(coalesce(html, '')) AS size, length(coalesce(html, '')) AS chars FROM pages WHERE page_id % 6 IN (0, 2, 5)""")
def source_tree(spark, sf_dir):
    """Every page as a file of a tree some of whose folders are ignored, and what a scan of the tree finds."""
    place = F.get(F.array(*(F.lit(f) for f in FOLDERS)), (F.col("page_id") % 6).cast("int"))
    pages = table(spark, sf_dir, "pages").select(F.concat(place, F.lit("/page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    with Scratch(spark, "tree") as tmp:
        root = tmp.claim("files", keep=True)
        write_files(pages, root)
    return I.scan(spark, root).select("filepath", "size", F.char_length(F.col("content").cast("string")).cast("long").alias("chars"))


@query("SELECT doc_id FROM (SELECT doc_id, doc_id % 8 AS k, CASE WHEN doc_id % 11 = 0 THEN '// Code generated by x' || chr(10) || text WHEN doc_id % 13 = 0 THEN ' ' || chr(10) ELSE text END AS c FROM documents) WHERE k IN (0, 5, 7) AND NOT c LIKE '// Code generated by%' AND trim(c, ' ' || chr(10)) <> ''")
def ingest_filters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("// Code generated by x\n"), "text")).when(F.col("doc_id") % 13 == 0, " \n").otherwise(F.col("text"))
    files = d.select("doc_id", F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 8).cast("int")).alias("filename"), content.alias("content"))
    files = I.without_generated_names(I.without_binary(files.withColumn("fileExtension", X.extension(F.col("filename")))))
    return I.without_empty(I.without_generated_headers(files)).select("doc_id")


TYPES = [("pom.xml", "maven", True), ("a.xml", "xml", True), ("README", "markdown", True), ("readme.txt", "markdown", False), ("Makefile", "makefile", True), ("makefile.am", "makefile", True), ("x.KT", "java", True), ("y.json", "default", True), (".env", "default", True), ("a.tar.gz", "default", True), ("z.html", "default", False), ("license.adoc", "markdown", False), ("Gemfile.lock", "ruby-bundler", True), ("n.csproj", "dotnet-proj", False), ("noext", "default", True), ("q.r", "default", True)]


@query(f'SELECT d.doc_id, v.t AS "canonicalType", v.code AS "isCode" FROM documents d JOIN {values([(k, *t) for k, t in enumerate(TYPES)], "k, name, t, code")} ON d.doc_id % {len(TYPES)} = v.k')
def canonical_types(spark, sf_dir):
    name = F.get(F.array(*(F.lit(n) for n, _, _ in TYPES)), (F.col("doc_id") % len(TYPES)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", X.canonical_type(F.col("name"), X.extension(F.col("name"))).alias("canonicalType"), X.is_code(X.extension(F.col("name"))).alias("isCode"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_skip(spark, sf_dir):
    return I.new_files(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS name FROM customer WHERE c_custkey % 5 = 0)
    SELECT coalesce(o.k, n.k) AS "projectName", coalesce(n.name, o.name) AS name, seg FROM o FULL JOIN n ON o.k = n.k""")
def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("projectName"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    new = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("projectName"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("name"))
    return store.upserted(old, new)


@query("""SELECT c_custkey AS "projectName", CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 3 <> 0""")
def update_existing(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("projectName"), F.col("c_name").alias("name"))
    new = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("projectName"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("name"))
    return store.updated(old, new)


@query("SELECT doc_id FROM documents WHERE source <> 'src0'")
def delete_project(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("projectName"), "doc_id")
    return store.without_project(d, "src0").select("doc_id")


@query("SELECT event_type AS owner, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def duplicate_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("owner"))
    repeated = A.duplicate_keys(e, "key", "owner")
    single = e.select("key", "owner").distinct().join(repeated.select("key"), "key", "left_anti")
    return repeated.select(F.explode("owners").alias("owner")).unionByName(single.select("owner")).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


# Functions

EVENT_STATUSES = (("click", "SUCCESS"), ("view", "FAILURE"), ("error", "SWITCH"), ("signup", "CROP"))


@query(f"""WITH s AS (SELECT v.s FROM events JOIN {values(list(EVENT_STATUSES), "k, s")} ON event_type = k) SELECT w.status, count(s.s) AS n FROM {values([(s,) for s in V.LLM_STATUSES], "status").replace(' AS v(', ' AS w(')} LEFT JOIN s ON s.s = w.status GROUP BY w.status UNION ALL SELECT 'TOTAL', count(*) FROM s WHERE s IN ('SUCCESS', 'FAILURE')""")
def llm_status_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.try_element_at(X.literal_map(EVENT_STATUSES), F.col("event_type")).alias("status"))
    return A.status_counts(e)


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_type IN ('view', 'error') THEN 'READ' WHEN event_type = 'click' THEN 'READ_WRITE' ELSE 'INVALID' END AS op, CASE WHEN event_type = 'click' THEN 'WRITE,INVALID' ELSE 'INVALID' END AS ops FROM events")
def enum_normalise(spark, sf_dir):
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    raw = F.when(F.col("event_id") % 4 == 3, None).when(kind.isin("view", "error"), "read").when(kind == "click", "Read_Write").otherwise(kind)
    many = F.when(kind == "click", F.array(F.lit("write"), F.lit(None), F.lit("odd"))).otherwise(F.array(kind))
    return e.select("event_id", X.normalise_enum(raw, V.OPERATION_TYPES).alias("op"), F.array_join(X.normalise_enums(many, V.OPERATION_TYPES), ",").alias("ops"))


MESSAGES = [
    ("bedrock", "ValidationException: 400 Bad Request: Too many input tokens. Max input tokens: 8192, request input token count: 9279", 9279, 0, 8192),
    ("bedrock", "expected maxLength: 50000, actual: 52611, please reformat", 134_685, 0, 128_000),
    ("bedrock", "This model's maximum context length is 8192 tokens. Please reduce", 8193, 0, 8192),
    ("openai", "This model's maximum context length is 8191 tokens, however you requested 10346 tokens (10346 in your prompt; 5 for the completion).", 10_346, 5, 8191),
    ("openai", "nothing known", 128_001, 0, 128_000),
    ("vertex-claude", "Prompt is too long: 9000 tokens > 8000 maximum", 9000, 0, 8000),
    ("vertex-gemini", "The input token count (1594712) exceeds the maximum number of tokens allowed (1048576)", 1_594_712, 0, 1_048_576),
]


@query(f"SELECT event_id, v.prompt, v.completion, v.most FROM events JOIN {values([(k, *m[2:]) for k, m in enumerate(MESSAGES)], 'k, prompt, completion, most')} ON event_id % {len(MESSAGES)} = k")
def error_tokens(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % len(MESSAGES)
    found = X.first_match([(k == i, X.error_tokens(F.lit(m), F.lit(100).cast("long"), p, F.lit(128_000).cast("long"))) for i, (p, m, *_) in enumerate(MESSAGES)])
    return e.select("event_id", found.alias("t")).select("event_id", *(F.col(f"t.{c}").cast("int").alias(c) for c in ("prompt", "completion", "most")))


@query("SELECT event_id, CAST(CASE WHEN 95 + event_id % 10 >= 95 AND event_id % 2 = 0 THEN floor(1000 * least(100 / (95.0 + event_id % 10 + 1), 0.75)) ELSE floor(1000 * least(200 / (150.0 + event_id % 100 + 1), 0.85)) END AS BIGINT) AS kept FROM events")
def prompt_crop(spark, sf_dir):
    e, even = table(spark, sf_dir, "events"), F.col("event_id") % 2 == 0
    completion = F.when(even, 95 + F.col("event_id") % 10).otherwise(0)
    prompt = F.when(even, 0).otherwise(150 + F.col("event_id") % 100)
    return e.select("event_id", X.cropped_length(F.lit(1000), prompt, completion, F.lit(200), F.lit(100)).alias("kept"))


@query("SELECT page_id, replace(url, '://', '://REDACTED:REDACTED@') AS redacted, 'REDACTED_URL' AS odd FROM pages")
def url_redaction(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    with_user = F.replace("url", F.lit("://"), F.lit("://me:secret@"))
    return p.select("page_id", X.redact_url(with_user).alias("redacted"), X.redact_url(F.lit("no url")).alias("odd"))


@query("SELECT o_orderkey, CAST(floor(length(o_orderpriority) * 100 / 3.6) AS BIGINT) AS tokens, CASE WHEN o_orderstatus = 'F' THEN 'Refactor into smaller, single-purpose methods' WHEN o_orderstatus = 'O' THEN 'Extract common code into reusable functions or utilities' ELSE 'Review and refactor as part of modernization effort' END AS advice FROM orders")
def advice_and_tokens(spark, sf_dir):
    smell = F.when(F.col("o_orderstatus") == "F", "LONG METHOD").when(F.col("o_orderstatus") == "O", "some Duplicate code").otherwise("X")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.estimated_tokens(F.char_length("o_orderpriority") * 100).alias("tokens"), X.smell_advice(smell).alias("advice"))


@query("""SELECT n_nationkey, 'Nation Key ' || n_nationkey AS title, '* ' || n_name || ': undefined ' || n_nationkey AS bullet, '#91;' || n_name || '#93;#quot;' AS label FROM nation""")
def labels_and_bullets(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    return n.select("n_nationkey", X.title_case(F.concat(F.lit("nationKey "), key)).alias("title"), X.summary_bullet(F.col("n_name"), F.lit(None).cast("string"), key).alias("bullet"), X.mermaid_label(F.concat(F.lit("["), "n_name", F.lit(']"'))).alias("label"))


# JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS mutated FROM events")
def json_fast_path(spark, sf_dir):
    got = J.repaired(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return got.select("event_id", F.get_json_object("repaired.json", "$.k").cast("long").alias("k"), F.col("repaired.mutated").alias("mutated"))


#: How a text is broken, as a format of the text's number, and the number that repair finds again.
BROKEN = ['{"k": %d,}', "```json\n{\"k\": %d}\n```", "Here it is: {'k': %d} I hope it helps", '{k: %d, "extra_text": "x"}', '{"k": %d /* c */, // d\n}', '{"k" %d', '{"k": %d]', '{“k”: %d', '{* "k": %d', '{"k": %d, "l": [1, 2}']


@query(f"SELECT event_id, event_id % 1000 AS k, event_id % 10 <> 1 AS mutated FROM events")
def json_repair(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    texts = [F.replace(F.lit(b.replace("%d", "%%")), F.lit("%%"), (F.col("event_id") % 1000).cast("string")) for b in BROKEN]
    broken = e.withColumn("t", F.get(F.array(*texts), (F.col("event_id") % len(BROKEN)).cast("int")))
    got = J.repaired(broken, "t")
    return got.select("event_id", F.get_json_object("repaired.json", "$.k").cast("long").alias("k"), F.coalesce("repaired.mutated", F.lit(False)).alias("mutated"))


@query(f"SELECT v.kind, n_nationkey AS n, replace(v.json, '%d', CAST(n_nationkey AS VARCHAR)) AS json FROM nation, {values([(kind, json.dumps(json.loads(whole.replace('%d', chr(34) + '%d' + chr(34))), ensure_ascii=False).replace(chr(34) + '%d' + chr(34), '%d')) for kind, _, whole in FORMS], 'kind, json')}")
def json_forms(spark, sf_dir):
    """Each kind of damage, with the key of each nation as its number."""
    forms = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(broken).alias("broken")) for kind, broken, _ in FORMS)))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), forms.alias("f"))
    texts = n.select("f.kind", "n", F.replace("f.broken", F.lit("%d"), F.col("n").cast("string")).alias("t"))
    return J.repaired(texts, "t").select("kind", "n", F.col("repaired.json").alias("json"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'INVALID' ELSE 'COMPLETED' END AS text_status, CASE WHEN event_id % 5 IN (2, 4) THEN 'COMPLETED' ELSE 'INVALID' END AS json_status, CASE WHEN event_id % 5 IN (2, 4) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def response_gate(spark, sf_dir):
    """Answers that are missing, blank, JSON, plain text and JSON that needs repair, held against the gate of both formats."""
    case = F.col("event_id") % 5
    content = F.when(case == 1, " \n\t ").when(case == 2, F.col("props")).when(case == 3, F.col("event_type")).when(case == 4, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    e = table(spark, sf_dir, "events").select("event_id", content.alias("content"))
    of_text = responses.gated(e, "content").select("event_id", "content", F.col("status").alias("text_status"))
    got = responses.gated(of_text, "content", responses.JSON, StructType([StructField("k", LongType())]))
    return got.select("event_id", "text_status", F.col("status").alias("json_status"), "generated.k")


@query("""WITH o AS (SELECT DISTINCT user_id FROM events WHERE event_id % 701 = 0) SELECT user_id AS "filepath", 'p' AS "projectName" FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT user_id FROM o WHERE user_id IS NOT NULL) GROUP BY 1""")
def unseen_rows(spark, sf_dir):
    """What a buffered writer adds: each user once, without those of the events that are there already."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select(F.lit("p").alias("projectName"), F.col("user_id").alias("filepath"), "event_id")
    return store.unseen(e.drop("event_id"), e.where("event_id % 701 = 0"), ("projectName", "filepath")).select("filepath", "projectName")


#: What is left of the name nationKey: its case, a beginning, an end, other separators, an inner part, a slip.
LEFT = ["NATIONKEY", "nati", "onKey", "nation_key", "tionK", "natoinKey"]


@query("SELECT s_suppkey AS k, s_nationkey AS \"nationKey\", s_name AS \"supplierName\", s_acctbal AS balance FROM supplier")
def restored_names(spark, sf_dir):
    """Suppliers as broken answers in which each of six things happened to a name, read with the schema."""
    name = F.get(F.array(*(F.lit(x) for x in LEFT)), (F.col("s_suppkey") % 6).cast("int"))
    text = F.concat(F.lit("{"), name, F.lit(": "), F.col("s_nationkey").cast("string"), F.lit(', "supplierName": "'), "s_name", F.lit('" "balance": '), F.col("s_acctbal").cast("string"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("t"))
    schema = StructType([StructField("nationKey", LongType()), StructField("supplierName", StringType(), False), StructField("balance", DoubleType())])
    return J.parsed(s, "t", schema).select("k", "parsed.*")


@query("SELECT event_id, CAST(event_id % 100 AS DOUBLE) AS a, event_id % 100 + 0.5 AS b, CAST(event_id % 100 AS DOUBLE) AS c, CAST(NULL AS DOUBLE) AS d FROM events")
def numeric_coercion(spark, sf_dir):
    n = (F.col("event_id") % 100).cast("string")
    texts = {"a": F.concat(F.lit(" "), n), "b": F.concat(F.lit("~"), n, F.lit(".5 items")), "c": F.concat(F.lit("about "), n, F.lit(" or more")), "d": F.lit("none")}
    return table(spark, sf_dir, "events").select("event_id", *(J.number_column(c).alias(k) for k, c in texts.items()))


@query("SELECT event_id, event_type || '|x' AS a, event_type || '|y' AS b, event_type || '|b|c' AS c, '' AS d, event_type || '|q' AS e FROM events")
def string_to_array(spark, sf_dir):
    k = F.col("event_type")
    texts = {"a": F.concat(F.lit("- "), k, F.lit("\n* x")), "b": F.concat(F.lit("1. "), k, F.lit("\n2) y")), "c": F.concat(k, F.lit(", b; c")), "d": F.concat(k, F.lit(", as it is, was. It ended.")), "e": F.concat(F.lit("['"), k, F.lit("', 'q']"))}
    return table(spark, sf_dir, "events").select("event_id", *(F.array_join(J.list_column(c), "|").alias(n) for n, c in texts.items()))


@query("""WITH o AS (SELECT o_orderstatus AS s, count(*) AS rows, count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderstatus IN ('F', 'O')) AS first_kept, count(*) FILTER (o_orderkey % 7 <> 0) AS second_kept FROM orders GROUP BY 1)
    SELECT s AS status, first_kept AS kept, rows - first_kept AS refused, CAST(1 AS INTEGER) AS version FROM o UNION ALL SELECT s, second_kept, rows - second_kept, 2 FROM o""")
def table_constraints(spark, sf_dir):
    """Orders written to a table that demands a clerk and knows two statuses, and to it again when a third was added: rows kept and refused by status and version."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("projectName"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 7 != 0, F.struct(F.col("o_orderpriority").alias("name"))).alias("clerk"))
    ddl, parts = "projectName string, key bigint, clerk struct<name: string>", []
    with Scratch(spark, "constraints") as tmp:
        for version, statuses in ((1, ["F", "O"]), (2, ["F", "O", "P"])):
            at, bad = tmp.claim("orders", keep=True), tmp.claim(f"refused{version}", keep=True)
            kept = store.create(spark, at, ddl, required=["key", "clerk", "clerk.name"], vocabularies={"projectName": statuses})
            store.insert(o.withColumn("key", F.col("key") + F.lit(version) * (1 << 40)), at, bad)
            good = store.read(spark, at).where(F.shiftright("key", 40) == version).groupBy(F.col("projectName").alias("status")).agg(F.count(F.lit(1)).alias("kept"))
            refused = spark.read.parquet(bad).groupBy(F.col("projectName").alias("status")).agg(F.count(F.lit(1)).alias("refused"))
            both = good.join(refused, "status", "full_outer").select("status", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("refused", F.lit(0)).alias("refused"), F.lit(kept.version).alias("version"))
            parts.append(both)
    return parts[0].unionByName(parts[1])


@query("SELECT user_id, min(event_id % 3) AS batch, true AS indexed FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def keyed_inserts(spark, sf_dir):
    """Users of events, inserted in three batches through an index of keys: each stands in the table once, from its first batch, and in the index."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select(F.lit("p").alias("projectName"), F.col("user_id").cast("string").alias("filepath"), (F.col("event_id") % 3).alias("batch"))
    with Scratch(spark, "keyed") as tmp:
        at, _ = tmp.claim("users", keep=True), tmp.claim("users-keys", keep=True)
        index = KeyIndex(spark, at, buckets=8)
        for b in range(3):
            store.insert_new(e.where(F.col("batch") == b), at, valid=F.lit(True), index=index)
        keys = index.keys().groupBy(F.get_json_object("key", "$[1]").alias("filepath")).agg((F.count(F.lit(1)) == 1).alias("indexed"))
    return store.read(spark, at).join(keys, "filepath").select(F.col("filepath").cast("long").alias("user_id"), "batch", "indexed")


@query("SELECT s_suppkey AS k, 'asked once: ' || s_name AS answer FROM supplier")
def resumed_calls(spark, sf_dir):
    """Prompts answered by a model and kept, then put to one that always fails: the answers that were kept stay."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("prompt"))
    chain = [C.Candidate("one")]
    with Scratch(spark, "calls") as tmp:
        kept = tmp.claim("answers", keep=True)
        tmp.save(C.map_prompts(s, lambda p, m: C.Response(C.COMPLETED, f"asked once: {p}"), chain, answers=kept), "first")
    return C.map_prompts(s, lambda p, m: C.Response(C.ERRORED), chain, answers=kept).select("k", "answer")


from . import inventory  # noqa: E402, F401  registers its queries, which are built from what stands above
