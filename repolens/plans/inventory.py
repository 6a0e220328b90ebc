"""Further queries over the driver's tables, for functions and operators that no other query shows on its own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import scalars as X
from ..functions import vocab as V
from ..functions.jsonrepair import columns as J
from ..operators import batching as B
from ..operators import completion as C
from ..operators import prompts as PR
from ..operators import select as S
from ..scratch import Scratch
from ..sources import ingest as I
from ..sources import sinks
from ..sources.tree import write_files
from .queries import MECHANISM, TOKENS, event_files, nation_summaries, query, table


@query("SELECT doc_id, doc_id || '.' || lang AS name, coalesce(lang, '') || '/' || doc_id || '.' || lang AS below, '/other/' || doc_id AS outside FROM documents")
def path_parts(spark, sf_dir):
    """Names and relative paths of files, and a path that isn't below the root."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/data/x/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"))
    outside = X.relative_path(F.lit("/data/x"), F.concat(F.lit("/other/"), F.col("doc_id").cast("string")))
    return d.select("doc_id", X.basename(F.col("path")).alias("name"), X.relative_path(F.lit("/data/x/"), F.col("path")).alias("below"), outside.alias("outside"))


@query("""SELECT o_orderkey, CASE level WHEN 'Very High' THEN 'badge-danger' WHEN 'High' THEN 'badge-high' WHEN 'Medium' THEN 'badge-warning' WHEN 'Low' THEN 'badge-success' END AS coupling, CASE level WHEN 'Very High' THEN 'badge-danger' WHEN 'High' THEN 'badge-warning' WHEN 'Low' THEN 'badge-success' END AS debt
    FROM (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'Very High' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '4' THEN 'none' ELSE 'Low' END AS level FROM orders)""")
def level_classes(spark, sf_dir):
    first = F.left("o_orderpriority", F.lit(1))
    level = F.when(first == "1", "Very High").when(first == "2", "High").when(first == "3", "Medium").when(first == "4", "none").otherwise("Low")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.level_class(level, V.COUPLING_CLASSES).alias("coupling"), X.level_class(level, V.DEBT_CLASSES).alias("debt"))


@query("SELECT conv_id, turn, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM conversations")
def prefixed_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.join_lines(F.split("text", "\n"), "\n", "> ").alias("quoted"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END AS found FROM events")
def first_values(spark, sf_dir):
    """The first of two nested fields that is there."""
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, F.struct(F.struct(F.col("event_type").alias("x")).alias("b"))).alias("a"), F.struct(F.when(k == 1, F.col("user_id").cast("string")).alias("y")).alias("c"))
    return e.select("event_id", X.first_of("a.b.x", "c.y").alias("found"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S-%gZ') AS name FROM events")
def file_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.file_timestamp(F.col("ts")).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS plain, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '{"status":"' || o_orderstatus || '","keys":[' || o_custkey || ']}' END AS nested FROM orders""")
def table_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    plain = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    nested = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.col("o_orderstatus").alias("status"), F.array("o_custkey").alias("keys")))
    return o.select("o_orderkey", X.table_cell(plain).alias("plain"), X.table_cell(nested, nested=True).alias("nested"))


@query("""WITH s AS (SELECT s_suppkey, (s_suppkey % 63) * 0.1 AS a, (s_suppkey % 63) * 0.1 + (s_suppkey % 7) * 0.9 AS b FROM supplier)
    SELECT s_suppkey, printf('M 10.00 20.00 L %.2f %.2f A 5.00 5.00 0 %s 1 %.2f %.2f Z', 10 + 5 * cos(a), 20 + 5 * sin(a), CASE WHEN b - a > pi() THEN '1' ELSE '0' END, 10 + 5 * cos(b), 20 + 5 * sin(b)) AS path, 'hsl(' || CAST((((s_suppkey - 15) * 137.5) % 360 + 360) % 360 AS DOUBLE) || ', 65%, 55%)' AS colour FROM s""")
def slice_shapes(spark, sf_dir):
    k = F.col("s_suppkey")
    start = (k % 63) * F.lit(0.1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.slice_path(start, start + (k % 7) * F.lit(0.9), 5, 10, 20).alias("path"), X.slice_colour(k).alias("colour"))


#: A schema whose fields mustn't be null, and an answer of each kind that the transforms mend, as formats of a number.
COERCED = StructType([
    StructField("k", LongType(), False), StructField("name", StringType()), StructField("fields", StringType()), StructField("note", StringType()),
    StructField("items", ArrayType(StructType([StructField(x, LongType(), False) for x in "abcd"]))),
])
ANSWERS = ['{"k": %d, "items": [{"a": 1, "b": 2, "c": 3, "d": 4}, {"a": 1, "b": 2, "c": 3, "d": 4}, {"a": 1}]}', '{"k": %d, "name": "n", "fields": null}', '{"k": %d, "note": null, "name": "x"}', '{"k_": %d}', '{"type": "object", "properties": {"k": %d, "name": "p"}}', '{"k": "about %d or so"}', '{"k": %d, "items": [{"a": 1}]}']


@query("""SELECT event_id, CASE WHEN event_id % 7 < 6 THEN user_id END AS k, CASE event_id % 7 WHEN 1 THEN 'n' WHEN 2 THEN 'x' WHEN 4 THEN 'p' END AS name, CASE WHEN event_id % 7 = 1 THEN '' END AS fields, CASE WHEN event_id % 7 = 0 THEN 2 END AS items, event_id % 7 = 6 AS failed FROM events WHERE user_id IS NOT NULL""")
def coerced_answers(spark, sf_dir):
    """Answers that are JSON but don't fit: an item that breaks off, null fields, other nulls, a trailing mark, a schema around the data, a number in a text; and one that can't be mended."""
    e = table(spark, sf_dir, "events").where("user_id is not null").select("event_id", "user_id")
    texts = [F.replace(F.lit(a), F.lit("%d"), F.col("user_id").cast("string")) for a in ANSWERS]
    got = J.parsed(e.withColumn("t", F.get(F.array(*texts), (F.col("event_id") % len(ANSWERS)).cast("int"))), "t", COERCED)
    return got.select("event_id", "parsed.k", "parsed.name", "parsed.fields", F.when(F.col("parsed.items").isNotNull(), F.size("parsed.items")).alias("items"), F.col("parsed_error").isNotNull().alias("failed"))


@query("SELECT 'requirement' || s_suppkey || '.prompt' AS filename, 'Describe ' || s_name AS prompt FROM supplier WHERE s_suppkey % 2 = 0")
def prompt_files(spark, sf_dir):
    """Prompts written as files, those of other names among them, and read again."""
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 2 == 0, "requirement").otherwise("note"), k.cast("string"), F.lit(".prompt"))
    rows = table(spark, sf_dir, "supplier").select(name.alias("path"), F.concat(F.lit(" \n Describe "), "s_name", F.lit("\n\n")).alias("content"))
    with Scratch(spark, "prompts") as tmp:
        root = tmp.claim("files", keep=True)
        write_files(rows, root)
    return I.read_prompts(spark, root)


@query("SELECT 'What is ' || n_name || '?' AS question FROM nation WHERE n_nationkey % 3 <> 1")
def question_lists(spark, sf_dir):
    """Questions of a list with comments and blank lines."""
    k = F.col("n_nationkey")
    line = F.concat(F.when(k % 3 == 1, "# ").otherwise("  "), F.lit("What is "), "n_name", F.lit("? \n\n"))
    with Scratch(spark, "questions") as tmp:
        path = tmp.claim("lists", keep=True)
        table(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    return I.read_questions(spark, path)


@query("SELECT brand, count(*) AS lines, sum(length(line)) AS chars FROM (SELECT p_brand AS brand, p_name || ' of ' || p_type AS line FROM part) GROUP BY brand")
def prompt_results(spark, sf_dir):
    """Texts by name, written to a folder each, and read again."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat("p_name", F.lit(" of "), "p_type").alias("text"))
    with Scratch(spark, "results") as tmp:
        path = tmp.claim("texts", keep=True)
        sinks.write_texts(p, path, "brand")
    return spark.read.text(path).groupBy(F.col("name").alias("brand")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("value")).alias("chars"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS "projectName", 'about ' || n_regionkey AS "appDescription", 'm' AS "llmModels", count(*) AS services FROM nation WHERE n_regionkey = 1 GROUP BY n_regionkey""")
def summary_fields(spark, sf_dir):
    """The fields of a project's summary that two sections need, each once."""
    fields = S.required_fields(["potentialMicroservices"], ["potentialMicroservices", "llmModels"])
    return S.fields_of(nation_summaries(spark, sf_dir), "1", fields).select("projectName", "appDescription", "llmModels", F.size("potentialMicroservices").cast("long").alias("services"))


@query(f"""WITH m AS (SELECT DISTINCT {MECHANISM} AS mechanism FROM events WHERE event_type <> 'error' AND ({MECHANISM}) IS DISTINCT FROM 'NONE') SELECT mechanism, row_number() OVER (ORDER BY mechanism NULLS FIRST) AS place, true AS together FROM m""")
def integration_order(spark, sf_dir):
    """The order of database integrations: the places of mechanisms, missing ones first, whose rows stand together."""
    rows = S.database_integrations(event_files(spark, sf_dir)).select("mechanism", F.monotonically_increasing_id().alias("at"))
    by = rows.groupBy("mechanism").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    other = by.select(F.col("mechanism").alias("m"), F.col("first").alias("f"), F.col("last").alias("l"))
    pairs = by.join(F.broadcast(other))  # a row per mechanism on either side
    return pairs.groupBy("mechanism").agg(F.count_if(F.col("f") <= F.col("first")).alias("place"), F.bool_and(F.col("mechanism").eqNullSafe(F.col("m")) | (F.col("l") < F.col("first")) | (F.col("f") > F.col("last"))).alias("together"))


@query(f"""WITH RECURSIVE i AS (SELECT conv_id, {TOKENS} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE text IS NOT NULL),
    b AS (SELECT conv_id, k, n AS used, 1 AS batches FROM i WHERE k = 1 UNION ALL SELECT i.conv_id, i.k, CASE WHEN b.used + i.n > 64 THEN i.n ELSE b.used + i.n END, CASE WHEN b.used + i.n > 64 THEN b.batches + 1 ELSE b.batches END FROM b JOIN i ON i.conv_id = b.conv_id AND i.k = b.k + 1),
    n AS (SELECT conv_id, max(batches) AS n FROM b GROUP BY conv_id)
    SELECT conv_id, CASE WHEN n = 1 THEN 'single-pass' ELSE 'map-reduce' END AS strategy, CASE WHEN n = 1 THEN 'batch' ELSE 'whole of ' || n END AS answer, CASE WHEN n = 1 THEN 1 ELSE n + 1 END AS calls FROM n""")
def map_reduced(spark, sf_dir):
    """Conversations answered batch by batch, and the answers of several batches put into one more prompt."""
    batches = B.token_batches(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", max_tokens=128, ratio=0.5, chars_per_token=4.0)

    def model(prompt, name):
        parts = prompt.count('"batch"')
        return C.Response(C.COMPLETED, f"whole of {parts}" if parts else "batch")

    got = C.map_reduce(batches, "conv_id", model, [C.Candidate("one")], "Sum up:", sleep=lambda s: None)
    return got.select("conv_id", "strategy", "answer", F.size("events").alias("calls"))


@query("""SELECT p_partkey, CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN 'large: ' || p_partkey ELSE 'small: ' || p_partkey END AS answer, CASE k WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'OVERLOAD_RETRY,SUCCESS' WHEN 2 THEN 'HOPEFUL_RETRY,SUCCESS' WHEN 3 THEN 'SWITCH,SUCCESS' ELSE 'FAILURE' END AS events FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)""")
def model_outcomes(spark, sf_dir):
    """Retries after overload and invalid answers, a switch to the next model after too long a prompt, and an error, which ends a call."""
    seen: set[str] = set()

    def model(prompt, name):
        k = int(prompt) % 5
        if k in (1, 2) and prompt not in seen:
            seen.add(prompt)
            return C.Response(C.OVERLOADED if k == 1 else C.INVALID)
        if k == 3 and name == "small":
            return C.Response(C.EXCEEDED)
        return C.Response(C.ERRORED) if k == 4 else C.Response(C.COMPLETED, f"{name}: {prompt}")

    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("prompt"))
    got = C.map_prompts(p, model, C.candidates([C.Candidate("never"), C.Candidate("small"), C.Candidate("large")], 1), sleep=lambda s: None)
    return got.select("p_partkey", "answer", F.array_join("events", ",").alias("events"))


PERSONA_SQL = "'You are an experienced developer who studies the code of an existing application. The section '"
SCHEMA_SQL = """'Answer with JSON of this schema and nothing else:' || chr(10) || '{"type": "object"}'"""


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn % 5 AS k, chr(10) || chr(10) AS gap FROM conversations),
    p AS (SELECT conv_id, turn, CASE
    WHEN k = 0 THEN {PERSONA_SQL} || 'CODE below holds a class. From it, give:' || gap || '__Basics__' || chr(10) || '* Its name' || chr(10) || '* Its purpose' || chr(10) || '* Smells' || gap || {SCHEMA_SQL} || gap || 'Names are whole.' || gap || 'CODE:' || chr(10) || '```' || chr(10) || text || chr(10) || '```'
    WHEN k = 1 THEN {PERSONA_SQL} || 'FILE_SUMMARIES below holds summaries of files. From it, give:' || gap || '* Technologies' || gap || {SCHEMA_SQL} || gap || CASE WHEN conv_id % 2 = 0 THEN 'These are a part of many more file summaries; tell only what this part shows.' || gap ELSE '' END || 'FILE_SUMMARIES:' || chr(10) || text
    WHEN k = 2 THEN {PERSONA_SQL} || 'FRAGMENTED_DATA below holds partial results for ''technologies'' as JSON, which may repeat each other. From it, give:' || gap || '* One list of ''technologies'' without repeats' || gap || {SCHEMA_SQL} || gap || 'FRAGMENTED_DATA:' || chr(10) || text
    WHEN k = 3 THEN {PERSONA_SQL} || 'CODE below holds files of it. Answer the QUESTION in a few paragraphs, and name the places in the code that the answer rests on.' || gap || 'QUESTION:' || chr(10) || 'Why ' || conv_id || '?' || gap || 'CODE:' || chr(10) || text END AS prompt FROM c)
    SELECT conv_id, turn, length(prompt) AS chars, md5(prompt) AS digest FROM p""")
def built_prompts(spark, sf_dir):
    """Prompts of each kind: for a file by type, for insights from all or a part of the summaries, for joining partial results, and for questions; types without a kind have none."""
    c = table(spark, sf_dir, "conversations")
    k, text, schema = F.col("turn") % 5, F.col("text"), {"type": "object"}
    kinds = {"class": PR.Kind("a class", [("Basics", ["Its name", "Its purpose"]), "Smells"], schema, fenced=True, note="Names are whole.")}
    insight = PR.Kind("summaries of files", ["Technologies"], schema, PR.FILE_SUMMARIES)
    prompt = F.when(k == 1, PR.insight_prompt(insight, text, F.col("conv_id") % 2 == 0)).when(k == 2, PR.reduce_prompt("technologies", schema, text)).when(k == 3, PR.query_prompt(F.concat(F.lit("Why "), F.col("conv_id").cast("string"), F.lit("?")), text))
    prompt = prompt.otherwise(PR.source_prompt(kinds, F.when(k == 0, "class").otherwise("other"), text))
    return c.select("conv_id", "turn", F.char_length(prompt).cast("long").alias("chars"), F.md5(prompt.cast("binary")).alias("digest"))
