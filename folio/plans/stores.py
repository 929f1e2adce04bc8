"""Queries of the vector store, keyed streams, sinks, model calls and answers at depth, and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import markup as M
from folio.operators import blocks as B
from folio.operators import model_calls
from folio.operators import search as S
from folio.operators import vector_store as V
from folio.shared import shared_dir
from folio.sources import blobs
from folio.streaming import sinks, state
from folio.streaming import trace as X
from folio.tables import table

from .oracles import CANONICAL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOP = 10


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- vector store ------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as records of documents, forty of them."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("record_id"), (F.col("vec_id") % 40).alias("doc_id"), "embedding", "vec_id")


def asked(rows: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return rows.where("vec_id % 50 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("vector"))


@query
def vector_store_search(spark, sf_dir):
    """The nearest records of every asked vector by the lists that it probes."""
    rows = vectors(spark, sf_dir)
    found = V.search(V.build(rows), asked(rows), TOP)
    return found.select("query_id", "record_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query
def vector_store_recall(spark, sf_dir):
    """How many of the nearest records, found by comparison with all, the probed lists give too."""
    rows = vectors(spark, sf_dir)
    exact = S.nearest(rows, asked(rows), TOP).select("query_id", "record_id", F.lit(1).alias("due"))
    found = V.search(V.build(rows), asked(rows), TOP).select("query_id", "record_id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "record_id"], "left")
    return both.groupBy("query_id").agg(F.count("due").alias("due"), F.count("found").alias("found"))


@query
def vector_store_documents(spark, sf_dir):
    """The nearest records of five documents, all lists probed, so that the result is exact."""
    rows = vectors(spark, sf_dir)
    store = V.build(rows)
    found = V.search(store, asked(rows), TOP, probes=len(store.centroids), doc_ids=list(range(5)))
    return found.select("query_id", "record_id", F.round("distance", 5).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query
def vector_store_failures(spark, sf_dir):
    """Records that can't be stored, made from every ninth or so: their reasons, beside how many are stored."""
    rows, at = vectors(spark, sf_dir), F.col("vec_id") % 36
    broken = F.when(at == 9, F.slice("embedding", 1, 10)).when(at == 18, F.transform("embedding", lambda x, i: F.when(i != 7, x))).when(at == 27, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(at != 35, F.col("embedding"))
    store = V.build(rows.withColumn("embedding", broken).withColumn("record_id", F.when(at != 0, F.col("record_id"))))
    return store.failures.unionByName(store.vectors.select("record_id", "doc_id", F.lit("stored").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


ORACLES["vector_store_documents"] = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id::VARCHAR AS record_id, round(list_sum(list_transform(list_zip(v.e, q.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM v, v q WHERE q.vec_id % 50 = 0 AND v.vec_id % 40 < 5)
SELECT query_id, record_id, round(distance, 5) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS rank FROM d QUALIFY rank <= {TOP}"""
ORACLES["vector_store_failures"] = "SELECT CASE vec_id % 36 WHEN 0 THEN 'no id' WHEN 35 THEN 'no vector' WHEN 9 THEN 'other length' WHEN 18 THEN 'not finite' WHEN 27 THEN 'not finite' ELSE 'stored' END AS reason, count(*) AS n FROM embeddings GROUP BY 1"


# --- streams and sinks -------------------------------------------------------


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"


def appended(df: DataFrame, path: str) -> DataFrame:
    """All rows that a stream adds over what there is now, through the file sink, which keeps a batch once."""
    spark = df.sparkSession
    before = spark.conf.get(state.PROVIDER[0], None)
    spark.conf.set(*state.PROVIDER)
    try:
        made = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        made.awaitTermination()
    finally:
        spark.conf.unset(state.PROVIDER[0]) if before is None else spark.conf.set(state.PROVIDER[0], before)
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of files, as a stream of (run_id, event_id, at, event, props)."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.select(F.col("user_id").alias("run_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("event"), "props")


@query
def step_stream(spark, sf_dir):
    """Steps paired by keyed state over the events as a stream."""
    found = state.steps(event_stream(spark, sf_dir), "signup", ("purchase", "error"), ("error",))
    return appended(found, folder(spark, "steps"))


@query
def status_change_stream(spark, sf_dir):
    """Every change of a run's status by keyed state over the events as a stream."""
    return appended(state.status_changes(event_stream(spark, sf_dir), "purchase", "error"), folder(spark, "changes"))


def _sunk(spark: SparkSession, sf_dir: str) -> str:
    """The events as messages through the log sinks; the folder that holds the logs and the summary."""
    path = folder(spark, "logs")
    component = F.when(F.col("event") == "view", "search_index").when(F.col("event") == "click", "write")
    message = F.to_json(F.struct("event", component.alias("component"), F.col("event_id").alias("duration_ms"), "props"))
    rows = event_stream(spark, sf_dir).select(F.col("run_id").cast("string"), F.timestamp_micros("at").alias("at"), message.alias("message"), F.col("event").alias("value"))
    updates = lambda batch: batch.select(F.col("run_id").alias("key"), "value", F.unix_micros("at").alias("at"))
    made = rows.writeStream.foreachBatch(sinks.log_sink(path, X.recorded, updates)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    made.awaitTermination()
    return path


@query
def log_sinks(spark, sf_dir):
    """Both logs after all events went through the sinks, by component and event."""
    path = _sunk(spark, sf_dir)
    logs = [sinks.read_log(spark, f"{path}/logs", name).withColumn("log", F.lit(name)) for name in sinks.LOGS]
    return logs[0].unionByName(logs[1]).groupBy("log", "component", "event").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"), F.countDistinct("run_id").alias("runs"))


@query
def log_summary(spark, sf_dir):
    """The summary after all events went through the sinks: the last event of every run."""
    return sinks.read_summary(spark, f"{_sunk(spark, sf_dir)}/summary").select("key", "at")


TRACE = "tr AS (SELECT user_id AS run_id, event_id, epoch_us(ts) AS us, event_type AS event FROM events)"
ORACLES["step_stream"] = f"""WITH {TRACE}, s AS (SELECT *, lead(event) OVER w AS ended_by, lead(us) OVER w AS ended FROM tr WHERE event IN ('signup', 'purchase', 'error') WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id))
SELECT run_id, event_id, ended_by, (ended - us) // 1000 AS duration_ms, ended_by = 'error' AS failed FROM s WHERE event = 'signup' AND ended_by IN ('purchase', 'error')"""
ORACLES["status_change_stream"] = f"""WITH {TRACE}, s AS (SELECT *, CASE event WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, row_number() OVER w AS n_events FROM tr WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id)),
c AS (SELECT *, lag(status, 1, 'not_started') OVER (PARTITION BY run_id ORDER BY us, event_id) AS before FROM s) SELECT run_id, event_id, status, n_events FROM c WHERE status <> before"""
ORACLES["log_sinks"] = """WITH r AS (SELECT CASE event_type WHEN 'view' THEN 'search_index' WHEN 'click' THEN 'write' ELSE 'trace' END AS component, event_type AS event, event_id, user_id FROM events)
SELECT log, component, event, count(*) AS n, sum(event_id)::DOUBLE AS ms, count(DISTINCT user_id) AS runs FROM (SELECT *, unnest(CASE WHEN component LIKE 'search%' THEN ['events', 'search'] ELSE ['events'] END) AS log FROM r) GROUP BY 1, 2, 3"""
ORACLES["log_summary"] = 'SELECT user_id::VARCHAR AS key, epoch_us(max(ts)) AS "at" FROM events GROUP BY 1'


# --- files, model calls, answers ---------------------------------------------


@query
def blob_files(spark, sf_dir):
    """Every page's whole markup and a line feed as a file through the two-phase sink, read back."""
    path = folder(spark, "blobs")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("name"), F.encode(F.concat(F.coalesce("html", F.lit("")), F.lit("\n")), "UTF-8").alias("content"))
    blobs.write_blobs(rows, path)
    return blobs.read_blobs(spark, path).select("name", "length", F.md5("content").alias("md5"))


@query
def font_files(spark, sf_dir):
    """A font file for every customer, made of a name table alone, some broken, through the sink and the font scan."""
    path, number = folder(spark, "fonts"), F.col("c_custkey")
    text = F.encode("c_name", "UTF-16BE")
    two = lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    four = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    names = F.concat(F.unhex(F.lit("0000000100120003000104090004")), two(F.octet_length(text)), F.unhex(F.lit("0000")), text)
    made = F.concat(F.unhex(F.lit("00010000000100000000" + "0000")), F.encode(F.lit("name"), "UTF-8"), F.unhex(F.lit("00000000")), four(F.lit(28)), four(F.octet_length(names)), names)
    content = F.when(number % 10 == 3, F.substring(made, 1, 20)).otherwise(made)
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), number, F.when(number % 10 == 4, ".otf").otherwise(".ttf")).alias("name"), content.alias("content"))
    blobs.write_blobs(rows, path)
    return blobs.fonts(spark, path)


@query
def document_nested(spark, sf_dir):
    """Documents in answers that are JSON in JSON, up to three levels, under any of the known keys."""
    full = F.concat(F.lit('<document id="output">'), F.coalesce("html", F.lit("")), F.lit("</document>"))
    # Slashes are escaped, as in answers made for scripts, so that only the decoded text holds a document.
    once = lambda c, key: F.concat(F.lit("Here: "), F.replace(F.to_json(F.struct(F.lit("x").alias("note"), c.alias(key))), F.lit("</"), F.lit("<\\/")))
    levels = [full, once(full, "html"), once(once(full, "output"), "content"), once(once(once(full, "content"), "html"), "document")]
    answer = F.element_at(F.array(*levels), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(M.document_block(answer)).alias("document_md5"))


def stub_model(payload: str, attempt: int) -> str:
    """Stands in for a model: by the block's number it fails, answers wrongly once or always, or answers well."""
    held = json.loads(payload)
    k = held["k"]
    if k % 17 == 0:
        raise RuntimeError("no answer")
    if k % 13 == 0 or (k % 11 == 0 and attempt == 0):
        return "I can't say."
    role = "oddity" if k % 7 == 0 else "body"
    return json.dumps({"block_id": held["block_id"], "generic_role": role, "domain_role": "supporting_argument", "role_confidence": 0.9, "reason": "r"})


@query
def model_driver(spark, sf_dir):
    """All blocks of all documents through the model driver, with a stand-in for the model."""
    rows = B.canonical(B.derived(table(spark, sf_dir, "documents"))).withColumn("k", F.col("doc_id") + F.col("reading_order"))
    blocks = rows.select("block_id", "quality", ((F.length("text") > 0) | F.col("label").isin("table", "chart", "image")).alias("eligible"), F.to_json(F.struct("block_id", "k", "label", "text")).alias("payload"))
    found = model_calls.decide(blocks, stub_model)
    return found.select("block_id", "source", "fallback_reason", "generic_role", "domain_role", "needs_review", F.col("attempts").cast("long").alias("attempts"))


ORACLES["blob_files"] = "SELECT 'page-' || page_id || '.html' AS name, strlen(coalesce(html, '')) + 1 AS length, md5(coalesce(html, '') || chr(10)) AS md5 FROM pages"
ORACLES["font_files"] = "SELECT 'f' || c_custkey || '.ttf' AS name, CASE WHEN c_custkey % 10 <> 3 THEN c_name END AS font FROM customer WHERE c_custkey % 10 <> 4"
ORACLES["document_nested"] = """SELECT page_id, md5(regexp_extract('<document id="output">' || coalesce(html, '') || '</document>', '<document\\b[^>]*>.*?</document>', 0, 'si')) AS document_md5 FROM pages"""
ORACLES["model_driver"] = f"""WITH {CANONICAL}, a AS (SELECT block_id, doc_id + reading_order AS k, quality, length(text) > 0 OR label IN ('table', 'chart', 'image') AS eligible FROM canonical),
b AS (SELECT *, CASE WHEN NOT eligible THEN 'ineligible_block' WHEN quality < 0.55 THEN 'low_page_quality' WHEN k % 17 = 0 THEN 'backend_error' WHEN k % 13 = 0 THEN 'invalid_json' WHEN k % 7 = 0 THEN 'schema_mismatch' END AS fallback_reason FROM a)
SELECT block_id, CASE WHEN fallback_reason IS NULL THEN 'model' ELSE 'fallback' END AS source, fallback_reason, CASE WHEN fallback_reason IS NULL THEN 'body' ELSE 'unknown' END AS generic_role, CASE WHEN fallback_reason IS NULL THEN 'supporting_argument' END AS domain_role,
  fallback_reason IS NOT NULL AS needs_review, CASE WHEN NOT eligible OR quality < 0.55 THEN 0 WHEN k % 17 = 0 THEN 1 WHEN k % 13 = 0 OR k % 11 = 0 OR k % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM b"""
