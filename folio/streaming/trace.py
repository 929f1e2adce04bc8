"""Event logs of runs, as batch queries and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

TAIL = 120


def route(events: DataFrame) -> DataFrame:
    """Default component and event, and whether an event also goes to the search log."""
    component = F.coalesce(F.nullif("component", F.lit("")), F.lit("trace"))
    event = F.coalesce(F.nullif("event", F.lit("")), F.lit("message"))
    return events.withColumn("component", component).withColumn("event", event).withColumn("to_search", component.startswith("search"))


def _utc(at: Column) -> tuple[Column, Column]:
    """Whole seconds as ``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session's zone, and the microseconds beside them."""
    micros = F.unix_micros(at)
    seconds = F.make_dt_interval(secs=F.floor(micros / F.lit(1000000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return (F.lit("1970-01-01").cast("timestamp_ntz") + seconds).cast("string"), F.lpad(F.pmod(micros, F.lit(1000000)).cast("string"), 6, "0")


def utc_time(at: Column) -> Column:
    whole, micros = _utc(at)
    return F.concat(F.replace(whole, F.lit(" "), F.lit("T")), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def epoch_seconds(at: Column) -> Column:
    return F.unix_micros(at) / 1000000


def run_name(at: Column) -> Column:
    """A run's id, from the time when it starts."""
    whole, micros = _utc(at)
    return F.concat(F.replace(F.translate(whole, "-:", ""), F.lit(" "), F.lit("T")), micros, F.lit("Z"))


ENVELOPE = ("event", "type", "component", "duration_ms")


def recorded(messages: DataFrame) -> DataFrame:
    """Rows of the event log from ``message`` (JSON): run_id, time, ts, component, event, duration_ms, payload, to_search.

    An object's own event, type, component and duration leave its payload;
    anything else is the message of a ``trace`` row.  A null payload is an
    empty one.  Rows of ``to_search`` also belong in the search log.
    """
    held = F.try_parse_json("message")
    fields = F.when(F.ltrim("message").startswith("{") & held.isNotNull(), F.from_json("message", "map<string,variant>"))
    rows = messages.withColumn("fields", fields)

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.try_element_at("fields", F.lit(name)), "$", kind)

    is_object = F.col("fields").isNotNull()
    rest = F.map_filter("fields", lambda k, _: ~k.isin(*ENVELOPE))
    event = F.when(is_object, F.coalesce(F.nullif(field("event"), F.lit("")), F.nullif(field("type"), F.lit("")), F.lit("trace"))).otherwise("message")
    component = F.coalesce(F.nullif(field("component"), F.lit("")), F.lit("trace"))
    numeric = F.schema_of_variant(F.try_element_at("fields", F.lit("duration_ms"))).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    payload = F.when(is_object, F.when(F.size(rest) > 0, F.to_json(rest))).otherwise(F.to_json(F.struct("message")))
    return rows.select(
        "run_id", utc_time(F.col("at")).alias("time"), epoch_seconds(F.col("at")).alias("ts"), component.alias("component"), event.alias("event"),
        F.when(numeric, F.round(field("duration_ms", "double"), 3)).alias("duration_ms"), payload.alias("payload"), component.startswith("search").alias("to_search"),
    )


def latest(events: DataFrame) -> DataFrame:
    """run_id, event, event_id, ts of each run's last event."""
    return events.groupBy("run_id").agg(F.max_by("event", F.struct("ts", "event_id")).alias("event"), F.max(F.struct("ts", "event_id")).alias("at")).select("run_id", "event", F.col("at.ts").alias("ts"), F.col("at.event_id").alias("event_id"))


def status_of(event: Column, summary: Column | None = None) -> Column:
    """A run's status: the summary's where it has one, else by the last event."""
    by_event = F.when(event.isNull(), "not_started").when(event == "run_completed", "completed").when(event == "run_failed", "failed").otherwise("running")
    return by_event if summary is None else F.coalesce(F.nullif(summary, F.lit("")), by_event)


def tail(events: DataFrame, most: int = TAIL) -> DataFrame:
    order = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("from_end", F.row_number().over(order)).where(F.col("from_end") <= most)


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def step_durations(events: DataFrame, starts: str, ends: tuple[str, ...]) -> DataFrame:
    """Steps: each start paired with the run's next end before another start."""
    order = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = events.where(F.col("event").isin(starts, *ends))
    rows = rows.withColumn("next_event", F.lead("event").over(order)).withColumn("next_ts", F.lead("ts").over(order))
    done = rows.where((F.col("event") == starts) & F.col("next_event").isin(*ends))
    return done.select("run_id", "event_id", F.col("next_event").alias("ended_by"), ((_micros("next_ts") - _micros("ts")) / 1000).cast("long").alias("duration_ms"))


def last_value(updates: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Key-wise merge: the last value of each key wins."""
    return updates.groupBy(key).agg(F.max_by(value, order).alias(value))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that are objects; blank and broken lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("e"), "value")
    return parsed.where(F.col("e._bad").isNull() & F.ltrim("value").startswith("{")).select("e.*").drop("_bad")


def stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", pattern).load(path)


def status_counts(events: DataFrame) -> DataFrame:
    """Running number of events and the last one of each run; update mode keeps one row a run as state."""
    return events.groupBy("run_id").agg(F.count("*").alias("n_events"), F.max(F.struct("ts", "event_id", "event")).alias("last")).select("run_id", "n_events", F.col("last.event").alias("event"))


def drain(df: DataFrame, folder: str, key: str) -> DataFrame:
    """Run a stream of updated rows over what there is now, into Parquet files; the last update of each ``key``.

    Each batch writes its own folder, so a batch that is run again replaces its
    files; nothing passes through the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField("__batch", IntegerType())])
    spark.createDataFrame([], schema).write.parquet(f"{folder}/rows/batch=none")  # a stream without rows has a result too
    query = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    last = F.max_by(F.struct(*df.columns), "__batch")
    return rows.groupBy(key).agg(last.alias("last")).select("last.*")
