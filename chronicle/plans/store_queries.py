"""Queries through files and streams: what is written and read again, and what streams leave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.time import iso_utc
from chronicle.operators import episodes, provenance, report, transcripts, upsert
from chronicle.plans import views
from chronicle.plans.catalogue import iso, query
from chronicle.plans.event_queries import _EVENTS, _numbered
from chronicle.plans.graph_queries import _LADDER
from chronicle.sources import capsules, chats, jsonl
from chronicle.streaming import sessions
from chronicle.streaming import upsert as stream_upsert
from chronicle.tables import shared_dir


def _new(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("s10_event_records", f"SELECT CAST(event_id AS VARCHAR) AS id, {iso('ts')} AS t_utc, event_type AS content, 'user' || user_id AS thread_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s10_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, read back."""
    path = _new(spark, "event-records")
    jsonl.write(jsonl.event_records(views.events(spark, sf_dir)), path)
    back = jsonl.read_events(spark, path)
    return back.select("id", iso_utc(F.col("t_utc")).alias("t_utc"), "content", "thread_id", F.get_json_object("additional_data", "$.k").cast("bigint").alias("k"))


@query("s8_chat_export", "SELECT CAST(conv_id AS VARCHAR) AS conversation, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def s8_chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as one export file and loaded from its folder; messages of each."""
    folder = _new(spark, "chats")
    whole = views.chat_export(spark, sf_dir)
    whole.coalesce(1).write.json(f"{folder}/conversations.json")
    rows = spark.read.schema(chats.CHAT_EXPORT).option("mode", "FAILFAST").json(f"{folder}/conversations.json")
    return chats.messages(rows).groupBy("conversation").agg(F.count(F.lit(1)).alias("n"))


@query("p6_capsule_records", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS place_name, count(o_orderkey) AS n_media, CAST(coalesce(sum(CAST(trunc(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS bytes FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def p6_capsule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capsules with their media as JSON lines, read back; the sizes of each one's media."""
    path = _new(spark, "capsules")
    c, m = views.capsule_tables(spark, sf_dir)
    jsonl.write(jsonl.capsule_records(capsules.with_media(c, m.withColumn("exif_t", F.lit(None).cast("timestamp")))), path)
    places, media = jsonl.read_capsules(spark, path)
    sums = media.groupBy("capsule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("byte_size").alias("bytes"))
    joined = places.join(sums, F.col("id") == F.col("capsule_id"), "left")
    return joined.select("id", "place_name", F.coalesce("n", F.lit(0)).alias("n_media"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query(
    "k8_bank",
    _numbered(720).rstrip()
    + f""",
t AS (SELECT thread_id, episode, string_agg((CASE WHEN role = 'self' THEN 'me' ELSE thread_id END) || ': ' || content, chr(10) ORDER BY t_utc, seq) AS content FROM n GROUP BY thread_id, episode)
SELECT substr(sha256(t.thread_id || chr(0) || first_id || chr(0) || {iso("a")}), 1, 16) AS id, t.content FROM t JOIN g USING (thread_id, episode)""",
)
def k8_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank after two loads, the second with the later half of the events too: grown episodes have one document."""
    path, e = _new(spark, "banks"), views.events(spark, sf_dir)
    half = e.agg(F.expr("timestamp_micros(cast((min(unix_micros(cast(t_utc as timestamp))) + max(unix_micros(cast(t_utc as timestamp)))) / 2 as bigint))").alias("t")).first().t
    for rows in (e.where(F.col("t_utc") < F.lit(half)), e):
        transcripts.retain(transcripts.documents(episodes.build(rows, 720)), path, "me")
    return transcripts.bank_table(spark, path, "me").read().select("id", "content")


@query(
    "k10_graph_json",
    f"""WITH {_LADDER}, ch AS (SELECT id FROM pc ORDER BY confidence * ln(n_events + 1) DESC, confidence DESC, id LIMIT 40)
SELECT (SELECT count(*) FROM ch) AS principles, (SELECT count(*) FROM ch WHERE id + 1 IN (SELECT id FROM ch)) AS edges, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT id FROM ch)) AS memories""",
)
def k10_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the 40 principles of most weight as one JSON text, and how much of each kind stands in it."""
    x = views.ladder(spark, sf_dir)
    chosen = provenance.top_principles(provenance.principle_counts(x["principles"], x["links"], x["memory_events"]), 40)
    parts = provenance.slice_of(chosen.select("id"), x["edges"], x["links"], x["edge_links"], x["memory_events"], x["events"])
    made = provenance.graph_json(chosen, parts["edges"], x["memories"].join(parts["memories"], "memory_id", "left_semi"), "user")
    size = lambda name: F.size(F.variant_get("v", f"$.{name}", "array<variant>")).cast("bigint").alias(name)
    return made.select(F.parse_json(F.col(made.columns[0])).alias("v")).select(*[size(n) for n in ("principles", "edges", "memories")])


@query("r10_people_lines", "SELECT s_name AS line, min(l_returnflag || l_partkey || l_linenumber) AS note FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY count(*) DESC, s_name LIMIT 25")
def r10_people_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people of the report as its lines and notes."""
    li, s = views.table(spark, sf_dir, "lineitem"), views.table(spark, sf_dir, "supplier")
    text = F.concat("l_returnflag", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    seen = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("s_name").alias("name"), F.lit(0).alias("t"), text.alias("text"))
    return report.persons(seen).rows.select("line", F.get("notes", F.lit(0)).alias("note"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of several files."""
    path = _new(spark, "stream")
    e = views.events(spark, sf_dir)
    e.repartitionByRange(3, "ingest_seq").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("t_utc", F.col("t_utc").cast("timestamp"))


def _left(spark: SparkSession, made: DataFrame, label: str) -> DataFrame:
    """What a stream leaves in its files once it has read all there is."""
    path = _new(spark, label)
    made.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


@query("t1s_stream_upsert", f"WITH {_EVENTS} SELECT id, content FROM e")
def t1s_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = upsert.EventTable(spark, _new(spark, "streamed"))
    stream_upsert.start(_stream(spark, sf_dir), table, f"{table.path}-progress").awaitTermination()
    return table.read().select("id", "content")


@query("t3s_closed_episodes", _numbered(30) + f"SELECT thread_id, substr(sha256(thread_id || chr(0) || first_id || chr(0) || {iso('a')}), 1, 16) AS episode_id, {iso('a')} AS start_utc, {iso('b')} AS end_utc, n_events, first_id FROM g WHERE epoch_us(b) + 1800000000 < (SELECT (epoch_ms(max(ts)) - 86400000) * 1000 FROM events)")
def t3s_closed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed episodes by the stateful processor; the stream is in order of time but for a day."""
    name, before = sessions.STORE[0], spark.conf.get(sessions.STORE[0], None)
    spark.conf.set(*sessions.STORE)
    try:
        made = _left(spark, sessions.closed_episodes(_by_time(spark, sf_dir), late_minutes=24 * 60), "closed")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return made.select("thread_id", "episode_id", iso_utc(F.col("start_utc")).alias("start_utc"), iso_utc(F.col("end_utc")).alias("end_utc"), "n_events", "first_id")


def _by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files by ranges of time, each of a task's size; all come in one batch, as files of one folder have no order."""
    path = _new(spark, "by-time")
    e = views.events(spark, sf_dir).withColumn("t_utc", F.col("t_utc").cast("timestamp"))
    e.repartitionByRange("t_utc").write.parquet(path)
    return spark.readStream.schema(e.schema).parquet(path)


@query("t2s_sessions", _numbered(30) + f"SELECT thread_id, {iso('a')} AS start_utc, {iso('b')} AS end_utc, n_events FROM g WHERE epoch_us(b) + 1800000001 <= (SELECT (epoch_ms(max(ts)) - 86400000) * 1000 FROM events)")
def t2s_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions by Spark's own session windows."""
    made = _left(spark, sessions.sessions(_by_time(spark, sf_dir), late_minutes=24 * 60), "sessions")
    return made.select("thread_id", iso_utc(F.col("start_utc")).alias("start_utc"), iso_utc(F.col("end_utc")).alias("end_utc"), "n_events")
