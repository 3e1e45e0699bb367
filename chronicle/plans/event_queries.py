"""Queries on canonical events: episodes, upserts, ids, transcripts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.ids import chat_id, clocked_id
from chronicle.functions.text import contact_label, shorten
from chronicle.functions.time import from_ns_2001, iso_utc, to_ns_2001
from chronicle.operators import episodes, transcripts, upsert
from chronicle.plans import views
from chronicle.plans.catalogue import iso, query
from chronicle.sources import jsonl, plays
from chronicle.tables import shared_dir

_EVENTS = """
e AS (SELECT CAST(event_id AS VARCHAR) AS id, ts AS t_utc, event_id AS seq, 'user' || user_id AS thread_id, event_type AS content, props,
             CASE WHEN event_type IN ('purchase', 'click') THEN 'self' ELSE 'other' END AS role FROM events)"""


def _numbered(minutes: int) -> str:
    return f"""WITH {_EVENTS},
l AS (SELECT *, CASE WHEN epoch_us(t_utc) - epoch_us(lag(t_utc) OVER w) > {minutes * 60_000_000} THEN 1 ELSE 0 END AS late FROM e WINDOW w AS (PARTITION BY thread_id ORDER BY t_utc, seq)),
n AS (SELECT *, CAST(sum(late) OVER (PARTITION BY thread_id ORDER BY t_utc, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM l),
g AS (SELECT thread_id, episode, min(t_utc) AS a, max(t_utc) AS b, count(*) AS n_events, arg_min(id, seq) AS first_id, min(seq) AS first_seq,
             array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM n GROUP BY thread_id, episode)
"""


_EPISODE_SQL = f"""SELECT thread_id, episode, {iso("a")} AS start_utc, {iso("b")} AS end_utc, n_events, first_id, roles,
  substr(sha256(thread_id || chr(0) || first_id || chr(0) || {iso("a")}), 1, 16) AS episode_id FROM g"""


def _shown(rows: DataFrame) -> DataFrame:
    out = episodes.gathered(rows)
    return out.select(
        "thread_id", "episode", iso_utc(F.col("start_utc")).alias("start_utc"), iso_utc(F.col("end_utc")).alias("end_utc"), "n_events", "first_id", F.array_join("participants", ",").alias("roles"), "episode_id"
    )


@query("w1_sessionize", _numbered(30) + _EPISODE_SQL)
def w1_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(episodes.numbered(views.events(spark, sf_dir)))


@query("w1_sessionize_12h", _numbered(720) + _EPISODE_SQL)
def w1_sessionize_12h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(episodes.numbered(views.events(spark, sf_dir), 720))


@query("w1_sessionize_by_day", _numbered(720) + _EPISODE_SQL)
def w1_sessionize_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for threads too large for one task."""
    return _shown(episodes.numbered_in_days(views.events(spark, sf_dir), 720))


@query("w1_session_window", _numbered(30) + f"SELECT thread_id, {iso('a')} AS start_utc, {iso('b')} AS end_utc, n_events FROM g")
def w1_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.events(spark, sf_dir)
    out = e.groupBy("thread_id", F.session_window("t_utc", "30 minutes 1 microsecond")).agg(F.min("t_utc").alias("a"), F.max("t_utc").alias("b"), F.count(F.lit(1)).alias("n_events"))
    return out.select("thread_id", iso_utc(F.col("a")).alias("start_utc"), iso_utc(F.col("b")).alias("end_utc"), "n_events")


@query("w2_thread_order", _numbered(720) + "SELECT thread_id, min(first_seq) AS thread_seq, count(*) AS episodes, CAST(sum(n_events) AS BIGINT) AS events FROM g GROUP BY thread_id")
def w2_thread_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = episodes.gathered(episodes.numbered_in_days(views.events(spark, sf_dir), 720))
    return built.groupBy("thread_id").agg(F.min("first_seq").alias("thread_seq"), F.count(F.lit(1)).alias("episodes"), F.sum("n_events").alias("events"))


@query(
    "a4_summary",
    _numbered(720)
    + "SELECT count(*) AS episodes, CAST(sum(n_events) AS BIGINT) AS events, median(n_events) AS median_size, round(avg(n_events), 6) AS mean_size, count(*) FILTER (WHERE n_events = 1) AS singles, max(n_events) AS largest FROM g",
)
def a4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.summary(episodes.gathered(episodes.numbered(views.events(spark, sf_dir), 720))).withColumn("mean_size", F.round("mean_size", 6))


_TRANSCRIPT = """
t AS (SELECT thread_id, episode, string_agg((CASE WHEN role = 'self' THEN 'me' ELSE thread_id END) || ': ' || content, chr(10) ORDER BY t_utc, seq) AS full_text FROM n GROUP BY thread_id, episode),
h AS (SELECT *, left(full_text, 585) AS a, right(full_text, 585) AS b FROM t)
SELECT thread_id, episode, CASE WHEN length(full_text) <= 1200 THEN full_text ELSE
  (CASE WHEN contains(a, chr(10)) THEN left(a, length(a) - position(chr(10) IN reverse(a))) ELSE a END) || chr(10) || '... [transcript truncated] ...' || chr(10) ||
  (CASE WHEN contains(b, chr(10)) THEN substr(b, position(chr(10) IN b) + 1) ELSE b END) END AS transcript FROM h"""


@query("x21_transcript", _numbered(720).rstrip() + "," + _TRANSCRIPT)
def x21_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of 1,200 characters, so that long episodes are cut here too."""
    return transcripts.with_transcript(episodes.build(views.events(spark, sf_dir), 720), 1200).select("thread_id", "episode", "transcript")


@query(
    "k8_documents",
    _numbered(720).rstrip()
    + f""",
t AS (SELECT thread_id, episode, string_agg((CASE WHEN role = 'self' THEN 'me' ELSE thread_id END) || ': ' || content, chr(10) ORDER BY t_utc, seq) AS content FROM n GROUP BY thread_id, episode)
SELECT t.content, {iso("g.a")} AS timestamp, t.thread_id AS entity, 'app' AS tag, substr(sha256(t.thread_id || chr(0) || first_id || chr(0) || {iso("a")}), 1, 16) AS episode_id
FROM t JOIN g USING (thread_id, episode)""",
)
def k8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = transcripts.documents(episodes.build(views.events(spark, sf_dir), 720))
    return docs.select("content", iso_utc(F.col("timestamp")).alias("timestamp"), F.col("entities")[0]["text"].alias("entity"), F.col("tags")[0].alias("tag"), F.col("metadata")["episode_id"].alias("episode_id"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = views.events(spark, sf_dir)
    again = e.where(F.col("ingest_seq") % 3 == 0).withColumns({"content": F.concat("content", F.lit(" edited")), "ingest_seq": F.col("ingest_seq") + 1_000_000_000})
    return e, again


@query(
    "k3_upsert",
    f"""WITH {_EVENTS}, v AS (SELECT id, content, seq, 0 AS new FROM e UNION ALL SELECT id, content || ' edited', seq + 1000000000, 1 FROM e WHERE seq % 3 = 0)
SELECT id, arg_max(content, new) AS content, CAST(arg_max(seq, new) AS BIGINT) AS ingest_seq FROM v GROUP BY id""",
)
def k3_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert(*_versions(spark, sf_dir)).select("id", "content", "ingest_seq")


@query("o3_union_sources", "SELECT source, count(*) AS n FROM (SELECT 'app' AS source FROM events UNION ALL SELECT 'spotify' FROM lineitem WHERE l_quantity * 2000 >= 30000) GROUP BY source")
def o3_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.union_sources(views.events(spark, sf_dir), plays.events(views.plays(spark, sf_dir))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("s12_source_filter", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS content FROM events")
def s12_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.by_source(views.events(spark, sf_dir), "app").select("id", "content")


@query("x12_content_sha", """SELECT CAST(event_id AS VARCHAR) AS id, sha256('{"additional_data":"' || replace(props, '"', '\\"') || '","content":"' || event_type || '"}') AS content_sha FROM events""")
def x12_content_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).select("id", "content_sha")


@query(
    "x13_verify",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type <> 'click' THEN 'yes' ELSE 'no' END AS intact FROM events
UNION ALL SELECT 'unknown' || n_nationkey, 'unknown' FROM nation""",
)
def x13_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are changed after they were hashed."""
    e = views.events(spark, sf_dir)
    changed = e.withColumn("content", F.when(F.col("content") == "click", "clack").otherwise(F.col("content")))
    ids = e.select("id").union(views.table(spark, sf_dir, "nation").select(F.concat(F.lit("unknown"), F.col("n_nationkey").cast("string"))))
    shown = F.when(F.col("intact"), "yes").when(~F.col("intact"), "no").otherwise("unknown")
    return upsert.verify(changed, ids).select("id", shown.alias("intact"))


@query("x3_apple_time", "SELECT event_id, epoch_us(ts) AS micros, CAST(trunc((CAST(epoch_us(ts) AS DOUBLE) / 1e6 - 978307200.0) * 1e9) AS BIGINT) AS key_ns FROM events")
def x3_apple_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back: nanoseconds since 2001 to a time, and the time to the number in ids, to the nanosecond."""
    message, _, _ = views.message_tables(spark, sf_dir)
    t = from_ns_2001(F.col("date"))
    return message.select(F.col("ROWID").alias("event_id"), F.unix_micros(t).alias("micros"), to_ns_2001(t).alias("key_ns"))


@query("x9_chat_ids", "SELECT conv_id, turn, substr(sha256(conv_id || '|m' || turn), 1, 16) AS id FROM conversations")
def x9_chat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", chat_id(F.col("conv_id").cast("string"), F.concat(F.lit("m"), F.col("turn").cast("string"))).alias("id"))


@query(
    "x19_contact",
    """SELECT page_id, CASE WHEN contains(url, '@') OR starts_with(url, '+') THEN url ELSE
  coalesce(nullif(list_last(string_split(list_last(string_split(list_last(string_split(url, ';-;')), ';')), '/')), ''), url) END AS contact FROM pages""",
)
def x19_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", contact_label(F.col("url")).alias("contact"))


@query(
    "x21_shorten",
    """WITH h AS (SELECT doc_id, text, left(text, 485) AS a, right(text, 485) AS b FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE
  (CASE WHEN contains(a, chr(10)) THEN left(a, length(a) - position(chr(10) IN reverse(a))) ELSE a END) || chr(10) || '... [transcript truncated] ...' || chr(10) ||
  (CASE WHEN contains(b, chr(10)) THEN substr(b, position(chr(10) IN b) + 1) ELSE b END) END AS short FROM h""",
)
def x21_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", shorten(F.col("text"), 1000).alias("short"))


@query("w1_equal_times", "SELECT CAST(user_id AS VARCHAR) AS thread_id, count(*) AS n_events, min(CAST(event_id AS VARCHAR)) AS first_id FROM events GROUP BY user_id")
def w1_equal_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a thread at one time and with one order number: ids alone order them."""
    e = views.events(spark, sf_dir).withColumns({"t_utc": F.lit("2024-01-01").cast("timestamp"), "ingest_seq": F.lit(0).cast("bigint"), "thread_id": F.substring("thread_id", 5, 20)})
    return episodes.gathered(episodes.numbered(e)).select("thread_id", "n_events", "first_id")


@query("x11_clocked_id", f"SELECT event_id, substr(sha256(event_id || '|' || event_type || '|' || {iso('ts')}), 1, 16) AS id FROM events")
def x11_clocked_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", clocked_id(F.col("event_id").cast("string"), F.col("event_type"), clock=F.col("ts")).alias("id"))


@query(
    "p6_event_records",
    f"""SELECT CAST(event_id AS VARCHAR) AS id, '{{"id":"' || event_id || '","t_utc":"' || {iso("ts")} || '","author_role":"' || (CASE WHEN event_type IN ('purchase', 'click') THEN 'self' ELSE 'other' END) || '","content":"' || event_type
  || '","thread_id":"user' || user_id || '","reply_to":null,"raw_ref":"events#' || event_id || '","source":"app","additional_data":' || replace(props, ': ', ':') || '}}' AS record FROM events""",
)
def p6_event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a record, extra data as an object."""
    return views.events(spark, sf_dir).select("id", F.to_json(jsonl.record(F.col), {"ignoreNullFields": "false"}).alias("record"))


@query(
    "w7_first_documents",
    _numbered(720).rstrip()
    + f""",
s AS (SELECT thread_id, min(first_seq) AS thread_seq FROM g GROUP BY thread_id)
SELECT thread_id AS entity, {iso("a")} AS timestamp FROM g JOIN s USING (thread_id) ORDER BY thread_seq, thread_id, episode LIMIT 20""",
)
def w7_first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the first twenty episodes, threads in the order in which they were first seen."""
    docs = transcripts.documents(episodes.build(views.events(spark, sf_dir), 720), 20)
    return docs.select(F.col("entities")[0]["text"].alias("entity"), iso_utc(F.col("timestamp")).alias("timestamp"))


@query("s11_episode_records", _numbered(720) + f"""SELECT substr(sha256(thread_id || chr(0) || first_id || chr(0) || {iso("a")}), 1, 16) AS id, {iso("a")} AS t_start, {iso("b")} AS t_end, n_events FROM g""")
def s11_episode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes as JSON lines, read back."""
    path = f"{shared_dir(spark)}/episodes-{uuid.uuid4().hex}"
    jsonl.write(jsonl.episode_records(episodes.build(views.events(spark, sf_dir), 720)), path)
    back = jsonl.read_episodes(spark, path)
    return back.select(F.col("episode_id").alias("id"), iso_utc(F.col("start_utc")).alias("t_start"), iso_utc(F.col("end_utc")).alias("t_end"), F.size("events").cast("bigint").alias("n_events"))
