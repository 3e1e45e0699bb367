"""Queries on joins in time, the levelled table, late events, and sums over sources, roles and days."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.time import iso_utc
from chronicle.operators import episodes, extra, ledger, lexical_index, retrieval, rollup, temporal, threads, upsert, vector_index
from chronicle.plans import views
from chronicle.plans.catalogue import iso, query
from chronicle.plans.event_queries import _EVENTS, _numbered
from chronicle.plans.memory_queries import _BM25
from chronicle.sources import plays
from chronicle.streaming import episodes as late
from chronicle.tables import materialize, shared_dir

_ASOF = "FROM (SELECT * FROM events WHERE event_type = '{new}') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = '{past}') b ON {by}a.ts >= b.ts"


def _as_of(spark: SparkSession, sf_dir: str, new: str, past: str, by: tuple[str, ...]) -> DataFrame:
    e = views.events(spark, sf_dir).select("id", "t_utc", "thread_id", "content")
    found = temporal.as_of(e.where(F.col("content") == new), e.where(F.col("content") == past), {"id": "past_id", "t_utc": "past_t"}, by)
    return found.select("id", "past_id", iso_utc(F.col("past_t")).alias("past_t"))


_ASOF_SQL = f"SELECT CAST(a.event_id AS VARCHAR) AS id, CAST(b.event_id AS VARCHAR) AS past_id, CASE WHEN b.ts IS NOT NULL THEN {iso('b.ts')} END AS past_t "


@query("j14_last_purchase", _ASOF_SQL + _ASOF.format(new="click", past="purchase", by="a.user_id = b.user_id AND "))
def j14_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the last purchase before it in its thread."""
    return _as_of(spark, sf_dir, "click", "purchase", ("thread_id",))


@query("j14_last_of_all", _ASOF_SQL + _ASOF.format(new="error", past="signup", by=""))
def j14_last_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the last signup before it, of anyone: one key has all rows."""
    return _as_of(spark, sf_dir, "error", "signup", ())


@query(
    "j15_at_one_time",
    _numbered(120).rstrip()
    + """, h AS (SELECT thread_id, episode, a, b FROM g)
SELECT x.thread_id AS thread_a, x.episode AS episode_a, y.thread_id AS thread_b, y.episode AS episode_b FROM h x JOIN h y ON x.a <= y.b AND y.a <= x.b AND x.thread_id < y.thread_id""",
)
def j15_at_one_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of episodes of different threads that run at one time."""
    e = episodes.gathered(episodes.numbered(views.events(spark, sf_dir), 120)).select("thread_id", "episode", "start_utc", "end_utc")
    met = temporal.meeting(e, "thread_id", ("episode",))
    return met.select(F.col("a.thread_id").alias("thread_a"), F.col("a.episode").alias("episode_a"), F.col("b.thread_id").alias("thread_b"), F.col("b.episode").alias("episode_b"))


def _table(spark: SparkSession) -> upsert.EventTable:
    return upsert.EventTable(spark, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")


_EDITED = f"""WITH {_EVENTS}, v AS (SELECT id, CASE WHEN seq % 3 = 0 THEN content || ' edited' ELSE content END AS content, seq, content AS kind FROM e)"""


@query("k3_table", _EDITED + " SELECT id, content FROM v WHERE seq % 7 > 0")
def k3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table after an upsert of a third of the events and the removal of a seventh."""
    table, e = _table(spark), views.events(spark, sf_dir)
    table.add(e)
    table.add(e.where("ingest_seq % 3 = 0").withColumn("content", F.concat("content", F.lit(" edited"))))
    table.delete(e.where("ingest_seq % 7 = 0"))
    return table.read().select("id", "content")


@query("s13_rows_of", _EDITED + " SELECT id, content FROM v WHERE kind = 'purchase'")
def s13_rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all purchases' ids, after an upsert."""
    table, e = _table(spark), views.events(spark, sf_dir)
    table.add(e)
    table.add(e.where("ingest_seq % 3 = 0").withColumn("content", F.concat("content", F.lit(" edited"))))
    return table.rows_of(e.where("content = 'purchase'").select("id")).select("id", "content")


_MOVED = _numbered(720).replace("'user' || user_id AS thread_id", "'user' || (user_id + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS thread_id")


@query("t4s_late_episodes", _MOVED + f"SELECT thread_id, episode, {iso('a')} AS start_utc, {iso('b')} AS end_utc, n_events, first_id FROM g")
def t4s_late_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes kept through two batches: late events come and a fifth of all move to the next thread."""
    e, table = views.events(spark, sf_dir), _table(spark)
    kept = late.LateEpisodes(table, f"{table.path}-episodes", 720)
    kept.apply(e.where("ingest_seq % 4 > 0"), 0)
    moved = F.concat(F.lit("user"), (F.substring("thread_id", 5, 20).cast("bigint") + 1).cast("string"))
    kept.apply(e.where("ingest_seq % 4 = 0 OR ingest_seq % 5 = 0").withColumn("thread_id", F.when(F.col("ingest_seq") % 5 == 0, moved).otherwise(F.col("thread_id"))), 1)
    return late.read(spark, kept.path).select("thread_id", "episode", iso_utc(F.col("start_utc")).alias("start_utc"), iso_utc(F.col("end_utc")).alias("end_utc"), "n_events", "first_id")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.union_sources(views.events(spark, sf_dir), plays.events(views.plays(spark, sf_dir)))


_BOTH = """WITH u AS (SELECT 'app' AS source, CASE WHEN event_type IN ('purchase', 'click') THEN 'self' ELSE 'other' END AS kind, CAST(ts AS DATE) AS day, 'user' || user_id AS thread, length(event_type) AS size FROM events
UNION ALL SELECT 'spotify', 'self', CAST(l_shipdate AS DATE), 'spotify', NULL FROM lineitem WHERE l_quantity * 2000 >= 30000)"""


@query("a14_cube", _BOTH + " SELECT source, kind, CAST(day AS VARCHAR) AS day, count(*) AS n, grouping(source) * 4 + grouping(kind) * 2 + grouping(day) AS level FROM u GROUP BY CUBE (source, kind, day)")
def a14_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by source, role and day, and all sums over them, from the stored days."""
    return rollup.cube(rollup.daily(_both(spark, sf_dir))).select("source", "kind", F.col("day").cast("string").alias("day"), "n", F.col("level").cast("bigint").alias("level"))


@query("a14_sources", _BOTH + " SELECT source, kind, count(*) AS n, count(DISTINCT day) AS days FROM u GROUP BY GROUPING SETS ((source, kind), (source), ())")
def a14_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets of their own choice over the stored days."""
    return rollup.grouping_sets(rollup.daily(_both(spark, sf_dir)), [("source", "kind"), ("source",), ()]).select("source", "kind", "n", "days")


@query("a14_estimates")
def a14_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads and content sizes of each source, role and day and of all sums, estimated from sketches; the tests hold them against exact ones."""
    return rollup.estimates(rollup.cube(rollup.daily(_both(spark, sf_dir)))).select("source", "kind", F.col("day").cast("string").alias("day"), "n", "threads", "median_size", "p95_size")


def _running_sql(start: str) -> str:
    return f"""WITH RECURSIVE d AS (SELECT user_id AS subject, event_id AS id, (value - 50) / {start} AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT subject, id, k, greatest(0.0, least(1.0, 0.0 + delta)) AS c FROM d WHERE k = 1 UNION ALL SELECT d.subject, d.id, d.k, greatest(0.0, least(1.0, r.c + d.delta)) FROM r JOIN d ON d.subject = r.subject AND d.k = r.k + 1)
SELECT subject, id, round(c, 6) AS confidence FROM r"""


@query("y4_running", _running_sql("100"))
def y4_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's confidence after every one of its changes, kept between 0 and 1 each time."""
    d = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("ts").alias("t"), F.col("event_id").alias("id"), ((F.col("value") - 50) / 100).alias("delta"))
    return ledger.running(d).select("subject", "id", F.round("confidence", 6).alias("confidence"))


_REPLIES = """WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, CASE WHEN turn % 4 > 0 OR turn % 8 = 4 THEN conv_id * 1000 + turn - (CASE WHEN turn % 3 = 0 THEN 2 ELSE 1 END) END AS parent FROM conversations),
p AS (SELECT a.id, CASE WHEN b.id IS NOT NULL THEN a.parent END AS parent FROM c a LEFT JOIN c b ON a.parent = b.id),
r AS (SELECT id, id AS root, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.id, r.root, r.depth + 1 FROM r JOIN p ON p.parent = r.id)
SELECT id, root, CAST(depth AS BIGINT) AS depth FROM r"""


@query("t9_reply_roots", _REPLIES)
def t9_reply_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each turn's thread of replies and its depth; a turn answers the one or two before it, some answer none."""
    c, key = views.table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn")
    answers = (F.col("turn") % 4 > 0) | (F.col("turn") % 8 == 4)
    back = F.when(F.col("turn") % 3 == 0, 2).otherwise(1)
    return threads.reply_roots(c.select(key.alias("id"), F.when(answers, key - back).alias("parent")))


def _with_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their extra data as a variant, stored as such and read again."""
    return materialize(extra.with_extra(views.events(spark, sf_dir)), "variants")


@query("m9_extra", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def m9_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_extra(spark, sf_dir).select("id", extra.value("$.k", "bigint").alias("k"))


@query("m9_by_field", "SELECT event_type AS content, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 GROUP BY event_type")
def m9_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a field that was shredded into a column."""
    rows = materialize(extra.shredded(_with_extra(spark, sf_dir), {"k": ("$.k", "bigint")}), "shredded")
    return rows.where("k >= 50").groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("m9_fields", "SELECT 'k' AS field, 'BIGINT' AS kind, count(*) AS n FROM events")
def m9_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extra.fields(_with_extra(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("r3_vector_index")
def r3_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As r3_vector_topk through the index; r3_index_recall says how much of it is found."""
    items, asked = _vectors(spark, sf_dir)
    return vector_index.search(vector_index.build(items, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", "vec_id"), asked, 10)


@query("r3_index_recall", "SELECT count(DISTINCT vec_id) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def r3_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least nine in ten of the exact ten best are found by the index, over all queries."""
    items, asked = _vectors(spark, sf_dir)
    told = vector_index.recall(r3_vector_index(spark, sf_dir), retrieval.vector(items, asked, 10, key="vec_id"), "vec_id")
    return told.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("r3_lexical_index", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 10")
def r3_lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As r3_lexical_topk, by the stored index."""
    docs, items = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "benchmark")
    index = lexical_index.build(docs.select("doc_id", "text"), f"{shared_dir(spark)}/words-{uuid.uuid4().hex}", "doc_id")
    return lexical_index.search(index, items.select(F.col("item_id").alias("query_id"), "text"), 10)[0]
