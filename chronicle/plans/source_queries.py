"""Queries on sources: messages, chats, plays, photos, capsules, watch history."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.text import media_kind, rendered_blocks
from chronicle.functions.time import iso_utc
from chronicle.plans import views
from chronicle.plans.catalogue import iso, query
from chronicle.sources import capsules, chats, messages, photos, plays, watch_history
from chronicle.sources.common import refused

_CHAT = "c AS (SELECT DISTINCT user_id, 'user' || user_id AS chat_identifier, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'name' || user_id END AS display_name FROM events)"


@query(
    "a1_top_threads",
    f"""WITH {_CHAT} SELECT c.user_id AS chat_id, chat_identifier, coalesce(nullif(display_name, ''), chat_identifier) AS label, count(*) AS messages
FROM events e JOIN c ON e.user_id = c.user_id GROUP BY ALL ORDER BY messages DESC, chat_id LIMIT 20""",
)
def a1_top_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chat, links = views.message_tables(spark, sf_dir)
    return messages.top_threads(chat, links, 20)


@query("s2_thread_scan_since", "SELECT event_id, 'user' || user_id AS thread_id, event_type AS text FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def s2_thread_scan_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    message, chat, links = views.message_tables(spark, sf_dir)
    rows = messages.thread_rows(message, chat, links, chat.select("chat_identifier"), datetime.date(2024, 1, 10))
    return rows.select(F.col("ROWID").alias("event_id"), F.col("chat_identifier").alias("thread_id"), "text")


@query(
    "s3_message_events",
    f"""WITH top AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 50)
SELECT 'chat.db#' || event_id AS raw_ref, 'user' || user_id AS thread_id, {iso("ts")} AS t, CASE WHEN event_type = 'click' THEN 'self' ELSE 'other' END AS author_role, event_type AS content,
  substr(sha256('user' || user_id || '|' || CAST(trunc((CAST(epoch_us(ts) AS DOUBLE) / 1e6 - 978307200.0) * 1e9) AS BIGINT) || '|' || (CASE WHEN event_type = 'click' THEN '1' ELSE '0' END) || '|' || event_type), 1, 16) AS id
FROM events WHERE user_id IN (SELECT user_id FROM top)""",
)
def s3_message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.events(*views.message_tables(spark, sf_dir), 50).select("raw_ref", "thread_id", iso_utc(F.col("t_utc")).alias("t"), "author_role", "content", "id")


_RENDER = r"""
r AS (SELECT conv_id, turn, role, trim(CASE WHEN turn % 3 = 0 THEN CASE WHEN trim(text, ' ' || chr(10)) = '' THEN '' ELSE text END ELSE text END
        || CASE WHEN turn % 2 = 1 THEN chr(10) || '[tool: ' || (CASE WHEN turn % 4 = 1 THEN 'search' ELSE 'None' END) || ']' ELSE '' END, ' ' || chr(10)) AS content
      FROM conversations)"""


@query("x18_render", f"WITH {_RENDER} SELECT conv_id, turn, content FROM r")
def x18_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.chat_rows(spark, sf_dir)
    return c.select(F.col("conversation").cast("bigint").alias("conv_id"), F.col("pos").alias("turn"), rendered_blocks(F.col("text"), F.col("content")).alias("content"))


@query(
    "s9_chat_events",
    f"""WITH {_RENDER} SELECT substr(sha256(conv_id || '|m' || turn), 1, 16) AS id, CAST(conv_id AS VARCHAR) AS thread_id, CASE WHEN role = 'user' THEN 'self' ELSE 'other' END AS author_role, content,
  CASE WHEN turn > 0 THEN 'm' || (turn - 1) END AS reply_to, 'claude:' || conv_id || '#m' || turn AS raw_ref FROM r WHERE role IN ('user', 'assistant') AND content <> ''""",
)
def s9_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.events(views.chat_export(spark, sf_dir)).select("id", "thread_id", "author_role", "content", "reply_to", "raw_ref")


@query("f8_unknown_sender", "SELECT role AS sender, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY role")
def f8_unknown_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refused(views.chat_rows(spark, sf_dir), "sender", chats.SENDERS)


@query(
    "t9_reply_chain",
    f"""WITH {_RENDER}, k AS (SELECT * FROM r WHERE role IN ('user', 'assistant') AND content <> '')
SELECT a.conv_id, a.turn, coalesce(b.turn, -1) AS parent_turn FROM k a LEFT JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""",
)
def t9_reply_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = chats.events(views.chat_export(spark, sf_dir))
    turn = F.substring_index("raw_ref", "#m", -1).cast("bigint")
    child = e.select(F.col("thread_id").cast("bigint").alias("conv_id"), turn.alias("turn"), chats.reply_event_id(F.col("thread_id"), F.col("reply_to")).alias("parent"))
    return child.join(e.select(F.col("id").alias("parent"), turn.alias("parent_turn")), "parent", "left").select("conv_id", "turn", F.coalesce("parent_turn", F.lit(-1).cast("bigint")).alias("parent_turn"))


_KEY = "(l_orderkey || '-' || l_linenumber || '-' || l_partkey)"
_LINE = f"""CASE l_returnflag
  WHEN 'A' THEN 'Listened to ''track ' || l_partkey || ''' by ' || (CASE WHEN l_suppkey % 2 = 0 THEN 'artist ' || l_suppkey ELSE 'unknown artist' END) || (CASE WHEN l_linenumber > 2 THEN ' (album album)' ELSE '' END)
  WHEN 'N' THEN 'Listened to podcast ''episode ' || {_KEY} || '''' || (CASE WHEN l_linestatus = 'O' THEN ' from show' ELSE '' END)
  ELSE CASE WHEN l_linestatus = 'O' THEN 'Listened to ''chapter ' || {_KEY} || ''' from book ' || {_KEY} ELSE 'Played chapter ' || {_KEY} END END"""
_REF = f"""(CASE l_returnflag WHEN 'A' THEN 'spotify:track:' || {_KEY} WHEN 'N' THEN 'spotify:episode ' || {_KEY} ELSE 'spotify:chapter ' || {_KEY} END) || '#' || {iso("l_shipdate")}"""


@query("p2_play_events", f"SELECT substr(sha256({_REF}), 1, 16) AS id, {_REF} AS raw_ref, {_LINE} AS content FROM lineitem WHERE CAST(l_quantity * 2000 AS BIGINT) >= 30000")
def p2_play_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plays.events(views.plays(spark, sf_dir)).select("id", "raw_ref", "content")


@query(
    "x14_play_kinds",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'music' WHEN 'N' THEN 'podcast' ELSE CASE WHEN l_linestatus = 'O' THEN 'audiobook' ELSE 'unknown' END END AS kind,
  count(*) AS plays, count(*) FILTER (WHERE l_returnflag = 'A') AS with_track, CAST(sum(CAST(l_quantity * 2000 AS BIGINT)) AS BIGINT) AS ms FROM lineitem GROUP BY 1""",
)
def x14_play_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.plays(spark, sf_dir).select(plays.kind().alias("kind"), plays.track_id().alias("track"), "ms_played")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("plays"), F.count("track").alias("with_track"), F.sum("ms_played").alias("ms"))


_COORD = "CASE WHEN o_orderkey % {m} = 0 THEN NULL ELSE CAST(o_orderkey % {n} AS DOUBLE) END"


@query(
    "j3_photo_records",
    f"""WITH p AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(s_name))), '|') AS people FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 <> 0 GROUP BY l_orderkey)
SELECT 'photo' || o_orderkey AS id, {_COORD.format(m=7, n=90)} AS lat, {_COORD.format(m=11, n=170)} AS lng, CASE WHEN o_orderkey % 3 = 0 THEN 'IMG ' || o_orderkey ELSE o_orderkey || '.jpg' END AS original_filename,
  'originals/' || (o_orderkey % 10) || '/' || o_orderkey || '.jpg' AS original_path, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 4000 AS INTEGER) ELSE 0 END AS width,
  CASE WHEN o_orderstatus = 'P' THEN 'video' ELSE 'photo' END AS kind, coalesce(people, '') AS people, {iso("o_orderdate")} AS captured
FROM orders LEFT JOIN p ON o_orderkey = l_orderkey WHERE o_orderkey % 50 <> 0""",
)
def j3_photo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = photos.records(*views.photo_tables(spark, sf_dir))
    return r.select("id", "lat", "lng", "original_filename", "original_path", "width", "kind", F.array_join("people", "|").alias("people"), iso_utc(F.col("captured_at")).alias("captured"))


@query(
    "a2_named_people",
    "SELECT l_orderkey AS asset, array_to_string(list_sort(list_distinct(list(s_name))), '|') AS people FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 <> 0 GROUP BY l_orderkey",
)
def a2_named_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, face, person = views.photo_tables(spark, sf_dir)
    return photos.named_people(face, person).select(F.col("_asset").alias("asset"), F.array_join("people", "|").alias("people"))


_MEDIA = "m AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'photo' WHEN 'O' THEN 'audio' ELSE 'video' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 80 AS DOUBLE) END AS la, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 160 AS DOUBLE) END AS lo FROM orders)"


@query(
    "s14_capsules_nested",
    f"WITH {_MEDIA} SELECT CAST(c_custkey AS VARCHAR) AS id, count(o_orderkey) AS n_media, coalesce(string_agg(kind || o_orderkey, ',' ORDER BY o_orderkey), '') AS media FROM customer LEFT JOIN m ON c_custkey = o_custkey GROUP BY c_custkey",
)
def s14_capsules_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = capsules.with_media(*views.capsule_tables(spark, sf_dir))
    shown = F.array_join(F.transform("media", lambda m: F.concat(m["kind"], F.substring_index(m["file_path"], "/", -1))), ",")
    return nested.select("id", F.size("media").cast("bigint").alias("n_media"), shown.alias("media"))


_CARDS = f"""{_MEDIA}, f AS (SELECT o_custkey, arg_min(la, o_orderkey) FILTER (WHERE true) AS x, min(o_orderkey) AS k FROM m WHERE kind = 'photo' GROUP BY o_custkey),
q AS (SELECT c_custkey, 'media/' || f.k AS cover, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 200 END, m.la) AS lat, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 100 END, m.lo) AS lng
      FROM customer LEFT JOIN f ON c_custkey = f.o_custkey LEFT JOIN m ON m.o_orderkey = f.k)"""


@query("p8_cards", f"WITH {_CARDS} SELECT CAST(c_custkey AS VARCHAR) AS id, cover, round(lat, 6) AS lat, round(lng, 6) AS lng FROM q")
def p8_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = capsules.cards(capsules.with_media(*views.capsule_tables(spark, sf_dir)))
    return cards.select("id", "cover", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("a11_bounding_box", f"WITH {_CARDS} SELECT round(min(lat), 6) AS south, round(max(lat), 6) AS north, round(min(lng), 6) AS west, round(max(lng), 6) AS east FROM q WHERE lat IS NOT NULL AND lng IS NOT NULL")
def a11_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = capsules.bounding_box(capsules.map_points(capsules.cards(capsules.with_media(*views.capsule_tables(spark, sf_dir)))))
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query(
    "p5_capsule_events",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, 'capsule#' || c_custkey AS raw_ref, c_name AS place, count(o_orderkey) AS n_media FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
)
def p5_capsule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = capsules.events(capsules.with_media(*views.capsule_tables(spark, sf_dir)))
    extra = F.from_json("additional_data", "place_name string, media array<struct<id: string>>")
    return e.select("id", "raw_ref", extra["place_name"].alias("place"), F.size(extra["media"]).cast("bigint").alias("n_media"))


@query("x22_media_kind", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'photo' WHEN 'O' THEN 'audio' END AS kind FROM orders")
def x22_media_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.when(F.col("o_orderstatus") == "F", "image/jpeg").when(F.col("o_orderstatus") == "O", "audio/mpeg").otherwise("application/pdf")
    return views.table(spark, sf_dir, "orders").select("o_orderkey", media_kind(mime).alias("kind"))


@query("s16_video_ids", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def s16_video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit("page")).alias("page"))


@query("x6_blob_bodies", "SELECT doc_id, sha256(text) AS content_sha256, 'chat.db#' || doc_id AS raw_ref FROM documents WHERE regexp_matches(text, '\\S')")
def x6_blob_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of messages whose texts only stand in BLOBs; the BLOBs of blank texts give none."""
    e = messages.events(*views.blob_messages(spark, sf_dir), 1)
    return e.select(F.col("ingest_seq").alias("doc_id"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "raw_ref")


_PHOTO = f"""WITH p AS (SELECT l_orderkey, list_sort(list_distinct(list(s_name))) AS people FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 <> 0 GROUP BY l_orderkey)
SELECT 'photo' || o_orderkey AS id, 'photos.sqlite#' || o_orderkey AS raw_ref, {iso("o_orderdate")} AS t, '{{"lat":' || coalesce(CAST({_COORD.format(m=7, n=90)} AS VARCHAR), 'null') || ',"lng":' || coalesce(CAST({_COORD.format(m=11, n=170)} AS VARCHAR), 'null')
  || ',"original_filename":"' || (CASE WHEN o_orderkey % 3 = 0 THEN 'IMG ' || o_orderkey ELSE o_orderkey || '.jpg' END) || '","original_path":"originals/' || (o_orderkey % 10) || '/' || o_orderkey || '.jpg","width":' || (CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4000 ELSE 0 END)
  || ',"height":0,"is_favorite":' || (CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END) || ',"is_hidden":false,"is_trashed":false,"kind":"' || (CASE WHEN o_orderstatus = 'P' THEN 'video' ELSE 'photo' END)
  || '","people":[' || coalesce(array_to_string(list_transform(people, lambda x: '"' || x || '"'), ','), '') || ']}}' AS additional_data FROM orders LEFT JOIN p ON o_orderkey = l_orderkey WHERE o_orderkey % 50 <> 0"""


@query("p3_photo_events", _PHOTO)
def p3_photo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = photos.events(photos.records(*views.photo_tables(spark, sf_dir)))
    return e.select("id", "raw_ref", iso_utc(F.col("t_utc")).alias("t"), "additional_data")


_WATCH_REF = f"""((CASE WHEN contains(url, '?') THEN 'yt:video:' || page_id ELSE 'yt:title:page ' || page_id END) || '#' || {iso("make_timestamp((1600000000 + page_id * 60) * 1000000)")})"""


@query(
    "s16_watch_events",
    f"""SELECT substr(sha256({_WATCH_REF}), 1, 16) AS id, {_WATCH_REF} AS raw_ref, 'Listened to ''page ' || page_id || '''' || (CASE WHEN length(url) > 40 THEN ' on channel ' || page_id ELSE '' END) AS content FROM pages""",
)
def s16_watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch_history.events(views.watch_history(spark, sf_dir)).select("id", "raw_ref", "content")


@query("a12_pins", f"""WITH {_CARDS} SELECT count(*) FILTER (WHERE cover IS NOT NULL) AS found, count(*) AS placed FROM q WHERE lat IS NOT NULL AND lng IS NOT NULL""")
def a12_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = capsules.cards(capsules.with_media(*views.capsule_tables(spark, sf_dir)))
    return capsules.discovered(cards.withColumn("discovered", F.col("cover").isNotNull()))


@query("f9_rejected_places", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'blank place name' AS reason FROM customer WHERE c_mktsegment = 'BUILDING'")
def f9_rejected_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capsules of one segment's customers have blank names; every other one is accepted."""
    c = views.table(spark, sf_dir, "customer")
    blank = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", " \t").otherwise(F.col("c_name")).alias("place_name"))
    return capsules.named(blank)[1].select("id", "reason")


@query("f9_rejected_uploads", "SELECT CAST(o_orderkey AS VARCHAR) AS capsule_id, CASE WHEN o_orderstatus = 'F' THEN 'photo' WHEN o_orderstatus = 'O' THEN 'text' ELSE 'unsupported media type' END AS outcome FROM orders")
def f9_rejected_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "image/png").when(F.col("o_orderstatus") == "O", "text/plain").otherwise("application/pdf")
    good, bad = capsules.checked_uploads(views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("capsule_id"), kind.alias("content_type")))
    return good.select("capsule_id", F.col("kind").alias("outcome")).unionByName(bad.select("capsule_id", F.col("reason").alias("outcome")))


@query("x23_notes", "SELECT CAST(o_custkey AS VARCHAR) AS capsule_id, arg_min(o_orderpriority, o_orderkey) AS note FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def x23_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as uploads of their customers: texts with blanks around them, blank texts, photos."""
    o = views.table(spark, sf_dir, "orders")
    body = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("\n "), F.col("o_orderpriority"), F.lit("  "))).otherwise("  ")
    kind = F.when(F.col("o_orderstatus") == "F", "image/png").otherwise("text/plain; charset=utf-8")
    uploads = o.select(F.col("o_custkey").cast("string").alias("capsule_id"), F.col("o_orderkey").alias("pos"), body.cast("binary").alias("content"), kind.alias("content_type"))
    return capsules.notes(uploads)
