"""The driver's tables seen as the canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.ids import content_sha


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as events of threads; purchases and clicks are the owner's own."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("t_utc"),
        F.when(F.col("event_type").isin("purchase", "click"), "self").otherwise("other").alias("author_role"),
        F.col("event_type").alias("content"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("thread_id"),
        F.lit(None).cast("string").alias("reply_to"),
        F.concat(F.lit("events#"), F.col("event_id").cast("string")).alias("raw_ref"),
        F.lit("app").alias("source"),
        F.col("props").alias("additional_data"),
        content_sha(F.col("event_type"), F.col("props")).alias("content_sha"),
        F.col("event_id").alias("ingest_seq"),
    )


def message_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(message, chat, links): users as chats, some without a name."""
    e = table(spark, sf_dir, "events")
    named = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, F.concat(F.lit("name"), F.col("user_id").cast("string")))
    chat = e.select("user_id").distinct().select(F.col("user_id").alias("ROWID"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("chat_identifier"), named.alias("display_name"))
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(978307200000000)) * 1000
    message = e.select(
        F.col("event_id").alias("ROWID"), F.col("event_type").alias("text"), F.lit(None).cast("binary").alias("attributedBody"), (F.col("event_type") == "click").cast("int").alias("is_from_me"), ns.alias("date")
    )
    return message, chat, e.select(F.col("user_id").alias("chat_id"), F.col("event_id").alias("message_id"))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages: the turn before is the parent, the text is also a block, odd turns call a tool."""
    c = table(spark, sf_dir, "conversations")
    block = lambda kind, text, name: F.struct(F.lit(kind).alias("type"), text.alias("text"), name.alias("name"))
    none = F.lit(None).cast("string")
    blocks = F.array(block("text", F.col("text"), none), block("thinking", F.lit("private"), none), block("tool_use", none, F.when(F.col("turn") % 4 == 1, "search")))
    return c.select(
        F.col("conv_id").cast("string").alias("conversation"),
        F.col("turn").alias("pos"),
        F.concat(F.lit("m"), F.col("turn").cast("string")).alias("uuid"),
        F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"),
        F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(F.col("turn") % 2 == 1, blocks).otherwise(F.slice(blocks, 1, 2)).alias("content"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86400 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(F.col("turn") > 0, F.concat(F.lit("m"), (F.col("turn") - 1).cast("string"))).otherwise("00000000-0000-4000-8000-000000000000").alias("parent_message_uuid"),
    )


def chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of known senders, nested as in an export."""
    rows = chat_rows(spark, sf_dir).where(F.col("sender").isin("human", "assistant"))
    m = F.struct("pos", "uuid", "sender", "text", "content", "created_at", F.col("created_at").alias("updated_at"), "parent_message_uuid")
    nested = rows.groupBy("conversation").agg(F.array_sort(F.collect_list(m)).alias("chat_messages"), F.min("created_at").alias("created_at"))
    fields = ["uuid", "sender", "text", "content", "created_at", "updated_at", "parent_message_uuid"]
    plain = F.transform("chat_messages", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return nested.select(F.col("conversation").alias("uuid"), "created_at", plain.alias("chat_messages"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays; which fields are filled depends on the flags."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    when = lambda flag, value: F.when(F.col("l_returnflag") == flag, value)
    none = F.lit(None).cast("string")
    return li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        (F.col("l_quantity") * 2000).cast("bigint").alias("ms_played"),
        when("A", F.concat(F.lit("track "), F.col("l_partkey").cast("string"))).alias("master_metadata_track_name"),
        when("A", F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("artist "), F.col("l_suppkey").cast("string"))).otherwise("")).alias("master_metadata_album_artist_name"),
        when("A", F.when(F.col("l_linenumber") > 2, "album")).alias("master_metadata_album_album_name"),
        when("A", F.concat(F.lit("spotify:track:"), key)).alias("spotify_track_uri"),
        when("N", F.concat(F.lit("episode "), key)).alias("episode_name"),
        when("N", F.when(F.col("l_linestatus") == "O", "show").otherwise("")).alias("episode_show_name"),
        none.alias("spotify_episode_uri"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), F.concat(F.lit("book "), key)).alias("audiobook_title"),
        none.alias("audiobook_uri"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("chapter "), key)).alias("audiobook_chapter_title"),
    )


def photo_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(asset, attributes, face, person): orders as photos, their suppliers as the people on them."""
    o, li, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    key = F.col("o_orderkey")
    asset = o.select(
        key.alias("Z_PK"),
        F.concat(F.lit("photo"), key.cast("string")).alias("ZUUID"),
        F.when(key % 50 != 0, (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 - 978307200.0)).alias("ZDATECREATED"),
        F.when(key % 7 == 0, -180.0).otherwise((key % 90).cast("double")).alias("ZLATITUDE"),
        F.when(key % 11 == 0, -180.0).otherwise((key % 170).cast("double")).alias("ZLONGITUDE"),
        (key % 10).cast("string").alias("ZDIRECTORY"),
        F.concat(key.cast("string"), F.lit(".jpg")).alias("ZFILENAME"),
        F.when(key % 5 != 0, (key % 4000).cast("int")).alias("ZWIDTH"),
        F.lit(None).cast("int").alias("ZHEIGHT"),
        (F.col("o_orderstatus") == "F").cast("int").alias("ZFAVORITE"),
        F.lit(0).alias("ZHIDDEN"),
        F.lit(0).alias("ZTRASHEDSTATE"),
        (F.col("o_orderstatus") == "P").cast("int").alias("ZKIND"),
    )
    attributes = o.where("o_orderkey % 3 = 0").select(key.alias("Z_PK"), key.alias("ZASSET"), F.concat(F.lit("IMG "), key.cast("string")).alias("ZORIGINALFILENAME"))
    face = li.select(F.monotonically_increasing_id().alias("Z_PK"), F.col("l_orderkey").alias("ZASSETFORFACE"), F.col("l_suppkey").alias("ZPERSONFORFACE"))
    person = s.select(F.col("s_suppkey").alias("Z_PK"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("ZDISPLAYNAME"))
    return asset, attributes, face, person


def capsule_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(capsules, media): customers as places, their orders as media."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    capsules = c.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.timestamp_seconds(F.lit(1_600_000_000) + F.col("c_custkey") * 3600).alias("created_at"),
        F.col("c_name").alias("place_name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") / 200).alias("lat"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") / 100).alias("lng"),
    )
    kind = F.when(F.col("o_orderstatus") == "F", "photo").when(F.col("o_orderstatus") == "O", "audio").otherwise("video")
    media = o.select(
        F.format_string("%010d", F.col("o_orderkey")).alias("id"),
        F.col("o_custkey").cast("string").alias("capsule_id"),
        kind.alias("kind"),
        F.concat(F.lit("media/"), F.col("o_orderkey").cast("string")).alias("file_path"),
        F.concat(kind, F.lit("/x")).alias("mime"),
        F.col("o_totalprice").cast("bigint").alias("byte_size"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 80).cast("double").alias("exif_lat"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 160).cast("double").alias("exif_lng"),
    )
    return capsules, media


def ladder(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as principles, orders as memories, line items as events; edges between customers of following keys."""
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    event = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return {
        "principles": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"), (F.col("c_acctbal") / 10000).alias("confidence")),
        "edges": c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("src_principle_id"), (F.col("c_custkey") + 1).alias("dst_principle_id"), F.lit("supports").alias("relation")),
        "memories": o.select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderpriority").alias("text")),
        "links": o.select(F.col("o_custkey").alias("principle_id"), F.col("o_orderkey").alias("memory_id")),
        "edge_links": o.select(F.col("o_custkey").alias("edge_id"), F.col("o_orderkey").alias("memory_id")),
        "memory_events": li.select(F.col("l_orderkey").alias("memory_id"), event.alias("event_id")),
        "events": li.groupBy(event.alias("id")).agg(
            F.min("l_shipdate").alias("t_utc"), F.min(F.concat(F.col("l_returnflag"), F.lit(" "), F.col("l_partkey").cast("string"))).alias("content"), F.lit("app").alias("source"), F.min("l_linestatus").alias("raw_ref")
        ),
    }


def blob_messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(message, chat, links): documents as messages of one chat whose texts only stand in BLOBs, with all three kinds of lengths."""
    d = table(spark, sf_dir, "documents")
    n = F.octet_length("text")
    low_first = lambda size: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)]))
    head = lambda mark: F.unhex(F.lit("040B84012B" + mark))
    length = F.when(n < 128, F.concat(head(""), low_first(1))).when(n < 1 << 16, F.concat(head("81"), low_first(2))).otherwise(F.concat(head("82"), low_first(4)))
    blob = F.concat(length, F.col("text").cast("binary"), F.unhex(F.lit("8684")))
    message = d.select(F.col("doc_id").alias("ROWID"), F.lit(None).cast("string").alias("text"), blob.alias("attributedBody"), F.lit(1).alias("is_from_me"), (F.col("doc_id") * 1_000_000_000).alias("date"))
    chat = spark.createDataFrame([(1, "notes", "")], "ROWID long, chat_identifier string, display_name string")
    return message, chat, d.select(F.lit(1).cast("long").alias("chat_id"), F.col("doc_id").alias("message_id"))


def watch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as played videos; those without a query in their address have no video id."""
    p = table(spark, sf_dir, "pages")
    video = F.when(F.col("url").contains("?"), F.concat(F.lit("https://video.example/watch?v="), F.col("page_id").cast("string")))
    time = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    channel = F.when(F.length("url") > 40, F.array(F.struct(F.concat(F.lit("channel "), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("url"))))
    return p.select(F.lit("YouTube Music").alias("header"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), video.alias("titleUrl"), channel.alias("subtitles"), time.alias("time"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories of three kinds, by what their label says."""
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind = F.when(F.col("quality") == 1, "world").when(F.col("quality") == 0, "experience").otherwise("opinion")
    return d.join(la, "doc_id", "left").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars", kind.alias("fact_type"))


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the distinct names of parts, each with its least key."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id")).select("id", "text")
