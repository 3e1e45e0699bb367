"""Message database: tables ``message``, ``chat`` and ``chat_message_join``."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.functions.binary import decode_body
from chronicle.functions.ids import message_id
from chronicle.functions.text import filled, is_blank
from chronicle.functions.time import EPOCH_2001, from_ns_2001
from chronicle.sources.common import canonical


def top_threads(chat: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """(chat_id, chat_identifier, label, messages) of the busiest chats, largest first; equal ones by chat_id."""
    counts = links.groupBy("chat_id").agg(F.count(F.lit(1)).alias("messages"))
    return (
        counts.join(chat, counts["chat_id"] == chat["ROWID"])
        .select("chat_id", "chat_identifier", F.coalesce(filled(F.col("display_name")), "chat_identifier").alias("label"), "messages")
        .orderBy(F.desc("messages"), "chat_id")
        .limit(n)
    )


def since_ns(since: datetime.date | None) -> int | None:
    if since is None:
        return None
    midnight = datetime.datetime(since.year, since.month, since.day, tzinfo=datetime.UTC)
    return int((midnight.timestamp() - EPOCH_2001) * 1e9)


def thread_rows(message: DataFrame, chat: DataFrame, links: DataFrame, identifiers: DataFrame, since: datetime.date | None = None) -> DataFrame:
    """Messages of all chats with one of the ``identifiers`` (chat_identifier), each message of a thread once.

    Two chats may have one identifier; they are read as one thread.
    """
    rows = message if since is None else message.where(F.col("date") >= F.lit(since_ns(since)))
    wanted = chat.join(identifiers.select("chat_identifier").distinct(), "chat_identifier", "left_semi").select(F.col("ROWID").alias("chat_id"), "chat_identifier")
    linked = links.join(wanted, "chat_id").select("message_id", "chat_identifier").distinct()
    return rows.join(linked, rows["ROWID"] == linked["message_id"]).drop("message_id")


def events(message: DataFrame, chat: DataFrame, links: DataFrame, top_n: int, since: datetime.date | None = None) -> DataFrame:
    """Canonical events of the busiest threads; messages without text in column or BLOB are skipped."""
    rows = thread_rows(message, chat, links, top_threads(chat, links, top_n), since)
    body = F.when(F.col("text").isNull(), decode_body(F.col("attributedBody"))).otherwise(F.col("text"))
    rows = rows.withColumns({"_content": body, "_t": from_ns_2001(F.col("date"))})
    rows = rows.where(~is_blank(F.col("_content")))
    reply = F.col("reply_to_guid") if "reply_to_guid" in rows.columns else F.lit(None)
    mine = F.col("is_from_me").cast("boolean")
    return canonical(
        rows,
        [F.col("ROWID")],
        id=message_id(F.col("chat_identifier"), F.col("_t"), mine, F.col("_content")),
        t_utc=F.col("_t"),
        author_role=F.when(mine, "self").otherwise("other"),
        content=F.col("_content"),
        thread_id=F.col("chat_identifier"),
        reply_to=reply,
        raw_ref=F.concat(F.lit("chat.db#"), F.col("ROWID").cast("string")),
        source=F.lit("imessage"),
    )
