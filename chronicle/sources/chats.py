"""Assistant chats: ``conversations.json``, conversations with messages with blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.ids import chat_id
from chronicle.functions.text import rendered_blocks
from chronicle.functions.time import parse_iso
from chronicle.schema import CHAT_EXPORT
from chronicle.sources.common import canonical, required

#: The parent that stands for none.
ROOT = "00000000-0000-4000-8000-000000000000"
SENDERS = ("human", "assistant")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The export of a folder; malformed JSON or a missing file is an error."""
    return spark.read.schema(CHAT_EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/conversations.json")


def messages(export: DataFrame) -> DataFrame:
    """One row for each message, in the order of the export."""
    rows = export.select("uuid", "created_at", F.posexplode("chat_messages").alias("pos", "m"))
    return rows.select(F.col("uuid").alias("conversation"), F.col("created_at").alias("conversation_at"), "pos", "m.*")


def parent(uuid: Column) -> Column:
    return F.nullif(uuid, F.lit(ROOT))


def events(export: DataFrame) -> DataFrame:
    """Canonical events of all messages that render to some text; an unknown sender is an error."""
    sender = required(F.col("sender"), SENDERS, "sender")
    # The sender is judged in the filter, so that a message without text is judged too.
    rows = messages(export).withColumn("_text", rendered_blocks(F.col("text"), F.col("content"))).where(sender.isNotNull() & (F.col("_text") != ""))
    reply = parent(F.col("parent_message_uuid"))
    return canonical(
        rows,
        [F.pmod(F.xxhash64("conversation"), F.lit(1 << 31)), F.col("pos")],
        id=chat_id(F.col("conversation"), F.col("uuid")),
        t_utc=parse_iso(F.col("created_at")),
        author_role=F.when(sender == "human", "self").otherwise("other"),
        content=F.col("_text"),
        thread_id=F.col("conversation"),
        reply_to=reply,
        raw_ref=F.concat(F.lit("claude:"), F.col("conversation"), F.lit("#"), F.col("uuid")),
        source=F.lit("claude"),
    )


def reply_event_id(thread: Column, reply_to: Column) -> Column:
    """The id of the event that a chat event replies to; ``reply_to`` itself names the source's message."""
    return F.when(reply_to.isNotNull(), chat_id(thread, reply_to))
