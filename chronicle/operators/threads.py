"""Threads of replies: the first message of each message's thread, and how deep it stands under it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronicle.tables import join_split, materialize


def reply_roots(messages: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(key, root, depth) of each message, by pointer doubling.

    Each message points at its parent, one step away; in every round it takes its target's
    target and adds the steps, so a chain of n replies takes log2(n) rounds, each written to
    the shared folder.  Messages whose target is a first one are done and move no more; a
    target of very many messages is sent to where they lie.  A parent that is not there makes
    a message a first one, of depth 0.  Messages that lead into a circle have neither root
    nor depth.  Keys must be unique.
    """
    known = messages.select(F.col(key).alias("_known"))
    linked = messages.select(F.col(key).alias("id"), F.col(parent).alias("to")).join(known, F.col("to") == F.col("_known"), "left")
    state = materialize(linked.select("id", F.col("_known").alias("to"), F.col("_known").isNotNull().cast("bigint").alias("steps")), "replies")
    first = state.where("to IS NULL").select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"))
    done, open_ = [first], state.where("to IS NOT NULL")
    ends = first.select(F.col("id").alias("to"), F.lit(True).alias("_end"))
    rest, rounds = open_.count(), 0
    limit = rest.bit_length() + 1
    while rest and rounds <= limit:
        told = materialize(open_.join(ends, "to", "left"), "replies")
        done.append(told.where("_end").select("id", F.col("to").alias("root"), F.col("steps").alias("depth")))
        left = told.where("_end IS NULL").select("id", "to", "steps")
        # A target that is not first has a target of its own, among the messages of this round or among those done before.
        target = told.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        for d in done[1:-1]:
            target = target.unionByName(d.select(F.col("id").alias("to"), F.col("root").alias("next"), F.col("depth").alias("more")))
        weight = left.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        side = materialize(target.join(weight, "to"), "targets")
        rest = left.count()
        open_ = materialize(join_split(left, side, "to", "n", rest).select("id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "replies")
        rounds += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    lost = open_.select("id", F.lit(None).cast(first.schema["root"].dataType).alias("root"), F.lit(None).cast("bigint").alias("depth"))
    return out.unionByName(lost).withColumnRenamed("id", key)
