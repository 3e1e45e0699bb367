"""From principles through memories to raw events, and back: counts, traces, slices, integrity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronicle.functions.text import filled
from chronicle.tables import materialize

#: Events shown with a memory, and characters shown of each.
SAMPLE_EVENTS, SHOWN_CHARS = 8, 280
#: Pairs of items that a task makes or sums up, on average.
PAIRS_A_TASK = 1_000_000


def principle_counts(principles: DataFrame, links: DataFrame, memory_events: DataFrame) -> DataFrame:
    """Each principle with its distinct memories and events, also if it has none.

    Events are made distinct per principle before they are counted; both counts come
    from one pass over the joined links.
    """
    joined = links.join(memory_events, "memory_id", "left")
    counts = joined.groupBy("principle_id").agg(
        F.count_distinct("memory_id").alias("n_memories"), F.count_distinct("event_id").alias("n_events"), F.array_sort(F.collect_set("memory_id")).alias("memory_ids")
    )
    out = principles.join(counts, principles["id"] == counts["principle_id"], "left").drop("principle_id")
    none = F.array().cast(out.schema["memory_ids"].dataType)
    return out.withColumns({"n_memories": F.coalesce("n_memories", F.lit(0)), "n_events": F.coalesce("n_events", F.lit(0)), "memory_ids": F.coalesce("memory_ids", none)})


def edge_counts(edges: DataFrame, links: DataFrame, memory_events: DataFrame) -> DataFrame:
    """Each edge with the distinct memories and events behind it."""
    renamed = links.withColumnRenamed("edge_id", "principle_id")
    return principle_counts(edges, renamed, memory_events)


def memory_samples(memories: DataFrame, memory_events: DataFrame, events: DataFrame, keep: int = SAMPLE_EVENTS) -> DataFrame:
    """Each memory with the number of its events and the first ``keep`` of them in time.

    The rank filter stands directly on the window, so Spark cuts each partition's groups
    before the shuffle.
    """
    joined = memory_events.join(events.select(F.col("id").alias("event_id"), "t_utc", "content", "source", "raw_ref"), "event_id")
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy("t_utc", "event_id"))
    shown = F.substring(F.coalesce("content", F.lit("")), 1, SHOWN_CHARS).alias("content")
    first = joined.withColumn("rank", rank).where(F.col("rank") <= keep)
    first = first.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id", "t_utc", shown, "source", "raw_ref"))).alias("events"))
    out = memories.join(event_totals(memory_events), "memory_id", "left").join(first, "memory_id", "left")
    return out.withColumns({"n_events": F.coalesce("n_events", F.lit(0)), "events": F.coalesce("events", F.array().cast(out.schema["events"].dataType))})


def event_totals(memory_events: DataFrame) -> DataFrame:
    """(memory_id, n_events): the events linked to each memory."""
    return memory_events.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n_events"))


def raw_events(counted: DataFrame) -> DataFrame:
    """(memories, raw_events): all memories (n_events) and the raw events behind them, in one row."""
    return counted.agg(F.count(F.lit(1)).alias("memories"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("raw_events"))


def trace(principles: DataFrame, links: DataFrame, memory_events: DataFrame, events: DataFrame) -> DataFrame:
    """(principle_id, memory_id, event_id and the event's columns): each way from a principle to raw events."""
    ids = principles.select(F.col("id").alias("principle_id"))
    raw = events.withColumnRenamed("id", "event_id")
    return ids.join(links, "principle_id").join(memory_events, "memory_id").join(raw, "event_id")


def depth(links: DataFrame, memory_events: DataFrame, key: str = "principle_id") -> DataFrame:
    """(key, memories, events) by falling number of events."""
    joined = links.join(memory_events, "memory_id")
    return joined.groupBy(key).agg(F.count_distinct("memory_id").alias("memories"), F.count_distinct("event_id").alias("events")).orderBy(F.desc("events"), key)


def top_principles(counted: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by confidence times ln(events + 1); a missing confidence is an error."""
    sure = F.coalesce("confidence", F.raise_error(F.concat(F.lit("no confidence: "), F.col("id").cast("string"))))
    return counted.withColumn("score", sure * F.ln(F.col("n_events") + 1.0)).orderBy(F.desc("score"), F.desc("confidence"), "id").limit(n)


def find_by_prefix(table: DataFrame, prefixes: DataFrame, key: str = "id") -> DataFrame:
    """(prefix, id): the first ``key`` that begins with each prefix, as ``key``; any number of prefixes.

    Each key is cut to the lengths that prefixes have and joined on equal text; the least
    key of a cut is found before anything moves.
    """
    asked = prefixes.select("prefix").where("prefix IS NOT NULL").distinct()
    lengths = sorted(r[0] for r in asked.select(F.char_length("prefix")).distinct().collect())  # no more than the longest prefix has characters
    text = F.col(key).cast("string")
    cut = table.select(key, F.explode(F.array(*map(F.lit, lengths or [0]))).alias("n")).where(F.char_length(text) >= F.col("n"))
    least = cut.groupBy(F.substring(text, F.lit(1), F.col("n")).alias("prefix")).agg(F.min(key).alias(key))
    return least.join(asked, "prefix")


def slice_of(chosen: DataFrame, edges: DataFrame, links: DataFrame, edge_links: DataFrame, memory_events: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """What hangs together with the chosen principles (id): edges inside, memories of both, their events."""
    ids = chosen.select("id").distinct()
    end = lambda c: ids.select(F.col("id").alias(c))
    inner = edges.join(end("src_principle_id"), "src_principle_id", "left_semi").join(end("dst_principle_id"), "dst_principle_id", "left_semi")
    own = links.join(end("principle_id"), "principle_id", "left_semi")
    on_edges = edge_links.join(inner.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    memories = own.select("memory_id").union(on_edges.select("memory_id")).distinct()
    kept = memory_events.join(memories, "memory_id", "left_semi")
    raw = events.join(kept.select(F.col("event_id").alias("id")), "id", "left_semi")
    return {"edges": inner, "principle_memories": own, "edge_memories": on_edges, "memories": memories, "memory_events": kept, "events": raw}


def orphans(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, orphans): for each (name, child, column, parent, column) the child rows without a parent."""
    out = None
    for name, child, column, parent, key in checks:
        lone = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
        row = lone.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("orphans"))
        out = row if out is None else out.unionByName(row)
    return out


def integrity(principles: DataFrame, edges: DataFrame, memories: DataFrame, links: DataFrame, edge_links: DataFrame, memory_events: DataFrame, events: DataFrame) -> DataFrame:
    """(check, orphans) of the eight references, and of principles that no event stands behind."""
    eight = [
        ("edge source", edges, "src_principle_id", principles, "id"),
        ("edge target", edges, "dst_principle_id", principles, "id"),
        ("link principle", links, "principle_id", principles, "id"),
        ("link memory", links, "memory_id", memories, "memory_id"),
        ("edge link edge", edge_links, "edge_id", edges, "id"),
        ("edge link memory", edge_links, "memory_id", memories, "memory_id"),
        ("event link memory", memory_events, "memory_id", memories, "memory_id"),
        ("event link event", memory_events, "event_id", events, "id"),
    ]
    backed = links.join(memory_events, "memory_id").select(F.col("principle_id").alias("id"))
    bare = principles.join(backed, "id", "left_anti").agg(F.lit("principle without event").alias("check"), F.count(F.lit(1)).alias("orphans"))
    return orphans(eight).unionByName(bare)


def graph_json(principles: DataFrame, edges: DataFrame, memories: DataFrame, origin: str) -> DataFrame:
    """One row with the whole graph as compact JSON: a file for one user, of a size that was chosen with ``top_principles``."""
    whole = lambda df, name: df.agg(F.lit(1).alias("one"), F.collect_list(F.struct(*df.columns)).alias(name))
    joined = whole(principles, "principles").join(whole(edges, "edges"), "one").join(whole(memories, "memories"), "one")
    return joined.select(F.to_json(F.struct("principles", "edges", "memories", F.lit(origin).alias("generated_from"))).alias("value"))


def co_occurrence(tagged: DataFrame, item: str, group: str = "memory_id") -> DataFrame:
    """(a, b, together): pairs of items by the number of groups that hold both.

    Pairs are counted before they are made, and made and summed up in tasks of PAIRS_A_TASK on
    average: by their bytes groups would be dealt to few tasks, as pairs are far more than rows.
    """
    own = tagged.select(group, F.col(item).alias("a")).where(filled(F.col("a").cast("string")).isNotNull()).distinct()
    own = materialize(own, "tagged")
    n = F.col("n").cast("double")
    pairs = own.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    tasks = max(1, math.ceil(pairs / PAIRS_A_TASK))
    left, right = own.repartition(tasks, group), own.withColumnRenamed("a", "b").repartition(tasks, group)
    met = left.join(right.hint("merge"), group).where("a < b").select("a", "b")
    return met.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
