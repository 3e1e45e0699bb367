"""A façade over one user's data: ingest, episodes, documents, capsules, networks, report."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.operators import episodes, provenance, report, retrieval, transcripts
from chronicle.operators.episodes import GAP_MINUTES
from chronicle.operators.upsert import EventTable
from chronicle.schema import CAPSULE, MEDIA
from chronicle.sources import capsules, chats, jsonl, messages, photos, plays, watch_history
from chronicle.tables import materialize

DEFAULT_EPISODES = 20


class Provider(Protocol):
    """What a memory engine does for us; the default ranks and sums up without a model."""

    def recall(self, bank: DataFrame, query: str, k: int) -> DataFrame: ...

    def reflect(self, facts: DataFrame, query: str) -> str: ...


class PlainProvider:
    """BM25 for recall; the best facts within the token budget, as a list, for reflection."""

    def recall(self, bank: DataFrame, query: str, k: int = 25) -> DataFrame:
        asked = bank.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
        return retrieval.lexical(bank, asked, k, key="id").join(bank, "id").orderBy("rank")

    def reflect(self, facts: DataFrame, query: str) -> str:
        tokens = F.size(F.split("text", r"\s+"))
        kept = retrieval.within_budget(facts.withColumn("query_id", F.lit(0)), tokens)
        return "\n".join(f"- {r.text}" for r in kept.orderBy("rank").collect())  # within the budget


class Engine:
    """Tables under ``root``: events, capsules, media and memory banks."""

    def __init__(self, spark: SparkSession, root: str, provider: Provider | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.events = EventTable(spark, f"{self.root}/events")
        self.provider = provider or PlainProvider()

    def ingest_messages(self, message: DataFrame, chat: DataFrame, links: DataFrame, top: int, since=None) -> int:
        return self.events.add(messages.events(message, chat, links, top, since))

    def ingest_plays(self, folder: str, min_ms: int = plays.MIN_MS) -> int:
        return self.events.add(plays.events(plays.records(self.spark, folder), min_ms))

    def ingest_photos(self, asset: DataFrame, attributes: DataFrame, face: DataFrame, person: DataFrame) -> int:
        return self.events.add(photos.events(photos.records(asset, attributes, face, person)))

    def ingest_chats(self, folder: str) -> int:
        return self.events.add(chats.events(chats.load(self.spark, folder)))

    def ingest_watch_history(self, path: str) -> int:
        return self.events.add(watch_history.events(watch_history.load(self.spark, path)))

    def episodes(self, gap_minutes: float = GAP_MINUTES, source: str | None = None) -> DataFrame:
        rows = self.events.read()
        return episodes.build(rows if source is None else rows.where(F.col("source") == source), gap_minutes)

    def load(self, bank: str, limit: int | None = DEFAULT_EPISODES, gap_minutes: float = GAP_MINUTES) -> int:
        """Put the episodes' documents into a bank; how many were put."""
        return transcripts.retain(transcripts.documents(self.episodes(gap_minutes), limit), f"{self.root}/banks", bank)

    def create_bank(self, bank: str) -> bool:
        return transcripts.create_bank(self.spark, f"{self.root}/banks", bank)

    def banks(self) -> list[str]:
        return transcripts.banks(self.spark, f"{self.root}/banks")

    def bank(self, bank: str) -> DataFrame:
        rows = transcripts.bank_table(self.spark, f"{self.root}/banks", bank).read()
        names = F.transform("entities", lambda e: e["text"]).alias("entities")
        return rows.select("id", F.col("content").alias("text"), "timestamp", "tags", names)

    def show(self, bank: str, query: str, k: int = 25) -> list[str]:
        """A short report: what was recalled, and a reflection on it."""
        found = self.provider.recall(self.bank(bank), query, k)
        lines = [f"- {r.text}" for r in found.collect()]  # k rows at most
        return ["MEMORIES", *(lines or ["  (nothing surfaced)"]), "REFLECTION", self.provider.reflect(found, query) or "  (nothing to reflect on)"]

    def memories(self, bank: str) -> DataFrame:
        """The bank's documents as memories of experiences."""
        none = F.lit(None).cast("timestamp")
        return self.bank(bank).select("id", "text", F.col("timestamp").alias("occurred_start"), none.alias("mentioned_at"), none.alias("occurred_end"), "entities", F.lit("experience").alias("fact_type"))

    def recalled(self, memories: DataFrame, types: list[str], query: str | None, k: int) -> DataFrame:
        """The ``k`` memories of some types that answer a query best, or without one the latest, with their rank."""
        rows = retrieval.of_types(memories, types)
        if query:
            return self.provider.recall(rows, query, k)
        latest = rows.orderBy(F.desc("occurred_start"), "id").limit(k)
        return latest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("occurred_start"), "id")))  # k rows

    def report(self, bank: str, query: str | None = None, k: int = 25, memories: DataFrame | None = None, observations: DataFrame | None = None, principles: DataFrame | None = None) -> list[str]:
        """The five sections as lines; people are counted in the memories' entities if no ``observations`` (name, text, t) are given."""
        held = self.memories(bank) if memories is None else memories
        lived, known = (self.recalled(held, [kind], query, k) for kind in ("experience", "world"))
        if observations is None:
            observations = held.select(F.explode("entities").alias("name"), F.lit(None).cast("string").alias("text"), F.col("occurred_start").alias("t"))
        if principles is None:
            principles = self.spark.createDataFrame([], "rank long, name string, content string")
        facts = lived.select("text", "rank").unionByName(known.select("text", (F.col("rank") + k).alias("rank")))
        text = self.provider.reflect(facts, query or "")
        sections = [report.experiences(lived), report.facts(known), report.persons(observations), report.beliefs(principles)]
        return [x for section in sections for x in report.lines(section)] + report.connections(text)

    def write_episodes(self, path: str, gap_minutes: float = GAP_MINUTES) -> int:
        """The episodes as JSON lines; their number."""
        return jsonl.write(jsonl.episode_records(self.episodes(gap_minutes)), path)

    def export(self, principles: DataFrame, edges: DataFrame, links: DataFrame, edge_links: DataFrame, memories: DataFrame, memory_events: DataFrame, path: str, origin: str, n: int | None = None) -> dict[str, int]:
        """Write one user's graph as JSON: all principles, or the ``n`` of most weight with the edges between them; what was written."""
        chosen = provenance.principle_counts(principles, links, memory_events)
        chosen = chosen if n is None else provenance.top_principles(chosen, n)
        chosen = materialize(chosen, "export-principles")
        parts = provenance.slice_of(chosen.select("id"), edges, links, edge_links, memory_events, memories.select(F.col("memory_id").alias("id")))
        kept = memories.join(parts["memories"], "memory_id", "left_semi")
        counted = kept.join(provenance.event_totals(memory_events), "memory_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
        counted = materialize(counted, "export-memories")
        provenance.graph_json(chosen, parts["edges"], counted, origin).write.mode("overwrite").text(path)
        totals = provenance.raw_events(counted).first()
        return {"principles": chosen.count(), "edges": parts["edges"].count(), "memories": totals.memories, "raw_events": totals.raw_events}

    def add_capsules(self, new: DataFrame, media: DataFrame) -> tuple[int, DataFrame]:
        """Store capsules with their media, and as events; the number stored, and those rejected with a reason.

        The capsules themselves are written last: if a step before fails, none is there, and the
        same call may be made again.
        """
        good, bad = capsules.named(new)
        if good.groupBy("id").count().where("count > 1").limit(1).count() or good.join(self._table("capsules", CAPSULE).select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("a capsule with this id is there already")
        own = media.join(good.select(F.col("id").alias("capsule_id")), "capsule_id", "left_semi").select(*media.columns)
        own.write.mode("append").parquet(f"{self.root}/media")
        stored = self.events.add(capsules.events(capsules.with_media(good, media)))
        good.write.mode("append").parquet(f"{self.root}/capsules")
        return stored, bad

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table under the root; an empty one if nothing was written yet."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def capsules(self, id: str | None = None) -> DataFrame:
        """Capsules with their media, newest first; one of them by its id."""
        rows = self._table("capsules", CAPSULE)
        rows = rows if id is None else rows.where(F.col("id") == id)
        return capsules.with_media(rows, self._table("media", MEDIA).dropDuplicates(["id"])).orderBy(F.desc("created_at"), "id")
