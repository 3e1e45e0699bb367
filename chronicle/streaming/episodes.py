"""Episodes that late and changed events change: only the stretches between the nearest gaps are cut anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronicle.operators import episodes
from chronicle.operators.levels import LevelledTable
from chronicle.operators.temporal import UNIT, overlaps
from chronicle.operators.upsert import EventTable
from chronicle.tables import materialize

EPISODES = "episode_id string, thread_id string, start_utc timestamp, end_utc timestamp, n_events bigint, first_id string, first_seq bigint"
CHANGE = "id string, thread_id string, t_utc timestamp"


class LateEpisodes:
    """The episodes of an events table, kept right through every upsert.

    An upsert touches the places (thread and time) of its rows, and those that the same ids
    had before it.  An episode is touched that reaches within a gap of such a place.  The
    events in touched episodes and the new rows are cut anew: what lies beyond was further
    off than a gap from all of them before, and still is.  Touched episodes that did not come
    out again are taken away in the same commit that puts the others.
    """

    def __init__(self, events: EventTable, path: str, gap_minutes: float = episodes.GAP_MINUTES):
        self.spark, self.events, self.path, self.gap_minutes = events.spark, events, path.rstrip("/"), gap_minutes
        self.table = _table(self.spark, path)

    def _changes(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """(id, thread_id, t_utc) of the batch's rows and of what they replace, written before anything is changed.

        A batch that comes again after a failure finds them there, as the events table may
        already have the new rows.
        """
        own = self.events.latest(batch.withColumn("_gone", F.lit(False)))
        path = f"{self.path}/changes/batch={batch_id}"
        folder = self.events._of(f"{self.path}/changes")
        if not self.events._fs.exists(self.events._of(f"{path}/_SUCCESS")):
            before = self.events.rows_of(own.select("id"))
            both = own.select("id", "thread_id", "t_utc").unionByName(before.select("id", "thread_id", "t_utc"))
            both.where("thread_id IS NOT NULL").write.mode("overwrite").parquet(path)
        for s in self.events._fs.listStatus(folder):  # those of batches that are done
            name = s.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < batch_id:
                self.events._fs.delete(s.getPath(), True)
        return self.spark.read.schema(CHANGE).parquet(path)

    def _places(self, changes: DataFrame) -> DataFrame:
        """(thread_id, start_utc, end_utc): all times within a gap of a change; changes of one slot of a gap's length are one interval."""
        gap = int(self.gap_minutes * 60_000_000)
        micros = F.unix_micros("t_utc")
        slots = changes.groupBy("thread_id", F.floor(micros / max(1, gap)).alias("_slot")).agg(F.min(micros).alias("a"), F.max(micros).alias("b"))
        return slots.select("thread_id", F.timestamp_micros(F.col("a") - gap).alias("start_utc"), F.timestamp_micros(F.col("b") + gap).alias("end_utc"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Upsert ``batch`` and bring the episodes up to date; nothing changes if it is done twice."""
        batch = batch.persist()
        try:
            changes = self._changes(batch, batch_id)
            self.events.add(batch)
            places = materialize(self._places(changes), "places")
            ends = places.agg(F.min("start_utc"), F.max("end_utc")).first()
            if ends[0] is None:
                return
            unit = max(UNIT, int(self.gap_minutes * 60_000_000))  # a thread's episodes begin further apart, so few meet in a slot, and an event is a row in few levels
            # Statistics of the files leave out the episodes before and after all places, and so below for events.
            near = self.table.read().where((F.col("end_utc") >= F.lit(ends[0])) & (F.col("start_utc") <= F.lit(ends[1])))
            touched = materialize(overlaps(near, places, by=("thread_id",), unit=unit).select("a.*").dropDuplicates(["episode_id"]), "touched")
            reach = touched.agg(F.min("start_utc"), F.max("end_utc")).first()
            new = self.events.latest(batch.withColumn("_gone", F.lit(False))).select("id", "thread_id", "t_utc", "ingest_seq", "author_role")
            if reach[0] is None:
                rows = new
            else:
                held = self.events.read().select(*new.columns).where(F.col("t_utc").between(F.lit(reach[0]), F.lit(reach[1])))
                points = held.withColumns({"start_utc": F.col("t_utc"), "end_utc": F.col("t_utc")})
                inside = overlaps(points, touched.select("thread_id", "start_utc", "end_utc"), by=("thread_id",), unit=unit).select(*[F.col(f"a.{c}") for c in new.columns])
                rows = inside.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new)
            cut = episodes.gathered(episodes.numbered_in_days(rows, self.gap_minutes))
            made = materialize(cut.select(*self.table.columns), "episodes")
            self.table.apply(made, touched.join(made, "episode_id", "left_anti"))
        finally:
            batch.unpersist()


def _table(spark: SparkSession, path: str) -> LevelledTable:
    return LevelledTable(spark, f"{path.rstrip('/')}/episodes", EPISODES, "episode_id", sort=("start_utc", "end_utc"))


def start(events: DataFrame, table: EventTable, path: str, checkpoint: str, gap_minutes: float = episodes.GAP_MINUTES, **trigger) -> StreamingQuery:
    """Upsert a stream of events and keep the episodes of all threads under ``path``, however late an event is or where it moves."""
    kept = LateEpisodes(table, path, gap_minutes)
    return events.writeStream.foreachBatch(kept.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The episodes as they are, with their number in the thread; a thread may have any number, as they are counted by day."""
    rows = _table(spark, path).read().withColumn("_day", F.to_date("start_utc"))
    days = rows.groupBy("thread_id", "_day").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("thread_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    own = F.row_number().over(Window.partitionBy("thread_id", "_day").orderBy("start_utc"))
    days = days.select("thread_id", "_day", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_own", own).join(days, ["thread_id", "_day"])
    return numbered.withColumn("episode", (F.col("_before") + F.col("_own") - 1).cast("bigint")).drop("_day", "_before", "_own")
