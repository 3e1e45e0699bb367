"""Streams over files must give what the batch operators give."""

import datetime

from pyspark.sql import functions as F

from chronicle.operators import episodes, upsert
from chronicle.schema import EVENT
from chronicle.streaming import sessions
from chronicle.streaming import upsert as stream_upsert

T0 = datetime.datetime(2024, 1, 1, 12)


def batch(spark, rows):
    return spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=m), "self", i, "t", None, i, "app", "{}", "x", k) for k, (i, m) in enumerate(rows)], EVENT)


def test_streams(spark, tmp_path):
    rows = [("a", 0), ("b", 30), ("c", 70), ("d", 80), ("e", 1000), ("f", 3000)]
    src = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        batch(spark, part).coalesce(1).write.mode("append").json(src)
    read = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(src)

    table = upsert.EventTable(spark, str(tmp_path / "table"))
    stream_upsert.start(read(), table, str(tmp_path / "c1")).awaitTermination(120)
    assert table.read().count() == 6

    want = {r.first_id: r.n_events for r in episodes.build(batch(spark, rows)).collect()}
    for name, made in (("s1", sessions.sessions(read())), ("s2", sessions.exact_episodes(read()))):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.n_events for r in spark.table("s1").collect()) == [1, 2, 2]
    got = {r.first_id: r.n_events for r in spark.table("s2").collect()}
    # The watermark has passed all but the last episode, which stays open.
    assert got == {i: n for i, n in want.items() if i != "f"}


def test_closed_episodes_leave_no_state(spark, tmp_path):
    """However the rows are cut into micro-batches: every closed episode once, as the batch operators give it, and only open events in the state."""
    spark.conf.set(*sessions.STORE)
    rows = [("a", 0), ("c", 70), ("b", 30), ("u1", 75), ("d", 80), ("f", 500), ("e", 505), ("u2", 700), ("g", 3000)]
    thread = lambda i: "u" if i.startswith("u") else "t"
    made = lambda part: batch(spark, part).withColumn("thread_id", F.when(F.col("id").startswith("u"), "u").otherwise("t"))
    want = {(r.thread_id, r.episode_id, r.start_utc, r.end_utc, r.n_events, r.first_id) for r in episodes.gathered(episodes.numbered(made(rows))).collect()}
    for case, cuts in enumerate(([3, 6], [1, 2, 5, 7])):
        src = str(tmp_path / f"in{case}")
        for a, z in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            made(rows[a:z]).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(src)
        out = sessions.closed_episodes(stream, late_minutes=90)
        q = out.writeStream.format("memory").queryName(f"closed{case}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{case}")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = spark.table(f"closed{case}").collect()
        assert len(got) == len({r.first_id for r in got})
        # The watermark has passed all but the last event, which alone is kept.
        assert {tuple(r) for r in got} == {w for w in want if w[5] != "g"}
        held = spark.read.format("statestore").option("stateVarName", "held").option("flattenCollectionTypes", "true").load(str(tmp_path / f"c{case}")).collect()
        assert [thread(r.list_element.id) + r.list_element.id for r in held] == ["tg"]
        timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(str(tmp_path / f"c{case}")).collect()
        assert len(timers) == 1


def test_threads_share_states_and_timers(spark, tmp_path):
    """Some messages for each bucket, not for each thread: 300 threads of two buckets leave two timers at most."""
    spark.conf.set(*sessions.STORE)
    rows = [(f"e{k}", 40 * (k // 300) + k % 7) for k in range(900)] + [("last", 5000)]
    made = batch(spark, rows).withColumn("thread_id", F.when(F.col("id") == "last", "end").otherwise(F.concat(F.lit("t"), F.col("ingest_seq") % 300)))
    want = {(r.thread_id, r.episode_id, r.start_utc, r.end_utc, r.n_events, r.first_id) for r in episodes.gathered(episodes.numbered(made)).collect()}
    src, at = str(tmp_path / "in"), str(tmp_path / "c")
    for part in ("ingest_seq < 450", "ingest_seq >= 450 AND id <> 'last'"):
        made.where(part).coalesce(1).write.mode("append").json(src)
    run = lambda: sessions.closed_episodes(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(src), late_minutes=240, buckets=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination(180)
    run()
    timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(at).collect()
    assert 1 <= len(timers) <= 2
    made.where("id = 'last'").coalesce(1).write.mode("append").json(src)
    run()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {w for w in want if w[5] != "last"}


def test_files_of_a_stream_have_a_tasks_size(spark, tmp_path, monkeypatch):
    """As many files as the session shuffles into, not three."""
    from chronicle.plans import store_queries

    monkeypatch.setattr(store_queries, "_new", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        store_queries._by_time(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(list((tmp_path / "by-time").glob("part-*"))) > 3
