"""The events table through stops, repeats and many upserts; ties in time."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronicle.operators import episodes, upsert
from chronicle.schema import EVENT
from chronicle.sources import chats, plays
from chronicle.tables import shared_dir, unused

T0 = datetime.datetime(2024, 1, 1, 12)


def rows(spark, ids, content="x"):
    return spark.createDataFrame([(i, T0, "self", content, "t", None, i, "app", "{}", content, 0) for i in ids], EVENT)


def held(table):
    return {r.id: r.content for r in table.read().collect()}


def test_a_stop_leaves_the_table_before(spark, tmp_path):
    path = str(tmp_path / "events")
    table = upsert.EventTable(spark, path)
    assert held(table) == {} and table.add(rows(spark, [])) == 0
    table.add(rows(spark, ["a", "b"]))
    before = held(table)
    for stop in ("_write", "_commit"):
        broken = upsert.EventTable(spark, path)
        real = getattr(broken, stop)

        def fail(*args, real=real, late=stop == "_write"):
            if late:
                real(*args)  # the folder is there, the log does not name it
            raise OSError("stop")

        setattr(broken, stop, fail)
        for act in (broken.add, broken.replace):
            with pytest.raises(OSError):
                act(rows(spark, ["b", "c"], "new"))
        assert held(upsert.EventTable(spark, path)) == before
    table.add(rows(spark, ["b", "c"], "new"))
    assert held(table) == {"a": "x", "b": "new", "c": "new"}
    assert table.vacuum() == 0 and table.vacuum(0) >= 4 and held(upsert.EventTable(spark, path)) == {"a": "x", "b": "new", "c": "new"}


def test_two_writers_are_an_error(spark, tmp_path):
    one = upsert.EventTable(spark, str(tmp_path / "events"))
    one.add(rows(spark, ["a"]))
    number, state = one._state()
    one._commit(number + 1, state)
    with pytest.raises(RuntimeError, match="another writer"):
        one._commit(number + 1, state)
    assert one._log() == [1, 2]


def test_equal_times_do_not_depend_on_row_order(spark):
    """Plays have no order of their own: ids decide, however the rows lie."""
    record = [(f"2024-01-01T0{k // 6}:00:00Z", 40_000 + k, f"song {k}", f"u:{k}") for k in range(48)]
    names = "ts string, ms_played long, master_metadata_track_name string, spotify_track_uri string"
    more = ["master_metadata_album_artist_name", "master_metadata_album_album_name", "episode_name", "episode_show_name", "spotify_episode_uri", "audiobook_title", "audiobook_uri", "audiobook_chapter_title"]

    def made(order, parts):
        random.Random(order).shuffle(record)
        df = spark.createDataFrame(record, names).withColumns({c: F.lit(None).cast("string") for c in more}).repartition(parts)
        e = plays.events(df)
        return [sorted((r.episode_id, r.n_events) for r in episodes.gathered(f(e, 30)).collect()) for f in (episodes.numbered, episodes.numbered_in_days)]

    first, second = made(1, 1), made(2, 5)
    assert first == second and first[0] == first[1] and len(first[0]) == 8


def test_unknown_sender_without_text(spark):
    message = ("m0", "robot", "", [], "2024-01-01T00:00:00Z", None, None)
    schema = "uuid string, created_at string, chat_messages array<struct<uuid: string, sender: string, text: string, content: array<struct<type: string, text: string, name: string>>, created_at: string, updated_at: string, parent_message_uuid: string>>"
    with pytest.raises(Exception, match="unknown sender"):
        chats.events(spark.createDataFrame([("c", "2024-01-01T00:00:00Z", [message])], schema)).collect()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "Row int, row_ int")
    assert unused(df, "row") == "row__" and unused(df, "other") == "other"
