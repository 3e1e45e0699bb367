"""Banks through repeated loads, records in the order of their lines, capsule records, commands of every source."""

import datetime
import json

import pytest

from chronicle import cli
from chronicle.operators import transcripts
from chronicle.plans.engine import Engine
from chronicle.schema import EVENT
from chronicle.sources import capsules, jsonl

T0 = datetime.datetime(2024, 1, 1, 12)


def event(i, minutes, content, thread="t"):
    return (i, T0 + datetime.timedelta(minutes=minutes), "self", content, thread, None, i, "app", "{}", content, minutes)


def test_a_grown_episode_has_one_document(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "user"))
    engine.events.add(spark.createDataFrame([event("a", 0, "one"), event("z", 900, "far")], EVENT))
    assert engine.load("me", None) == 2
    engine.events.add(spark.createDataFrame([event("b", 5, "two")], EVENT))
    assert engine.load("me", 1) == 1  # what was put, not what the bank has
    assert sorted(r.text for r in engine.bank("me").collect()) == ["me: far", "me: one\nme: two"]


def test_banks_are_made_and_named(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "user"))
    assert engine.banks() == [] and engine.bank("none").count() == 0
    assert engine.create_bank("a/b c") and not engine.create_bank("a/b c") and engine.banks() == ["a/b c"]
    assert engine.bank("a/b c").count() == 0 and engine.show("a/b c", "x")[1] == "  (nothing surfaced)"
    engine.events.add(spark.createDataFrame([event("a", 0, "one")], EVENT))
    assert engine.load("a/b c") == 1 and engine.load("other") == 1 and engine.banks() == ["a/b c", "other"]
    assert not engine.create_bank("other") and engine.bank("other").count() == 1
    with pytest.raises(ValueError):
        transcripts.documents(engine.episodes(), -1)


def test_the_last_line_of_an_id_wins(spark, tmp_path):
    """Whatever the content hashes say, and in the order of the files' names."""
    line = lambda i, content: json.dumps({"id": i, "t_utc": "2024-01-01T00:00:00+00:00", "author_role": "self", "content": content, "thread_id": "t", "reply_to": None, "raw_ref": i})
    (tmp_path / "in").mkdir()
    for name, versions in (("b.jsonl", ["c", "b", "a"]), ("a.jsonl", ["z", "y"])):
        (tmp_path / "in" / name).write_text("\n".join([line("one", v) for v in versions] + [line(f"{name}{k}", "x" * 200) for k in range(300)]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        events = jsonl.read_events(spark, str(tmp_path / "in"))
        engine = Engine(spark, str(tmp_path / "user"))
        assert engine.events.add(events) == 605 and engine.events.lookup("one").first().content == "a"
        ordered = [r.id for r in events.where("id <> 'one'").orderBy("ingest_seq").collect()]
        assert ordered == [f"{n}{k}" for n in ("a.jsonl", "b.jsonl") for k in range(300)] and events.select("ingest_seq").distinct().count() == 605
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_capsule_records_come_back(spark, tmp_path):
    c = spark.createDataFrame([("a", T0, "Here", 1.5, -2.0), ("b", T0 + datetime.timedelta(microseconds=5), "Th\u00e9re", None, None)], "id string, created_at timestamp, place_name string, lat double, lng double")
    m = spark.createDataFrame([("1", "a", "photo", "p", "image/x", 1, T0, 3.0, None), ("2", "a", "text", "q", "text/plain", 0, None, None, None)], "id string, capsule_id string, kind string, file_path string, mime string, byte_size bigint, exif_t timestamp, exif_lat double, exif_lng double")
    assert jsonl.write(jsonl.capsule_records(capsules.with_media(c, m)), str(tmp_path / "c")) == 2
    record = next(json.loads(r.value) for r in spark.read.text(str(tmp_path / "c")).collect() if "Here" in r.value)
    assert list(record) == ["id", "created_at", "place_name", "lat", "lng", "media"] and record["created_at"] == "2024-01-01T12:00:00+00:00"
    assert record["media"][0] == {"id": "1", "capsule_id": "a", "kind": "photo", "file_path": "p", "mime": "image/x", "byte_size": 1, "exif_t": "2024-01-01T12:00:00+00:00", "exif_lat": 3.0, "exif_lng": None}
    places, media = jsonl.read_capsules(spark, str(tmp_path / "c"))
    shown = lambda df, like: sorted(map(str, df.select(*like.columns).collect()))
    assert shown(places, c) == shown(c, c) and shown(media, m) == shown(m, m)
    (tmp_path / "old.jsonl").write_text('{"id": "x", "created_at": "2024-01-01T00:00:00Z", "place_name": "P"}\n')
    places, media = jsonl.read_capsules(spark, str(tmp_path / "old.jsonl"))
    assert places.first().lat is None and media.count() == 0


def test_commands_of_other_sources(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "user"))
    told = lambda folder, source, *more: cli.run(engine, cli.parser().parse_args(["x", "ingest", "--tables", str(folder), "--source", source, *more]))
    plays, chats, records = (tmp_path / n for n in ("plays", "chats", "records"))
    for folder in (plays, chats, records):
        folder.mkdir()
    (plays / "Streaming_History_0.json").write_text(json.dumps([{"ts": f"2024-01-01T0{h}:00:00Z", "ms_played": 20_000 + 20_000 * h, "master_metadata_track_name": f"Song {h}", "spotify_track_uri": f"u:{h}"} for h in range(3)]))
    assert told(plays, "plays") == ["events: 2"] and told(plays, "plays", "--min-ms", "1") == ["events: 3"]
    message = {"uuid": "m", "sender": "human", "text": "hi", "content": [], "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "parent_message_uuid": None}
    (chats / "conversations.json").write_text(json.dumps([{"uuid": "c", "name": "n", "summary": "", "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z", "chat_messages": [message]}]))
    assert told(chats, "chats") == ["events: 1"]
    jsonl.write(jsonl.event_records(engine.events.read().where("source = 'spotify'")), str(records / "r"))
    assert told(records / "r", "records") == ["events: 3"] and engine.events.read().count() == 4
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x", "ingest", "--tables", "t", "--source", "nothing"])
