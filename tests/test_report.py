"""Report, JSON lines, commands, export, and episodes that late events change."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from chronicle import cli
from chronicle.operators import episodes, report, retrieval, upsert
from chronicle.plans.engine import Engine
from chronicle.schema import EVENT
from chronicle.sources import jsonl
from chronicle.streaming import episodes as late

T0 = datetime.datetime(2024, 1, 1, 12)


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=m), "self", f"says {i}", t, None, i, "app", '{"k": {"n": 1}}', "x", 0) for i, m, t in rows], EVENT)


def test_sections(spark):
    lived = spark.createDataFrame([(1, "a trip", None, None, "2024", ["Ann", "Bob"]), (2, "rain", None, None, None, [])], "rank int, text string, occurred_start string, mentioned_at string, occurred_end string, entities array<string>")
    assert report.lines(report.experiences(lived))[4:] == ["  - a trip", "      when: 2024", "      involving: Ann, Bob", "  - rain"]
    seen = spark.createDataFrame([("Ann", "kind", T0), ("Ann", "late", T0 + datetime.timedelta(1)), (None, None, T0)], "name string, text string, t timestamp")
    assert report.lines(report.persons(seen))[4:] == ["  - Ann", "      kind", "  - (unknown)"]
    beliefs = spark.createDataFrame([(1, "", "be fair")], "rank int, name string, content string")
    assert report.lines(report.beliefs(beliefs))[4:] == ["  - (unnamed)", "      be fair"]
    for k, empty in enumerate([report.experiences(lived.limit(0)), report.facts(lived.limit(0)), report.persons(seen.limit(0)), report.beliefs(beliefs.limit(0))]):
        assert report.lines(empty)[2:] == [f"  {k + 1}. {report.TITLES[k]}", report.RULE, f"  {report.EMPTY[k]}"]
    assert report.connections(None)[-1] == f"  {report.EMPTY[4]}" and report.connections("so")[-1] == "  so"


def test_json_lines(spark, tmp_path):
    e = events(spark, [("a", 0, "t"), ("b", 5, "t"), ("c", 500, "t")])
    assert jsonl.write(jsonl.event_records(e), str(tmp_path / "e")) == 3
    first = json.loads(jsonl.event_records(e.where("id = 'a'")).first().value)
    assert first == {"id": "a", "t_utc": "2024-01-01T12:00:00+00:00", "author_role": "self", "content": "says a", "thread_id": "t", "reply_to": None, "raw_ref": "a", "source": "app", "additional_data": {"k": {"n": 1}}}
    back = {r.id: r for r in jsonl.read_events(spark, str(tmp_path / "e")).collect()}
    assert back["b"].t_utc == T0 + datetime.timedelta(minutes=5) and json.loads(back["b"].additional_data) == {"k": {"n": 1}} and back["b"].content_sha
    built = episodes.build(e)
    assert jsonl.write(jsonl.episode_records(built), str(tmp_path / "p")) == 2
    got = {r.episode_id: r for r in jsonl.read_episodes(spark, str(tmp_path / "p")).collect()}
    want = {r.episode_id: r for r in built.collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.start_utc, r.end_utc, r.participants, [x.id for x in r.events]) == (want[i].start_utc, want[i].end_utc, want[i].participants, [x.id for x in want[i].events])
    (tmp_path / "old.json").write_text('{"id": "z", "t_utc": "2024-01-01T12:00:00Z", "raw_ref": "r"}\n')
    old = jsonl.read_events(spark, str(tmp_path / "old.json")).first()
    assert old.source == "imessage" and old.additional_data == "{}"


def test_commands(spark, tmp_path):
    tables = tmp_path / "tables"
    base = int((T0 - datetime.datetime(2001, 1, 1)).total_seconds())
    spark.createDataFrame([(k, f"hello {k}", None, k % 2, (base + 60 * k) * 10**9) for k in range(4)], "ROWID long, text string, attributedBody binary, is_from_me int, date long").write.parquet(f"{tables}/message")
    spark.createDataFrame([(1, "+15550100", "Ann")], "ROWID long, chat_identifier string, display_name string").write.parquet(f"{tables}/chat")
    spark.createDataFrame([(1, k) for k in range(4)], "chat_id long, message_id long").write.parquet(f"{tables}/chat_message_join")
    engine = Engine(spark, str(tmp_path / "user"))
    args = cli.parser().parse_args([str(tmp_path / "user"), "all", "--tables", str(tables), "--limit", "0", "--bank", "ann"])
    out = cli.run(engine, args)
    assert "events: 4" in out and "episodes: 1" in out and "documents in bank ann: 1" in out and any("hello 3" in x for x in out) and "  - +15550100" in out
    assert cli.run(engine, cli.parser().parse_args(["x", "show", "--bank", "ann"]))[0] == ""
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x"])
    assert engine.write_episodes(str(tmp_path / "ep")) == 1


def test_export(spark, tmp_path):
    df = lambda data, schema: spark.createDataFrame(data, schema)
    principles = df([("p1", "x", 0.9), ("p2", "y", 0.5), ("p3", "z", 0.1)], "id string, text string, confidence double")
    edges = df([("e1", "p1", "p2"), ("e2", "p1", "p3")], "id string, src_principle_id string, dst_principle_id string")
    links, edge_links = df([("p1", "m1"), ("p2", "m2"), ("p3", "m3")], "principle_id string, memory_id string"), df([("e1", "m1")], "edge_id string, memory_id string")
    memories, me = df([("m1",), ("m2",), ("m3",)], "memory_id string"), df([("m1", "v1"), ("m1", "v2"), ("m2", "v3")], "memory_id string, event_id string")
    engine = Engine(spark, str(tmp_path / "user"))
    told = engine.export(principles, edges, links, edge_links, memories, me, str(tmp_path / "out"), "user", 2)
    assert told == {"principles": 2, "edges": 1, "memories": 2, "raw_events": 3}
    whole = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert {p["id"] for p in whole["principles"]} == {"p1", "p2"} and {m["memory_id"]: m["n_events"] for m in whole["memories"]} == {"m1": 2, "m2": 1}
    assert engine.export(principles, edges, links, edge_links, memories, me, str(tmp_path / "out"), "user")["principles"] == 3


def test_late_events_change_episodes(spark, tmp_path):
    source = tmp_path / "in"
    e = events(spark, [("a", 0, "t"), ("c", 50, "t"), ("x", 0, "u")])
    e.coalesce(1).write.json(str(source))
    table = upsert.EventTable(spark, str(tmp_path / "table"))
    run = lambda: late.start(spark.readStream.schema(EVENT).json(str(source)), table, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    run()
    counts = lambda: sorted((r.thread_id, r.n_events) for r in late.read(spark, str(tmp_path / "out")).collect())
    assert counts() == [("t", 1), ("t", 1), ("u", 1)]
    events(spark, [("b", 25, "t")]).coalesce(1).write.mode("append").json(str(source))
    run()
    assert counts() == [("t", 3), ("u", 1)]


def test_duplicate_capsules_in_one_call(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "user"))
    c = spark.createDataFrame([("a", T0, "Here", None, None)] * 2, "id string, created_at timestamp, place_name string, lat double, lng double")
    m = spark.createDataFrame([], "id string, capsule_id string, kind string, file_path string, mime string, byte_size bigint, exif_t timestamp, exif_lat double, exif_lng double")
    with pytest.raises(ValueError):
        engine.add_capsules(c, m)
    assert engine.capsules().count() == 0 and not (tmp_path / "user" / "capsules").exists()


def test_lexical_against_plain_loops(spark):
    import math
    import random
    import re

    rng = random.Random(3)
    texts = {k: " ".join(rng.choice("red blue green bird stone the a".split()) for _ in range(rng.randint(0, 12))) for k in range(60)}
    asked = {1: "the red bird", 2: "stone", 3: "nothing here", 4: "", 5: "a a the"}
    m = spark.createDataFrame([*texts.items(), (99, None)], "id long, text string").repartition(3)
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    words = {k: re.findall(r"\w+", t) for k, t in texts.items()} | {99: []}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    want = []
    for i, t in asked.items():
        scores = {}
        for term in set(re.findall(r"\w+", t)):
            df = sum(term in w for w in words.values())
            for k, w in words.items():
                tf = w.count(term)
                if tf:
                    scores[k] = scores.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        best = sorted(((round(s, 6), -k) for k, s in scores.items()), reverse=True)[:5]
        want += [(i, -k, r + 1) for r, (_, k) in enumerate(best)]
    got = [(r.query_id, r.id, r.rank) for r in retrieval.lexical(m, q, 5).collect()]
    assert sorted(got) == sorted(want) and len(want) > 12
