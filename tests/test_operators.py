"""Operators on small synthetic inputs."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chronicle.functions.ids import content_sha, content_sha_sorted_json
from chronicle.operators import episodes, graph, ledger, provenance, retrieval, transcripts, upsert
from chronicle.schema import EVENT

T0 = datetime.datetime(2024, 1, 1, 12)


def events(spark, rows):
    """rows: (id, minutes, thread, role, content)"""
    full = [(i, T0 + datetime.timedelta(minutes=m), r, c, t, None, f"x#{i}", "app", "{}", None, k) for k, (i, m, t, r, c) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def test_gaps(spark):
    e = events(spark, [("a", 0, "t", "self", "1"), ("b", 30, "t", "other", "2"), ("c", 60.0001, "t", None, "3"), ("d", 5, "u", "self", "x"), ("e", 5, "u", "other", "y"), ("f", 7, None, "self", "no thread")])
    got = {r.first_id: r for r in episodes.build(e).collect()}
    assert {k: r.n_events for k, r in got.items()} == {"a": 2, "c": 1, "d": 2}
    assert got["a"].participants == ["other", "self"] and [x.id for x in got["d"].events] == ["d", "e"]
    want = hashlib.sha256(b"t\0a\0" + b"2024-01-01T12:00:00+00:00").hexdigest()[:16]
    assert got["a"].episode_id == want
    assert [r.first_id for r in episodes.in_thread_order(episodes.build(e)).collect()] == ["a", "c", "d"]
    key = lambda df: sorted((r.id, r.episode) for r in df.select("id", "episode").collect())
    assert key(episodes.numbered_in_days(e)) == key(episodes.numbered(e))
    assert episodes.build(e.limit(0)).count() == 0 and episodes.summary_lines(episodes.build(e.limit(0))) == ["episodes: 0"]
    assert episodes.summary_lines(episodes.build(e))[4] == "single-message episodes: 1 (33.3%)"
    with pytest.raises(Exception, match="no thread"):
        episodes.strict(e).collect()


def test_days_are_stitched(spark):
    e = events(spark, [(f"{k}", m, "t", "self", "") for k, m in enumerate([0, 600, 705, 719, 735, 800, 2200, 2229])])
    key = lambda df: sorted((r.id, r.episode) for r in df.select("id", "episode").collect())
    assert key(episodes.numbered_in_days(e)) == key(episodes.numbered(e))


def test_transcripts(spark):
    e = events(spark, [("a", 0, "+15550100", "self", "hi"), ("b", 1, "+15550100", "other", None)])
    d = transcripts.documents(episodes.build(e)).first()
    assert d.content == "me: hi\n+15550100: " and d.tags == ["app"] and d.metadata["thread_id"] == "+15550100" and d.entities[0].text == "+15550100"
    assert transcripts.documents(episodes.build(e), 0).count() == 1 and transcripts.documents(episodes.build(e), tag="imessage").first().tags == ["imessage"]
    with pytest.raises(ValueError):
        transcripts.documents(episodes.build(e), -1)


def test_upsert(spark, tmp_path):
    table = upsert.EventTable(spark, str(tmp_path / "events"))
    e = events(spark, [("a", 0, "t", "self", "1"), ("b", 1, "t", "self", "2"), ("a", 2, "t", "self", "3")])
    hashed = e.withColumn("content_sha", content_sha(F.col("content"), F.col("additional_data")))
    assert table.add(hashed) == 3 and {r.id: r.content for r in table.read().collect()} == {"a": "3", "b": "2"}
    before = sorted(map(str, table.read().collect()))
    table.add(hashed)
    assert sorted(map(str, table.read().collect())) == before
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    bad = table.read().withColumn("content", F.when(F.col("id") == "b", "tampered").otherwise(F.col("content")))
    assert {r.id: r.intact for r in upsert.verify(bad, ids).collect()} == {"a": True, "b": False, "z": None}
    with pytest.raises(Exception, match="duplicate id"):
        upsert.append_new(table.read(), table.read()).collect()
    assert upsert.write_jsonl(table.read(), str(tmp_path / "j")) == 2 and upsert.read_events_jsonl(spark, str(tmp_path / "j")).count() == 2


def test_sorted_json_hash(spark):
    df = spark.createDataFrame([("é", '{"b":1,"a":null}'), (None, None)], "c string, x string")
    want = [hashlib.sha256(json.dumps({"content": c, "additional_data": x}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for c, x in (("é", {"b": 1, "a": None}), (None, {}))]
    assert [r.h for r in df.select(content_sha_sorted_json("c", "x").alias("h")).collect()] == want


def ladder(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "principles": df([("p1", "x", 0.9), ("p2", "y", 0.5), ("p3", "z", 0.1)], "id string, text string, confidence double"),
        "edges": df([("e1", "p1", "p2"), ("e2", "p1", "gone")], "id string, src_principle_id string, dst_principle_id string"),
        "memories": df([("m1",), ("m2",)], "memory_id string"),
        "links": df([("p1", "m1"), ("p1", "m2"), ("p2", "m2"), ("p9", "m1")], "principle_id string, memory_id string"),
        "edge_links": df([("e1", "m1")], "edge_id string, memory_id string"),
        "memory_events": df([("m1", f"v{k}") for k in range(10)] + [("m2", "v0"), ("m2", "missing"), ("m7", "v1")], "memory_id string, event_id string"),
        "events": df([(f"v{k}", T0 - datetime.timedelta(minutes=k), "c" * 300, "app", "r") for k in range(10)], "id string, t_utc timestamp, content string, source string, raw_ref string"),
    }


def test_provenance(spark):
    x = ladder(spark)
    counted = provenance.principle_counts(x["principles"], x["links"], x["memory_events"])
    assert {r.id: (r.n_memories, r.n_events) for r in counted.collect()} == {"p1": (2, 11), "p2": (1, 2), "p3": (0, 0)}
    s = {r.memory_id: r for r in provenance.memory_samples(x["memories"], x["memory_events"], x["events"]).collect()}
    assert s["m1"].n_events == 10 and [e.event_id for e in s["m1"].events] == [f"v{k}" for k in range(9, 1, -1)] and len(s["m1"].events[0].content) == 280
    assert [r.id for r in provenance.top_principles(counted, 2).collect()] == ["p1", "p2"]
    bad = {r.check: r.orphans for r in provenance.integrity(*[x[k] for k in ("principles", "edges", "memories", "links", "edge_links", "memory_events", "events")]).collect()}
    assert bad == {"edge source": 0, "edge target": 1, "link principle": 1, "link memory": 0, "edge link edge": 0, "edge link memory": 0, "event link memory": 1, "event link event": 1, "principle without event": 1}
    part = provenance.slice_of(spark.createDataFrame([("p1",), ("p2",)], "id string"), x["edges"], x["links"], x["edge_links"], x["memory_events"], x["events"])
    assert part["edges"].count() == 1 and part["memories"].count() == 2 and part["events"].count() == 10
    whole = json.loads(provenance.graph_json(x["principles"], x["edges"], x["memories"], "here").first().value)
    assert len(whole["principles"]) == 3 and whole["generated_from"] == "here"
    with pytest.raises(Exception, match="no confidence"):
        provenance.top_principles(counted.withColumn("confidence", F.lit(None).cast("double")), 1).collect()


def brute_clusters(texts):
    """Clusters of (id, text) by plain loops."""
    import math
    import re

    from chronicle.functions.text import STOP_WORDS

    bags = {i: {} for i, _ in texts}
    for i, t in texts:
        for w in re.findall(r"[a-z']+", t.lower()):
            if len(w) > 3 and w not in STOP_WORDS:
                bags[i][w] = bags[i].get(w, 0) + 1
    df = {}
    for b in bags.values():
        for w in b:
            df[w] = df.get(w, 0) + 1
    vec = {i: {w: c * math.log(len(texts) / (1 + df[w])) for w, c in b.items()} for i, b in bags.items()}

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a.values())), math.sqrt(sum(x * x for x in b.values()))
        return sum(a[w] * b[w] for w in a if w in b) / (na * nb) if na and nb else 0.0

    group = {i: i for i in vec}
    for a in sorted(vec):
        for b in sorted(vec):
            if a < b and cos(vec[a], vec[b]) >= 0.18 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    parts = {}
    for i, g in group.items():
        parts.setdefault(g, []).append(i)
    big = sorted(parts, key=lambda g: (-len(parts[g]), g))[:5]
    out = {i: big.index(g) for i, g in group.items() if g in big}
    centre = [{w: sum(vec[i].get(w, 0) for i in parts[g]) for w in {w for i in parts[g] for w in vec[i]}} for g in big]
    for i, g in group.items():
        if g not in big:
            out[i] = max(range(len(big)), key=lambda c: (cos(vec[i], centre[c]), -c))
    return out


def test_clusters(spark):
    words = ["kindness patience", "patience family", "family dinner", "running morning", "morning coffee", "music guitar", "guitar practice", "honest letters", "letters abroad", "garden roses", "winter garden", "solitude", "chess chess endgame", "coffee chess", "nothing shared here", "dinner garden music"]
    texts = [(k, t) for k, t in enumerate(words)]
    df = spark.createDataFrame(texts, "id long, text string")
    edges, clusters = graph.derived(df)
    assert {r.id: r.cluster for r in clusters.collect()} == brute_clusters(texts)
    assert all(r.src < r.dst and r.weight >= 0.18 for r in edges.collect())
    assert graph.derived(df.limit(0))[1].count() == 0


def test_components_of_a_chain(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


def test_focus(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    near = graph.adjacency(e)
    assert {r.node: r.neighbours for r in near.collect()}[2] == [1, 3]
    assert sorted(r.node for r in graph.focus(near, spark.createDataFrame([(3,)], "node long")).collect()) == [2, 3, 4]


def test_ledger(spark):
    d = spark.createDataFrame([("s", 1, 0.6), ("s", 2, 0.7), ("t", 3, -1.0)], "subject string, id long, delta double")
    assert {r.subject: r.confidence for r in ledger.confidence(d).collect()} == {"s": 1.0, "t": 0.0}
    a = spark.createDataFrame([("k", T0, 2), ("k", T0, 1), ("l", T0, 3)], "assertion_key string, t timestamp, id long")
    assert {r.assertion_key: r.id for r in ledger.once(a).collect()} == {"k": 1, "l": 3}
    q = spark.createDataFrame([("a", "normal", 1), ("b", "high", 2), ("c", "high", 1), ("d", "odd", 0)], "id string, priority string, created_at int")
    assert [r.id for r in ledger.queue(q).collect()] == ["c", "b", "a", "d"]
    kept, gone = ledger.pruned(spark.createDataFrame([(0.5,), (0.1,), (None,)], "confidence double"), 0.2)
    assert (kept.count(), gone.count()) == (1, 2)
    c = ledger.with_contradictions(spark.createDataFrame([("x", "c1", "normal"), ("y", None, "normal")], "id string, parent_contradiction string, priority string"), spark.createDataFrame([("c1", "t")], "id string, text string"))
    assert {r.id: r.priority for r in c.collect()} == {"x": "high", "y": "normal"}


def test_retrieval(spark):
    m = spark.createDataFrame([(1, "red red bird", "world"), (2, "blue bird", "experience"), (3, "stone", "world")], "id long, text string, fact_type string")
    q = spark.createDataFrame([(1, "red bird")], "query_id long, text string")
    assert [r.id for r in retrieval.lexical(m, q, 5).orderBy("rank").collect()] == [1, 2]
    assert [r.id for r in retrieval.lexical(m, q, 5, ["experience"]).collect()] == [2]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, embedding array<float>")
    found = retrieval.vector(v, spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>"), 3).orderBy("rank").collect()
    assert [r.id for r in found] == [1, 2, 3] and found[2].score == 0.0
    n = retrieval.networks("b", m, m.limit(0), m.select("text"), m.select("text"), "none").first()
    assert len(n.episodic) == 3 and n.semantic == []


def test_engine(spark, tmp_path):
    from chronicle.plans.engine import Engine

    engine = Engine(spark, str(tmp_path / "user"))
    (tmp_path / "Streaming_History_0.json").write_text(json.dumps([{"ts": f"2024-01-01T0{h}:00:00Z", "ms_played": 40000, "master_metadata_track_name": f"Song {h}", "spotify_track_uri": f"u:{h}"} for h in range(3)]))
    assert engine.ingest_plays(str(tmp_path)) == 3 and engine.ingest_plays(str(tmp_path)) == 3
    assert engine.events.read().count() == 3 and engine.episodes().count() == 3 and engine.episodes(90, "spotify").count() == 1
    assert engine.load("me") == 3
    assert engine.show("me", "song 1")[1] == "- me: Listened to 'Song 1' by unknown artist"
    c = spark.createDataFrame([("a", T0, "Here", 1.0, 2.0), ("b", T0 + datetime.timedelta(days=1), "There", None, None), ("c", T0, "", None, None)], "id string, created_at timestamp, place_name string, lat double, lng double")
    m = spark.createDataFrame([("1", "a", "photo", "p", "image/x", 1, None, None, None)], "id string, capsule_id string, kind string, file_path string, mime string, byte_size bigint, exif_t timestamp, exif_lat double, exif_lng double")
    stored, bad = engine.add_capsules(c, m)
    assert stored == 2 and bad.count() == 1 and [r.id for r in engine.capsules().collect()] == ["b", "a"] and len(engine.capsules("a").first().media) == 1
    with pytest.raises(ValueError):
        engine.add_capsules(c, m)
    assert engine.events.read().where("source = 'capsule'").count() == 2
