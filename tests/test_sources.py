"""Sources on small synthetic inputs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from chronicle.functions.binary import typed_stream_text
from chronicle.functions.text import contact_label, from_first_bold, html_escaped, is_blank, keyword_reply, media_kind, shorten, strip
from chronicle.functions.time import from_ns_2001, iso_utc, parse_iso
from chronicle.sources import capsules, chats, messages, photos, plays, watch_history

MARK = bytes([0x84, 0x01, 0x2B])


@pytest.mark.parametrize(
    ("blob", "text"),
    [
        (b"xx" + MARK + bytes([5]) + b"hello!", "hello"),
        (MARK + bytes([0x81]) + (300).to_bytes(2, "little") + b"a" * 300, "a" * 300),
        (MARK + bytes([0x82]) + (70000).to_bytes(4, "little") + b"b" * 70000, "b" * 70000),
        (b"no marker", None), (None, None), (b"", None), (MARK, None), (MARK + b"\x81\x01", None), (MARK + b"\x82\x01\x00", None), (MARK + b"\x00", None),
        (MARK + bytes([9]) + b"abc", "abc"), (MARK + bytes([2]) + b"\xff\xfe", "��"),
    ],
)
def test_typed_stream(blob, text):
    assert typed_stream_text(blob) == text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_text_rules(spark):
    assert one(spark, strip, "\x1c  a b \x1f\n") == "a b"
    assert one(spark, is_blank, "\x1c \t") is True and one(spark, is_blank, None) is True and one(spark, is_blank, "x") is False
    labels = {"": "unknown", "  ": "unknown", " +15550100 ": "+15550100", "a@b.example": "a@b.example", "chat1;-;5550100": "5550100", "a;b/c": "c", "plain": "plain", "odd/": "odd/"}
    assert {k: one(spark, contact_label, k) for k in labels} == labels
    assert one(spark, from_first_bold, "so **x**") == "**x**" and one(spark, from_first_bold, "**x**") == "**x**"
    assert one(spark, html_escaped, "<a href='b'>&\"") == "&lt;a href=&#39;b&#39;&gt;&amp;&quot;"
    assert one(spark, media_kind, "image/png") == "photo" and one(spark, media_kind, "application/pdf") is None and one(spark, media_kind, None) is None
    rules = [(("sad", "low"), "one"), (("low",), "two")]
    assert one(spark, lambda c: keyword_reply(c, rules, "none"), "So LOW") == "one" and one(spark, lambda c: keyword_reply(c, rules, "none"), "x") == "none"


def test_shorten_goes_two_over_without_line_breaks(spark):
    assert len(one(spark, shorten, "x" * 20000)) == 12002
    assert one(spark, shorten, "x" * 12000) == "x" * 12000
    long = "\n".join(f"line {i} " + "y" * 100 for i in range(300))
    short = one(spark, shorten, long)
    assert len(short) <= 12002 and short.startswith("line 0 ") and short.endswith(long[-50:]) and all(x.startswith(("line ", "...")) for x in short.split("\n"))


def test_times(spark):
    assert one(spark, lambda c: iso_utc(parse_iso(c)), "2024-01-02T03:04:05Z") == "2024-01-02T03:04:05+00:00"
    assert one(spark, lambda c: iso_utc(parse_iso(c)), "2024-01-02T03:04:05.120+01:00") == "2024-01-02T02:04:05.120000+00:00"
    ns = 700_000_000_123_456_789
    want = datetime.datetime.fromtimestamp(ns / 1e9 + 978307200, tz=datetime.UTC)
    got = one(spark, lambda c: F.unix_micros(from_ns_2001(c)), ns, "bigint")
    assert got == round(want.timestamp() * 1e6)


def test_messages(spark):
    m = [
        (1, "hi", None, 1, 700_000_000_000_000_000), (2, None, bytearray(MARK + b"\x03hey"), 0, 700_000_000_000_000_000), (3, "", bytearray(MARK + b"\x03hey"), 0, 700_000_000_000_000_001),
        (4, "  ", None, 0, 700_000_000_000_000_001), (5, "alone", None, 0, 600_000_000_000_000_000), (6, "twin", None, 0, 700_000_000_000_000_002),
    ]
    message = spark.createDataFrame(m, "ROWID long, text string, attributedBody binary, is_from_me int, date long")
    chat = spark.createDataFrame([(1, "+15550100", "Al"), (2, "b@x.example", ""), (3, "+15550100", None), (4, "empty", None)], "ROWID long, chat_identifier string, display_name string")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (3, 6), (3, 1)], "chat_id long, message_id long")
    top = messages.top_threads(chat, links, 10).collect()
    assert [(r.chat_id, r.label, r.messages) for r in top] == [(1, "Al", 4), (3, "+15550100", 2), (2, "b@x.example", 1)]
    e = messages.events(message, chat, links, 3).orderBy("raw_ref").collect()
    assert [(r.raw_ref, r.content, r.author_role) for r in e] == [("chat.db#1", "hi", "self"), ("chat.db#2", "hey", "other"), ("chat.db#5", "alone", "other"), ("chat.db#6", "twin", "other")]
    late = messages.events(message, chat, links, 3, since=datetime.date(2023, 1, 1)).collect()
    assert {r.raw_ref for r in late} == {"chat.db#1", "chat.db#2", "chat.db#6"}
    assert messages.events(message, chat, links, 3, since=datetime.date(2040, 1, 1)).count() == 0


def test_plays(spark, tmp_path):
    rows = [
        {"ts": "2024-01-01T00:00:00Z", "ms_played": 30000, "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A", "master_metadata_album_album_name": "L", "spotify_track_uri": "spotify:track:1", "extra": 1},
        {"ts": "2024-01-01T00:01:00Z", "ms_played": 1500, "spotify_track_uri": "spotify:track:2"},
        {"ts": "2024-01-01T00:02:00Z", "ms_played": 60000, "episode_name": "E", "episode_show_name": "", "spotify_track_uri": ""},
        {"ts": "2024-01-01T00:03:00Z", "ms_played": 60000, "audiobook_title": "B", "audiobook_chapter_title": "C"},
        {"ts": "2024-01-01T00:04:00Z", "ms_played": 60000},
    ]
    (tmp_path / "inner").mkdir()
    with pytest.raises(FileNotFoundError):
        plays.records(spark, str(tmp_path))
    (tmp_path / "inner" / "Streaming_History_Audio_0.json").write_text(json.dumps(rows))
    found = plays.records(spark, str(tmp_path))
    e = plays.events(found).orderBy("t_utc").collect()
    assert [r.content for r in e] == ["Listened to 'T' by A (album L)", "Listened to podcast 'E'", "Listened to 'C' from B", "Played unknown content"]
    assert e[0].raw_ref == "spotify:track:1#2024-01-01T00:00:00+00:00" and e[1].raw_ref == "spotify:E#2024-01-01T00:02:00+00:00" and e[0].thread_id == plays.THREAD
    assert plays.events(found, 0).count() == 5
    (tmp_path / "Streaming_History_Audio_1.json").write_text(json.dumps(rows[:1]))
    assert plays.records(spark, str(tmp_path)).count() == 1


def test_photos(spark):
    asset = spark.createDataFrame(
        [(1, "u1", 0.5, 10.0, -180.0, "A", "a.jpg", 4, None, 1, 0, 0, 0), (2, "u2", 1.0, -180.0, -180.0, "B", "b.mov", None, 3, 0, 1, 1, 1), (3, "u3", None, 1.0, 1.0, "C", "c.jpg", 1, 1, 0, 0, 0, 0)],
        "Z_PK long, ZUUID string, ZDATECREATED double, ZLATITUDE double, ZLONGITUDE double, ZDIRECTORY string, ZFILENAME string, ZWIDTH int, ZHEIGHT int, ZFAVORITE int, ZHIDDEN int, ZTRASHEDSTATE int, ZKIND int",
    )
    attributes = spark.createDataFrame([(5, 1, "second"), (4, 1, "first"), (6, 2, "")], "Z_PK long, ZASSET long, ZORIGINALFILENAME string")
    face = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 2, 3)], "Z_PK long, ZASSETFORFACE long, ZPERSONFORFACE long")
    person = spark.createDataFrame([(1, "Zed"), (2, "Ann, B"), (3, None)], "Z_PK long, ZDISPLAYNAME string")
    r = {x.id: x for x in photos.records(asset, attributes, face, person).collect()}
    assert set(r) == {"u1", "u2"}
    assert (r["u1"].lat, r["u1"].lng, r["u1"].original_filename, r["u1"].people, r["u1"].height, r["u1"].kind) == (10.0, None, "first", ["Ann, B", "Zed"], 0, "photo")
    assert (r["u2"].lat, r["u2"].original_filename, r["u2"].people, r["u2"].kind, r["u2"].is_trashed) == (None, "b.mov", [], "video", True)
    e = photos.events(photos.records(asset, attributes, face, person)).where("id = 'u2'").first()
    extra = json.loads(e.additional_data)
    assert len(extra) == 11 and extra["lat"] is None and e.thread_id is None and e.source == "photos"


def test_chats(spark, tmp_path):
    block = lambda kind, **x: {"type": kind, **x}
    m = lambda uuid, sender, text, content=(), parent=chats.ROOT: {"uuid": uuid, "sender": sender, "text": text, "content": list(content), "created_at": "2024-01-01T00:00:00Z", "parent_message_uuid": parent}
    export = [
        {"uuid": "c1", "created_at": "2024-01-01T00:00:00Z", "chat_messages": [
            m("m1", "human", "top", [block("text", text="other"), block("thinking", thinking="SECRET")]),
            m("m2", "assistant", " ", [block("text", text="a"), block("text", text=" "), block("text", text="b"), block("tool_use", name="find", input={"q": "SECRET"}), block("tool_result", content="SECRET")], "m1"),
            m("m3", "assistant", "", [block("voice_note", text="SECRET")], "m2"),
        ]},
        {"uuid": "c2", "created_at": "2024-01-01T00:00:00Z", "chat_messages": []},
    ]
    (tmp_path / "conversations.json").write_text(json.dumps(export))
    e = chats.events(chats.load(spark, str(tmp_path))).orderBy("ingest_seq").collect()
    assert [r.content for r in e] == ["top", "a\nb\n[tool: find]\n[tool: None]"]
    assert [r.reply_to for r in e] == [None, "m1"] and not any("SECRET" in str(r) for r in e)
    linked = chats.events(chats.load(spark, str(tmp_path))).select(chats.reply_event_id(F.col("thread_id"), F.col("reply_to")).alias("p")).where("p is not null").first().p
    assert linked == e[0].id
    export[0]["chat_messages"][0]["sender"] = "robot"
    (tmp_path / "conversations.json").write_text(json.dumps(export))
    with pytest.raises(Exception, match="unknown sender"):
        chats.events(chats.load(spark, str(tmp_path))).collect()


def test_capsules(spark):
    c = spark.createDataFrame([("a", datetime.datetime(2024, 1, 2), "Here", None, None), ("b", datetime.datetime(2024, 1, 1), " ", 1.0, 2.0)], "id string, created_at timestamp, place_name string, lat double, lng double")
    m = spark.createDataFrame([("2", "a", "photo", "p2", "image/x", 1, None, 5.0, 6.0), ("1", "a", "audio", "p1", "audio/x", 1, None, None, None)], "id string, capsule_id string, kind string, file_path string, mime string, byte_size bigint, exif_t timestamp, exif_lat double, exif_lng double")
    nested = capsules.with_media(c, m)
    assert [[x.id for x in r.media] for r in nested.orderBy("id").collect()] == [["1", "2"], []]
    card = capsules.cards(nested).where("id = 'a'").first()
    assert (card.cover, card.lat, card.lng, len(card.media)) == ("p2", 5.0, 6.0, 1)
    e = capsules.events(nested.withColumn("note", F.lit("n"))).where("id = 'a'").first()
    assert e.content == "n" and e.raw_ref == "capsule#a" and [x["id"] for x in json.loads(e.additional_data)["media"]] == ["1", "2"]
    good, bad = capsules.named(c)
    assert (good.count(), bad.count()) == (1, 1)
    uploads = spark.createDataFrame([("a", 0, "x.pdf", bytearray(b"1"), "application/pdf"), ("a", 1, "e.txt", bytearray(b" "), "text/plain"), ("a", 2, "n.txt", bytearray(b" note\xff "), "text/plain")], "capsule_id string, pos int, filename string, content binary, content_type string")
    ok, no = capsules.checked_uploads(uploads)
    assert ok.count() == 2 and no.count() == 1 and capsules.notes(uploads).first().note == "note�"


def test_watch_history(spark, tmp_path):
    rows = [{"header": "YouTube Music", "title": "Watched A", "titleUrl": "https://www.youtube.com/watch?v=abc&t=1", "subtitles": [{"name": "N"}], "time": "2024-01-01T00:00:00Z"}, {"header": "YouTube Music", "title": "B", "time": "2024-01-01T00:00:01Z"}, {"header": "YouTube", "title": "C", "time": "2024-01-01T00:00:02Z"}]
    (tmp_path / "h.json").write_text(json.dumps(rows))
    e = watch_history.events(watch_history.load(spark, str(tmp_path / "h.json"))).orderBy("t_utc").collect()
    assert [r.raw_ref for r in e] == ["yt:video:abc#2024-01-01T00:00:00+00:00", "yt:title:B#2024-01-01T00:00:01+00:00"] and e[0].content == "Listened to 'Watched A' on N"
