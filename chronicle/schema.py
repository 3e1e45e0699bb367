"""Fixed schemas of the canonical tables and of the exports that are read."""

from __future__ import annotations

EVENT = (
    "id string, t_utc timestamp, author_role string, content string, thread_id string, reply_to string, "
    "raw_ref string, source string, additional_data string, content_sha string, ingest_seq bigint"
)
EPISODE = (
    "episode_id string, thread_id string, start_utc timestamp, end_utc timestamp, participants array<string>, "
    "events array<struct<id: string, t_utc: timestamp, author_role: string, content: string, thread_id: string, reply_to: string, raw_ref: string, source: string, additional_data: string>>"
)
CAPSULE = "id string, created_at timestamp, place_name string, lat double, lng double"
MEDIA = "id string, capsule_id string, kind string, file_path string, mime string, byte_size bigint, exif_t timestamp, exif_lat double, exif_lng double"
PRINCIPLE = "id string, text string, confidence double"
EDGE = "id string, src_principle_id string, dst_principle_id string, relation string"
MEMORY = "memory_id string, text string, document_id string, source string, fact_type string, entities string, occurred_start timestamp, tags string"

PLAY = (
    "ts string, platform string, ms_played bigint, conn_country string, ip_addr string, master_metadata_track_name string, master_metadata_album_artist_name string, "
    "master_metadata_album_album_name string, spotify_track_uri string, episode_name string, episode_show_name string, spotify_episode_uri string, audiobook_title string, "
    "audiobook_uri string, audiobook_chapter_title string, audiobook_chapter_uri string, reason_start string, reason_end string, shuffle boolean, skipped boolean, offline boolean, "
    "offline_timestamp bigint, incognito_mode boolean"
)
CHAT_BLOCK = "struct<type: string, text: string, name: string>"
CHAT_EXPORT = (
    "uuid string, name string, summary string, created_at string, updated_at string, "
    f"chat_messages array<struct<uuid: string, sender: string, text: string, content: array<{CHAT_BLOCK}>, created_at: string, updated_at: string, parent_message_uuid: string>>"
)
WATCH_HISTORY = "header string, title string, titleUrl string, subtitles array<struct<name: string, url: string>>, time string, products array<string>"

#: What each relation between principles may be, and the media kinds.
RELATIONS = ("supports", "refines", "contradicts")
MEDIA_KINDS = ("photo", "audio", "video", "text")
