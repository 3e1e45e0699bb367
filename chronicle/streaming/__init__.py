"""Streams of events: upserts, sessions with watermarks, exact episodes."""
