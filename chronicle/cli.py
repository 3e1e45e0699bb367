"""Commands over one user's data: ``python -m chronicle.cli ROOT COMMAND``.

``ingest`` reads one folder of a source: tables of messages (Parquet folders ``message``, ``chat`` and
``chat_message_join``) or photos (``asset``, ``attributes``, ``face`` and ``person``), an export of plays,
chats or watched videos, or event records as JSON lines; ``episodes`` prints how the events fall into episodes, ``load`` makes documents of
them in a bank, ``show`` prints the bank's report, and ``all`` does these one after another.
"""

from __future__ import annotations

import argparse
import datetime

from chronicle.operators import episodes
from chronicle.plans.engine import DEFAULT_EPISODES, Engine
from chronicle.session import session
from chronicle.sources import jsonl, plays

BANK = "default"
SOURCES = ("messages", "plays", "chats", "photos", "watched", "records")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronicle", description=__doc__.splitlines()[0])
    top.add_argument("root", help="folder of the user's tables")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("ingest", "episodes", "load", "show", "all"):
        own = commands.add_parser(name)
        if name in ("ingest", "all"):
            own.add_argument("--tables", required=True, help="folder of the source")
            own.add_argument("--source", choices=SOURCES, default=SOURCES[0])
            own.add_argument("--min-ms", type=int, default=plays.MIN_MS, help="shortest play in milliseconds")
            own.add_argument("--top-n", type=int, default=5, help="threads with the most messages")
            own.add_argument("--since", type=datetime.date.fromisoformat, help="first day, YYYY-MM-DD")
        if name in ("episodes", "load", "all"):
            own.add_argument("--gap-minutes", type=float, default=episodes.GAP_MINUTES)
        if name in ("load", "all"):
            own.add_argument("--limit", type=int, default=DEFAULT_EPISODES, help="episodes to load; 0: all")
        if name in ("load", "show", "all"):
            own.add_argument("--bank", default=BANK)
    return top


def _ingest(engine: Engine, args: argparse.Namespace) -> int:
    tables = lambda *names: [engine.spark.read.parquet(f"{args.tables}/{t}") for t in names]
    if args.source == "messages":
        return engine.ingest_messages(*tables("message", "chat", "chat_message_join"), args.top_n, args.since)
    if args.source == "photos":
        return engine.ingest_photos(*tables("asset", "attributes", "face", "person"))
    if args.source == "plays":
        return engine.ingest_plays(args.tables, args.min_ms)
    if args.source == "chats":
        return engine.ingest_chats(args.tables)
    if args.source == "watched":
        return engine.ingest_watch_history(args.tables)
    return engine.events.add(jsonl.read_events(engine.spark, args.tables))


def run(engine: Engine, args: argparse.Namespace) -> list[str]:
    """The lines that a command prints."""
    out: list[str] = []
    step = lambda *names: args.command in (*names, "all")
    if step("ingest"):
        out.append(f"events: {_ingest(engine, args)}")
    if step("episodes"):
        out += episodes.summary_lines(engine.episodes(args.gap_minutes))
    if step("load"):
        out.append(f"documents in bank {args.bank}: {engine.load(args.bank, args.limit, args.gap_minutes)}")
    if step("show"):
        out += engine.report(args.bank)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print("\n".join(run(Engine(session(), args.root), args)))


if __name__ == "__main__":
    main()
