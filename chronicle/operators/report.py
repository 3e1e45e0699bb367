"""A bank's networks as text: experiences, facts, people, principles, connections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.functions.text import filled
from chronicle.operators.retrieval import PEOPLE, people, time_label

#: Fixed values of the report: titles and what stands for an empty section.
TITLES = ("EPISODIC MEMORY (experiences)", "SEMANTIC MEMORY (world facts)", "PEOPLE (entities)", "PRINCIPLES / EVOLVING BELIEFS", "CONNECTIONS")
EMPTY = ("(no episodic memories surfaced)", "(no semantic facts surfaced)", "(no people surfaced)", "(none surfaced yet)", "(no connection synthesized)")
RULE = "=" * 72


@dataclass
class Section:
    """A section's number and its rows (rank, line, notes), in order by rank."""

    number: int
    rows: DataFrame


def _rows(df: DataFrame, rank: Column, line: Column, *notes: Column) -> DataFrame:
    return df.select(rank.alias("rank"), line.alias("line"), F.array_compact(F.array(*notes, F.lit(None).cast("string"))).alias("notes"))


def experiences(recalled: DataFrame) -> Section:
    """Recalled experiences (rank, text, occurred_start, mentioned_at, occurred_end, entities) with their time and people."""
    when = time_label(*[F.col(c).cast("string") for c in ("occurred_start", "mentioned_at", "occurred_end")])
    who = F.when(F.size("entities") > 0, F.concat(F.lit("involving: "), F.array_join("entities", ", ")))
    return Section(0, _rows(recalled, F.col("rank"), F.col("text"), F.concat(F.lit("when: "), when), who))


def facts(recalled: DataFrame) -> Section:
    return Section(1, _rows(recalled, F.col("rank"), F.col("text")))


def persons(observations: DataFrame, n: int = PEOPLE) -> Section:
    """The ``n`` people with the most observations (name, text, t), each with the first one."""
    top = people(observations, n)
    return Section(2, _rows(top, -F.col("observations"), F.coalesce(filled(F.col("name")), F.lit("(unknown)")), filled(F.col("first"))))


def beliefs(principles: DataFrame) -> Section:
    """Principles (rank, name, content)."""
    return Section(3, _rows(principles, F.col("rank"), F.coalesce(filled(F.col("name")), F.lit("(unnamed)")), filled(F.col("content"))))


def lines(section: Section) -> list[str]:
    """The section as lines; its rows are the few that were chosen for the report."""
    out = _head(section.number)
    found = section.rows.orderBy("rank", "line").collect()
    for r in found:
        out += [f"  - {r.line}", *[f"      {note}" for note in r.notes]]
    return out if found else [*out, f"  {EMPTY[section.number]}"]


def connections(text: str | None) -> list[str]:
    return [*_head(4), f"  {text}" if text else f"  {EMPTY[4]}"]


def _head(number: int) -> list[str]:
    return ["", RULE, f"  {number + 1}. {TITLES[number]}", RULE]
