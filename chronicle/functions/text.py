"""Text rules: white space, labels, rendered lines, transcripts, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's strip() has it: Unicode's and four separators.
_BLANK = r"[\s\x1c-\x1f]"
TRANSCRIPT_CHARS = 12_000
#: Fixed text between the two kept ends of a transcript that is too long.
TRUNCATION_MARK = "... [transcript truncated] ..."
#: Fixed words that say nothing about a principle.
STOP_WORDS = (
    "you your the a an and or to of in on for with that this is are be as own into about over they them their it its make making value valuing "
    "seek seeking strive striving have has had more most than then when while who what which not"
).split()


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def is_blank(x: Column) -> Column:
    return F.coalesce(x.rlike(f"(?U)^{_BLANK}*$"), F.lit(True))


def filled(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def contact_label(thread: Column) -> Column:
    """A readable label: addresses as they are, else what follows the last separator."""
    label = strip(thread)
    last = label
    for sep in (";-;", ";", "/"):
        last = F.substring_index(last, sep, -1)
    return F.when(label == "", "unknown").when(label.contains("@") | label.startswith("+"), label).otherwise(F.coalesce(filled(last), thread))


def event_line(role: Column, content: Column, contact: Column) -> Column:
    return F.concat(F.when(role == "self", F.lit("me")).otherwise(contact), F.lit(": "), F.coalesce(content, F.lit("")))


def shorten(transcript: Column, limit: int = TRANSCRIPT_CHARS, mark: str = TRUNCATION_MARK) -> Column:
    """The first and last part of a text over ``limit`` characters, cut at line ends where there are any.

    The two line breaks beside the mark come on top of the limit.
    """
    head = (limit - len(mark)) // 2
    tail = limit - len(mark) - head
    first, last = F.substring(transcript, 1, head), F.right(transcript, F.lit(tail))
    cut = F.char_length(first) - F.char_length(F.substring_index(first, "\n", -1)) - 1
    first = F.when(first.contains("\n"), F.substring(first, F.lit(1), cut)).otherwise(first)
    last = F.when(last.contains("\n"), F.substring(last, F.instr(last, "\n") + 1, F.char_length(last))).otherwise(last)
    return F.when(F.char_length(transcript) <= limit, transcript).otherwise(F.concat(first, F.lit(f"\n{mark}\n"), last))


def rendered_blocks(text: Column, blocks: Column) -> Column:
    """A chat message without private parts: its text, or else its text blocks, then a marker for each tool block."""
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & ~is_blank(b["text"])), lambda b: b["text"])
    tools = F.transform(F.filter(blocks, lambda b: b["type"].isin("tool_use", "tool_result")), lambda b: F.concat(F.lit("[tool: "), F.coalesce(b["name"], F.lit("None")), F.lit("]")))
    none = F.array().cast("array<string>")
    body = F.when(~is_blank(text), F.array(text)).otherwise(F.coalesce(texts, none))
    return strip(F.array_join(F.concat(body, F.coalesce(tools, none)), "\n"))


def play_kind(track_uri: Column, track: Column, episode_uri: Column, episode: Column, book_uri: Column, book: Column) -> Column:
    some = lambda a, b: filled(a).isNotNull() | filled(b).isNotNull()
    return F.when(some(track_uri, track), "music").when(some(episode_uri, episode), "podcast").when(some(book_uri, book), "audiobook").otherwise("unknown")


def media_kind(mime: Column) -> Column:
    """photo, audio, video or text by the type's first part; null for others."""
    first = F.substring_index(mime, "/", 1)
    return F.when(first == "image", "photo").when(first.isin("audio", "video", "text"), first)


def tokens(text: Column, stop: Sequence[str] = STOP_WORDS, longer_than: int = 3) -> Column:
    """Words of letters and apostrophes, repeats included, without short and stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1))
    return F.filter(words, lambda w: (F.char_length(w) > longer_than) & ~w.isin(*stop))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*map(filled, columns))


def from_first_bold(text: Column) -> Column:
    """A reflection from its first ``**`` on, if something stands before it."""
    at = F.instr(text, "**")
    return F.when(at > 1, F.substring(text, at, F.char_length(text))).otherwise(text)


def bullets(facts: Column) -> Column:
    return F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")


def keyword_reply(question: Column, rules: Sequence[tuple[Sequence[str], str]], fallback: str) -> Column:
    """The reply of the first rule with a word that the question holds."""
    out = F.lit(None).cast("string")
    low = F.lower(question)
    for words, reply in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, reply).otherwise(out)
    return F.coalesce(out, F.lit(fallback))


def html_escaped(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def emphasised(text: Column) -> Column:
    """Words between single asterisks as HTML emphasis."""
    return F.regexp_replace(text, r"\*([^*]+)\*", "<em>$1</em>")


def cited(text: Column, citations: Column) -> Column:
    """``{k}`` as a mark with the number and title of citation k (label, n), counted from 0; a question mark if there is none."""
    mark = lambda label, n: F.concat(F.lit('<sup class="cited" title="'), label, F.lit('">['), n, F.lit("]</sup>"))
    known = F.coalesce(citations, F.array().cast("array<struct<label: string, n: int>>"))
    numbered = F.transform(known, lambda c, k: F.struct(F.concat(F.lit("{"), k.cast("string"), F.lit("}")).alias("at"), mark(html_escaped(F.coalesce(c["label"], F.lit(""))), c["n"].cast("string")).alias("mark")))
    # Of many replacements in a row none may look into another one's label, so braces there are coded.
    done = F.aggregate(numbered, text, lambda out, c: F.replace(out, c["at"], F.replace(c["mark"], F.lit("{"), F.lit("&#123;"))))
    return F.regexp_replace(done, r"\{\d+\}", '<sup class="cited" title="">[?]</sup>')
