"""Line dedup: drop lines that many documents share, in DataFrame operations only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
in lower case.  Keys of at least ``min_length`` code points that at least
``min_documents`` documents hold lose all their lines except those of the
largest doc_id that holds them.

Every row counts as a document.  A null or empty text is one empty line.  Rows
that repeat a doc_id are told apart for counting, and the largest doc_id keeps the
line in all of its rows; a null doc_id is smaller than any other.  Columns besides
doc_id and text are left alone, whatever their names, but for those that have the
names of the three new ones: they give way.

A line that very many documents hold is no hot key: fewer than ``HOT_PART`` lines can
have more than that part of all repeated lines, and these few meet their documents
where the documents lie.  A text learns the positions of the lines that it loses and is put
together from the others, in time linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.llm.shared import documents, materialize, sha256_hex, unused
from chronicle.tables import HOT_PART

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    """128 bits, so that different keys do not meet in any corpus."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def repeated_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, text_hash, dropped): positions of the lines that a text of a doc_id loses."""
    keys = F.transform(_lines(F.col("text")), line_key)
    long = docs.where(F.length("text") >= min_length)
    once = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_length))
    held = long.select("doc_id", F.explode(once).alias("key")).select("doc_id", _hash(F.col("key")).alias("h")).select("doc_id", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    counts = held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_documents)
    common = materialize(counts, "common-lines")
    hot = F.col("n") * HOT_PART > F.lit(common.agg(F.sum("n")).first()[0] or 0)
    few = common.where(hot).select(F.col("a").alias("hot_a"), F.col("b").alias("hot_b"), F.col("last").alias("hot_last"))
    rest = common.where(~hot).select(F.col("a").alias("other_a"), F.col("b").alias("other_b"), F.col("last").alias("other_last"))
    placed = (
        long.select("doc_id", F.xxhash64("text").alias("text_hash"), keys.alias("keys"))  # a text's hash is made before its lines are rows
        .select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "key"))
        .where(F.char_length("key") >= min_length)
        .select("doc_id", "text_hash", "pos", _hash(F.col("key")).alias("h"))
        .select("doc_id", "text_hash", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    )
    marked = placed.join(F.broadcast(few), (F.col("a") == F.col("hot_a")) & (F.col("b") == F.col("hot_b")), "left")  # fewer than HOT_PART rows
    # A hot line has its answer; it goes on under its document's hash and meets no other line.
    known = F.col("hot_a").isNotNull()
    marked = marked.select("doc_id", "text_hash", "pos", "b", "hot_last", F.when(known, F.xxhash64("doc_id", "text_hash")).otherwise(F.col("a")).alias("by"), known.alias("known"))
    told = marked.join(rest, (F.col("by") == F.col("other_a")) & (F.col("b") == F.col("other_b")) & ~F.col("known"), "left")
    last = F.coalesce("hot_last", "other_last")
    lost = told.where(last.isNotNull() & ~F.col("doc_id").eqNullSafe(last))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def with_line_dedup(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with three columns of the given names: the text that stays, its lines before, and how many of them went."""
    kept_name, total_name, gone_name = names
    doc, text_hash, dropped, kept = (unused(docs, c) for c in ("line_doc", "line_text", "line_dropped", "line_kept"))
    drops = repeated_lines(docs, min_length, min_documents).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("dropped").alias(dropped))
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    lines = _lines(F.col("text"))
    # The array of lines is bound once, and each kept position takes its line from it.
    kept_of = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(dropped))
    stay = F.element_at(F.transform(F.array(lines), lambda own: F.transform(kept_of(own), lambda k: F.get(own, k))), 1)
    touched = F.col(dropped).isNotNull()
    total = F.size(lines).cast("long")
    out = joined.withColumn(kept, F.when(touched, stay))
    made = {
        kept_name: F.when(touched, F.array_join(kept, "\n")).otherwise(F.coalesce("text", F.lit(""))),
        total_name: total,
        gone_name: F.when(touched, total - F.size(kept)).otherwise(0).cast("long"),
    }
    old = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return out.select(*old, *[c.alias(name) for name, c in made.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_line_dedup(docs).select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.last) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE c.key IS NULL OR k.doc_id = c.last), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""
