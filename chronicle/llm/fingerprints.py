"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a bag of words (runs other than ``[\\x20\\x09-\\x0D]``).  For each of
``SAMPLES`` samples every word draws, by hash, r and c from a gamma distribution of
shape 2 and b between 0 and 1; with count w, t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1).  The sample is the word and t of least a, for which a
itself stands.  Two bags give the same sample with a probability of their
generalised Jaccard similarity, the sum of lesser counts over that of greater ones.

The query pairs each document with the next one by doc_id.  Documents are dealt into
buckets of neighbouring doc_ids, of near equal rows; the first document of a bucket is
a guest in the bucket before it, and the first of all in the last.  The text moves
once, to its bucket, and every later grouping stays there.

A null or empty text, or one without words, has the empty bag: like another empty one
in all samples and like no other bag in any.  Rows are ordered by doc_id, a null before
all others, and then by text, so repeated rows follow each other; a single row is its
own next one.  No rows give no rows.  All rows of one doc_id, or of none, lie in one
bucket, so a table of a single doc_id is one task.  Columns besides doc_id and text are
not looked at.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.llm.shared import documents, sha256_hex

#: Samples of a fingerprint, and how many are drawn in one pass over a word.
SAMPLES, PASS = 64, 4
#: Documents in a bucket, and buckets at most: beyond their product, 300 million documents, buckets get larger and are sorted on disk.
BUCKET_ROWS, MOST_BUCKETS = 1500, 200_000
_FIRST = -(1 << 63)
_PART = (1 << 21) - 1


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at or below the key, found in two steps."""
    step = max(1, int(len(splits) ** 0.5))
    coarse, fine = splits[step - 1 :: step], [splits[i : i + step - 1] for i in range(0, len(splits), step)] + [[]]
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= key))
    at = below(_literal(coarse, "array<bigint>"))
    return (at * step + below(F.element_at(_literal(fine, "array<array<bigint>>"), at + 1))).cast("int")


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, r, guest, doc_id, text, next_text): ``docs`` beside their successors by doc_id."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    keys = docs.select(key.alias("key"))
    rows = keys.count()
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    splits: list[int] = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        splits = sorted(set(keys.agg(F.percentile_approx("key", shares, max(10_000, 10 * buckets))).first()[0]))
    firsts = {r.bucket: r.first for r in keys.groupBy(_bucket(F.col("key"), splits).alias("bucket")).agg(F.min("key").alias("first")).collect()}  # a row a bucket
    held = sorted(firsts)
    first = [firsts.get(b, 0) for b in range(len(splits) + 1)]
    before = [held[held.index(b) - 1] if b in firsts else 0 for b in range(len(splits) + 1)]
    placed = docs.select("doc_id", "text", key.alias("key")).withColumn("bucket", _bucket(F.col("key"), splits))
    own = F.struct(F.lit(False).alias("guest"), F.col("bucket").alias("b"))
    guest = F.struct(F.lit(True).alias("guest"), F.element_at(_literal(before, "array<int>"), F.col("bucket") + 1).alias("b"))
    leads = F.col("key") == F.element_at(_literal(first, "array<bigint>"), F.col("bucket") + 1)
    dealt = placed.select("text", "key", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    return (
        dealt.select(F.coalesce("text", F.lit("")).alias("text"), "key", F.coalesce("p.b", F.lit(0)).alias("bucket"), F.coalesce("p.guest", F.lit(False)).alias("guest"))
        .withColumn("r", F.row_number().over(order))
        .withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
        .withColumn("doc_id", F.nullif("key", F.lit(_FIRST)))
        .drop("key")
    )


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = F.expr("char_length(text) div 2").cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def bags(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, word, counts): for each of the text ``columns`` the count of each word."""
    words = lambda c: F.filter(F.split(F.col(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), words(c).alias("words")) for i, c in enumerate(columns)]))
    rows = texts.select(*keys, sides.alias("s")).select(*keys, "s.side", F.explode("s.words").alias("w"))
    rows = rows.select(*keys, "side", F.xxhash64("w").alias("word"))
    return rows.groupBy(*keys, "word").agg(*[F.sum(F.when(F.col("side") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(len(columns))])


def signatures(counted: DataFrame, keys: list[str], sides: int) -> DataFrame:
    """(keys, sig0, sig1 ...): the least a of each sample, for each count column.

    A row for each word and few samples: with one, rows cost more than samples; with
    many, the loop grows beyond what the JVM compiles.
    """
    part = lambda x, k: (F.shiftrightunsigned(x, 21 * k).bitwiseAND(F.lit(_PART)) + 0.5) / float(_PART + 1)
    each, pass_ = range(PASS), F.col("_pass")
    wide = counted.withColumns({f"_ln{i}": F.when(F.col(f"n{i}") > 0, F.log(F.col(f"n{i}").cast("double"))) for i in range(sides)})
    wide = wide.select(*keys, "word", *[f"_ln{i}" for i in range(sides)], F.explode(F.array(*map(F.lit, range(0, SAMPLES, PASS)))).alias("_pass"))
    wide = wide.withColumns({f"_x{j}": F.xxhash64("word", pass_ + j) for j in each} | {f"_y{j}": F.xxhash64(pass_ + j, "word") for j in each})
    x, y = lambda j: F.col(f"_x{j}"), lambda j: F.col(f"_y{j}")
    wide = wide.withColumns(
        {f"_r{j}": -F.log(part(x(j), 0) * part(x(j), 1)) for j in each} | {f"_c{j}": F.log(-F.log(part(x(j), 2) * part(y(j), 0))) for j in each} | {f"_b{j}": part(y(j), 1) for j in each}
    )
    r, c, b = (lambda j, n=n: F.col(f"_{n}{j}") for n in "rcb")
    least = [F.min(c(j) - r(j) * (F.floor(F.col(f"_ln{i}") / r(j) + b(j)) - b(j) + 1)).alias(f"_a{i}_{j}") for i in range(sides) for j in each]
    passes = wide.groupBy(*keys, "_pass").agg(*least)
    one = lambda i: F.array(*[F.col(f"_a{i}_{j}") for j in each]).alias(f"a{i}")
    whole = passes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pass", *[one(i) for i in range(sides)]))).alias("_p"))
    return whole.select(*keys, *[F.flatten(F.col("_p").getField(f"a{i}")).alias(f"sig{i}") for i in range(sides)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; null signatures are those of empty bags."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda s: s)) / float(SAMPLES)
    empty = lambda s: s.isNull() | F.element_at(s, 1).isNull()
    return F.when(empty(a) & empty(b), 1.0).when(empty(a) | empty(b), 0.0).otherwise(same)


def as_text(signature: Column) -> Column:
    """Eight hex digits for each sample; zeros for the empty bag."""
    some = F.array_join(F.transform(signature, lambda a: F.lower(F.lpad(F.hex(F.xxhash64(a)), 16, "0").substr(1, 8))), "")
    return F.when(signature.isNull() | F.element_at(signature, 1).isNull(), "0" * 8 * SAMPLES).otherwise(some)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with its signature, that of its edited text, and its likeness to that and to its successor."""
    rows = in_order(docs.select("doc_id", "text"))
    texts = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    meta = texts.select("bucket", "r", "guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), sha256_hex(F.col("edited")).alias("edited_sha256"))
    # Up to the exchange both sides need the same columns, so Spark moves the texts once.
    keys = ["bucket", "r"]
    signed = signatures(bags(texts, keys, ["text", "edited"]), keys, 2)
    out = meta.join(signed, ["bucket", "r"], "left")
    following = F.lead("sig0").over(Window.partitionBy("bucket").orderBy("r"))
    out = out.withColumn("_next", following).where("NOT guest")
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("sig0")).alias("fingerprint"), as_text(F.col("sig1")).alias("edited_fingerprint"),
        likeness(F.col("sig0"), F.col("sig1")).alias("near_edited"), likeness(F.col("sig0"), F.col("_next")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
