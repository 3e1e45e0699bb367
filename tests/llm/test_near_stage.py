"""The near-dedup stage against all pairs of texts, by shingles made with plain Python."""

import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return Fraction(len(a & b), len(a | b)) if a or b else Fraction(1)


def brute(rows):
    """The doc_ids that stay, by all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and root[i] != root[j] and likeness(a, b) >= Fraction(4, 5):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_near_stage_finds_all_planted_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(900)]
    rows, planted = [], []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 400]))]
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.uniform(0.005, 0.03)))):
                copy[at] = f"new{rng.random()}"
            rows.append((10 * i + k, " ".join(copy).upper() if k == 2 else "\n".join(copy)))
            planted.append(likeness(shingles(rows[-1][1]), shingles(rows[-1 - k][1])))
    # At exactly 0.8 (72 of 90 shingles) and just below it.
    base = [f"b{k}" for k in range(94)]
    rows += [(5000, " ".join(base)), (5001, " ".join(base[:76])), (5002, " ".join(base[:75]))]
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "a b"), (6004, "A  b"), (6005, "a b c"), (6006, "a b c d e")]
    exact = likeness(shingles(rows[-10][1]), shingles(rows[-9][1]))
    assert exact == Fraction(4, 5) and likeness(shingles(rows[-10][1]), shingles(rows[-8][1])) < exact
    assert sum(Fraction(4, 5) <= x < Fraction(95, 100) for x in planted) > 40 and any(x < Fraction(4, 5) for x in planted)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert kept == brute(rows)
    assert corpus_pipeline.dedup_near(spark, docs.where("false"), "").count() == 0


def test_dense_group_with_a_null_id(spark):
    """One row of a group stays, and a null doc_id only where there is no other."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(100)] + [(None, " ".join(base))]
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, SCHEMA), "").select(F.coalesce("doc_id", F.lit(-1)).alias("i")).collect()
    assert sorted(r.i for r in kept) == [0]


def test_repeated_ids_and_clashing_names(spark):
    """A row goes for its own text, not for another row's of the same doc_id; all columns stay."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (None, a, 4), (None, "only this one has these words", 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_key long").withColumns({"near_row": F.lit(1), "key": F.lit(2), "n": F.lit(3), "root": F.lit(4), "fp": F.lit(5), "near_f0": F.lit(6), "tile": F.lit(7)})
    kept = corpus_pipeline.dedup_near(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(1, a), (5, b), (0, "only this one has these words"), (7, "")])
