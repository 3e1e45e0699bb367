"""The stored index of words must give what the plain ranking gives, and read less."""

import random

from pyspark.sql import functions as F

from chronicle.operators import lexical_index, retrieval


def shown(df):
    return sorted(map(str, df.select("query_id", "id", "score", "rank").collect()))


def test_same_rows_and_fewer_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_ROWS", 8)
    rnd = random.Random(1)
    topics = [[f"t{t}w{k}" for k in range(12)] for t in range(30)]
    text = lambda i: " ".join(["common"] * rnd.randrange(3) + rnd.choices(topics[i // 20], k=rnd.randrange(1, 25)))
    rows = [(i, text(i)) for i in range(600)] + [(700, None), (701, ""), (702, "Common COMMON it's")]
    memories = spark.createDataFrame(rows, "id long, text string").repartitionByRange(3, "id").sortWithinPartitions("id")
    asked = [(q, " ".join(rnd.choices(topics[q], k=4)) + (" common" if q % 3 == 0 else "")) for q in range(30)] + [(100, "common"), (101, "nowhere"), (102, ""), (103, None), (104, "it's")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = lexical_index.build(memories, str(tmp_path / "i"))
    assert index.memories == 603 and index.blocks(spark).agg(F.max(F.size("postings"))).first()[0] <= 8
    for k in (1, 5):
        found, read = lexical_index.search(index, queries, k)
        assert shown(found) == shown(retrieval.lexical(memories, queries, k))
        total = read.agg(F.sum("postings").alias("all"), F.sum("read").alias("read")).first()
        assert total.read < 0.75 * total.all
    # Nothing is skipped where fewer than k are found.
    found, read = lexical_index.search(index, queries, 1000)
    assert shown(found) == shown(retrieval.lexical(memories, queries, 1000)) and read.where("read < postings").count() == 0
    assert lexical_index.search(index, queries.limit(0), 5)[0].count() == 0
    none = lexical_index.build(memories.limit(0), str(tmp_path / "none"))
    assert none.memories == 0


def test_bounds_are_read_without_postings(spark, tmp_path):
    memories = spark.createDataFrame([(i, f"word{i % 7} other") for i in range(50)], "id long, text string")
    index = lexical_index.build(memories, str(tmp_path / "i"))
    bounds = index.blocks(spark).where(F.col("bucket").isin(1, 2)).select("term", "block", "most", "df")
    text = bounds._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in text and "PartitionFilters: [bucket" in text


def test_no_part_of_a_sum_moves(spark, tmp_path, monkeypatch):
    """Blocks give their best memories alone, also where the queries go in several sets; equal scores stay in order of keys."""
    kept = {}
    real = lexical_index.materialize
    monkeypatch.setattr(lexical_index, "materialize", lambda df, label: kept.setdefault(label, []).append(real(df, label)) or kept[label][-1])
    monkeypatch.setattr(lexical_index, "QUERY_BLOCK", 3)
    memories = spark.createDataFrame([(i, "common " + "filler " * (i // 2) + ("rare" if i % 50 == 0 else "other")) for i in range(640)], "id long, text string").coalesce(1)
    queries = spark.createDataFrame([(f"q{q}", "common rare" if q % 2 else "common other") for q in range(7)], "query_id string, text string")
    index = lexical_index.build(memories, str(tmp_path / "i"))
    assert shown(lexical_index.search(index, queries, 2)[0]) == shown(retrieval.lexical(memories, queries, 2))
    # Of 640 sums two of each of ten blocks stay, or three where they are equal.
    assert sum(df.where("query_id = 'q1'").count() for df in kept["scored"]) < 50
