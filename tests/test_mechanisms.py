"""Reply threads, running confidence, variants and the vector index against plain loops."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronicle.operators import extra, ledger, retrieval, threads, vector_index

T0 = datetime.datetime(2024, 1, 1)


def brute_roots(rows):
    parent = dict(rows)
    out = {}
    for i in parent:
        at, depth, seen = i, 0, set()
        while at is not None and parent[at] in parent and at not in seen:
            seen.add(at)
            at, depth = parent[at], depth + 1
        out[i] = (None, None) if at in seen else (at, depth)
    return out


def test_reply_threads(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([k - 1, k - 2, k // 2, 0, None, 9999])) for k in range(1, 60)] + [(0, None)]
    rows += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 204)]  # a circle, what leads into it, and a message that answers itself
    rows += [(1000 + k, 999 + k) for k in range(1, 40)] + [(1000, None)]
    got = {r.id: (r.root, r.depth) for r in threads.reply_roots(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == brute_roots(rows) and got[1039] == (1000, 39) and got[203] == (None, None)


def test_one_message_with_all_answers(spark):
    rows = spark.range(1, 3000).select("id", F.when(F.col("id") % 2 == 0, 1).when(F.col("id") > 1, F.col("id") - 1).cast("long").alias("parent"))
    got = threads.reply_roots(rows)
    assert got.groupBy("depth").count().orderBy("depth").collect() == [(0, 1), (1, 1499), (2, 1499)] and got.where("root <> 1").count() == 0
    assert threads.reply_roots(rows.limit(0)).count() == 0


def brute_running(rows, first=0.0):
    at, out = {}, []
    for s, t, i, d in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        at[s] = min(1.0, max(0.0, at.get(s, first) + (d or 0.0)))
        out.append((i, at[s]))
    return dict(out)


@pytest.mark.parametrize(("parts", "batch"), [(1, 10_000), (5, 7), (9, 3)])
def test_running_confidence(spark, parts, batch):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), T0 + datetime.timedelta(minutes=rnd.randrange(50)), i, rnd.choice([0.3, -0.4, 0.9, -1.5, 0.01, None])) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "subject string, t timestamp, id long, delta double")
        for first in (0.0, 0.5):
            got = ledger.running(df, first=first)
            assert got.columns == ["subject", "t", "id", "delta", "confidence"]
            want, told = brute_running(rows, first), {r.id: r.confidence for r in got.collect()}
            assert set(told) == set(want) and all(math.isclose(told[i], want[i], abs_tol=1e-9) for i in want)
        assert ledger.running(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_changes_compose():
    rnd = np.random.default_rng(1)
    delta, new = rnd.normal(0, 0.6, 1000), rnd.random(1000) < 0.02
    new[0] = True
    total, low, high = ledger._composed(delta, new)
    for start in (0.0, 0.4, 1.0):
        x = start
        for k in range(1000):
            x = min(1.0, max(0.0, (start if new[k] else x) + delta[k]))
            assert math.isclose(x, min(high[k], max(low[k], start + total[k])), abs_tol=1e-9)


def test_extra_data(spark, tmp_path):
    rows = [("a", '{"k": 5, "deep": {"x": [1, {"y": "z"}]}}'), ("b", '{"k": "five"}'), ("c", None), ("d", "no json"), ("e", "[1, 2]"), ("f", '{"k": 2.5}')]
    held = extra.with_extra(spark.createDataFrame(rows, "id string, additional_data string"))
    held.write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert dict(back.dtypes)["extra"] == "variant"
    got = {r.id: (r.k, r.y, r.t) for r in back.select("id", extra.value("$.k", "bigint").alias("k"), extra.value("$.deep.x[1].y", "string").alias("y"), extra.value("$.text", "string").alias("t")).collect()}
    assert got == {"a": (5, "z", None), "b": (None, None, None), "c": (None, None, None), "d": (None, None, "no json"), "e": (None, None, None), "f": (2, None, None)}
    kinds = {(r.field, r.kind): r.n for r in extra.fields(back.where("id IN ('a', 'b', 'f')")).collect()}
    assert kinds[("k", "BIGINT")] == 1 and kinds[("k", "STRING")] == 1 and kinds[("k", "DECIMAL(2,1)")] == 1
    extra.shredded(back, {"k": ("$.k", "bigint")}).write.parquet(str(tmp_path / "s"))
    narrow = spark.read.parquet(str(tmp_path / "s")).where("k > 3").select("id")
    assert [r.id for r in narrow.collect()] == ["a"] and "ReadSchema: struct<id:string,k:bigint>" in narrow._jdf.queryExecution().executedPlan().toString()


def test_vector_index(spark, tmp_path):
    rnd = np.random.default_rng(5)
    middle = rnd.normal(size=(25, 16))
    rows = [(k, (middle[k % 25] + 0.3 * rnd.normal(size=16)).tolist()) for k in range(1500)] + [(2000 + k, middle[0].tolist()) for k in range(700)] + [(5000, None), (5001, [0.0] * 16)]
    items = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = items.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = vector_index.build(items, str(tmp_path / "i"))
    stored = index.rows(spark)
    # Every row with a vector is in the index, also those that the centres were not fitted on.
    few = vector_index.build(items, str(tmp_path / "few"), sample=100, cells=30)
    assert stored.count() == few.rows(spark).count() == 2201 and len(few.centres) <= 30
    exact = retrieval.vector(items, asked, 10)
    shown = lambda df: sorted(map(str, df.select("query_id", "id", "score", "rank").collect()))
    assert shown(vector_index.search(index, asked, 10, len(index.centres))) == shown(exact)
    told = vector_index.recall(vector_index.search(index, asked, 10), exact).first()
    assert told.queries == asked.where("embedding IS NOT NULL").count() and told.recall >= 0.9
    one = vector_index.search(index, asked.limit(1), 10, 1)
    assert one.count() == 10 and "PartitionFilters: []" not in one._jdf.queryExecution().executedPlan().toString()
    none = vector_index.build(items.limit(0), str(tmp_path / "none"))
    assert none.centres.shape == (1, 1) and vector_index.search(index, asked.limit(0), 10).count() == 0


def test_centres_are_the_same_for_the_same_rows():
    rows = np.random.default_rng(2).normal(size=(300, 8))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert (vector_index.fitted(rows, 12) == vector_index.fitted(rows.copy(), 12)).all()
    assert len(vector_index.fitted(np.repeat(rows[:1], 50, axis=0), 12)) == 1


def test_pairs_are_summed_up_in_as_many_tasks_as_they_need(spark, monkeypatch):
    from chronicle.operators import provenance

    monkeypatch.setattr(provenance, "PAIRS_A_TASK", 500)
    rows = [(g, (g * 7 + k * k) % 40) for g in range(200) for k in range(6)]
    got = provenance.co_occurrence(spark.createDataFrame(rows, "memory_id long, item long"), "item")
    want = {}
    for g in range(200):
        items = sorted({i for m, i in rows if m == g})
        for x, a in enumerate(items):
            for b in items[x + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.together for r in got.collect()} == want
    assert got.select(F.spark_partition_id()).distinct().count() > 2
