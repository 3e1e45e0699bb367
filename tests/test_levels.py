"""The levelled table: what it rewrites, what it reads, and what it says after puts, deletes and stops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronicle.operators import levels, upsert
from chronicle.operators.levels import LevelledTable
from chronicle.schema import EVENT

T0 = datetime.datetime(2024, 1, 1, 12)
SCHEMA = "k string, v bigint, part string"


def made(spark, path):
    return LevelledTable(spark, str(path), SCHEMA, key="k", order="v", parts=("part",), sort=("v",))


def rows(spark, held):
    return spark.createDataFrame([(k, v, "p" + str(v % 2)) for k, v in held], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("base", "size"), [(0, 1), (500, 3), (100_000, 10), (64, 1)])
def test_a_thousand_upserts_rewrite_the_base_once_a_doubling(base, size):
    runs, oldest, rewritten, written, most = [base] if base else [], 0, [], 0, 0
    for _ in range(1000):
        runs.append(size)
        start = levels.first_to_merge(runs)
        if start is not None:
            total = sum(runs[start:])
            written += total
            if start == 0:
                oldest += 1
                rewritten.append(total)
            runs[start:] = [total]
        assert all(r > sum(runs[k + 1 :]) for k, r in enumerate(runs[:-1]))
        most = max(most, len(runs))
    assert sum(runs) == base + 1000 * size
    # Each time the base is written it has at least doubled.
    assert all(b >= 2 * a for a, b in zip([base, *rewritten], rewritten, strict=False))
    assert most <= 2 + (base + 1000 * size).bit_length() and written <= (base + 1000 * size) * (1000).bit_length() + 2 * base


def test_puts_and_deletes(spark, tmp_path):
    rnd, table, want = random.Random(5), made(spark, tmp_path / "t"), {}
    assert table.read().count() == 0 and table.lookup("x").count() == 0 and table.rows_of(rows(spark, [("x", 1)])).count() == 0
    for step in range(5):
        put = [(f"k{rnd.randrange(12)}", rnd.randrange(100)) for _ in range(rnd.randrange(1, 8))]
        gone = [f"k{rnd.randrange(12)}" for _ in range(3)]
        given = table.apply(rows(spark, put), spark.createDataFrame([(k,) for k in gone], "k string"))
        for k in gone:
            want.pop(k, None)
        for k, v in sorted(put, key=lambda x: x[1]):
            want[k] = v
        assert given == len(put) and {r.k: (r.v, r.part) for r in table.read().collect()} == {k: (v, f"p{v % 2}") for k, v in want.items()}
    for k in ("k1", "k5", "none"):
        assert [r.v for r in table.lookup(k).collect()] == ([want[k]] if k in want else [])
    asked = [f"k{k}" for k in range(0, 12, 2)]
    assert {r.k: r.v for r in table.rows_of(spark.createDataFrame([(k,) for k in asked], "k string")).collect()} == {k: want[k] for k in asked if k in want}
    table.delete(spark.createDataFrame([(k,) for k in want], "k string"))
    assert table.read().count() == 0
    sizes = [r["rows"] for r in table._state()[1]]
    assert all(r > sum(sizes[k + 1 :]) for k, r in enumerate(sizes[:-1]))


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.BUCKET_ROWS = 10
    table.replace(rows(spark, [(f"k{k}", k) for k in range(200)]), 200)
    assert table._state()[1][0]["buckets"] == 32
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    found = table.lookup("k77")
    assert [r.v for r in found.collect()] == [77] and "PartitionFilters: [isnotnull(_bucket" in plan(found) and files(found) == 1
    few = table.rows_of(spark.createDataFrame([("k1",), ("k2",), ("no",)], "k string"))
    assert {r.k for r in few.collect()} == {"k1", "k2"} and files(few) <= 2
    # Files are sorted, and a range of the sort column is pushed to their statistics.
    assert "GreaterThan(v,150)]" in plan(table.read().where("v > 150"))


def test_a_run_with_too_few_buckets_is_dealt_anew(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    table.BUCKET_ROWS = 5
    table.add(rows(spark, [(f"k{k}", k) for k in range(100)]))
    assert [(r["rows"], r["buckets"]) for r in table._state()[1]] == [(100, 32)] and table.read().count() == 100


def test_a_stop_before_the_commit(spark, tmp_path, monkeypatch):
    table = made(spark, tmp_path / "t")
    table.add(rows(spark, [("a", 1)]))
    for stop in ("_write", "_commit", "settle"):
        broken = made(spark, tmp_path / "t")
        monkeypatch.setattr(broken, stop, lambda *a, **b: (_ for _ in ()).throw(OSError("stop")))
        with pytest.raises(OSError):
            broken.add(rows(spark, [("b", 2)]))
        assert {r.k for r in table.read().collect()} == ({"a", "b"} if stop == "settle" else {"a"})
    assert table.vacuum() == 0 and table.vacuum(0) > 0 and {r.k for r in table.read().collect()} == {"a", "b"}


def test_a_merge_that_loses_to_another_writer_changes_nothing(spark, tmp_path, monkeypatch):
    one, two = made(spark, tmp_path / "t"), made(spark, tmp_path / "t")
    one.add(rows(spark, [("a", 1)]))
    real = one._write

    def late(*args, **more):
        if len(args) > 1:  # a merge
            monkeypatch.setattr(two, "settle", lambda: None)
            two.add(rows(spark, [("c", 3)]))
        return real(*args, **more)

    monkeypatch.setattr(one, "_write", late)
    one.add(rows(spark, [("b", 2)]))
    assert {r.k for r in one.read().collect()} == {"a", "b", "c"}


def test_last_of_many_versions_moves_little(spark, tmp_path):
    """A key with most of the rows leaves each task once: ranks are limited before the shuffle."""
    table = made(spark, tmp_path / "t")
    many = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"), F.lit("p").alias("part"))
    assert "WindowGroupLimit" in plan(table.latest(many.withColumn("_gone", F.lit(False))))
    assert table.add(many) == 20_000 and table.lookup("hot").first().v == 19_999


def test_events_by_id(spark, tmp_path):
    table = upsert.EventTable(spark, str(tmp_path / "events"))
    made_ = lambda n, content: spark.createDataFrame([(f"e{k}", T0 + datetime.timedelta(minutes=k), "self", content, "t", None, f"e{k}", "app" if k % 2 else "chat", "{}", content, k) for k in range(n)], EVENT)
    table.add(made_(30, "old"))
    table.add(made_(3, "new"))
    assert table.lookup("e2").first().content == "new" and table.lookup("e7").first().content == "old"
    assert upsert.by_source(table.read(), "chat").count() == 15
    assert "source" in plan(table.read().where("source = 'app'")).split("PartitionFilters: [")[1][:200]


def test_rows_of_merged_runs_move_once(spark, tmp_path, monkeypatch):
    """The newest row of a key is picked where the rows were dealt to, so one exchange leads to the merged run's files."""
    table, picked = made(spark, tmp_path / "t"), []
    real = table._first
    monkeypatch.setattr(table, "_first", lambda *a: picked.append(real(*a)) or picked[-1])
    table.add(rows(spark, [(str(k), k) for k in range(50)]))
    table.add(rows(spark, [(str(k), k + 100) for k in range(60)]))
    assert len(picked) == 1 and picked[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r.v for r in table.read().collect()) == list(range(100, 160))
