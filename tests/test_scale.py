"""Similar pairs, sums with sketches, budgets, prefixes, groups: right for any rows, and without one large group."""

import datetime
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronicle.operators import episodes, graph, provenance, retrieval, rollup
from chronicle.schema import EVENT

T0 = datetime.datetime(2024, 1, 1, 12)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_pairs(rows, least):
    by = defaultdict(dict)
    for i, t, w in rows:
        by[i][t] = w
    norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in by.items()}
    out = {}
    for a in by:
        for b in by:
            if a < b and norm[a] and norm[b]:
                s = sum(w * by[b].get(t, 0) for t, w in by[a].items()) / norm[a] / norm[b]
                if s >= least:
                    out[a, b] = s
    return out


@pytest.mark.parametrize(("least", "tile"), [(0.18, 4096), (0.7, 5), (0.18, 3)])
def test_similar_pairs(spark, monkeypatch, least, tile):
    monkeypatch.setattr(graph, "TILE", tile)
    rnd = random.Random(7)
    rows = [(i, f"t{t}", round(rnd.choice([-0.3, 0.01, 0.4, 1.0, 2.5]), 2)) for i in range(60) for t in {int(rnd.paretovariate(0.6)) % 30 for _ in range(rnd.randrange(0, 8))}]
    rows += [(100, "t1", 0.0), (101, "alone", 3.0), (102, "alone", 1.0)]
    got = {(r.a, r.b): r.similarity for r in graph.similarities(spark.createDataFrame(rows, "id long, term string, weight double"), least).collect()}
    want = brute_pairs(rows, least)
    assert set(got) == {k for k in want if want[k] >= least} and all(abs(got[k] - want[k]) < 1e-9 for k in got) and (101, 102) in got


def test_common_terms_do_not_meet(spark):
    """A term that all texts have, of little weight, is in no prefix: no pair is made by it."""
    term = F.explode(F.array(F.struct(F.lit("common").alias("term"), F.lit(0.05).alias("weight")), F.struct(F.concat(F.lit("own"), F.col("id").cast("string")).alias("term"), F.lit(2.0).alias("weight"))))
    weights = spark.range(400).select("id", term.alias("t")).select("id", "t.*")
    kept = []
    real = graph.materialize
    graph.materialize = lambda df, label: kept.append(real(df, label)) or kept[-1]
    try:
        assert graph.similarities(weights).count() == 0
    finally:
        graph.materialize = real
    assert {t for r in kept[0].collect() for t in r.prefix}== {f"own{k}" for k in range(400)}


def some_events(spark, n=4000):
    e = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 700).alias("t_utc"), F.when(F.col("id") % 3 == 0, "self").otherwise("other").alias("author_role"),
        F.repeat(F.lit("x"), (F.col("id") % 101).cast("int")).alias("content"), F.concat(F.lit("t"), F.pmod(F.xxhash64("id"), F.lit(1500)).cast("string")).alias("thread_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("id").alias("ingest_seq"),
    )
    return e


def test_sketches_are_near(spark):
    """Relative error of distinct threads below 5 % (three standard errors of 1.6 %), ranks of quantiles within 3 %; counts exact."""
    e = some_events(spark)
    rows = e.collect()
    days = rollup.daily(e)
    got = {(r.source, r.kind, r.day): r for r in rollup.estimates(rollup.cube(days)).collect()}
    threads, sizes = defaultdict(set), defaultdict(list)
    for r in rows:
        for s in (r.source, None):
            for k in (r.author_role, None):
                for d in (r.t_utc.date(), None):
                    threads[s, k, d].add(r.thread_id)
                    sizes[s, k, d].append(len(r.content))
    assert set(got) == set(threads)
    for key, r in got.items():
        assert r.n == len(sizes[key]) and abs(r.threads - len(threads[key])) <= max(1, 0.05 * len(threads[key]))
        for q, v in ((0.5, r.median_size), (0.95, r.p95_size)):
            own = sorted(sizes[key])
            low, high = sum(x < v for x in own) / len(own), sum(x <= v for x in own) / len(own)
            assert low - 0.03 - 1 / len(own) <= q <= high + 0.03 + 1 / len(own)
    assert got[None, None, None].level == 7 and got[None, None, None].days == len({r.t_utc.date() for r in rows})


def test_days_merge_with_later_ones(spark):
    e = some_events(spark, 1500)
    whole = rollup.estimates(rollup.cube(rollup.daily(e)))
    parts = rollup.merged(rollup.daily(e.where("id % 2 = 0")), rollup.daily(e.where("id % 2 = 1")))
    told = lambda df: {(r.source, r.kind, r.day): (r.n, r.days, r.first_t, r.last_t, r.threads) for r in df.collect()}
    got, want = told(rollup.estimates(rollup.cube(parts))), told(whole)
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()} and all(abs(got[k][4] - want[k][4]) <= 0.01 * want[k][4] + 1 for k in want)
    assert rollup.cube(rollup.daily(e.limit(0))).where("n IS NOT NULL").count() == 0
    sets = rollup.grouping_sets(rollup.daily(e), [("source",), ()]).collect()
    assert sorted((str(r.source), r.n) for r in sets) == [("None", 1500), ("a", 750), ("b", 750)]


def test_budget_of_one_source_with_all_rows(spark):
    rnd = random.Random(2)
    rows = [(None if k % 50 == 0 else "hot" if k % 5 else "b", k * 7 % 1009, rnd.choice([0, 1, 5, 40, None])) for k in range(900)]
    want, spent = [], Counter()
    for s, i, n in sorted(rows, key=lambda r: r[1]):
        spent[s] += n or 0
        if spent[s] <= 300:
            want.append((s, i, n, spent[s]))
    df = spark.createDataFrame(rows, "source string, id long, n long").repartition(5)
    got = retrieval.first_within_budget(df, F.col("n"), ["id"], 300, "source")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_prefixes_of_any_number(spark):
    table = spark.createDataFrame([("abc",), ("abd",), ("b",), ("",), ("ébc",)], "id string")
    asked = spark.createDataFrame([("ab",), ("abd",), ("b",), ("é",), ("zz",), ("",), (None,), ("ab",)], "prefix string")
    got = provenance.find_by_prefix(table, asked)
    assert {r.prefix: r.id for r in got.collect()} == {"ab": "abc", "abd": "abd", "b": "b", "é": "ébc", "": ""} and got.count() == 5
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert provenance.find_by_prefix(table, asked.limit(0)).count() == 0


def test_one_component_of_all_nodes(spark):
    nodes = spark.range(1, 1001)
    pairs = spark.range(2, 901).select(F.lit(1).cast("long").alias("a"), F.col("id").alias("b"))
    got = graph.grouped(nodes, pairs)
    assert got.columns == ["id", "root", "size"] and {(r.root, r.size): r.n for r in got.where("root = 1 OR id > 995").groupBy("root", "size").agg(F.count("*").alias("n")).collect()} == {(1, 900): 900, **{(k, 1): 1 for k in range(996, 1001)}}
    assert "Window" not in plan(got)


def test_thread_order_without_a_window_over_episodes(spark):
    full = [(f"e{k}", T0 + datetime.timedelta(hours=k), "self", "x", "t" if k % 4 else "u", None, "r", "app", "{}", None, (k * 37) % 50) for k in range(50)]
    built = episodes.build(spark.createDataFrame(full, EVENT))
    assert {(r.thread_id, r.thread_seq) for r in built.collect()} == {(t, min(x[10] for x in full if x[4] == t)) for t in "tu"}
    # Windows see days, or a row a day; none sees the gathered episodes.
    text = plan(built)
    assert text.index("Window") > text.index("Aggregate")
