"""Components over all rows of the tables, against union-find in Python."""

from chronicle.operators import graph
from chronicle.plans import graph_queries


def brute(links):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    return {x: top(x) for x in root if top(x) != x}


def test_components_of_all_rows(spark, tmp_path):
    customers, orders = [1, 2, 3, 4, 5], [(10, 1, "O"), (11, 1, "P"), (12, 2, "F"), (13, 3, "O"), (14, 4, "F"), (3010, 9, "O")]
    items = [(10, 100), (12, 100), (13, 101), (14, 102), (3010, 101), (99, 102)]
    for name, rows, schema in [("customer", [(c,) for c in customers], "c_custkey long"), ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string"), ("lineitem", items, "l_orderkey long, l_partkey long")]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    keys = {k for k, _, _ in orders}
    links = [(3 * c, 3 * k + 1) for k, c, _ in orders if c in customers] + [(3 * k + 1, 3 * p + 2) for k, p in items if k in keys]
    got = {r.node: r.root for r in graph_queries.g5_components_all(spark, str(tmp_path)).collect()}
    assert got == brute(links) and len(got) > 8


def test_components_run_to_the_end(spark):
    links = [(k, k + 1) for k in range(400)] + [(1000, 1000 + k) for k in range(1, 500)] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == brute([x for x in links if None not in x])
    assert graph.components(df.limit(0)).count() == 0


def test_links_are_contracted_where_they_lie(spark, monkeypatch):
    """Stars alternate over what crosses the ranges alone, also where few links are contracted at a time and nodes are texts."""
    seen = []
    real = graph._stars
    monkeypatch.setattr(graph, "_stars", lambda links: seen.append(links.count()) or real(links))
    links = [(k, k + d) for k in range(0, 3000) for d in (1, 2, 3) if (k + d) // 500 == k // 500]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == brute(links) and seen[0] < 100
    monkeypatch.setattr(graph, "LOCAL_LINKS", 7)
    few = [(f"n{u:04d}", f"n{v:04d}") for u, v in links[:900]]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(few, "u string, v string")).collect()}
    assert got == brute(few)
