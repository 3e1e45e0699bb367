"""Queries on provenance and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.time import iso_utc
from chronicle.operators import graph, provenance
from chronicle.plans import views
from chronicle.plans.catalogue import iso, query

_LADDER = """
me AS (SELECT l_orderkey AS memory_id, l_orderkey * 8 + l_linenumber AS event_id FROM lineitem),
ev AS (SELECT l_orderkey * 8 + l_linenumber AS id, min(l_shipdate) AS t, min(l_returnflag || ' ' || l_partkey) AS content FROM lineitem GROUP BY 1),
pc AS (SELECT c_custkey AS id, c_acctbal / 10000 AS confidence, count(DISTINCT o_orderkey) AS n_memories, count(DISTINCT event_id) AS n_events
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN me ON memory_id = o_orderkey GROUP BY ALL)"""


@query("g1_principles", f"WITH {_LADDER} SELECT id, n_memories, n_events FROM pc")
def g1_principles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    return provenance.principle_counts(x["principles"], x["links"], x["memory_events"]).select("id", "n_memories", "n_events")


@query(
    "g2_edges",
    f"WITH {_LADDER} SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS n_memories, count(DISTINCT event_id) AS n_events FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN me ON memory_id = o_orderkey GROUP BY c_custkey",
)
def g2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    return provenance.edge_counts(x["edges"], x["edge_links"], x["memory_events"]).select("id", "n_memories", "n_events")


@query("g2_edges_all", f"WITH {_LADDER} SELECT id, n_memories, n_events FROM pc")
def g2_edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As g2_edges, over all orders."""
    x = views.ladder(spark, sf_dir)
    return provenance.edge_counts(x["edges"], x["edge_links"], x["memory_events"]).select("id", "n_memories", "n_events")


@query(
    "g3_memory_top8",
    f"""WITH {_LADDER}, r AS (SELECT memory_id, event_id, t, content, row_number() OVER (PARTITION BY memory_id ORDER BY t, event_id) AS k FROM me JOIN ev ON id = event_id),
s AS (SELECT memory_id, string_agg(event_id || '@' || {iso("t")} || '=' || content, ';' ORDER BY k) AS events FROM r WHERE k <= 8 GROUP BY memory_id)
SELECT o_orderkey AS memory_id, (SELECT count(*) FROM me WHERE memory_id = o_orderkey) AS n_events, coalesce(events, '') AS events FROM orders LEFT JOIN s ON s.memory_id = o_orderkey""",
)
def g3_memory_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    out = provenance.memory_samples(x["memories"], x["memory_events"], x["events"])
    shown = F.array_join(F.transform("events", lambda e: F.concat(e["event_id"].cast("string"), F.lit("@"), iso_utc(e["t_utc"]), F.lit("="), e["content"])), ";")
    return out.select("memory_id", "n_events", shown.alias("events"))


@query("j8_trace", f"WITH {_LADDER} SELECT o_custkey AS principle_id, o_orderkey AS memory_id, event_id, content FROM customer JOIN orders ON c_custkey = o_custkey JOIN me ON memory_id = o_orderkey JOIN ev ON ev.id = event_id")
def j8_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    return provenance.trace(x["principles"], x["links"], x["memory_events"], x["events"]).select("principle_id", "memory_id", "event_id", "content")


@query(
    "j9_edge_trace",
    f"WITH {_LADDER} SELECT c_custkey AS edge_id, o_orderkey AS memory_id, event_id FROM customer JOIN orders ON c_custkey = o_custkey JOIN me ON memory_id = o_orderkey JOIN ev ON ev.id = event_id",
)
def j9_edge_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    out = provenance.trace(x["edges"], x["edge_links"].withColumnRenamed("edge_id", "principle_id"), x["memory_events"], x["events"])
    return out.select(F.col("principle_id").alias("edge_id"), "memory_id", "event_id")


@query("j9_edge_trace_all", f"WITH {_LADDER} SELECT c_custkey AS edge_id, o_orderkey AS memory_id, event_id FROM customer JOIN orders ON c_custkey = o_custkey JOIN me ON memory_id = o_orderkey JOIN ev ON ev.id = event_id")
def j9_edge_trace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As j9_edge_trace, over all orders."""
    x = views.ladder(spark, sf_dir)
    out = provenance.trace(x["edges"], x["edge_links"].withColumnRenamed("edge_id", "principle_id"), x["memory_events"], x["events"])
    return out.select(F.col("principle_id").alias("edge_id"), "memory_id", "event_id")


@query("a7_depth", f"WITH {_LADDER} SELECT o_custkey AS principle_id, count(DISTINCT o_orderkey) AS memories, count(DISTINCT event_id) AS events FROM orders JOIN me ON memory_id = o_orderkey GROUP BY o_custkey")
def a7_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    return provenance.depth(x["links"], x["memory_events"])


@query("w6_rank", f"WITH {_LADDER} SELECT id, n_events, round(confidence * ln(n_events + 1), 6) AS score FROM pc ORDER BY confidence * ln(n_events + 1) DESC, confidence DESC, id LIMIT 40")
def w6_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    top = provenance.top_principles(provenance.principle_counts(x["principles"], x["links"], x["memory_events"]), 40)
    return top.select("id", "n_events", F.round("score", 6).alias("score"))


@query(
    "g6_slice",
    f"""WITH {_LADDER}, ch AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'),
ie AS (SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT id FROM ch) AND c_custkey + 1 IN (SELECT id FROM ch)),
pm AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT id FROM ch)),
em AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT id FROM ie)),
mm AS (SELECT o_orderkey FROM pm UNION SELECT o_orderkey FROM em),
km AS (SELECT * FROM me WHERE memory_id IN (SELECT o_orderkey FROM mm))
SELECT 'edges' AS part, count(*) AS n FROM ie UNION ALL SELECT 'principle_memories', count(*) FROM pm UNION ALL SELECT 'edge_memories', count(*) FROM em UNION ALL SELECT 'memories', count(*) FROM mm
UNION ALL SELECT 'memory_events', count(*) FROM km UNION ALL SELECT 'events', count(*) FROM ev WHERE id IN (SELECT event_id FROM km)""",
)
def g6_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    chosen = views.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    parts = provenance.slice_of(chosen, x["edges"], x["links"], x["edge_links"], x["memory_events"], x["events"])
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "g7_integrity",
    """WITH o AS (SELECT * FROM orders), me AS (SELECT l_orderkey AS memory_id, l_orderkey * 8 + l_linenumber AS event_id FROM lineitem)
SELECT 'edge source' AS "check", 0 AS orphans UNION ALL SELECT 'edge target', (SELECT count(*) FROM customer WHERE c_custkey + 1 NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'link principle', (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'link memory', 0
UNION ALL SELECT 'edge link edge', (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'edge link memory', 0
UNION ALL SELECT 'event link memory', (SELECT count(*) FROM me WHERE memory_id NOT IN (SELECT o_orderkey FROM o)) UNION ALL SELECT 'event link event', 0
UNION ALL SELECT 'principle without event', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o JOIN me ON memory_id = o_orderkey))""",
)
def g7_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    return provenance.integrity(x["principles"], x["edges"], x["memories"], x["links"], x["edge_links"], x["memory_events"], x["events"])


@query("f11_prefix", "SELECT r_name AS prefix, min(p_name) AS p_name FROM (SELECT 'small' AS r_name UNION ALL SELECT 'red' UNION ALL SELECT 'hot g') JOIN part ON starts_with(p_name, r_name) GROUP BY r_name")
def f11_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.createDataFrame([("small",), ("red",), ("hot g",)], "prefix string")
    return provenance.find_by_prefix(views.table(spark, sf_dir, "part"), prefixes, "p_name")


_TFIDF = """
p AS (SELECT p_name AS text, min(p_partkey) AS id FROM part GROUP BY p_name),
w AS (SELECT id, unnest(string_split(text, ' ')) AS term FROM p), k AS (SELECT id, term, count(*) AS c FROM w WHERE length(term) > 3 GROUP BY id, term),
d AS (SELECT term, count(*) AS df FROM k GROUP BY term), v AS (SELECT id, term, c * ln((SELECT count(*) FROM p) / (df + 1.0)) AS weight FROM k JOIN d USING (term)),
m AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) / (min(x.norm) * min(y.norm)) AS similarity FROM v a JOIN v b ON a.term = b.term AND a.id < b.id JOIN m x ON x.id = a.id JOIN m y ON y.id = b.id GROUP BY a.id, b.id HAVING similarity >= 0.18)"""


@query("g4_similarity", f"WITH {_TFIDF} SELECT a, b, round(similarity, 6) AS similarity FROM s")
def g4_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graph.similarities(graph.tfidf(views.short_texts(spark, sf_dir)))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "g4_knn_edges",
    f"""WITH {_TFIDF}, u AS (SELECT a AS x, b AS y, round(similarity, 9) AS similarity FROM s UNION ALL SELECT b, a, round(similarity, 9) FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY similarity DESC, y DESC) AS k FROM u)
SELECT least(x, y) AS src, greatest(x, y) AS dst, round(max(similarity), 3) AS weight FROM r WHERE k <= 3 GROUP BY 1, 2""",
)
def g4_knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities are rounded to nine digits first, so that the order of summing decides no tie."""
    pairs = graph.similarities(graph.tfidf(views.short_texts(spark, sf_dir))).withColumn("similarity", F.round("similarity", 9))
    return graph.nearest_edges(pairs)


@query(
    "g5_components",
    """WITH RECURSIVE e AS (SELECT c_custkey * 3 AS u, c_nationkey * 3 + 2 AS v FROM customer UNION ALL SELECT s_suppkey * 3 + 1, s_nationkey * 3 + 2 FROM supplier),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), n AS (SELECT DISTINCT u FROM b),
r(node, root) AS (SELECT u, u FROM n UNION SELECT b.v, r.root FROM r JOIN b ON r.node = b.u) SELECT node, min(root) AS root FROM r GROUP BY node HAVING min(root) <> node""",
)
def g5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of all customers, suppliers and their nations; each node that is not a root with its root.

    Nodes are keys times three, plus 0 for customers, 1 for suppliers and 2 for nations.
    """
    node = lambda key, kind: F.col(key).cast("bigint") * 3 + kind
    c = views.table(spark, sf_dir, "customer").select(node("c_custkey", 0).alias("u"), node("c_nationkey", 2).alias("v"))
    s = views.table(spark, sf_dir, "supplier").select(node("s_suppkey", 1).alias("u"), node("s_nationkey", 2).alias("v"))
    return graph.components(c.unionByName(s))


@query("g5_components_all")
def g5_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of all customers, orders and parts; held against union-find in the tests.

    Nodes are keys times three, plus 0 for customers, 1 for orders and 2 for parts.
    """
    c, o, li = (views.table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    node = lambda key, kind: F.col(key).cast("bigint") * 3 + kind
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(node("c_custkey", 0).alias("u"), node("o_orderkey", 1).alias("v"))
    held = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(node("o_orderkey", 1).alias("u"), node("l_partkey", 2).alias("v"))
    return graph.components(placed.unionByName(held))


@query("g5_clusters")
def g5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative; held against a brute-force version in the tests."""
    return graph.derived(views.short_texts(spark, sf_dir))[1]


@query("g9_adjacency", """WITH b AS (SELECT c_custkey AS node, c_custkey + 1 AS other FROM customer UNION SELECT c_custkey + 1, c_custkey FROM customer)
SELECT node, string_agg(other, ',' ORDER BY other) AS neighbours FROM b GROUP BY node""")
def g9_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.ladder(spark, sf_dir)["edges"].select(F.col("src_principle_id").alias("src"), F.col("dst_principle_id").alias("dst"))
    return graph.adjacency(e).select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("g11_places", "SELECT p_type AS text, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS places FROM part GROUP BY p_type")
def g11_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = views.table(spark, sf_dir, "part").select(F.col("p_type").alias("text"), F.col("p_brand").alias("place"))
    return graph.places_of(cited).select("text", F.array_join("places", ",").alias("places"))


@query("a13_raw_events", "SELECT (SELECT count(*) FROM orders) AS memories, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS raw_events")
def a13_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.ladder(spark, sf_dir)
    counted = x["memories"].join(provenance.event_totals(x["memory_events"]), "memory_id", "left")
    return provenance.raw_events(counted.withColumn("n_events", F.coalesce("n_events", F.lit(0))))


@query("a10_group_sizes", "WITH k AS (SELECT c_nationkey AS nation, min(c_custkey) AS root, count(*) AS size FROM customer GROUP BY 1) SELECT c_custkey AS id, root, size FROM customer JOIN k ON nation = c_nationkey")
def a10_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked to the first one of their nation: each one's group and its size."""
    c = views.table(spark, sf_dir, "customer")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("a"))
    pairs = c.join(first, "c_nationkey").select("a", F.col("c_custkey").alias("b")).where("a <> b")
    return graph.grouped(c.select(F.col("c_custkey").alias("id")), pairs)


@query(
    "g12_focus",
    """WITH b AS (SELECT c_custkey AS node, c_custkey + 1 AS other FROM customer UNION SELECT c_custkey + 1, c_custkey FROM customer), f AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT node FROM f UNION SELECT other FROM b WHERE node IN (SELECT node FROM f)""",
)
def g12_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.ladder(spark, sf_dir)["edges"].select(F.col("src_principle_id").alias("src"), F.col("dst_principle_id").alias("dst"))
    chosen = views.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return graph.focus(graph.adjacency(e), chosen)
