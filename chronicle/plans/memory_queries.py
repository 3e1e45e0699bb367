"""Queries on memory banks and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronicle.functions.text import bullets, cited, emphasised, from_first_bold, keyword_reply
from chronicle.operators import ledger, provenance, retrieval
from chronicle.plans import views
from chronicle.plans.catalogue import query

_BM25 = r"""
r AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:''\p{L}+)*') AS w FROM documents), r2 AS (SELECT doc_id, w, len(w) AS n FROM r),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:''\p{L}+)*')) AS term FROM benchmark),
u AS (SELECT doc_id, n, unnest(w) AS term FROM r2), tf AS (SELECT term, doc_id, n, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n, avg(n) AS mean FROM r2),
b AS (SELECT query_id, doc_id, sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.n / mean))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY query_id, doc_id),
k AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b)"""


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs, items = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "benchmark")
    return retrieval.lexical(docs.select("doc_id", "text"), items.select(F.col("item_id").alias("query_id"), "text"), k, key="doc_id")


@query("r3_lexical_topk", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 10")
def r3_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, 10)


_COS = """
i AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT query_id, vec_id, round(CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS DOUBLE), 6) AS score FROM i, q),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c)"""


def _vector(spark: SparkSession, sf_dir: str, k: int, turned: bool = False) -> DataFrame:
    """Queries are the vectors whose ids are divisible by 100, against all vectors."""
    e = views.table(spark, sf_dir, "embeddings")
    asked = F.reverse("embedding") if turned else F.col("embedding")
    return retrieval.vector(e.select("vec_id", "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), asked.alias("embedding")), k, key="vec_id")


@query("r3_vector_topk", f"WITH {_COS} SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 10")
def r3_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector(spark, sf_dir, 10)


@query(
    "r8_rrf",
    f"""WITH {_COS}, c2 AS (SELECT query_id, vec_id, round(CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(e) AS DOUBLE[])) AS DOUBLE), 6) AS score FROM i, q),
l AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c2),
a AS (SELECT query_id, vec_id, rank FROM k WHERE rank <= 50 UNION ALL SELECT * FROM l WHERE rank <= 50),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM a GROUP BY query_id, vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f QUALIFY rank <= 10""",
)
def r8_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by a query's vector with that by the same vector turned round."""
    wide = retrieval.fused(_vector(spark, sf_dir, 50), _vector(spark, sf_dir, 50, turned=True), k=100, key="vec_id")
    return retrieval.ranked(wide.withColumn("score", F.round("score", 9)).drop("rank"), 10, "vec_id")


@query(
    "r7_token_budget",
    """WITH h AS (SELECT source, doc_id, n_chars // 4 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
s AS (SELECT *, CAST(sum(t) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM h) SELECT source, doc_id, spent FROM s WHERE spent <= 3000""",
)
def r7_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return retrieval.first_within_budget(docs, F.expr("n_chars div 4"), ["doc_id"], by="source").select("source", "doc_id", "spent")


@query("r5_people", "SELECT s_name AS name, count(*) AS observations, arg_min(l_returnflag || l_partkey, (l_shipdate, l_returnflag || l_partkey)) AS first FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY observations DESC, name LIMIT 25")
def r5_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = views.table(spark, sf_dir, "lineitem"), views.table(spark, sf_dir, "supplier")
    seen = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("s_name").alias("name"), F.col("l_shipdate").alias("t"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    return retrieval.people(seen)


@query("r11_co_occurrence", """WITH t AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem) SELECT a.i AS a, b.i AS b, count(*) AS together FROM t a JOIN t b ON a.g = b.g AND a.i < b.i GROUP BY a.i, b.i""")
def r11_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.co_occurrence(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_suppkey").alias("item")), "item")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("ts").alias("t"), F.col("event_id").alias("id"), "event_type", ((F.col("value") - 50) / 10000).alias("delta"))


@query("y4_confidence", "SELECT user_id AS subject, round(greatest(0.0, least(1.0, sum((value - 50) / 10000))), 6) AS confidence, count(*) AS changes FROM events GROUP BY user_id")
def y4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.confidence(_deltas(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("y8_current_state", "SELECT user_id AS subject, event_id AS id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def y8_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.current(_deltas(spark, sf_dir)).select("subject", "id", "event_type")


@query("y11_once", "SELECT user_id || event_type AS assertion_key, min(event_id) AS id FROM events GROUP BY 1")
def y11_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _deltas(spark, sf_dir).withColumn("assertion_key", F.concat(F.col("subject").cast("string"), F.col("event_type")))
    return ledger.once(keyed).select("assertion_key", "id")


@query("y9_queue", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS band, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders")
def y9_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its place in the whole queue; y9_queue_all is its older name."""
    return y9_queue_all(spark, sf_dir)


@query("y9_queue_all", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS band, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders")
def y9_queue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its place in the whole queue."""
    o = views.table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderstatus") == "P", "high").when(F.col("o_orderstatus") == "O", "normal").otherwise("low")
    items = o.select(F.col("o_orderkey").alias("id"), priority.alias("priority"), F.col("o_orderdate").alias("created_at"))
    return ledger.places(items).select("id", "band", "place")


@query(
    "y6_promotion",
    """WITH s AS (SELECT user_id, count(*) AS n, sum(value) / count(*) / 100 * exp(-ln(2.0) * date_diff('day', max(CAST(ts AS DATE)), DATE '2024-12-31') / 365.0) AS v FROM events GROUP BY user_id)
SELECT user_id AS subject, round(v, 6) AS value, CASE WHEN v < 0.2 THEN 'archived' WHEN v >= 0.24 AND n >= 60 THEN 'active' ELSE 'provisional' END AS state FROM s""",
)
def y6_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max(F.to_date("ts")).alias("last"))
    value = ledger.decayed(F.col("v") / F.col("n") / 100, F.datediff(F.lit("2024-12-31").cast("date"), F.col("last")), 365.0)
    return e.withColumn("w", value).select("subject", F.round("w", 6).alias("value"), ledger.state(F.col("w"), F.col("n"), 0.24, 60).alias("state"))


@query("y7_verdicts", """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS a FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN s + a = 0 THEN 'insufficient' WHEN a > s THEN 'contradict' WHEN s >= 2 THEN 'reinforce' ELSE 'candidate' END AS verdict FROM c""")
def y7_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("s"), F.count_if(F.col("l_returnflag") == "R").alias("a"))
    return li.select("l_orderkey", ledger.verdict(F.col("s"), F.col("a")).alias("verdict"))


@query("y2_source_refs", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS source_refs FROM events GROUP BY user_id")
def y2_source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = views.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("raw_ref"))
    return ledger.source_refs(units, "user_id").select("user_id", F.array_join("source_refs", ",").alias("source_refs"))


@query("r11_labelled_sources", "SELECT source, count(*) AS labelled, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def r11_labelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, la = views.table(spark, sf_dir, "documents").select("doc_id", "source"), views.table(spark, sf_dir, "labels")
    return d.join(la, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"), F.sum("toxic").cast("bigint").alias("toxic"))


_KINDS = "m AS (SELECT doc_id, source, lang, n_chars, CASE quality WHEN 1 THEN 'world' WHEN 0 THEN 'experience' ELSE 'opinion' END AS kind FROM documents LEFT JOIN labels USING (doc_id))"


@query("f14_fact_types", f"WITH {_KINDS} SELECT doc_id AS id, kind AS fact_type FROM m WHERE kind IN ('world', 'experience')")
def f14_fact_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.of_types(views.memories(spark, sf_dir), ["world", "experience"]).select("id", "fact_type")


@query("a12_network_sizes", f"WITH {_KINDS} SELECT kind AS network, count(*) AS n FROM m WHERE kind <> 'opinion' GROUP BY kind UNION ALL SELECT 'people', count(DISTINCT source) FROM m")
def a12_network_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.memories(spark, sf_dir)
    return retrieval.network_sizes(world=retrieval.of_types(m, ["world"]), experience=retrieval.of_types(m, ["experience"]), people=m.where("source IS NOT NULL").select("source").distinct())


@query("x25_time_label", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, nullif(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END, ''), 'customer ' || o_custkey) AS label FROM orders")
def x25_time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    start = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(F.col("o_orderkey").alias("id"), retrieval.time_label(start, F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise(""), F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))).alias("label"))


@query("x27_bullets", "SELECT l_orderkey AS id, string_agg('- ' || l_linenumber || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY l_orderkey")
def x27_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.concat(x["l_linenumber"].cast("string"), x["l_returnflag"]))
    return views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(bullets(facts).alias("lines"))


@query(
    "x33_marked_up",
    """SELECT o_orderkey AS id, replace(replace(replace('<em>' || o_orderpriority || '</em> by {0}, {1} and {7}', '{0}', '<sup class="cited" title="order ' || o_orderkey || '">[' || (o_custkey % 7) || ']</sup>'),
  '{1}', '<sup class="cited" title="a &amp; b">[2]</sup>'), '{7}', '<sup class="cited" title="">[?]</sup>') AS html FROM orders""",
)
def x33_marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    told = F.concat(F.lit("*"), F.col("o_orderpriority"), F.lit("* by {0}, {1} and {7}"))
    citations = F.array(F.struct(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("label"), (F.col("o_custkey") % 7).cast("int").alias("n")), F.struct(F.lit("a & b").alias("label"), F.lit(2).alias("n")))
    return o.select(F.col("o_orderkey").alias("id"), cited(emphasised(told), citations).alias("html"))


@query("y3_handles", "SELECT s_suppkey AS id, coalesce(n_name, s_name) AS contact FROM supplier LEFT JOIN (SELECT n_name, min(s_name) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) ON p = s_name")
def y3_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names as handles, of which the first of each nation has a contact, written in another way."""
    s, n = views.table(spark, sf_dir, "supplier"), views.table(spark, sf_dir, "nation")
    known = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.min("s_name").alias("p"))
    handles = known.select(F.concat(F.lit("("), F.upper(F.regexp_replace("p", "#", "# ")), F.lit(")")).alias("handle"), F.col("n_name").alias("contact"), F.lit("place").alias("kind"))
    return ledger.tagged_handles(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("author")), handles).select("id", "contact")


@query("x26_from_bold", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '**' || o_orderpriority || '** said' END AS said FROM orders")
def x26_from_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders")
    bold = F.concat(F.lit("**"), F.col("o_orderpriority"), F.lit("** said"))
    told = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "F", F.concat(F.lit("thinking about it: "), bold)).otherwise(bold)
    return o.select(F.col("o_orderkey").alias("id"), from_first_bold(told).alias("said"))


@query(
    "x34_keyword_reply",
    """SELECT p_partkey AS id, CASE WHEN contains(lower(p_name), 'small') OR contains(lower(p_name), 'large') THEN 'a size' WHEN contains(lower(p_name), 'red') THEN 'a colour' ELSE 'not known' END AS reply FROM part""",
)
def x34_keyword_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(("small", "large"), "a size"), (("red",), "a colour")]
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keyword_reply(F.col("p_name"), rules, "not known").alias("reply"))


@query("y10_pruned", "SELECT user_id AS subject, CASE WHEN sum(value) / count(*) / 100 >= 0.5 THEN 'kept' ELSE 'archived' END AS part FROM events GROUP BY user_id")
def y10_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject")).agg((F.sum("value") / F.count(F.lit(1)) / 100).alias("confidence"))
    kept, gone = ledger.pruned(e, 0.5)
    return kept.select("subject", F.lit("kept").alias("part")).unionByName(gone.select("subject", F.lit("archived").alias("part")))


@query("y5_contradictions", "SELECT o_orderkey AS id, CASE WHEN s_suppkey IS NOT NULL THEN 'high' ELSE 'normal' END AS priority, coalesce(s_name, '') AS contradiction FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def y5_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "supplier")
    items = o.select(F.col("o_orderkey").alias("id"), F.lit("normal").alias("priority"), F.col("o_custkey").alias("parent_contradiction"))
    out = ledger.with_contradictions(items, s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text")))
    return out.select("id", "priority", F.coalesce("contradiction", F.lit("")).alias("contradiction"))


@query(
    "r9_bundle",
    """SELECT 'me' AS bank_id, 'none' AS connections, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = 0) AS episodic, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = 1) AS semantic,
  (SELECT count(*) FROM region) AS persons, 0 AS principles""",
)
def r9_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of two regions as memories, regions as people, no principles."""
    n, r = views.table(spark, sf_dir, "nation"), views.table(spark, sf_dir, "region")
    of = lambda k: n.where(F.col("n_regionkey") == k).select("n_name")
    names = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x["n_name"])), ",").alias(c)
    row = retrieval.networks("me", of(0), of(1), r.select("r_name"), r.where("false").select("r_name"), "none")
    return row.select("bank_id", "connections", names("episodic"), names("semantic"), F.size("people").cast("bigint").alias("persons"), F.size("principles").alias("principles"))
