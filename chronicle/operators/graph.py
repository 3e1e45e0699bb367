"""Similarity of short texts, components, clusters, and neighbourhoods in graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronicle.functions.text import tokens
from chronicle.tables import join_split, materialize

NEIGHBOURS, LEAST_SIMILARITY, CLUSTERS = 3, 0.18, 5
#: Texts of one term that are compared in one task's tile.
TILE = 4096
#: Links that a task contracts at a time.
LOCAL_LINKS = 1_000_000


def tfidf(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, weight): count times ln(n / (1 + documents with the term)), which may be negative."""
    terms = texts.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("c"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    weight = F.col("c") * F.ln(F.col("n") / (F.col("df") + 1.0))
    return terms.join(df, "term").join(F.broadcast(n)).select(key, "term", weight.alias("weight"))  # one row


def similarities(weights: DataFrame, least: float = LEAST_SIMILARITY, key: str = "id") -> DataFrame:
    """(a, b, similarity), a < b: all pairs of cosine at least ``least`` > 0, by prefix filtering.

    Each text's terms stand in one order, rare ones first, as a vector of length 1.  Its
    prefix ends where the rest is shorter than ``least``.  If two texts share no term of both
    prefixes, all that they share lies in the rest of one of them, and their cosine is less
    (Cauchy-Schwarz).  So texts meet only by terms of their prefixes, which common terms
    seldom are; a pair counts at the first such term that both have, and is verified there by
    both whole vectors.  No pair moves, only vectors do, once for each term of a prefix.  A
    term in the prefixes of more than TILE texts is cut into tiles of pairs of groups.
    """
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm")).where("norm > 0")
    unit = weights.where("weight <> 0").join(norms, key).select(key, "term", (F.col("weight") / F.col("norm")).alias("u"))
    df = unit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vector = F.array_sort(F.collect_list(F.struct("df", "term", "u"))).alias("v")
    vectors = unit.join(df, "term").groupBy(key).agg(vector)
    limit = least * least - 1e-9  # so that rounding never shortens a prefix
    end = F.aggregate("v", F.struct(F.lit(1.0).alias("rest"), F.lit(0).alias("n")), lambda s, x: F.struct((s["rest"] - x["u"] * x["u"]).alias("rest"), (s["n"] + F.when(s["rest"] >= limit, 1).otherwise(0)).alias("n")))
    terms = F.transform("v", lambda x: x["term"])
    placed = materialize(vectors.select(F.col(key).alias("key"), F.slice(terms, F.lit(1), end["n"]).alias("prefix"), F.map_from_arrays(terms, F.transform("v", lambda x: x["u"])).alias("v")), "prefixes")
    posted = placed.select("key", "prefix", "v", F.explode("prefix").alias("term"))
    groups = posted.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("groups")).where("groups > 1")
    # Fewer rows than postings / TILE; a term that is not among them is one group.
    tiled = posted.join(groups, "term", "left").withColumn("groups", F.coalesce("groups", F.lit(1))).withColumn("g", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int"))
    a = tiled.select("term", F.col("g").alias("i"), F.explode(F.sequence("g", F.col("groups") - 1)).alias("j"), F.col("key").alias("x"), F.col("prefix").alias("px"), F.col("v").alias("vx"))
    b = tiled.select("term", F.explode(F.sequence(F.lit(0), "g")).alias("i"), F.col("g").alias("j"), F.col("key").alias("y"), F.col("prefix").alias("py"), F.col("v").alias("vy"))
    first = F.get(F.array_intersect("px", "py"), F.lit(0)) == F.col("term")
    met = a.join(b, ["term", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & first)
    dot = F.aggregate(F.map_entries("vx"), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at("vy", x["key"]), F.lit(0.0)))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), dot.alias("similarity")).where(F.col("similarity") >= least)


def nearest_edges(pairs: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(src, dst, weight): each node's ``k`` most similar others, each undirected edge once.

    Equal similarities go by the greater id first; weights are rounded half to even.
    """
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), F.desc("y")))
    near = both.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return near.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.bround(F.max("similarity"), 3).alias("weight"))


def _near_links(edges: DataFrame) -> DataFrame:
    """(node, least): of each LOCAL_LINKS of a task's links (u, v) each node with the least one that it hangs together with there, itself included."""
    schema = T.StructType([T.StructField("node", edges.schema["u"].dataType), T.StructField("least", edges.schema["u"].dataType)])

    def contract(u: pa.ChunkedArray, v: pa.ChunkedArray) -> pa.RecordBatch:
        coded = pa.chunked_array([*u.chunks, *v.chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        nodes, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        ends = place[coded.indices.to_numpy()]
        x, y = ends[: len(u)], ends[len(u) :]
        root = np.arange(len(nodes))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            open_ = low < high
            x, y, low, high = x[open_], y[open_], low[open_], high[open_]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], names=["node", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= LOCAL_LINKS:
                whole = pa.Table.from_batches(held)
                yield contract(whole.column("u"), whole.column("v"))
                held, n = [], 0
        if n:
            whole = pa.Table.from_batches(held)
            yield contract(whole.column("u"), whole.column("v"))

    return edges.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the graph of ``links`` (u, v).  The root is the least node of its component; links with a null end are none.

    Links are sorted into ranges, as neighbours in number are often neighbours in the graph,
    and contracted where they lie: of LOCAL_LINKS links only a star of each of their
    components goes on.  A node of several stars links their least nodes; what hangs together
    among these, far fewer than the nodes, is found by ``_stars``.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    near = materialize(_near_links(edges.repartitionByRange("u", "v")), "near-links")
    met = materialize(near.groupBy("node").agg(F.min("least").alias("least"), F.array_distinct(F.collect_list("least")).alias("all")), "near-nodes")
    across = met.where(F.size("all") > 1).select(F.explode("all").alias("u"), F.col("least").alias("v"))
    found = _stars(across).select(F.col("node").alias("least"), "root")
    count = met.count()
    sizes = met.groupBy("least").agg(F.count(F.lit(1)).alias("n"))
    roots = materialize(sizes.join(found, "least", "left").select("least", F.coalesce("root", "least").alias("root"), "n"), "roots")
    return join_split(met.select("node", "least"), roots, "least", "n", count).where("node <> root").select("node", "root")


def _stars(links: DataFrame) -> DataFrame:
    """(node, root) of the graph of ``links`` (u, v), by alternating large and small stars.

    Rounds go on until one changes nothing; every round is written to the shared folder,
    so the plan stays short.  The root is the least node of its component.  Links with a
    null end are none.
    """
    star = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges, told = materialize(star.distinct(), "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == told:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_split(both.where("v > u"), least, "u", "n", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = materialize(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "links")


def grouped(nodes: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """(key, root, size): each node's component over the similar pairs, singletons included."""
    found = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = materialize(nodes.select(key).join(found, nodes[key] == found["node"], "left").select(key, F.coalesce("root", key).alias("root")), "rooted")
    sizes = materialize(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "sizes")
    # The giant component stays where its nodes lie.
    return join_split(rooted, sizes, "root", "size", rooted.count()).select(key, "root", "size")


def clusters(nodes: DataFrame, weights: DataFrame, pairs: DataFrame, keep: int = CLUSTERS, key: str = "id") -> DataFrame:
    """(key, cluster): the ``keep`` largest components, equal ones by their least node; each other node goes to
    the cluster whose summed weights it is most similar to, the first of equals, or to 0."""
    members = grouped(nodes, pairs, key)
    big = members.select("root", "size").distinct().orderBy(F.desc("size"), "root").limit(keep)
    big = big.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "root")) - 1).select("root", "cluster")  # ``keep`` rows
    placed = members.join(F.broadcast(big), "root", "left").select(key, "cluster")
    centre = weights.join(placed.where("cluster IS NOT NULL"), key).groupBy("cluster", "term").agg(F.sum("weight").alias("cw"))
    length = lambda df, by, w, name: df.groupBy(by).agg(F.sqrt(F.sum(F.col(w) ** 2)).alias(name))
    lone = weights.join(placed.where("cluster IS NULL").select(key), key)
    dots = lone.join(centre, "term").groupBy(key, "cluster").agg(F.sum(F.col("weight") * F.col("cw")).alias("dot"))
    dots = dots.join(length(lone, key, "weight", "na"), key).join(length(centre, "cluster", "cw", "nb"), "cluster")
    near = dots.select(key, "cluster", F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("s"))
    # A cluster without a shared term has similarity 0, so every cluster takes part.
    all_ = placed.where("cluster IS NULL").select(key).withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(keep - 1)))).join(F.broadcast(big.select("cluster")), "cluster", "left_semi")
    best = all_.join(near, [key, "cluster"], "left").groupBy(key).agg(F.max_by("cluster", F.struct(F.coalesce("s", F.lit(0.0)), -F.col("cluster"))).alias("cluster"))
    return placed.where("cluster IS NOT NULL").unionByName(best)


def derived(principles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, clusters) of principles (id, text)."""
    weights = tfidf(principles)
    pairs = materialize(similarities(weights), "similar")
    return nearest_edges(pairs), clusters(principles, weights, pairs)


def adjacency(*edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted neighbours over all given edge lists (src, dst)."""
    out = None
    for e in edges:
        both = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        out = both if out is None else out.union(both)
    return out.groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def focus(neighbours: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): the chosen nodes and their neighbours."""
    near = neighbours.join(nodes.select("node"), "node", "left_semi").select(F.explode("neighbours").alias("node"))
    return nodes.select("node").union(near).distinct()


def places_of(cited: DataFrame) -> DataFrame:
    """(text, places): the places (place, text) that cite principles of the same text."""
    return cited.groupBy("text").agg(F.array_sort(F.collect_set("place")).alias("places"))
