"""SimHash near-dedup: exact links between fingerprints by tiled comparison.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 hashes of
a text's word shingles (repeats included).  Equal fingerprints collapse first.
The distinct ones, ordered by their bit counts, form tiles; a pair of tiles is
compared by exclusive-or and bit counts, block by block.  Pairs of tiles, and
blocks in them, whose bit counts differ beyond the radius are skipped: by the
triangle inequality they hold no link.  A pair of tiles yields a spanning forest
of its links, so a dense group never yields all its pairs; forests are then joined
to components by rounds of large and small stars.

A null or empty text, or one without words, has the fingerprint zero and links
like any other.  A component's id is its smallest doc_id that is not null, or null
if there is none.  Repeated rows have equal fingerprints and one component.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronicle.llm.shared import documents, materialize, small_batches, unused
from chronicle.llm.words import buffers, mix, slices, split_words
from chronicle.operators.graph import components

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints compared as a block; a tile's rows at most; tiles that small inputs form, for work for all cores.
BLOCK, TILE_ROWS, LEAST_TILES = 256, 1 << 17, 16
_QUARTERS = np.uint64(16) * np.arange(4, dtype=np.uint64)

#: Of near copies: words of a shingle, the least similarity as a fraction, 64-bit words of a fingerprint.
NEAR_WORDS, ALIKE, OF, WIDE = 5, 4, 5, 16
#: Differing bits of 1024: two steps up to what a similarity of 0.8 has on average, and 3.3 standard deviations more; and of the first 64, 3.5 more.
TIGHT, LOOSE, FIRST = (115, 155), 193, 20
#: Pairs of texts verified at once; bits of the table of wanted texts (in a corpus that fills it more texts move, results stay).
PAIRS, SLOTS = 64, 1 << 22


def simhash_texts(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints of texts that lie in one buffer of UTF-8 bytes."""
    words = split_words(data, bounds)
    raw, digest = data.tobytes().lower(), xxhash.xxh64_intdigest
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    starts, ends = words.starts.tolist(), words.ends.tolist()
    for k, (a, b) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        found = [raw[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)]
        line = b" ".join(found)  # a shingle is a part of the words joined by one space
        at = np.zeros(b - a + 1, dtype=np.int64)
        np.cumsum(words.ends[a:b] - words.starts[a:b] + 1, out=at[1:])
        n = max(1, b - a - size + 1)
        first, last = at[:n].tolist(), (at[min(size, b - a) :][:n] - 1).tolist()
        hashes = np.fromiter((digest(line[i:j], SEED) for i, j in zip(first, last, strict=True)), dtype=np.uint64, count=n)
        out[k] = majority(hashes[:, None])[0]
    return out


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that more than half of the rows of 64-bit words have."""
    rows = hashes.view(np.uint8).reshape(len(hashes), -1)
    ones = np.zeros(rows.shape[1] * 8, dtype=np.int64)
    for i in range(0, len(rows), 255):  # so many fit a byte
        ones += np.unpackbits(rows[i : i + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(rows), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            fp = simhash_texts(data, bounds, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def tiled(rows: DataFrame, level: Column, reach: int) -> DataFrame:
    """``rows`` with (tile, a, b), once for each pair of tiles (a, b) whose levels come within ``reach`` of each other.

    ``level`` has few values, each a row for the driver.  Tiles, in the order of levels, hold
    TILE_ROWS rows at most: some levels, or a part by hash of one.
    """
    counts = sorted((r.level, r.n) for r in rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a level
    size = max(1, min(TILE_ROWS, -(-sum(n for _, n in counts) // LEAST_TILES)))
    places, tiles, room = [], 0, 0
    for value, n in counts:
        parts = -(-n // size)
        if n <= room:
            first, room = tiles - 1, room - n
        else:
            first, tiles, room = tiles, tiles + parts, size - n if parts == 1 else 0
        places.append((value, first, parts, first + parts - 1))
    near = [[p for p in places if abs(p[0] - value) <= reach] for value, *_ in places]
    table = [(value, first, parts, min(p[1] for p in own), max(p[3] for p in own)) for (value, first, parts, _), own in zip(places, near, strict=True)]
    where = rows.sparkSession.createDataFrame(table or [(0, 0, 1, 0, 0)], "_level int, _first int, _parts int, _low int, _high int")
    return (
        rows.withColumn("_level", level)
        .join(F.broadcast(where), "_level")  # a row a level
        .withColumn("tile", F.col("_first") + F.pmod(F.xxhash64(F.lit("tile"), *rows.columns), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence("_low", "_high")))
        .select(*rows.columns, "tile", F.least("tile", "_other").alias("a"), F.greatest("tile", "_other").alias("b"))
    )


def compared(tiles: DataFrame, find, schema: str) -> DataFrame:
    """``find(left, right)`` of each pair of tiles, ``right`` None within a tile, as columns of ``schema``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile, a, b = table.column("tile").to_numpy(), key[0].as_py(), key[1].as_py()
        columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("tile", "a", "b")}
        side = lambda t: {c: x[tile == t] for c, x in columns.items()}
        return pa.table({c: x.view(np.int64) for c, x in find(side(a), None if a == b else side(b)).items()})

    return tiles.groupBy("a", "b").applyInArrow(run, schema)


def forest(n: int, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph of n nodes and the links ``found``."""
    root = np.arange(n)
    src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def top(at: np.ndarray) -> np.ndarray:
        up = root[at]
        while not np.array_equal(over := root[up], up):
            up = over
        root[at] = up
        return up

    for u, v in found:
        while len(u):
            x, y = top(u), top(v)
            open_ = x != y
            u, v, x, y = u[open_], v[open_], x[open_], y[open_]
            lower, upper = np.minimum(x, y), np.maximum(x, y)
            # Each root hangs itself below the least of those that it is linked to.
            order = np.lexsort((lower, upper))
            hung, at = np.unique(upper[order], return_index=True)
            taken = order[at]
            root[hung] = lower[taken]
            src.append(u[taken])
            dst.append(v[taken])
    return np.concatenate(src), np.concatenate(dst)


def _quarters(x: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit parts."""
    return np.bitwise_count((x[:, None] >> _QUARTERS) & np.uint64(0xFFFF)).astype(np.int16)


def _block_pairs(low: np.ndarray, high: np.ndarray, cut: int, apart) -> Iterator[tuple[slice, slice]]:
    """Pairs of blocks, the second from ``cut`` on, that ``apart`` does not keep from each other."""
    starts = [*range(0, cut or len(low), BLOCK)]
    others = starts if not cut else [*range(cut, len(low), BLOCK)]
    ends = {i: min(i + BLOCK, cut if cut and i < cut else len(low)) for i in {*starts, *others}}
    least = np.array([low[i : ends[i]].min(axis=0) for i in others]) if others else low[:0]
    most = np.array([high[i : ends[i]].max(axis=0) for i in others]) if others else high[:0]
    for n, i in enumerate(starts):
        skip = apart(low[i : ends[i]].min(axis=0), high[i : ends[i]].max(axis=0), least, most)
        for m in np.flatnonzero(~skip).tolist():
            if cut or m >= n:
                yield slice(i, ends[i]), slice(others[m], ends[others[m]])


def tile_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of fingerprints, or within one."""
    order = lambda x: x[np.lexsort(_quarters(x).T)]
    all_ = order(left) if right is None else np.concatenate([order(left), order(right)])
    if right is not None and not (len(left) and len(right)):
        return all_[:0], all_[:0]
    q = _quarters(all_)

    def apart(least, most, others_least, others_most):
        return np.maximum(0, np.maximum(others_least - most, least - others_most)).sum(axis=1) > radius

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in _block_pairs(q, q, 0 if right is None else len(left), apart):
            u, v = np.nonzero(np.bitwise_count(all_[i, None] ^ all_[None, j]) <= radius)
            u, v = u + i.start, v + j.start
            yield u[u != v], v[u != v]

    u, v = forest(len(all_), found())
    return all_[u], all_[v]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join the fingerprints of ``distinct`` (column fp) as the pairs within ``radius`` do."""

    def find(left: dict, right: dict | None) -> dict:
        u, v = tile_forest(left["fp"].view(np.uint64), None if right is None else right["fp"].view(np.uint64), radius)
        return {"u": u, "v": v}

    return compared(tiled(distinct.select("fp"), F.bit_count("fp"), radius), find, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``."""
    marked = materialize(fingerprints(docs, size), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = materialize(components(near_links(distinct, radius)), "components")
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    told = materialize(rooted.join(named, "root").select("fp", "component_id"), "told")
    return marked.join(told, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = NEAR_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case; a shorter text has one shingle, all its words."""
    words = split_words(data, bounds, lower=True)
    windows = {k: words.windows(k) for k in range(1, size + 1)}
    spans = zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)
    return [np.unique(windows[min(size, b - a)][a : b - min(size, b - a) + 1]) if a < b else np.zeros(0, dtype=np.uint64) for a, b in spans]


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDE words for each set: SimHash over its shingles with WIDE hashes."""
    turn = mix(np.arange(1, WIDE + 1, dtype=np.uint64))
    return np.array([majority(mix(s[:, None] ^ turn)) if len(s) else turn * np.uint64(0) for s in sets], dtype=np.uint64).reshape(-1, WIDE)


def near_marked(docs: DataFrame, size: int, key: str, n: str, prints: list[str]) -> DataFrame:
    """``docs`` with the key of each text's shingle set, its size and its wide fingerprint in columns of these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in slices(batches):
            sets = shingle_sets(data, bounds, size)
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            wide = np.ascontiguousarray(wide_prints(sets).T).view(np.int64)
            own = [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, wide)]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, key, n, *prints])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in (key, n, *prints)]])
    return small_batches(docs).mapInArrow(run, schema)


def _close_pairs(left: dict, right: dict | None, steps: tuple[int, ...]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Keys of the rows of two tiles, the pairs of them whose sizes allow the similarity, by growing radii, and their roots."""
    order = lambda s: np.argsort(s["n"], kind="stable")
    sides = [{c: x[order(s)] for c, x in s.items()} for s in (left, right) if s is not None]
    whole = {c: np.concatenate([s[c] for s in sides]) for c in left}
    prints = np.stack([whole[f"f{k}"].view(np.uint64) for k in range(WIDE)])
    n = whole["n"]

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if right is not None and not (len(left["n"]) and len(right["n"])):
            return
        apart = lambda least, most, low, high: (OF * most < ALIKE * low) | (OF * high < ALIKE * least)
        for radius, (i, j) in itertools.product(steps, list(_block_pairs(n, n, 0 if right is None else len(left["n"]), apart))):
            u, v = np.nonzero(np.bitwise_count(prints[0, i, None] ^ prints[0, None, j]) <= FIRST)
            u, v = u + i.start, v + j.start
            fits = (u != v) & (OF * np.minimum(n[u], n[v]) >= ALIKE * np.maximum(n[u], n[v]))
            u, v = u[fits], v[fits]
            near = np.bitwise_count(prints[:, u] ^ prints[:, v]).sum(axis=0, dtype=np.int64) <= radius
            yield u[near], v[near]

    return whole["key"], found(), whole["root"]


def near_candidates(distinct: DataFrame, steps: tuple[int, ...], every: bool) -> DataFrame:
    """(u, v), u < v: pairs of keys (key, n, root, f0 ...) of different roots within a radius: every one, or a forest that takes near ones first, by growing radii."""

    def find(left: dict, right: dict | None) -> dict:
        keys, found, root = _close_pairs(left, right, steps)
        across = ((u[root[u] != root[v]], v[root[u] != root[v]]) for u, v in found)
        if every:
            pairs = [np.zeros((2, 0), dtype=np.int64), *map(np.array, across)]
            u, v = np.concatenate(pairs, axis=1)
        else:
            u, v = forest(len(keys), across)
        return {"u": np.minimum(keys[u], keys[v]), "v": np.maximum(keys[u], keys[v])}

    # Levels are fiftieths of the size's logarithm: sets that are alike at 0.8 are 12 levels apart at most.
    level = F.floor(F.ln(F.greatest("n", F.lit(1))) * 50).cast("int")
    reach = int(50 * np.log(OF / ALIKE)) + 1
    tiles = tiled(distinct.select("key", "n", "root", *[f"f{k}" for k in range(WIDE)]), level, reach)
    return compared(tiles, find, "u long, v long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Those of ``pairs`` (u, v) of keys whose shingle sets are alike; ``texts`` (key, text) has each key at least once."""
    wanted = materialize(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "near-wanted")  # read three times
    slot = lambda c: F.pmod(F.xxhash64(F.lit("slot"), c), F.lit(SLOTS)).cast("int")
    hit = np.zeros(SLOTS // 8, dtype=np.uint8)
    table = wanted.select(slot("key").alias("s")).groupBy(F.expr("s div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, s % 8)")).alias("bits")).toArrow()
    hit[table.column("at").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)  # a row for each byte of the table at most
    sent = texts.sparkSession.sparkContext.broadcast(hit)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.select(["key", "text"]).filter(pa.array((sent.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    some = small_batches(texts).select("key", "text", slot("key").alias("slot")).mapInArrow(likely, "key long, text string")
    bodies = materialize(some.join(wanted, "key", "left_semi").groupBy("key").agg(F.max("text").alias("text")), "near-bodies")
    body = lambda key, name: bodies.select(F.col("key").alias(key), F.col("text").alias(name))
    both = pairs.join(body("u", "a"), "u").join(body("v", "b"), "v")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                part = batch.slice(i, PAIRS)
                near = []
                for a, b in zip(shingle_sets(*buffers(part.column("a")), size), shingle_sets(*buffers(part.column("b")), size), strict=True):
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    near.append((OF + ALIKE) * shared >= ALIKE * (len(a) + len(b)))
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return small_batches(both).select("u", "v", "a", "b").mapInArrow(alike, "u long, v long")


def one_of_near_copies(docs: DataFrame, size: int = NEAR_WORDS) -> DataFrame:
    """One row of ``docs`` of each group of texts whose ``size``-word shingle sets are alike at 0.8 or more, all columns kept.

    Texts with equal sets collapse first.  Tiles of 1024-bit fingerprints give candidates: first a
    forest of the pairs within TIGHT bits, verified on the whole sets and joined to components;
    then every pair within LOOSE bits across these components, verified too.  A pair at 0.8
    differs in 155 bits on average with a standard deviation of 11.5, so 0.05 % of the pairs at
    just 0.8 are missed, and fewer above it.  Pairs across components are alike at 0.7 to 0.8:
    each of them has to be looked at, as one of them may be a link.

    The row of the smallest doc_id stays, one with a null doc_id only if all have one; of rows of
    one doc_id the one of the least shingle key.  Null and empty texts are a group of their own.
    """
    key, n, row = unused(docs, "near_key"), unused(docs, "near_n"), unused(docs, "near_row")
    prints = [unused(docs, f"near_f{k}") for k in range(WIDE)]
    marked = near_marked(docs, size, key, n, prints).withColumn(row, F.monotonically_increasing_id())
    marked = materialize(marked, "near-marked")  # written, so that row numbers never change
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key), F.col(row))
    names = [F.first(c).alias(f"f{k}") for k, c in enumerate(prints)]
    distinct = materialize(marked.groupBy(F.col(key).alias("key")).agg(F.first(n).alias("n"), F.min(order).alias("best"), *names), "near-distinct")
    texts = marked.select(F.col(key).alias("key"), "text")

    beside = materialize(near_candidates(distinct.withColumn("root", F.col("key")), TIGHT, every=False), "near-beside")
    first = materialize(_verified(beside, texts, size), "near-first")
    linked = materialize(components(first), "near-linked")
    rooted = distinct.join(linked, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    across = near_candidates(materialize(rooted.drop("best", "node"), "near-rooted"), (LOOSE,), every=True)
    across = materialize(across.join(beside, ["u", "v"], "left_anti"), "near-across")
    links = first.unionByName(_verified(across, texts, size))
    found = materialize(components(links), "near-components")
    best = distinct.select("key", "best").join(found, F.col("key") == F.col("node"), "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best"))
    kept = best.select(F.col("best").getField(row).alias(row))
    gone = materialize(marked.select(row).join(kept, row, "left_anti"), "near-gone")  # fewer rows than stay, in most corpora
    return marked.join(gone, row, "left_anti").select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
