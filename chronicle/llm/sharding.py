"""Sharding by histogram sort: shards of near equal bytes that keep equal texts together.

Documents are ordered by (hash of the text, doc_id), so equal texts, a group, stand
together.  Rounds of one aggregation each count exact rows and bytes between candidate
boundaries (probes).  A cell between two probes is refined while it holds several groups
and more bytes than a small part of a shard, or a shard's end and more bytes than the
tolerance; a group is refined by doc_id only while it has very many rows.  Then each
document moves once, to its cell; its slot is the rows before the cell in its shard,
which the counts give, plus its place in the cell.

A group of more bytes than a small part of a shard is a cell, or several, of its own.
Such groups are placed first, the largest first, each in the emptiest shard; the other
cells then fill the shards in their order up to what is left of each.  So a group is
never cut, unless it has more bytes than a shard: then its cells are dealt like others.

Null texts have size 8 and the checksum of no bytes.  Null doc_ids come first
among equal texts.  Rows equal in text and doc_id cannot be parted by any probe
and follow each other in any order.  No rows give no rows.  Other columns than doc_id
and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronicle.llm.shared import documents, materialize

SHARDS = 24
#: Bytes by which a boundary may miss its ideal place, as a part of a shard.
TOLERANCE = 0.002
#: Bytes of a cell as a part of a shard: beyond it a cell of several groups is refined, and a group is placed by itself.
CELL = 1 / 64
#: A cell may hold this part of the rows, where distinct keys allow it; beyond
#: CELL_ROWS rows the parts get smaller, down to 1 / MOST_CELLS.
LEAST_CELLS, MOST_CELLS, CELL_ROWS = 512, 20_000, 100_000
#: Probes put into a cell that is refined; cells to start with; rounds at most, more than 128 bits of keys can need.
FANOUT, FIRST_CELLS, MAX_ROUNDS = 16, 2048, 64
_MIN = -(1 << 63)


def _cell_of(h: np.ndarray, d: np.ndarray, probe_h: np.ndarray, probe_d: np.ndarray) -> np.ndarray:
    """How many of the sorted probes are at or below each key (h, d)."""
    cell = np.searchsorted(probe_h, h, side="left")
    upto = np.searchsorted(probe_h, h, side="right")
    for at in np.unique(cell[upto > cell]):  # hashes that are probes themselves: the doc_id decides
        rows = np.flatnonzero((cell == at) & (upto > cell))
        last = upto[rows[0]]
        cell[rows] = at + np.searchsorted(probe_d[at:last], d[rows], side="right")
    return cell


def _with_cell(probes: list[int]):
    probe_h = np.array([(p >> 64) + _MIN for p in probes], dtype=np.int64)
    probe_d = np.array([(p & ((1 << 64) - 1)) + _MIN for p in probes], dtype=np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _cell_of(b.column("h").to_numpy(), b.column("d").to_numpy(), probe_h, probe_d)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    return assign


def _cells(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Rows, bytes, least and greatest key of each cell that has rows."""
    celled = keyed.select("h", "d", "size").mapInArrow(_with_cell(probes), "h long, d long, size long, cell int")
    # A hash's rows differ in doc_id only, so the least and greatest keys come from two plain minima and maxima.
    hashed = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("d").alias("d0"), F.max("d").alias("d1")
    )
    out = {}
    for r in hashed.collect():  # a row for each cell
        low, high = (r.h0 - _MIN) << 64, (r.h1 - _MIN) << 64
        out[r.cell] = (r.n, r.bytes, low | (r.d0 - _MIN), high | (r.d1 - _MIN))
    return out


def _placed(cells: dict[int, tuple[int, int, int, int]], shards: int) -> tuple[dict[int, int], set[int]]:
    """The shard of each cell, and the cells that hold a shard's end."""
    total = sum(c[1] for c in cells.values())
    target = total / shards
    groups: dict[int, list[int]] = {}
    for k, (_, size, low, high) in cells.items():
        if low >> 64 == high >> 64:
            groups.setdefault(low >> 64, []).append(k)
    bytes_of = {g: sum(cells[k][1] for k in own) for g, own in groups.items()}
    load, shard = [0] * shards, {}
    alone = [g for g, own in groups.items() if bytes_of[g] <= target and (bytes_of[g] > target * CELL or len(own) > 1)]
    for g in sorted(alone, key=lambda g: (-bytes_of[g], g)):
        where = min(range(shards), key=lambda s: (load[s], s))
        load[where] += bytes_of[g]
        shard.update(dict.fromkeys(groups[g], where))
    room = [max(0.0, target - x) for x in load]
    scale = (total - sum(load)) / max(sum(room), 1)
    ends, reached = [], 0.0
    for r in room:
        reached += r * scale
        ends.append(reached)
    cut, at, before = set(), 0, 0
    for k in sorted(k for k in cells if k not in shard):
        size = cells[k][1]
        # A cell goes where its middle byte belongs; shards never go back.
        while at < shards - 1 and before + size / 2 >= ends[at]:
            at += 1
        shard[k] = at
        if any(before < e < before + size for e in ends[:-1]):
            cut.add(k)
        before += size
    return shard, cut


def split_points(keyed: DataFrame, shards: int, tolerance: float) -> tuple[list[int], list[int], list[int]]:
    """Probes, and for each cell its shard and the rows before it in the shard."""
    probes = [((1 << 64) * k // FIRST_CELLS) << 64 for k in range(1, FIRST_CELLS)]
    for _ in range(MAX_ROUNDS):
        cells = _cells(keyed, probes)
        shard, cut = _placed(cells, shards)
        target = sum(c[1] for c in cells.values()) / shards
        rows = sum(c[0] for c in cells.values())
        most = max(64, rows // max(LEAST_CELLS, min(MOST_CELLS, rows // CELL_ROWS)))
        more: set[int] = set()
        group_bytes = Counter()
        for _, size, low, high in cells.values():
            if low >> 64 == high >> 64:
                group_bytes[low >> 64] += size
        for k, (n, size, low, high) in cells.items():
            if low >> 64 < high >> 64:  # several groups: probes only between groups
                if n > most or size > target * CELL or (k in cut and size > tolerance * target):
                    a, b = low >> 64, high >> 64
                    more.update((a + (b - a) * i // FANOUT + (i == FANOUT)) << 64 for i in range(1, FANOUT + 1))
                    more.add(b << 64)
            elif low < high and (n > most or (k in cut and size > tolerance * target and group_bytes[low >> 64] > target)):
                more.update(low + (high - low) * i // FANOUT for i in range(1, FANOUT + 1))
        new = sorted(p for p in {*probes, *more} if p < 1 << 128)
        if len(new) == len(probes):
            break
        probes = new
    else:
        raise RuntimeError(f"shard boundaries were not found in {MAX_ROUNDS} rounds")
    of, first, rows_in = [0] * (len(probes) + 1), [0] * (len(probes) + 1), [0] * shards
    for k in sorted(cells):
        of[k], first[k] = shard[k], rows_in[shard[k]]
        rows_in[shard[k]] += cells[k][0]
    return probes, of, first


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = materialize(
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_MIN) + F.monotonically_increasing_id()).alias("d"),  # many null doc_ids are parted too
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-keys",
    )
    probes, shard, first = split_points(keyed, shards, tolerance)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema) + ", cell int"
    place = Window.partitionBy("cell").orderBy("h", "d")
    spark = docs.sparkSession
    where = spark.createDataFrame([(k, shard[k], first[k]) for k in range(len(shard))], "cell int, shard int, first long")
    return (
        keyed.mapInArrow(_with_cell(probes), schema)
        .withColumn("_row", F.row_number().over(place))
        .join(F.broadcast(where), "cell")  # a row for each cell, a number that the driver holds already
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("_row") - 1).alias("slot"))
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
