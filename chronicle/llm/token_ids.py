"""Token ids as binary files: an id array a shard, and where its documents end by Elias-Fano codes.

``write`` puts documents into shards by ascending doc_id: quantiles of the ids, of which
there is one a shard, are the boundaries, and each document moves once, as ids.  A shard is
one file::

    magic      8 bytes, "TOKENIDS"
    ids        little-endian, 2 bytes each if the vocabulary allows it, else 4
    arrays     the Elias-Fano codes of the documents' ends and of their doc_ids
    head       JSON: how many of what, and how long each array is
    length     8 bytes, of the head

An end takes some log2(ids / documents) + 2.3 bits instead of 64; ``select`` gives the end
of any document without decoding the others.  The shards' names and sizes are a Parquet
table beside them.  A file gets a name that no other attempt has and counts only if that
table names it, so a task that is run again, or twice, leaves a file that nobody reads.

Ids are those of the tokenizers library.  White space ends every piece that the model
sees, and so does a change between ASCII letters and ``.,;:!?``; therefore a text is cut
there, each distinct piece is encoded by the library once, and ids are gathered by number.

A null or empty text has the end id alone.  Null doc_ids come first; rows of one doc_id
follow each other in the order of a hash of their texts, and an id with more rows than a
shard should have is parted by that hash.  No rows give no shards.  Other columns than
doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronicle.llm.elias_fano import EliasFano
from chronicle.llm.runs import runs, table
from chronicle.llm.shared import documents, shared_dir, small_batches
from chronicle.llm.words import slices

MAGIC, END = b"TOKENIDS", 2
#: Documents of a shard; beyond MOST_SHARDS shards they get more.
SHARD_DOCS, MOST_SHARDS = 8192, 100_000
#: Pieces that a worker remembers, the length of the longest, and how many words go to the library as one text.
MEMO, LONGEST, TOGETHER = 1_000_000, 64, 512
#: Bytes of text that are cut into pieces in one step; one longer text is a step.
STEP_BYTES = 1 << 22
#: Ids that are read in one step; one longer document is a step.
STEP_IDS = 1 << 20
_SOLID = table(bytes(set(range(128)) - {0x20, *range(0x09, 0x0E)}))
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
_MIN = -(1 << 63)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts by their pieces; piece 0 is the end of a text."""

    def __init__(self, path: str, end: int = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(end, *tokens.values()) < 1 << 16 else "<u4")
        self.end = end
        self.last = np.zeros(max(tokens.values()) + 1, dtype=bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for t, i in tokens.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.array([self.end], self.kind), np.array([0, 1], np.int64)

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one word each, and how many each has: many go as one text, and its last id tells where a word ends."""
        ids, size = [], []
        joined = [pieces[k : k + TOGETHER] for k in range(0, len(pieces), TOGETHER)]
        for own, e in zip(joined, self.tokenizer.encode_batch_fast([" ".join(j) for j in joined], add_special_tokens=False), strict=True):
            got = np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.last[got]) + 1
            got, many = (got, np.diff(ends, prepend=0)) if len(ends) == len(own) else self._each(own)
            ids.append(got)
            size.append(many)
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.concatenate([np.zeros(0, np.int64), *size])

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for g in got for i in g], self.kind), np.array([len(g) for g in got], np.int64)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces; new ones are encoded and remembered."""
        if len(self.known) > MEMO or len(self.ids) > 8 * MEMO:
            self.forget()
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            one = self.last.any()
            words = [p for p in new if one and p.isalpha() and p.lower().isalpha() and unicodedata.is_normalized("NFC", p)]
            rest = list(set(new).difference(words))
            (a, n), (b, m) = self._words(words), self._each(rest)
            known.update(zip(words + rest, range(len(self.ends) - 1, len(self.ends) - 1 + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, a, b])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([n, m]))])
        out = np.array([known[p] for p in pieces], dtype=np.int64)
        for p in [p for p in new if len(p) > LONGEST]:
            del known[p]  # its ids stay until the next time that all is forgotten
        return out

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts ``data[bounds[i]:bounds[i + 1]]``, and where each text's begin and end."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        letter, mark = _LETTER[data], _MARK[data]
        cut[1:-1] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        found = runs(data, bounds, _SOLID, cut)
        pieces, number = found.numbered()
        own = self._learn(pieces.to_numpy(zero_copy_only=False).tolist())
        each = np.insert(own[number] if len(number) else np.zeros(0, np.int64), found.offsets[1:], 0)
        size = (self.ends[1:] - self.ends[:-1])[each]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(upto[-1]) - np.repeat(upto[:-1] - self.ends[each], size)]
        return ids, upto[found.offsets + np.arange(len(found.offsets))]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """The worker's own, kept from task to task."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def _boundaries(key: DataFrame) -> list[int]:
    """Keys at which shards begin, one less than shards; one that fills several shards stands there several times."""
    rows = key.count()
    shards = max(1, min(MOST_SHARDS, rows // SHARD_DOCS))
    if shards == 1:
        return []
    return sorted(key.agg(F.percentile_approx("key", [k / shards for k in range(1, shards)], max(10_000, 10 * shards))).first()[0])


def encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(shard, null, doc_id, tie, n_tokens, ids) of each row; ids are little-endian bytes as in the files."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_MIN))
    bounds = docs.sparkSession.sparkContext.broadcast(np.array(_boundaries(docs.select(key.alias("key"))), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, code = bounds.value, encoder(tokenizer, end)
        for part, data, where in slices(batches, most=STEP_BYTES):
            ids, upto = code.encode(data, where)
            own, tie = (part.column(c).to_numpy() for c in ("doc_id", "tie"))
            # Boundaries at the row's own key are all its own: the hash says after how many of them it lies.
            low, high = np.searchsorted(splits, own, "left"), np.searchsorted(splits, own, "right")
            share = np.floor((tie.astype(np.float64) / 2.0**64 + 0.5) * (high - low)).astype(np.int64)
            shard = np.where(high > low, np.minimum(low + 1 + share, high), high)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((upto * code.kind.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), part.column("null"), part.column("doc_id"), part.column("tie"), pa.array(np.diff(upto)), packed],
                names=["shard", "null", "doc_id", "tie", "n_tokens", "ids"],
            )

    rows = small_batches(docs).select(key.alias("doc_id"), F.col("doc_id").isNull().alias("null"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    return rows.mapInArrow(run, "shard int, null boolean, doc_id long, tie long, n_tokens long, ids binary")


class _File:
    """A shard's file, from its first document to its head."""

    def __init__(self, folder: str, shard: int, width: int):
        self.shard, self.width, self.name = shard, width, f"{shard:06d}-{uuid.uuid4().hex}.ids"
        store, path = FileSystem.from_uri(f"{folder}/{self.name}")
        self.out = store.open_output_stream(path)
        self.out.write(MAGIC)
        self.sizes: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.nulls = 0

    def add(self, part: pa.RecordBatch) -> None:
        for ids in part.column("ids"):
            self.out.write(ids.as_buffer())
        null = part.column("null").to_numpy(zero_copy_only=False)
        self.nulls += int(null.sum())
        self.keys.append(part.column("doc_id").to_numpy()[~null])
        self.sizes.append(part.column("n_tokens").to_numpy())

    def close(self) -> tuple[int, str, int, int]:
        """(shard, name, documents, ids)."""
        ends, keys = np.cumsum(np.concatenate(self.sizes)), np.concatenate(self.keys)
        first = int(keys[0]) if len(keys) else 0
        codes = [EliasFano.of(ends.astype(np.uint64)), EliasFano.of(keys.astype(np.uint64) - np.array([first]).astype(np.uint64))]
        arrays = [p for c in codes for p in c.parts()]
        for a in arrays:
            self.out.write(a)
        head = json.dumps({"width": self.width, "documents": len(ends), "ids": int(ends[-1]), "nulls": self.nulls, "first": first, "codes": [[c.n, c.width] for c in codes], "arrays": [len(a) for a in arrays]}).encode()
        self.out.write(head + len(head).to_bytes(8, "little"))
        self.out.close()
        return self.shard, self.name, len(ends), int(ends[-1])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Files of ``docs`` in ``path``, a folder that all executors reach and where nothing is yet."""
    tokenizer = tokenizer or default_tokenizer()
    folder = _qualified(docs.sparkSession, path)
    width = Encoder(tokenizer, end).kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _File | None = None
        done = []
        for b in batches:
            shard = b.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), b.num_rows]
            for a, z in zip(edges, edges[1:], strict=False):
                if z > a:
                    if now is None or now.shard != shard[a]:
                        done += [now.close()] if now else []
                        now = _File(folder, int(shard[a]), width)
                    now.add(b.slice(a, z - a))
        done += [now.close()] if now else []
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "file", "documents", "ids"])

    docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    rows = encoded(docs, tokenizer, end).repartition("shard").sortWithinPartitions("shard", F.desc("null"), "doc_id", "tie")
    rows.mapInArrow(run, "shard int, file string, documents long, ids long").write.parquet(f"{path}/shards")


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its store, as executors know it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return "file://" + out[5:] if out.startswith("file:/") and not out.startswith("file://") else out


class Shard:
    """An open file: ends, doc_ids and ids of any of its documents."""

    def __init__(self, uri: str):
        store, path = FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        length = int.from_bytes(self._bytes(size - 8, 8), "little")
        self.head = json.loads(self._bytes(size - 8 - length, length))
        if self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no file of ids")
        at, arrays = len(MAGIC) + self.head["ids"] * self.head["width"], []
        for n in self.head["arrays"]:
            arrays.append(self._bytes(at, n))
            at += n
        (self.ends, self.keys) = (EliasFano.load(*self.head["codes"][k], arrays[3 * k : 3 * k + 3]) for k in (0, 1))

    def _bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def bounds(self, a: int, z: int) -> np.ndarray:
        """Where documents a to z - 1 begin in the id array, and where the last one ends."""
        return self.ends.select(np.arange(a - 1, z)) if a else np.concatenate([np.zeros(1, np.uint64), self.ends.select(np.arange(z))])

    def doc_ids(self, a: int, z: int) -> pa.Array:
        nulls = self.head["nulls"]
        keys = self.keys.select(np.arange(max(0, a - nulls), max(0, z - nulls))) + np.array([self.head["first"]]).astype(np.uint64)
        return pa.concat_arrays([pa.nulls(max(0, min(z, nulls) - a), pa.int64()), pa.array(keys.view(np.int64))])

    def ids(self, first: int, last: int) -> np.ndarray:
        width = self.head["width"]
        return np.frombuffer(self._bytes(len(MAGIC) + first * width, (last - first) * width), f"<u{width}")

    def steps(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about STEP_IDS ids."""
        a, n = 0, self.head["documents"]
        while a < n:
            z = min(n, a + 1024)
            bounds = self.bounds(a, z).astype(np.int64)
            while a < z:
                start = len(bounds) - 1 - (z - a)
                upto = max(start + 1, int(np.searchsorted(bounds, bounds[start] + STEP_IDS, "right")) - 1)
                yield a, a + upto - start
                a += upto - start


def read(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, in files' order within each partition.

    ``start`` is the number of ids of all documents before it.  ``ids`` is an array, or
    little-endian bytes, four for each id.
    """
    folder = _qualified(spark, path)
    shards = sorted(spark.read.parquet(f"{path}/shards").collect())  # a row a shard
    rows, before = [], 0
    for s in shards:
        rows.append((s.shard, s.file, before))
        before += s.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                shard = Shard(f"{folder}/{name}")
                for a, z in shard.steps():
                    at = shard.bounds(a, z).astype(np.int64)
                    ids, where = shard.ids(int(at[0]), int(at[-1])).astype("<u4"), (at - at[0]).astype(np.int32)
                    if as_bytes:
                        held = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(where * 4), pa.py_buffer(ids)])
                    else:
                        held = pa.ListArray.from_arrays(pa.array(where), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([shard.doc_ids(a, z), pa.array(at[:-1] + base), pa.array(np.diff(at)), held], names=["doc_id", "start", "n_tokens", "ids"])

    named = spark.createDataFrame(rows, "shard int, file string, base long")
    return named.repartitionById(max(1, len(rows)), "shard").mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {'binary' if as_bytes else 'array<int>'}")


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path)
    return read(spark, path, as_bytes=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
