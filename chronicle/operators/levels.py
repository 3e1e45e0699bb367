"""A keyed table of Parquet runs: small upserts stay small, and rows are found by key without reading the rest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

GONE, BUCKET, PART = "_gone", "_bucket", "_part"


def first_to_merge(rows: list[int]) -> int | None:
    """The oldest of the runs, given by their rows from old to new, that the newer ones together have reached; None if each is larger.

    Merging from there on leaves every run with more rows than all newer ones together, so
    there are about log2(rows) runs, and a run is written again only when what came after it
    has grown as large as it is.
    """
    newer, found = 0, None
    for k in range(len(rows) - 1, -1, -1):
        if k < len(rows) - 1 and newer >= rows[k]:
            found = k
        newer += rows[k]
    return found


def observed(seen: Observation, name: str) -> int:
    """A count that ``seen`` made; none was made where a plan turned out to have no rows while it ran."""
    try:
        return seen.get.get(name, 0)
    except Py4JJavaError:
        return 0


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the tables under ``path``."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(of(path)) if fs.exists(of(path)) else []
    return sorted(s.getPath().getName() for s in found if fs.exists(of(f"{path}/{s.getPath().getName()}/_log")))


class LevelledTable:
    """Rows of a fixed schema by key, in runs that a log names from old to new; the newest run that has a key has its row.

    A commit adds one run of its own rows and of marks for keys that are gone.  Runs merge
    among themselves by ``first_to_merge``; marks end in the oldest run.  A run is dealt into
    buckets by a hash of the key, a power of two by its size, one folder each, so a key is
    looked for in one bucket of each run, with a Bloom filter of the key in every file.  Files
    are sorted by ``sort``, so that their statistics let a range of it skip the others.

    A log entry is a file written under another name and renamed to the next number, which
    fails if that number is there already: a stop at any moment leaves the table of the
    entry before, and the later one of two writers gets an error.  Stores whose rename is not
    atomic need one writer at a time.
    """

    #: Rows that a bucket should have, and buckets of a run of unknown size.
    BUCKET_ROWS, NEW_BUCKETS = 1_000_000, 4
    #: Buckets that are named in a filter; with more, all are read.
    MOST_NAMED = 4096

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", order: str | None = None, parts: tuple[str, ...] = (), sort: tuple[str, ...] = ()):
        self.spark, self.path, self.key, self.order, self.parts, self.sort = spark, path.rstrip("/"), key, order, parts, sort
        self.schema = schema
        self.columns = [c.name for c in spark.createDataFrame([], schema).schema]
        self._of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._of(self.path).getFileSystem(self._conf)

    # The log

    def _log(self) -> list[int]:
        folder = self._of(f"{self.path}/_log")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _state(self) -> tuple[int, list[dict]]:
        """The number of the last log entry and the runs that it names; without one the table is empty."""
        numbers = self._log()
        if not numbers:
            return 0, []
        lines = self.spark.read.text(f"{self.path}/_log/{numbers[-1]:010d}").collect()  # one line
        return numbers[-1], json.loads(lines[0].value)["runs"]

    def _commit(self, number: int, runs: list[dict]) -> None:
        jvm = self.spark.sparkContext._jvm
        draft, entry = (self._fs.makeQualified(self._of(f"{self.path}/_log/{n}")) for n in (f"draft-{uuid.uuid4().hex}", f"{number:010d}"))
        out = self._fs.create(draft, False)
        out.write(bytearray((json.dumps({"runs": runs}) + "\n").encode()))
        out.close()
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri(), self._conf).rename(draft, entry, keep)
        except Exception as e:
            if not self._fs.exists(entry):
                raise
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer made entry {number} of {self.path}") from e

    def exists(self) -> bool:
        return bool(self._log())

    def create(self) -> None:
        """Make the empty table."""
        self._commit(1, [])

    # Runs

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _buckets(self, rows: int) -> int:
        return 1 << max(0, (rows // self.BUCKET_ROWS)).bit_length()

    def _run(self, run: dict) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {GONE} boolean, {BUCKET} int").parquet(f"{self.path}/{run['folder']}")

    def _write(self, rows: DataFrame, expected: int | None = None, pick: Callable[[DataFrame, tuple[str, ...]], DataFrame] | None = None) -> dict:
        """``rows`` as a run that no log entry names yet; with ``pick``, which leaves each key once, after they were dealt, so that they move once."""
        name, seen = f"run-{uuid.uuid4().hex}", Observation()
        buckets = self.NEW_BUCKETS if expected is None else self._buckets(expected)
        # A bucket of a large run goes to several tasks.
        dealt = rows.withColumn(BUCKET, self.bucket(buckets)).withColumn(PART, F.pmod(F.xxhash64(F.lit("part"), self.key), F.lit(16))).repartition(BUCKET, PART)
        if pick:
            dealt = pick(dealt, (BUCKET, PART))
        dealt = dealt.drop(PART).observe(seen, F.count(F.lit(1)).alias("rows"))
        sorted_ = dealt.sortWithinPartitions(BUCKET, *self.parts, *self.sort)
        sorted_.write.partitionBy(BUCKET, *self.parts).option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.path}/{name}")
        return {"folder": name, "rows": observed(seen, "rows"), "buckets": buckets}

    def _newest(self, runs: list[DataFrame]) -> DataFrame:
        """The row, or the mark, of each key in the newest run that has it."""
        return runs[0] if len(runs) == 1 else self._first(self._all(runs))

    def _all(self, runs: list[DataFrame]) -> DataFrame:
        both = None
        for number, rows in enumerate(runs):
            rows = rows.withColumn("_run", F.lit(number))
            both = rows if both is None else both.unionByName(rows)
        return both

    def _first(self, both: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*dealt, self.key).orderBy(F.desc("_run")))
        return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_run")

    def _held(self, rows: DataFrame) -> DataFrame:
        return rows.where(f"NOT {GONE}").select(*self.columns)

    def read(self) -> DataFrame:
        """All rows: the oldest run without the keys of newer ones, and the newest rows of those."""
        _, runs = self._state()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        oldest = self._run(runs[0])
        if len(runs) == 1:
            return self._held(oldest)
        newer = self._newest([self._run(r) for r in runs[1:]])
        return self._held(oldest.join(newer.select(self.key), self.key, "left_anti")).unionByName(self._held(newer))

    def lookup(self, value: str) -> DataFrame:
        """The row of one key: one bucket of each run is read."""
        _, runs = self._state()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        wanted = F.lit(value)
        parts = [self._run(r).where((F.col(BUCKET) == F.pmod(F.xxhash64(wanted), F.lit(r["buckets"])).cast("int")) & (F.col(self.key) == wanted)) for r in runs]
        return self._held(self._newest(parts))

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (a column named as the key), from the buckets that these lie in."""
        _, runs = self._state()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        wanted = keys.select(self.key).distinct()
        most = max(r["buckets"] for r in runs)
        held = [r[0] for r in wanted.select(self.bucket(most)).distinct().collect()] if most <= self.MOST_NAMED else None  # a number a bucket
        parts = []
        for r in runs:
            rows = self._run(r)
            named = set() if held is None else {b % r["buckets"] for b in held}
            if held is not None and len(named) < r["buckets"]:
                rows = rows.where(F.col(BUCKET).isin(sorted(named)) if named else F.lit(False))
            parts.append(rows.join(wanted, self.key, "left_semi"))
        return self._held(self._newest(parts))

    # Changes

    def latest(self, rows: DataFrame) -> DataFrame:
        """Of the rows of a key the last by the table's order; of equal ones that of the greatest content hash."""
        ties = [F.desc("content_sha")] if "content_sha" in rows.columns else []
        last = [F.desc(self.order)] if self.order else []
        rank = F.row_number().over(Window.partitionBy(self.key).orderBy(F.asc(GONE), *last, *ties))
        return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

    def apply(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Put ``rows`` and take away the keys of ``gone``, in one commit; a key in both is put.  How many rows were given."""
        number, runs = self._state()
        seen, change = Observation(), None
        if rows is not None:
            change = rows.select(*self.columns).observe(seen, F.count(F.lit(1)).alias("given")).withColumn(GONE, F.lit(False))
        if gone is not None:
            marks = gone.select(self.key).distinct().withColumn(GONE, F.lit(True))
            change = marks.select(*[F.col(c) if c == self.key else F.lit(None).cast(t.dataType).alias(c) for c, t in zip(self.columns, self.spark.createDataFrame([], self.schema).schema, strict=True)], GONE) if change is None else change.unionByName(marks, allowMissingColumns=True)
        run = self._write(self.latest(change))
        if run["rows"]:
            self._commit(number + 1, [*runs, run])
            self.settle()
        return observed(seen, "given") if rows is not None else 0

    def add(self, rows: DataFrame) -> int:
        """Upsert; the number of rows given, not of distinct keys.  The rows are evaluated once."""
        return self.apply(rows)

    def delete(self, keys: DataFrame) -> None:
        self.apply(gone=keys)

    def replace(self, rows: DataFrame, expected: int | None = None) -> None:
        """Make ``rows``, which have each key once, the whole table; ``expected`` is about their number, for buckets of the right size."""
        number, _ = self._state()
        self._commit(number + 1, [self._write(rows.select(*self.columns).withColumn(GONE, F.lit(False)), expected)])
        self.settle()

    def settle(self) -> None:
        """Merge the newest runs if that is due, and deal a run anew that has far too few buckets."""
        number, runs = self._state()
        start = first_to_merge([r["rows"] for r in runs])
        if start is None and runs and runs[-1]["rows"] > 2 * self.BUCKET_ROWS * runs[-1]["buckets"]:
            start = len(runs) - 1
        if start is None:
            return

        def pick(rows: DataFrame, dealt: tuple[str, ...]) -> DataFrame:
            rows = self._first(rows, dealt)
            return rows.where(f"NOT {GONE}") if start == 0 else rows

        run = self._write(self._all([self._run(r) for r in runs[start:]]).drop(BUCKET), sum(r["rows"] for r in runs[start:]), pick)
        try:
            self._commit(number + 1, [*runs[:start], run])
        except RuntimeError:
            pass  # another writer was first; its runs are settled with its own commits

    def vacuum(self, older_than_hours: float = 24.0) -> int:
        """Delete the folders that the last log entry does not name and that are older; the number deleted.

        Younger ones may be a writer's that has not committed yet, or in use by a reader.
        """
        _, runs = self._state()
        kept = {r["folder"] for r in runs} | {"_log"}
        limit = (time.time() - older_than_hours * 3600) * 1000
        found = self._fs.listStatus(self._of(self.path)) if self._fs.exists(self._of(self.path)) else []
        old = [s.getPath() for s in found if s.getPath().getName() not in kept and s.getModificationTime() <= limit]
        for path in old:
            self._fs.delete(path, True)
        return len(old)
