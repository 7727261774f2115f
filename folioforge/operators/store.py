"""Write-once stores in a folder: rows by the hash of their content, seen through snapshots.

A store's rows lie in Parquet files that are never written again, in folders by
the first digits of their hash.  A snapshot is a small file that lists the
writes that count; it is written under a
name that no other has and then takes effect by being renamed to its number,
which fails if that number is taken.  So a writer that dies before the rename
leaves the last snapshot as it was, and of two writers one has to try again.
The file system must rename folders at once, as HDFS and local ones do.

``append`` writes what no row of the current snapshot holds and nothing else.
``retain`` drops what is no longer wanted: the next snapshot marks the hashes
that are gone, whose rows may be appended again, and ``compact`` rewrites the
store without them.

Defined results: a row is known by its hash column; of rows with one hash the
first that came stays, of those that come together any; rows without a hash are
left out; an empty store has no snapshot and no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that name a folder.
PREFIX = 2


class Taken(RuntimeError):
    """Another writer has written the next snapshot meanwhile."""


class Store:
    """Rows of a fixed schema, with a hash column ``key``, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "hash"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def snapshots(self) -> list[int]:
        """Numbers of the snapshots, in order."""
        folder = self._path("snapshots")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def writes(self, snapshot: int | None = None) -> list[tuple[str, str]]:
        """(kind, write) of a snapshot, the last one unless told: the writes that count, rows or hashes that are gone."""
        numbers = self.snapshots()
        if not numbers:
            return []
        rows = self.spark.read.schema("kind string, write string").json(f"{self.path}/snapshots/{numbers[-1] if snapshot is None else snapshot}")
        return [tuple(r) for r in rows.select("kind", "write").collect()]

    def read(self, snapshot: int | None = None, prefixes: list[str] | None = None) -> DataFrame:
        """The rows of a snapshot; with ``prefixes`` only the folders of those hashes are read."""
        writes = self.writes(snapshot)
        out = self._rows([w for k, w in writes if k == "rows"], self.schema)
        gone = self._rows([w for k, w in writes if k == "gone"], f"{self.key} string")
        if prefixes is not None:
            out, gone = (x.where(F.col("prefix").isin(prefixes)) for x in (out, gone))
        if any(k == "gone" for k, _ in writes):  # a mark counts for the rows that were there before it
            marks = gone.groupBy(self.key).agg(F.max("_at").alias("_gone"))
            out = out.join(marks, self.key, "left").where("_gone is null or _gone < _at")
        return out.select(*self._columns())

    def _columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _rows(self, writes: list[str], schema: str) -> DataFrame:
        full = f"{schema}, _at int, write string, prefix string"
        paths = [f"{self.path}/rows/write={w}" for w in writes]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/rows").parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def _write(self, rows: DataFrame, number: int) -> str:
        """Write rows for the snapshot ``number`` in a folder of their own, by prefix; nothing reads it before a snapshot lists it."""
        name = uuid.uuid4().hex
        dealt = rows.withColumn("prefix", F.substring(self.key, 1, PREFIX)).withColumn("_at", F.lit(number))
        dealt.repartition("prefix").sortWithinPartitions(self.key).write.partitionBy("prefix").parquet(f"{self.path}/rows/write={name}")
        return name

    def _commit(self, number: int, writes: list[tuple[str, str]]) -> int:
        """Make ``writes`` the snapshot ``number``; raises ``Taken`` if there is one."""
        draft = f"drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(writes, "kind string, write string").coalesce(1).write.json(f"{self.path}/{draft}")
        self.fs.mkdirs(self._path("snapshots"))
        if self.fs.exists(self._path(f"snapshots/{number}")) or not self.fs.rename(self._path(draft), self._path(f"snapshots/{number}")):
            raise Taken(f"snapshot {number} of {self.path}")
        return number

    def append(self, rows: DataFrame) -> int:
        """Add the rows whose hash the store doesn't hold, each hash once; gives how many were written."""
        last = max(self.snapshots(), default=0)
        held = self.read(last or None).select(self.key)
        new = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(held, self.key, "left_anti").select(*self._columns())
        name = self._write(new, last + 1)
        n = self._rows([name], self.schema).count()
        if n:
            self._commit(last + 1, [*self.writes(last or None), ("rows", name)])
        return n

    def retain(self, wanted: DataFrame) -> int:
        """Drop the rows whose hash ``wanted`` doesn't hold; gives how many are gone. Files stay until ``compact``."""
        last = max(self.snapshots(), default=0)
        gone = self.read(last or None).select(self.key).join(wanted.select(self.key), self.key, "left_anti")
        name = self._write(gone, last + 1)
        n = self._rows([name], f"{self.key} string").count()
        if n:
            self._commit(last + 1, [*self.writes(last), ("gone", name)])
        return n

    def compact(self) -> int:
        """Rewrite the store as one write without what is gone; older snapshots and their files go."""
        last = max(self.snapshots(), default=0)
        if not last:
            return 0
        name = self._write(self.read(last), last + 1)
        number = self._commit(last + 1, [("rows", name)])
        for old in self.snapshots()[:-1]:
            self.fs.delete(self._path(f"snapshots/{old}"), True)
        for s in self.fs.listStatus(self._path("rows")):
            if s.getPath().getName() != f"write={name}":
                self.fs.delete(s.getPath(), True)
        return number


def cached(store: Store, texts: DataFrame, make, text: str = "text") -> DataFrame:
    """``texts`` with the columns that ``make`` gives for each distinct text: made for texts that the store doesn't hold, read for the others.

    ``make`` takes (hash, text), one row a text, and gives the store's columns.
    Texts that are no longer there are dropped from the next snapshot on.
    """
    keyed = texts.withColumn(store.key, F.sha2(F.col(text), 256))
    each = keyed.where(F.col(text).isNotNull()).select(store.key, F.col(text).alias("text")).dropDuplicates([store.key])
    held = store.read().select(store.key)
    store.append(make(each.join(held, store.key, "left_anti")))
    store.retain(each)
    return keyed.join(store.read(), store.key, "left").drop(store.key)
