"""The change feed as a stream: the last arrival of every key wins.

The state (the last change of every key) is a table of buckets by key, each a base and the deltas written since. A
batch writes only the keys that it changes, as one delta; a bucket is rewritten when its deltas hold as many rows as its
base, so a row is rewritten a number of times that grows with the logarithm of the state, not with the batches.
A manifest a version names the files that are live, and the last batch of the stream that is in them: a batch that comes
again, after a restart, is known and left out, and one that was cut off writes over what it left.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from leafmill.operators.snapshots import pending_changes

_BUCKET, _GONE, _MERGE = "__bucket", "__gone", "__merge"
_MANIFEST = "bucket int, base string, n_base long, deltas array<string>, n_deltas long"
_BATCH = -1  # the manifest's row that has the stream's last batch as n_base


def read_changes(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_changes(changes: DataFrame, key: str, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """One row per key with the values of its last change."""
    last = F.struct(*order)
    return changes.groupBy(key).agg(*[F.max_by(v, last).alias(v) for v in values])


@dataclass(frozen=True)
class ChangeState:
    """The last change of every ``key`` by ``order``, in the folder ``path`` of a shared file system.

    Null keys are one key. Of changes of equal order the one merged later stays, of one merge's any may. At most ``n_buckets`` rows of manifests pass
    through the driver; ``n_buckets`` should let a bucket's rows fit a task.
    """

    spark: SparkSession
    path: str
    key: str
    order: tuple[str, ...]
    schema: StructType
    n_buckets: int = 64
    max_deltas: int = 16

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ChangeState:
        """The state that stands in a folder."""
        told = json.loads(spark.read.text(f"{path.rstrip('/')}/settings").first()[0])
        return cls(spark, path, told["key"], tuple(told["order"]), StructType.fromJson(told["schema"]), told["n_buckets"], told["max_deltas"])

    def _describe(self) -> None:
        told = {"key": self.key, "order": self.order, "schema": self.schema.jsonValue(), "n_buckets": self.n_buckets, "max_deltas": self.max_deltas}
        self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path.rstrip('/')}/settings")

    @property
    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add(_GONE, "boolean").add(_MERGE, "long")

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path.rstrip('/')}/{kind}-{version:010d}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int")

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def manifest(self, version: int) -> dict[int, dict]:
        """By bucket, what is live in a version: base, n_base, deltas and n_deltas."""
        if version < 0:
            return {_BATCH: {"bucket": _BATCH, "base": None, "n_base": -1, "deltas": [], "n_deltas": 0}}
        return {r["bucket"]: r.asDict() for r in self.spark.read.schema(_MANIFEST).json(self._folder("manifest", version)).collect()}

    def version(self) -> int:
        """The last version whose manifest is whole; -1 without one."""
        system, place = self._files(f"{self.path.rstrip('/')}/manifest-*/_SUCCESS")
        return max((int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in system.globStatus(place) or ()), default=-1)

    def _read(self, live: dict[int, dict]) -> DataFrame:
        """The last row per key of the buckets of a manifest, keys that are gone included."""
        folders = [f"{folder}/{_BUCKET}={b}" for b, m in live.items() if b != _BATCH for folder in (*([m["base"]] if m["base"] else ()), *m["deltas"])]
        if not folders:
            return self.spark.createDataFrame([], self._stored)
        rest = [f.name for f in self._stored.fields if f.name != self.key]
        rows = self.spark.read.schema(self._stored).parquet(*folders)
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order, _MERGE)).alias("row")).select(self.key, "row.*").select(*self._stored.fieldNames())

    def read(self, version: int | None = None) -> DataFrame:
        """The state of a version (the last one). Versions before the last two have no files left."""
        return self._read(self.manifest(self.version() if version is None else version)).where(f"not {_GONE}").drop(_GONE, _MERGE)

    def _write(self, rows: DataFrame, folder: str) -> dict[int, int]:
        placed = rows.withColumn(_BUCKET, self._bucket())
        placed.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
        return {r[0]: r[1] for r in self.spark.read.schema(placed.schema).parquet(folder).groupBy(_BUCKET).count().collect()}

    def merge(self, changes: DataFrame, batch: int | None = None, gone: Column | None = None) -> None:
        """Take in changes: the last of each key becomes one delta; keys for whose last change ``gone`` holds end.

        ``batch`` is the stream's number of it; a number that the state has had already changes nothing.
        """
        last = self.version()
        before = self.manifest(last)
        if batch is not None and batch <= before[_BATCH]["n_base"]:
            return
        if last < 0:
            self._describe()
        rest = [f.name for f in self._stored.fields if f.name != self.key]
        marked = changes.withColumn(_GONE, F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).withColumn(_MERGE, F.lit(last + 1).cast("long"))
        newest = marked.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("row")).select(self.key, "row.*").select(*self._stored.fieldNames())
        delta = self._folder("delta", last + 1)
        live = {b: dict(m) for b, m in before.items()}
        for b, n in self._write(newest, delta).items():
            m = live.setdefault(b, {"bucket": b, "base": None, "n_base": 0, "deltas": [], "n_deltas": 0})
            m["deltas"], m["n_deltas"] = [*m["deltas"], delta], m["n_deltas"] + n
        full = {b: m for b, m in live.items() if b != _BATCH and m["deltas"] and (m["n_deltas"] >= m["n_base"] or len(m["deltas"]) > self.max_deltas)}
        if full:
            base = self._folder("base", last + 1)
            sizes = self._write(self._read(full).where(f"not {_GONE}"), base)
            for b, m in full.items():
                m |= {"base": base if b in sizes else None, "n_base": sizes.get(b, 0), "deltas": [], "n_deltas": 0}
        if batch is not None:
            live[_BATCH]["n_base"] = batch
        rows = [(m["bucket"], m["base"], m["n_base"], m["deltas"], m["n_deltas"]) for m in live.values()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(self._folder("manifest", last + 1))
        if last > 0:
            self._expire(last - 1, before, live)

    def _expire(self, version: int, *later: dict[int, dict]) -> None:
        """Delete a version's manifest, and the files that only it names."""
        names = lambda live: {f for m in live.values() for f in (m["base"], *m["deltas"]) if f}
        for folder in (names(self.manifest(version)) - set().union(*map(names, later))) | {self._folder("manifest", version)}:
            system, place = self._files(folder)
            system.delete(place, True)

    def prune(self, tree: DataFrame, version: str) -> None:
        """End the keys whose change the tree (key and version) holds, after a sync."""
        state = self.read()
        self.merge(state.join(pending_changes(state, tree, self.key, version).select(self.key), self.key, "left_anti"), None, F.lit(True))


def start_latest(changes: DataFrame, key: str, order: tuple[str, ...], path: str, checkpoint: str, tree: DataFrame | None = None, version: str | None = None, n_buckets: int = 64, every: str | None = None) -> StreamingQuery:
    """Merge each batch into the last change of every key, a ``ChangeState`` in ``path``, until the input is used up.

    With ``every`` (``3 seconds``) the input is polled for ever instead; a poll begins when the one before has ended.

    With ``tree`` (a batch table of key and version), a key ends whose last change it holds already, or that it
    lacks and that is trashed.
    """
    schema = changes.schema

    def merge(batch: DataFrame, number: int) -> None:
        gone = None
        if tree is not None:
            known = tree.select(F.col(key), F.col(version).alias("__version"))
            held = F.coalesce(F.col("__version") >= F.col(version), F.col("trashed"), F.lit(False))
            batch, gone = batch.join(known, key, "left").select(*schema.fieldNames(), held.alias("__held")), F.col("__held")
        ChangeState(batch.sparkSession, path, key, order, schema, n_buckets).merge(batch, number, gone)

    timing = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**timing).start()


def read_latest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The state of a version (the last one)."""
    return ChangeState.open(spark, path).read(version)


def sync_jobs(pending: DataFrame, drive: str, key: str) -> DataFrame:
    """drive and payload: one job per drive for all its pending keys, in order and joined by commas."""
    return pending.groupBy(drive).agg(F.array_join(F.transform(F.array_sort(F.collect_set(key)), lambda k: k.cast("string")), ",").alias("payload"))
