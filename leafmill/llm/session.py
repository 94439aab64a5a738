"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all runs on one machine (tests, a laptop) is a local one made and set.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if named is None:
        named = context.getCheckpointDir() or tempfile.mkdtemp(prefix="leafmill-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Within it, Spark deletes the shuffle files of a job when the job has ended; for jobs whose result is cut or written,
    so that nothing needs them again."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before) if before else spark.conf.unset(_DROP_SHUFFLES)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that an operator writes and reads again."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of a loop in the shared folder. Unlike a checkpoint, a table's size is known to the planner by its files,
    not as a product of the sizes of all joins before it, whose digits double in each round."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame) -> DataFrame:
        """``df``, written and to be read again."""
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path, table
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for table in tables:
            drop_scratch(self.spark, self.paths.pop(id(table))[0])


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver process was started."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)


def in_slices(run, rows: int = 512):
    """``run`` over slices of its Arrow batches, so that Python holds the texts of one slice and not of a batch."""

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return lambda batches: run(sliced(batches))


def held_out(doc_id: str = "doc_id"):
    """True for the documents whose labels no model may see."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == F.lit(HELD_OUT_REMAINDER)
