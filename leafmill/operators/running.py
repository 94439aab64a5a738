"""Checkpoints and tables for loops, and running sums and last values in groups of any size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; on a single machine a temporary one if it names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None and not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = named or context.getCheckpointDir() or tempfile.mkdtemp(prefix="leafmill-checkpoint-")  # one machine: any folder is shared
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df``, materialised in the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Rounds:
    """Tables of a loop in the shared folder. The planner knows a table's size by its files; that of a checkpoint is the
    product of the sizes of all joins before it, whose digits double in each round."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        """``df``, written and to be read again."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path, table
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a task that sorts or groups them.
PART_ROWS = 400_000


def parts_of(df: DataFrame) -> int:
    """How many partitions keep the rows of a task at PART_ROWS, whatever the input's size; few for a small one.

    The planner's own choice goes by compressed bytes and a set number of partitions, so a task would grow with the input.
    """
    n = df.count()
    return 1 + max(n // PART_ROWS, min(df.sparkSession.sparkContext.defaultParallelism, n // 20_000))


def _over_ranges(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: dict[str, Column], whole: Callable[[str], Column], upto: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """A running aggregate by ranges of (keys, order): ``whole`` aggregates a column, ``join`` puts what earlier ranges
    of the group hold before what the range holds up to ``upto`` rows from the row."""
    number = {name: f"__value{i}" for i, name in enumerate(values)}
    parts = parts_of(df)
    dealt = cut(df.select("*", *[values[n].alias(c) for n, c in number.items()]).repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()))
    ordered = F.struct(*order)
    in_range = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), ordered)) if whole is last_value else whole(c)
    summed = dealt.repartitionById(parts, F.col("__part")).groupBy(*keys, "__part").agg(*[in_range(c).alias(c) for c in number.values()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    by_group = summed.repartition(parts, *keys) if keys else summed
    offsets = by_group.select(*keys, "__part", *[whole(c).over(before).alias(f"__before{c}") for c in number.values()])
    # what earlier ranges hold comes as the first row of the range, so no join is needed
    both = dealt.withColumn("__real", F.lit(1)).unionByName(offsets.withColumn("__real", F.lit(0)), allowMissingColumns=True).repartitionById(parts, F.col("__part"))
    inside = Window.partitionBy(*keys, "__part").orderBy("__real", *order).rowsBetween(Window.unboundedPreceding, upto)
    found = [(n, F.first(f"__before{c}").over(inside).alias(f"__first{c}"), whole(c).over(inside).alias(f"__inside{c}")) for n, c in number.items()]
    rows = both.select("__real", *df.columns, *[c for _, first, own in found for c in (first, own)]).where("__real = 1")
    return rows.select(*df.columns, *[join(F.col(f"__first{c}"), F.col(f"__inside{c}")).alias(n) for n, c in number.items()])


def last_value(name: str) -> Column:
    """The last value that isn't null."""
    return F.last(name, ignorenulls=True)


def running_sums(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: dict[str, Column]) -> DataFrame:
    """The rows with one more column per value: its sum over the rows of the group up to the row, itself included.

    Rows are dealt by ranges of (keys, order) and summed inside their range; what earlier ranges of the group hold
    is added from a table of one row per group and range. So a group is spread over as many tasks as its size
    asks for. The order must be unique inside a group. Nulls among keys and order count as values.
    """
    return _over_ranges(df, keys, order, values, F.sum, 0, lambda before, inside: F.coalesce(before, F.lit(0)) + inside)


def running_last(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: dict[str, Column], own: bool = False) -> DataFrame:
    """The rows with one more column per value: its last value that isn't null in the rows of the group before the row
    (up to it with ``own``). Dealt as for ``running_sums``."""
    return _over_ranges(df, keys, order, values, last_value, 0 if own else -1, lambda before, inside: F.coalesce(inside, before))


def running_sum(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, keys, order, {name: value})
