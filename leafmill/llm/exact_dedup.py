"""Exact dedup by an extendible-hash index on shared files, with DataFrame functions only.

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.

1. One scan turns each row into an entry: a 64-bit key of the normalised text, its SHA-256 and the row's id.
   Texts are not written.
2. A histogram of key prefixes drives the directory of an extendible hash: it doubles until no bucket is over its
   capacity, and buckets that need no split share directory cells. Entries, counted by key, are written to the
   shared folder by bucket; each owner task has a range of buckets, in the order of their keys.
3. Keys with one entry are done. The entries of a key with more form a chain, and only their texts are read
   again. The index finds these candidates; texts of one chain are told apart by grouping on the normalised bytes
   themselves, which decide what is equal. Spark deals the groups by bucket, key and bytes, so the texts of a bucket
   may be compared by several tasks. Copies are combined before they are sent, so a group of any size costs one text
   a task.
4. The classes so found go back to the rows. Classes with over a 100,000th of all rows, of which there are fewer
   than 100,000, are broadcast, so no task gathers the copies of one text.

Cases: null text counts as empty, and all such rows are one group; ties on length go to the smallest
id, then to no id; repeated ids are rows of their own within their group; an empty table gives an empty result;
columns other than the id and the text are ignored, whatever their names; very long texts are compared whole.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import cut, drop_scratch, scratch_path

BUCKET_CAPACITY = 100_000
MAX_DEPTH = 16
#: Bound of the broadcast side when texts of chained keys are looked up: 8 bytes a key, 16 MB in all.
BROADCAST_KEYS = 2_000_000
#: A class with over one such part of all rows is broadcast: fewer than so many classes, of about 100 bytes each.
HEAVY_PARTS = 100_000


def normalised(text: Column) -> Column:
    """The text without spaces and the control characters from tab to carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def index_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One entry per row: id, key and digest."""
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return base.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256"))


def grow_directory(prefix_counts: dict[int, int], capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> list[int]:
    """Bucket numbers of the cells of an extendible-hash directory, by doubling.

    ``prefix_counts`` counts entries by the first ``max_depth`` bits of their keys; sums of ranges of prefixes come
    from running sums. A bucket over its capacity is split by its next bit; where that bit is beyond the
    directory's depth, the directory doubles. A bucket of a single prefix stays overfull: its keys chain.
    """
    sums = list(accumulate((prefix_counts.get(p, 0) for p in range(1 << max_depth)), initial=0))
    leaves: list[tuple[int, int]] = []  # (first prefix, bits that are fixed), in order of prefixes
    todo = [(0, 0)]
    while todo:
        first, bits = todo.pop()
        width = 1 << (max_depth - bits)
        if bits < max_depth and sums[first + width] - sums[first] > capacity:
            todo += [(first + width // 2, bits + 1), (first, bits + 1)]
        else:
            leaves.append((first, bits))
    depth = max(bits for _, bits in leaves)
    return [bucket for bucket, (_, bits) in enumerate(leaves) for _ in range(1 << (depth - bits))]


def build_index(entries: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, Column, str]:
    """The index (bucket, key, n_rows) on shared files, the bucket of a ``key`` as an expression, and the files' path."""
    spark = entries.sparkSession
    keys = cut(entries.groupBy("key").agg(F.count("*").alias("n_rows")))
    prefix = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    histogram = keys.groupBy(prefix.alias("prefix")).count().collect()  # at most 2 ** max_depth counts
    directory = grow_directory({r["prefix"]: r["count"] for r in histogram}, capacity, max_depth)
    depth = (len(directory) - 1).bit_length()
    cell = F.shiftrightunsigned("key", 64 - depth).cast("int") + 1 if depth else F.lit(1)
    cells = F.split(F.lit(",".join(map(str, directory))), ",").cast("array<int>")  # folds to one literal of at most 2 ** max_depth ints
    bucket = F.element_at(cells, cell)
    path = scratch_path(spark, "exact-index")
    placed = keys.withColumn("bucket", bucket)
    placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key").write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path), bucket, path


def compare_chains(docs: DataFrame, index: DataFrame, bucket: Column, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per distinct text under the keys of several rows: key, text_sha256, keep_id and group_size.

    Texts are grouped by bucket, key and their normalised bytes. The row of the most code points stays.
    """
    chained = index.where("n_rows > 1").select("key")
    if chained.limit(broadcast_keys + 1).count() <= broadcast_keys:
        chained = F.broadcast(chained)
    n_points = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    texts = docs.select(F.col(id_col).alias("doc_id"), n_points.alias("n_points"), normalised(F.col(text_col)).alias("norm")).withColumn("key", F.xxhash64("norm"))
    best = F.struct("n_points", F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("small"), "doc_id")
    owned = texts.join(chained, "key", "left_semi").withColumn("bucket", bucket).groupBy("bucket", "key", "norm").agg(F.count("*").alias("group_size"), F.max(best).alias("best"))
    return owned.select("key", F.sha2("norm", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and text_sha256.

    The row with the most code points in its original text stays, then the one with the smallest id.
    Rows that repeat the id of the row that stays are kept with it. Two texts of different bytes under
    one SHA-256 end the job: no answer is better than a merged one.
    """
    entries = cut(index_entries(docs, id_col, text_col))
    index, bucket, path = build_index(entries, capacity)
    classes = cut(compare_chains(docs, index, bucket, id_col, text_col))
    drop_scratch(docs.sparkSession, path)
    clashes = classes.groupBy("key", "text_sha256").count().where("count > 1").limit(1).collect()
    if clashes:
        raise RuntimeError(f"two texts of different bytes share SHA-256 {clashes[0]['text_sha256']}")
    least = entries.count() // HEAVY_PARTS + 1
    heavy = F.broadcast(classes.where(F.col("group_size") >= least).select("key", "text_sha256", F.col("keep_id").alias("heavy_id"), F.col("group_size").alias("heavy_size")))
    some = entries.join(heavy, ["key", "text_sha256"], "left")
    done = some.where("heavy_size is not null").select("doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"), "text_sha256")
    rest = some.where("heavy_size is null").join(classes.where(F.col("group_size") < least), ["key", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    rest = rest.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256")
    return done.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
