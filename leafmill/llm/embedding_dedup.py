"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

Vectors are normalised, so cosine similarity s is Euclidean distance ``sqrt(2 - 2 s)``. A table hashes a
vector by k quantised Gaussian projections ``floor((a x + b) / w)``; k grows with the logarithm of the
number of vectors, so that unrelated vectors seldom meet, and the number of tables follows from the
wanted probability that a pair just at the bound meets in at least one table (pairs above it meet
more often).

Equal vectors are one class from the start. Classes that share a bucket are compared in double precision
inside cells of at most two blocks: a bucket of any size is split into blocks of about ``block`` classes,
and each pair of blocks is one cell, so no task gathers a bucket. A pair that meets in several tables
belongs to the first of them, hence counts of links need no shuffle of pairs. A cell reports per class the
links it found and one spanning edge, never the pairs.

What is known of a class goes back to the rows by a hash of the vector, with the vectors compared. Classes of over
a ``HEAVY_PARTS``-th of all rows are broadcast for that, so no task gathers the copies of one vector.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths; equal vectors link with each other; repeated ids are vectors of their own; a null
id links with nothing; an empty table gives an empty result; columns other than the id and the vector are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.components import connected_components
from leafmill.llm.session import cut, ship_package


#: A class of over one such part of all rows is broadcast when it goes back to the rows: fewer than so many classes.
HEAVY_PARTS = 1000


@dataclass(frozen=True)
class PStableSettings:
    similarity: float = 0.95
    width: float = 2.0
    recall_at_bound: float = 0.995
    chance_mates: float = 0.25
    block: int = 1024
    seed: int = 20_240_501

    def agree(self, distance: float) -> float:
        """Probability that one quantised projection agrees for two vectors at a distance."""
        if distance <= 0:
            return 1.0
        c = self.width / distance
        below = 0.5 * math.erfc(c / math.sqrt(2))
        return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))

    def shape(self, n: int) -> tuple[int, int]:
        """Projections of a table, and tables, for n vectors."""
        far, near = self.agree(math.sqrt(2)), self.agree(math.sqrt(2 - 2 * self.similarity))
        k = max(1, math.ceil(math.log(max(n, 2) / self.chance_mates) / -math.log(far)))
        return k, max(1, math.ceil(math.log(1 - self.recall_at_bound) / math.log(1 - near**k)))


def _hash_vectors(settings: PStableSettings, k: int, tables: int):
    def run(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mixers = np.random.default_rng(settings.seed).integers(1, 1 << 62, k, dtype=np.int64) | 1
        for batch in batches:
            column = batch.column("vector")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lengths)])
            signs, dims = np.zeros((len(column), tables), dtype=np.int32), np.zeros(len(column), dtype=np.int32)
            data: list[bytes] = [b""] * len(column)
            for dim in np.unique(lengths):
                if dim not in planes:
                    rng = np.random.default_rng([settings.seed, int(dim)])
                    planes[dim] = rng.standard_normal((int(dim), k * tables)), rng.uniform(0, settings.width, k * tables)
                rows = np.flatnonzero(lengths == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                for r, vector in zip(rows.tolist(), x, strict=True):
                    data[r] = vector.tobytes()
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                a, b = planes[dim]
                cells = np.floor((x @ a + b) / settings.width).astype(np.int64).reshape(len(rows), tables, k)
                hashed = (cells * mixers).sum(axis=2) + int(dim) * 1_000_003
                signs[rows] = ((hashed ^ (hashed >> 31)) * 0x7FB5D329728EA185 >> 32).astype(np.int32)
                dims[rows] = dim
            signs_column = pa.array(list(signs), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.array(dims), pa.array(data, pa.binary()), signs_column], names=["node", "size", "dim", "vector", "signs"])

    return run


class _Cell:
    """Rows of one cell: all pairs across its two blocks (or inside its one block)."""

    def __init__(self, settings: PStableSettings):
        self.settings = settings

    def links(self, table: int, block: np.ndarray, node: np.ndarray, size: np.ndarray, x: np.ndarray, signs: np.ndarray):
        """Per row: weighted links found here, and the smallest node of its component here."""
        left = np.flatnonzero(block == block.min())
        right = np.flatnonzero(block == block.max())
        mask = x[left] @ x[right].T >= self.settings.similarity
        if block.min() == block.max():
            np.fill_diagonal(mask, False)
        for t in range(table):
            if not mask.any():
                return None
            mask &= signs[left, t][:, None] != signs[right, t][None, :]
        if not mask.any():
            return None
        weighted = np.zeros(len(node), dtype=np.int64)
        np.add.at(weighted, left, mask @ size[right])
        if block.min() != block.max():
            np.add.at(weighted, right, size[left] @ mask)
        label = node.copy()
        while True:  # label propagation inside the cell
            before = label.copy()
            for rows, columns, m in ((left, right, mask), (right, left, mask.T)):
                linked = m.any(axis=1)
                lowest = np.where(m[linked], label[columns][None, :], np.iinfo(np.int64).max).min(axis=1) if linked.any() else np.zeros(0, np.int64)
                np.minimum.at(label, rows[linked], lowest)
            if (label == before).all():
                return weighted, label


def _compare_cells(settings: PStableSettings):
    def run(batches):
        cell = _Cell(settings)
        waiting: list[pa.RecordBatch] = []

        def finish(rows: pa.Table) -> pa.RecordBatch:
            column = {c: rows.column(c).to_numpy() for c in ("node", "size", "table", "bucket", "low", "high", "block")}
            vectors, signs = rows.column("vector").to_pylist(), np.stack(rows.column("signs").to_numpy()) if len(rows) else np.zeros((0, 1))
            key = np.stack([column[c].astype(np.int64) for c in ("table", "bucket", "low", "high")])
            bounds = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(rows)]
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                x = np.frombuffer(b"".join(vectors[a:b]), np.float64).reshape(b - a, -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                found = cell.links(int(column["table"][a]), column["block"][a:b], column["node"][a:b], column["size"][a:b], x, signs[a:b])
                if found is not None:
                    some = found[0] > 0
                    out.append((column["node"][a:b][some], found[0][some], found[1][some]))
            merged = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in merged], names=["node", "links", "label"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            last = [batch.column(c)[-1] for c in ("table", "bucket", "low", "high")]
            if [waiting[0].column(c)[0] for c in ("table", "bucket", "low", "high")] == last:
                continue  # one cell so far
            rows = pa.Table.from_batches(waiting)
            same = np.ones(len(rows), dtype=bool)
            for c, value in zip(("table", "bucket", "low", "high"), last, strict=True):
                same &= rows.column(c).to_numpy() == value.as_py()
            done = int(np.flatnonzero(~same)[-1]) + 1
            yield finish(rows.slice(0, done))
            waiting = rows.slice(done).combine_chunks().to_batches()
        if waiting:
            yield finish(pa.Table.from_batches(waiting))

    return run


def _vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct usable vectors: node (a number of its own), first (smallest id), size and vector."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = _vectors(vectors, id_col, vector_col).where("vec_id is not null")
    classes = rows.where(usable).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"))
    return cut(classes.withColumn("node", F.monotonically_increasing_id()))  # numbers hold once they are written


def embedding_near_duplicates(vectors: DataFrame, settings: PStableSettings = PStableSettings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable) and kept."""
    ship_package(vectors.sparkSession)
    classes = vector_classes(vectors, id_col, vector_col)
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    k, tables = settings.shape(n_classes)
    hashed = cut(classes.select("node", "size", "vector").mapInArrow(_hash_vectors(settings, k, tables), "node long, size long, dim int, vector binary, signs array<int>"))
    # the length is part of a bucket, so vectors of different lengths never share one
    buckets = hashed.select("node", "dim", F.posexplode("signs").alias("table", "sign")).select("node", "table", (F.col("dim").cast("long") * (1 << 32) + F.col("sign")).alias("bucket"))
    shared = buckets.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = buckets.join(shared, ["table", "bucket"])
    blocks = met.withColumn("blocks", F.ceil(F.col("n") / settings.block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("table", "bucket", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = cells.join(hashed, "node").repartition("table", "bucket", "low", "high").sortWithinPartitions("table", "bucket", "low", "high")
    columns = ["table", "bucket", "low", "high", "block", "node", "size", "vector", "signs"]
    found = cut(full.select(*columns).mapInArrow(_compare_cells(settings), "node long, links long, label long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("label <> node").select(F.col("node").alias("u"), F.col("label").alias("v")))
    # written first, as a join with an aggregate's own output could not be split for a component of many nodes
    first = cut(components.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id")))
    named = components.join(first, "component").select("node", "component_id")
    known = classes.join(links, "node", "left").join(named, "node", "left")
    known = known.select("vector", "size", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")).where("n_links > 0")
    known = cut(known.withColumn("hash", F.xxhash64("vector")))
    rows = _vectors(vectors, id_col, vector_col).withColumn("hash", F.xxhash64("vector")).withColumn("named", F.col("vec_id").isNotNull())
    least = n_rows // HEAVY_PARTS + 1
    heavy = F.broadcast(known.where(F.col("size") >= least).select(F.col("hash").alias("h"), F.col("vector").alias("v"), F.col("n_links").alias("heavy_links"), F.col("component_id").alias("heavy_id")))
    some = rows.join(heavy, F.col("named") & (F.col("hash") == F.col("h")) & (F.col("vector") == F.col("v")), "left")
    done = some.where("heavy_links is not null").select("vec_id", F.col("heavy_links").alias("n_links"), F.col("heavy_id").alias("component_id"))
    light = known.where(F.col("size") < least).select(F.col("hash").alias("h2"), F.col("vector").alias("v2"), "n_links", "component_id")
    rest = some.where("heavy_links is null").select("vec_id", "vector", "hash", "named").join(light, F.col("named") & (F.col("hash") == F.col("h2")) & (F.col("vector") == F.col("v2")), "left")
    joined = done.unionByName(rest.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
    return joined.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
