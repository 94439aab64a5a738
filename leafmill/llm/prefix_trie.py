"""Prefix trie of conversations, by prefix-doubling names.

1. Turns are numbered by running sums over ranges, so a conversation of any length is spread over tasks. A turn is
   known by the SHA-256 of its role and text from then on.
2. Upward rounds name blocks of 1, 2, 4, ... turns that start at a multiple of their length: equal blocks of a level
   get one dense number. A block's key is the pair of the names of its halves.
3. Downward rounds compose the names of prefixes by the binary digits of their lengths: a prefix whose length is an
   odd multiple of 2**k is the pair of the prefix without its last 2**k turns and the block of those turns. Each
   level names at most as many rows as it has blocks, so both directions handle twice the turns in all.
4. Rows with one prefix name are the members of one node. A node's smallest member stands for it, so sums over a
   subtree are sums over suffixes of conversations: what a node adds once is counted in the row of that member.

A node many conversations share is pre-aggregated or joined through shuffles that adaptive execution can split;
nothing gathers the members of a node. The digest of the members that end at a node reads them in order, in chunks
made by range tasks.

Cases: null role or text counts as empty; turns are ordered with null first, then by the digest of role and text;
rows without conv_id belong to no conversation and are left out; repeated rows are turns of their own; an empty table
has no node, not even a root; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import Scratch, cut, ship_package
from leafmill.operators.running import running_sum, running_sums

#: The first turns of a conversation whose id is a multiple of FAMILY are those of the others; at most HEADS - 1 turns.
FAMILY = 5
HEADS = 9
#: Ids joined into one text before they are digested.
CHUNK_IDS = 1024
_ROW_BITS = 33  # of monotonically_increasing_id


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), digest and n_bytes of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    placed = running_sum(rows, ("conv_id",), ("turn", "digest", "row"), F.lit(1).cast("long"), "place")
    return cut(placed.select("conv_id", (F.col("place") - 1).alias("at"), "digest", "n_bytes"))


def conversation_lengths(turns: DataFrame) -> DataFrame:
    """conv_id and length."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation c got the first h turns of c - c % 5 for its own first h.

    h is the unsigned CRC-32 of the decimal id modulo 9. Remainders of negative ids are negative, as in SQL.
    """
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS - 1))
    heads = heads.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "n_bytes"))).alias("head"))  # at most 8
    own = conversation_lengths(turns).select("conv_id", "length", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("h"))
    plan = own.join(heads, "family", "left").withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h"))))
    plan = cut(plan.select("conv_id", "length", "h", "head", F.coalesce(F.size("head"), F.lit(0)).alias("lent")))
    lent = plan.where("lent > 0").select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.at", "t.digest", "t.n_bytes")
    kept = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "digest", "n_bytes")
    lengths = plan.select("conv_id", (F.col("lent") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    return cut(lent.unionByName(kept)), lengths


def dense_names(rows: DataFrame, keys: list[str], scratch: Scratch, first: int = 0) -> tuple[DataFrame, int]:
    """``rows`` with ``new_name``, a number per distinct key from ``first`` on without gaps, and the next free number."""
    found = scratch.put(rows.select(*keys).distinct().withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", _ROW_BITS)
    counts = {r["part"]: r["count"] for r in found.groupBy(part.alias("part")).count().collect()}  # one row a task
    if not counts:
        scratch.drop(found)
        return scratch.put(rows.withColumn("new_name", F.lit(0).cast("long"))), first
    *offsets, following = accumulate((counts.get(p, 0) for p in range(max(counts) + 1)), initial=first)
    offset = F.element_at(F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<long>"), (part + 1).cast("int"))  # folds to one literal
    named = found.select(*keys, (offset + F.col("row").bitwiseAND((1 << _ROW_BITS) - 1)).alias("new_name"))
    renamed = scratch.put(rows.join(named, keys))
    scratch.drop(found)
    return renamed, following


def block_names(turns: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """By level k: conv_id, at and new_name of every whole block of 2**k turns that starts at turn at * 2**k."""
    rows, n = dense_names(turns.select("conv_id", "at", "digest"), ["digest"], scratch)
    levels = []
    while n:
        levels.append(rows)
        half = F.col("at").bitwiseAND(1)
        pairs = rows.groupBy("conv_id", F.shiftright("at", 1).alias("up")).agg(F.max(F.when(half == 0, F.col("new_name"))).alias("left"), F.max(F.when(half == 1, F.col("new_name"))).alias("right"))
        pairs = scratch.put(pairs.where("left is not null and right is not null").withColumnRenamed("up", "at"))
        rows, n = dense_names(pairs, ["left", "right"], scratch)
        scratch.drop(pairs)
    scratch.drop(rows)
    return levels


def prefix_names(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, at and node: the name of the first ``at`` turns, from 0 (the root, node 0) to the conversation's length."""
    scratch, following = Scratch(turns.sparkSession, "prefix-names"), 1
    prefixes = scratch.put(lengths.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("node")))
    for blocks in reversed(block_names(turns, scratch)):
        last = blocks.where(F.col("at").bitwiseAND(1) == 0).select("conv_id", F.shiftright("at", 1).alias("at"), F.col("new_name").alias("block"))
        keys = scratch.put(last.join(prefixes, ["conv_id", "at"]))
        longer, following = dense_names(keys, ["node", "block"], scratch, following)
        moved = scratch.put(prefixes.select("conv_id", (F.col("at") * 2).alias("at"), "node").unionByName(longer.select("conv_id", (F.col("at") * 2 + 1).alias("at"), F.col("new_name").alias("node"))))
        scratch.drop(prefixes, longer, keys, blocks)
        prefixes = moved
    return prefixes


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) to (node, first, ids) with at most CHUNK_IDS ids each."""
    node, ids = None, []
    names = ["node", "first", "ids"]
    for batch in batches:
        out = []
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (n != node or len(ids) == CHUNK_IDS):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = n
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=names)


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, first, ids) to (node, ends_sha256)."""
    node, state = None, None
    names = ["node", "ends_sha256"]
    for batch in batches:
        out = []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is not None and n == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((node, state.hexdigest()))
            node, state = n, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: SHA-256 of the decimal conv_ids that end at a node, ascending and joined by commas."""
    ship_package(ends.sparkSession)
    chunks = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_join_ids, "node long, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digest_ids, "node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations; turns are conv_id, at, digest, n_bytes, lengths conv_id, length.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (bytes that members beyond the first of each node below, itself included, need not repeat) and ends_sha256.
    """
    ends = lengths.select("conv_id", F.col("length").alias("at"), F.lit(True).alias("ends"))
    rows = cut(prefix_names(turns, lengths).join(ends, ["conv_id", "at"], "left"))
    nodes = cut(rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("at").alias("depth"), F.count("*").alias("n_convs"), F.count("ends").alias("n_ends")))
    first = nodes.select("conv_id", F.col("depth").alias("at"), F.lit(True).alias("stands"), (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    last_bytes = turns.select("conv_id", (F.col("at") + 1).alias("at"), "n_bytes")
    marked = rows.select("conv_id", "at", "node").join(first, ["conv_id", "at"], "left").join(last_bytes, ["conv_id", "at"], "left")
    marked = marked.select("conv_id", (-F.col("at")).alias("back"), "node", F.when(F.col("stands"), 0).otherwise(F.coalesce("n_bytes", F.lit(0))).cast("long").alias("again"), F.coalesce(F.col("leaf"), F.lit(False)).cast("long").alias("leaf"))
    below = running_sums(marked, ("conv_id",), ("back",), {"saved": F.col("again"), "leaves": F.col("leaf")})
    sums = below.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("at"), F.col("node").alias("child")).join(rows.select("conv_id", "at", "node"), ["conv_id", "at"]).select("child", "node")
    parents = cut(parents)
    children = parents.groupBy("node").agg(F.count("*").alias("n_children"))
    above = parents.join(nodes.select("node", F.col("conv_id").alias("parent_conv_id")), "node").select(F.col("child").alias("node"), "parent_conv_id")
    whole = nodes.join(sums, "node").join(children, "node", "left").join(above, "node", "left").join(end_digests(rows.where("ends")), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    turns = numbered_turns(conversations)
    return prefix_trie(turns, conversation_lengths(turns))


def rebuilt_conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(numbered_turns(conversations)))
