"""MinHash near-dedup with DartMinHash signatures.

A document is the multiset of its runs of five words; equal runs have the weight of their count. Each
unit of weight of an element is a region into which hashed darts are thrown: arrival times of a Poisson
process that are a function of the region alone. Each dart falls into one of k coordinates, and the
earliest dart of a coordinate is the signature's entry there, so two documents agree in a coordinate
with a probability of their weighted Jaccard similarity. Only darts earlier than a bound near
``(ln k + 2) * k / weight`` are thrown, about the same number for short and long documents; documents with
a coordinate still empty are thrown again with a later bound.

Bands of the signature make buckets. Documents with equal shingles are one class from the start. Links
come from exact comparisons of shingle multisets, and no bucket is ever compared all with all: in each
round every bucket has one leader that the other components in the bucket are compared with (so rows in
proportion to the bucket), and what is linked merges. Documents whose buckets still hold several components
after the leader rounds are regrouped, without loss, by their rarest shingles: of shingles ordered from rare
to frequent, two documents of the wanted similarity share one among the first ``1 - similarity`` of both.
So an outlier of a large group of copies meets nobody. The groups have a leader round of their own, led by
the member with the fewest rarer shingles; what is left is compared across components, as far as the
places of the shared shingle and the weights allow the similarity at all.

Cases: null and empty texts have no words and stay alone, linked with nothing, like all texts without a
word; a text of one to four words is the single run of its words; repeated ids are one document: each of its
texts is compared, and the classes of all its texts with words are one; equal texts are always one class; a row
without an id is compared like others and is in the class of what it resembles, or in none (null). An empty
table gives an empty result; columns other than the id and the text are ignored, whatever their names; ties
(of leaders, of shingles equally rare) are broken by hash. Very long texts are hashed in slices.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.components import LINKS_A_TASK, connected_components
from leafmill.llm.session import cut, in_slices, ship_package
from leafmill.llm.wordhash import hash_words, mix, ngram_hashes

_CHUNK_CHARS = 1 << 20


@dataclass(frozen=True)
class NearDupSettings:
    """Five words and a similarity of 0.8; bands x rows coordinates; ``leader_rounds`` before documents are regrouped."""

    shingle_words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 6
    leader_rounds: int = 1


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, sorted inside the text; shorter texts are one run."""
    words, offsets = hash_words(texts)
    runs, run_offsets = ngram_hashes(words, offsets, n)
    counts = np.diff(run_offsets)
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        whole = []
        for k in short:
            total = words[offsets[k]].copy().reshape(1)
            for w in words[offsets[k] + 1 : offsets[k + 1]]:
                total = mix(total * np.uint64(0x9E3779B97F4A7C15) + w)
            whole.append(mix(total + np.uint64(lengths[k])))
        runs = np.insert(runs, run_offsets[short], np.concatenate(whole))
        counts[short] = 1
        run_offsets = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    return runs[np.lexsort((runs, owner))], run_offsets


def dart_signatures(regions: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Signatures (documents x k, uint64) of documents given as unit regions with offsets.

    Entry 0 of an empty document's row has no meaning. All documents of the call advance together.
    """
    weights = np.diff(offsets)
    n = len(weights)
    best_time = np.full((n, k), np.inf)
    best_dart = np.zeros((n, k), dtype=np.uint64)
    todo = np.flatnonzero(weights > 0)
    low = np.zeros(n)
    high = (math.log(k) + 2.0) * k / np.maximum(weights, 1)
    while len(todo):
        members = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in todo])
        owner = np.repeat(todo, weights[todo])
        region = regions[members]
        time = np.zeros(len(region))
        step = 0
        while len(region):  # the next dart of every region that may still have one before the bound
            step += 1
            draw = mix(region + np.uint64(step * 0x632BE59BD9B4E019 % (1 << 64)))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = time < high[owner]
            region, owner, time, draw = region[inside], owner[inside], time[inside], draw[inside]
            fresh = time >= low[owner]
            dart = mix(draw ^ np.uint64(0xA0761D6478BD642F))
            slot = owner[fresh] * k + (dart[fresh] % np.uint64(k)).astype(np.int64)
            order = np.lexsort((time[fresh], slot))
            slot, when, what = slot[order], time[fresh][order], dart[fresh][order]
            first = np.flatnonzero(np.diff(slot, prepend=-1))
            slot, when, what = slot[first], when[first], what[first]
            sooner = when < best_time.ravel()[slot]
            best_time.ravel()[slot[sooner]] = when[sooner]
            best_dart.ravel()[slot[sooner]] = what[sooner]
        todo = todo[np.isinf(best_time[todo]).any(axis=1)]
        low[todo], high[todo] = high[todo], high[todo] * 2
    return best_dart


def unit_regions(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One region per unit of weight: a run's hash mixed with which occurrence of the run it is."""
    if not len(runs):
        return runs
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    return mix(runs + (np.arange(len(runs)) - first).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def multiset_hash(regions: np.ndarray) -> int:
    """A signed 64-bit hash of a document's regions, whatever their order: equal for equal multisets of runs."""
    return int(mix(np.bitwise_xor.reduce(mix(regions), initial=0).reshape(1) + np.uint64(len(regions)))[0].astype(np.int64))


def _sign(settings: NearDupSettings):
    def run(batches):
        k = settings.bands * settings.rows
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            start = size = 0
            for at, text in enumerate(texts):
                size += len(text or "")
                if size < _CHUNK_CHARS and at + 1 < len(texts):
                    continue
                part = slice(start, at + 1)
                runs, offsets = shingles(texts[part], settings.shingle_words)
                regions = unit_regions(runs, offsets)
                signature = dart_signatures(regions, offsets, k).reshape(-1, settings.bands, settings.rows)
                band = np.zeros(signature.shape[:2], dtype=np.uint64)
                for r in range(settings.rows):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, r])
                whole = [multiset_hash(regions[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band.astype(np.int64).ravel()), settings.bands).cast(pa.list_(pa.int64()))
                weights = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([ids.slice(start, at + 1 - start), pa.array(weights), pa.array(whole, pa.int64()), bands], names=["doc_id", "weight", "whole", "bands"])
                start, size = at + 1, 0

    return run


def signatures(docs: DataFrame, settings: NearDupSettings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weight (runs), whole (a hash of the multiset of runs) and the hashes of the bands."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(in_slices(_sign(settings)), "doc_id long, weight long, whole long, bands array<long>")


def _shingle_rows(settings: NearDupSettings):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = size = 0
            for at, text in enumerate(texts):
                size += len(text or "")
                if size < _CHUNK_CHARS and at + 1 < len(texts):
                    continue
                runs, offsets = shingles(texts[start : at + 1], settings.shingle_words)
                regions = unit_regions(runs, offsets)
                parts = [regions[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([multiset_hash(x) for x in parts], pa.int64()), pa.array([np.sort(x).tobytes() for x in parts], pa.binary())], names=["node", "regions"])
                start, size = at + 1, 0

    return run


def _compare(settings: NearDupSettings):
    def run(batches):
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            same = np.zeros(len(left), dtype=bool)
            for k, (a, b) in enumerate(zip(left, right, strict=True)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                same[k] = common > 0 and common >= settings.similarity * (len(x) + len(y) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(same)], names=["u", "v", "linked"])

    return run


def near_duplicates(docs: DataFrame, settings: NearDupSettings = NearDupSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id reachable by links) and kept (it is its own class id)."""
    signed = cut(signatures(docs, settings, id_col, text_col))
    # a class is known by the hash of its runs, so that texts under one id stay apart
    classes = signed.where("weight > 0").groupBy(F.col("whole").alias("node")).agg(F.min("doc_id").alias("doc"), F.min("weight").alias("weight"), F.any_value("bands").alias("bands"))
    classes = cut(classes)
    buckets = classes.select("node", "weight", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = F.xxhash64("band", "bucket").alias("bucket"), F.lit(0).cast("long").alias("place")
    buckets = cut(buckets.join(shared.select("band", "bucket"), ["band", "bucket"]).select("node", "weight", *placed))
    wanted = buckets.select("node").distinct()
    docs_wanted = wanted.join(classes.select("node", "doc"), "node").select("doc").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = rows.join(docs_wanted, "doc", "left_semi").unionByName(rows.where("doc is null"))
    sets = cut(texts.mapInArrow(in_slices(_shingle_rows(settings)), "node long, regions binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("regions").alias("regions")))

    same_id = signed.where("weight > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("whole").alias("u"), F.max("whole").alias("last")).where("u <> last")
    links = cut(signed.where("weight > 0").join(same_id, "doc_id").select("u", F.col("whole").alias("v")).where("u <> v").distinct())
    tried = components = None
    n_pairs = 0
    state = _unmerged(buckets, None)  # who stands in which bucket, and in which component
    for k in range(settings.leader_rounds + 2):
        if k == settings.leader_rounds:
            buckets = cut(rare_groups(state.select("node").distinct(), sets, settings))
            state = _unmerged(buckets, components)
        if state.isEmpty():
            break
        pairs = _leader_pairs(state, settings) if k <= settings.leader_rounds else _remaining_pairs(state, settings)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = cut(pairs)
        n_pairs += pairs.count()
        few = max(1, math.ceil(n_pairs / LINKS_A_TASK))
        found = cut(compare_pairs(pairs, sets, settings))
        now, new = found.select("u", "v"), found.where("linked").select("u", "v")
        tried = cut((now if tried is None else tried.union(now)).coalesce(few))
        links = cut(links.union(new).coalesce(few))
        components = cut(connected_components(links))
        state = _unmerged(buckets, components)
    if components is None:
        components = connected_components(links)
    # written first, as a join with an aggregate's own output could not be split for a component of many nodes
    first = cut(components.join(classes.select("node", "doc"), "node").groupBy("component").agg(F.min("doc").alias("first")))
    by_node = components.join(first, "component").select("node", "first")
    known = cut(classes.select("node", "doc").join(by_node, "node", "left").select("node", F.coalesce("first", "doc").alias("class_id")))
    member = signed.where("weight > 0").select("doc_id", F.col("whole").alias("node")).join(known, "node").select("doc_id", "class_id")
    named = member.unionByName(signed.where("weight = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    return named.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _unmerged(buckets: DataFrame, components: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several components, with ``component``."""
    if components is None:
        named = buckets.withColumn("component", F.col("node"))
    else:
        named = buckets.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
    return cut(named.join(several, "bucket"))


def _region_rows(batches):
    for batch in batches:
        data = [np.frombuffer(x, np.int64) for x in batch.column("regions").to_pylist()]
        sizes = np.array([len(x) for x in data], dtype=np.int64)
        node = np.repeat(batch.column("node").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(data) if data else np.zeros(0, np.int64))], names=["node", "weight", "region"])


def rare_groups(nodes: DataFrame, sets: DataFrame, settings: NearDupSettings) -> DataFrame:
    """(bucket, node, weight, place): the shared ones among the rarest shingles of each node, and how many of it are rarer.

    Shingles are ordered by how many of ``nodes`` have them. Two nodes of the wanted similarity stand
    together in at least one bucket. Shingles that one node alone has make no bucket.
    """
    rows = sets.join(nodes, "node", "left_semi").mapInArrow(in_slices(_region_rows, 64), "node long, weight long, region long")
    often = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    known = rows.join(often, "region")
    by_node = Window.partitionBy("node")
    unique = F.col("weight") - F.count("*").over(by_node)
    placed = known.withColumn("place", unique + F.row_number().over(by_node.orderBy("n", "region")) - 1)
    return placed.where(F.col("place") <= F.col("weight") * (1 - settings.similarity) + 1e-6).select(F.col("region").alias("bucket"), "node", "weight", "place")


def compare_pairs(pairs: DataFrame, sets: DataFrame, settings: NearDupSettings) -> DataFrame:
    """(u, v, linked): whether the weighted Jaccard similarity of the two documents reaches the bound."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("regions").alias("left")), "u")
    full = left.join(sets.select(F.col("node").alias("v"), F.col("regions").alias("right")), "v")
    return full.select("u", "v", "left", "right").mapInArrow(in_slices(_compare(settings)), "u long, v long, linked boolean")


def _possible(x: Column, y: Column, settings: NearDupSettings) -> Column:
    """Whether two members of a bucket can be similar enough if its shingle is the rarest that they share."""
    needed = (x["weight"] + y["weight"]) * (settings.similarity / (1 + settings.similarity)) - 1e-6
    return F.least(x["weight"] - x["place"], y["weight"] - y["place"]) >= needed


def _leader_pairs(state: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Pairs of each bucket's leader with the bucket's members of other components.

    The leader has the fewest rarer shingles, then the smallest rank by a hash that differs between buckets.
    """
    member = F.struct("node", "component", "weight", "place")
    leaders = state.groupBy("bucket").agg(F.min_by(member, F.struct(F.col("place") / F.col("weight"), F.xxhash64("bucket", "node"), "node")).alias("leader"))
    joined = state.withColumn("own", member).join(leaders, "bucket").where((F.col("component") != F.col("leader.component")) & _possible(F.col("own"), F.col("leader"), settings))
    return joined.select(F.least("node", "leader.node").alias("u"), F.greatest("node", "leader.node").alias("v"))


def _remaining_pairs(state: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Pairs across components, for buckets with several: all members outside the largest component with all others."""
    sizes = state.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    member = F.struct("node", "component", "weight", "place")
    outside = state.join(largest, "bucket").where("component <> largest").select("bucket", member.alias("other"))
    own = state.select("bucket", member.alias("own"))
    apart = (F.col("own.component") != F.col("other.component")) & _possible(F.col("own"), F.col("other"), settings)
    joined = own.alias("a").join(outside.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & apart)
    return joined.select(F.least("own.node", "other.node").alias("u"), F.greatest("own.node", "other.node").alias("v"))
