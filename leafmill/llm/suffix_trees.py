"""Substring dedup by prefix-partitioned suffix trees over words.

A word is a run without ``[\\x20\\x09-\\x0D]``. A suffix is what starts at a word and has at least ``WINDOW`` words left
in its document; its window is its first ``WINDOW`` words. Two suffixes with one window hang below one deep internal
node of the suffix tree of all documents, and the windows of such a node are the repeats.

1. Suffixes are split by prefixes of variable length. One scan counts prefixes of 1, 2, ... words block by block,
   each longer one only below prefixes that the block holds often; prefixes with more suffixes than fit are extended by
   a word, the others are dealt to groups. The counts only decide where a suffix goes, never whether it does.
2. A task reads documents in blocks and sends each group, in one row a block, the suffixes it has: a 64-bit label of
   the window and its place. A window that a block holds again is sent once, the rest of its places only to
   be reported, so a passage in any number of documents costs a group one suffix a block.
3. A group is a subtree that fits in memory: its suffixes sorted by label, so the leaves of each deep node stand
   together. The leaf that starts first stays; the others are reported to the block that sent them, in one row a block
   and group.
4. Reports of a block meet in one task, where windows that follow each other make one run; runs go back to their
   documents, those of repeated rows through a join that adaptive execution can split, and make maximal repeats,
   whose words are removed.

Edges of a subtree below its prefix are compared by label: a 64-bit label of the window inside a group, of windows
that share the group's prefix. In a group of 2**21 suffixes the chance that two of different words have one label is about
2**-23.

Cases: null, empty and short texts repeat nothing; a document is what has its doc_id, so rows that repeat an id and
a window's start are level and none is removed for the other; a null id counts as the largest id; very long texts
are handled whole, in pieces of ``CHUNK_WINDOWS`` windows; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import cut, dropping_shuffles, in_slices, ship_package
from leafmill.llm.wordhash import mix, span_hashes

WINDOW = 20
#: Suffixes of one group, about; a prefix with over an eighth of that is extended.
GROUP_SUFFIXES = 1 << 21
#: Groups of small tables, which one task each would not keep a cluster busy.
LEAST_GROUPS = 64
#: Prefixes that a block holds less often aren't extended there.
BLOCK_FLOOR = 8
#: Most prefixes that are broadcast as extended ones, 8 bytes each; beyond that only the most frequent are extended.
MOST_PREFIXES = 1_000_000
BLOCK_BYTES = 6_000_000
CHUNK_WINDOWS = 1 << 20
_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_LAST_ID = (1 << 63) - 1
_ROW_BITS = 32  # of a block's number, above which its task's stands
_ZSTD = pa.Codec("zstd", 1)


def hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the offsets at which each text's words begin."""
    data = b"\n".join(texts)
    hashes, starts, at = [], [], 0
    while at < len(data):
        gap = _GAP.search(data, at + _PIECE)
        end = gap.start() if gap else len(data)
        buf = np.frombuffer(data, np.uint8, end - at, at)
        flags = np.zeros(len(buf) + 2, dtype=np.int8)
        flags[1:-1] = ~_SPACE[buf]
        step = np.diff(flags)
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        hashes.append(span_hashes(buf, first, last))
        starts.append(first + at)
        at = end
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def longer(label: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Labels of prefixes one edge longer."""
    return mix(label * _BASE + following)


def window_labels(words: np.ndarray) -> np.ndarray:
    """Labels of all runs of WINDOW (16 + 4) words."""
    two = longer(words[:-1], words[1:])
    four = longer(two[:-2], two[2:])
    eight = longer(four[:-4], four[4:])
    sixteen = longer(eight[:-8], eight[8:])
    return longer(sixteen[: len(words) - WINDOW + 1], four[16:])


class Chunk:
    """Up to CHUNK_WINDOWS windows of consecutive documents, sorted by label.

    ``place`` are the windows' first words (in ``words``), by document in the order of their ids. Of each label the
    window that starts first is ``sent``, with those of other rows of its id that start at the same word; ``same`` are
    those of rows that repeat such a row, ``again`` the others.
    """

    def __init__(self, words: np.ndarray, place: np.ndarray, doc: np.ndarray, start: np.ndarray, label: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> None:
        repeated = len(np.unique(ids)) < len(ids)
        order = np.lexsort((start, ids[doc], label)) if repeated else np.argsort(label, kind="stable")
        self.words, self.place, self.doc, self.start, self.label = words, place[order], doc[order], start[order], label[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = self.label[1:] != self.label[:-1]
        leader = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(order) else order
        level = (ids[self.doc] == ids[self.doc[leader]]) & (self.start == self.start[leader])
        self.same = level & ~fresh & (prints[self.doc] == prints[self.doc[leader]])  # a repeated row: told with the first
        self.sent = level & ~self.same
        self.again = ~level

    def prefixes(self, among: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, windows, labels of that prefix) while the caller narrows ``among`` by ``send``."""
        label = self.words[self.place[among]]
        for n in range(1, WINDOW + 1):
            keep = yield n, among, label
            among, label = among[keep], label[keep]
            if not len(among) or n == WINDOW:
                return
            label = longer(label, self.words[self.place[among] + n])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    """Chunks of the documents (id, print, text), with the ids and prints of their documents."""

    def flush(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
        rows.sort(key=lambda r: r[:2])
        words, offsets = hash_texts([r[2] for r in rows])
        if len(words) < WINDOW:
            return
        ids, prints = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
        doc = np.repeat(np.arange(len(rows)), np.diff(offsets))
        place = np.flatnonzero(np.arange(len(words)) + WINDOW <= offsets[doc + 1])
        labels = window_labels(words)
        for a in range(0, len(place), CHUNK_WINDOWS):
            part = place[a : a + CHUNK_WINDOWS]
            yield Chunk(words, part, doc[part], part - offsets[doc[part]], labels[part], ids, prints), ids, prints

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if row[2] and len(row[2]) >= 2 * WINDOW - 1:
                rows.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield from flush(rows)
                    rows, size = [], 0
    yield from flush(rows)


def _count_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words, prefix and n of the prefixes that a chunk holds at least BLOCK_FLOOR times; words 0: all suffixes it sends."""
    for chunk, _, _ in chunks(batches):
        among = np.flatnonzero(chunk.sent)
        found = [(np.array([0]), np.array([0], dtype=np.int64), np.array([len(among)]))]
        walk = chunk.prefixes(among)
        step = next(walk, None)
        while step is not None:
            n, _, label = step
            values, back, counts = np.unique(label, return_inverse=True, return_counts=True)
            often = counts >= BLOCK_FLOOR
            found.append((np.full(often.sum(), n), values[often].view(np.int64), counts[often]))
            try:
                step = walk.send(often[back])
            except StopIteration:
                step = None
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["words", "prefix", "n"])


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _pack(numbers: np.ndarray, n_bytes: int) -> bytes:
    """Numbers of at most ``n_bytes`` bytes, byte by byte and compressed: sorted ones are better given as differences."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes]
    return _ZSTD.compress(np.ascontiguousarray(planes.T).tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, n_bytes: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :n_bytes] = np.frombuffer(_ZSTD.decompress(data, n * n_bytes, asbytes=True), np.uint8).reshape(n_bytes, n).T
    return wide.view("<u8").ravel()


def _deal(extended: list[np.ndarray], n_groups: int):
    """Rows for the groups; ``extended`` are the sorted prefixes by their number of words (from 1) that are too frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_block = TaskContext.get().partitionId() << _ROW_BITS if TaskContext.get() else 0
        for block, (chunk, ids, prints) in enumerate(chunks(batches), first_block):
            among = np.flatnonzero(chunk.sent | chunk.again)
            group = np.zeros(len(chunk.place), dtype=np.int64)
            walk = chunk.prefixes(among)
            step = next(walk, None)
            while step is not None:
                n, among, label = step
                more = _is_in(label, extended[n - 1]) if n < WINDOW else np.zeros(len(label), dtype=bool)
                group[among[~more]] = (mix(label[~more] + np.uint64(n)) % np.uint64(n_groups)).astype(np.int64)
                try:
                    step = walk.send(more)
                except StopIteration:
                    step = None
            base = chunk.place.min()
            used = np.unique(chunk.doc)
            first = np.zeros(len(used), dtype=np.int64)
            begin = np.zeros(len(used), dtype=np.int64)
            by_doc = np.argsort(chunk.place)
            lead = by_doc[np.searchsorted(chunk.doc[by_doc], used)]
            first[:], begin[:] = chunk.place[lead] - base, chunk.start[lead]
            order = np.argsort(np.where(chunk.same, n_groups, group), kind="stable")[: len(group) - int(chunk.same.sum())]
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1)) if len(order) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at = order[a:b]
                own = np.flatnonzero(np.bincount(np.searchsorted(used, chunk.doc[at]), minlength=len(used)))
                sent, again = at[chunk.sent[at]], at[chunk.again[at]]
                documents = (ids[used[own]].tobytes(), prints[used[own]].tobytes(), first[own].tobytes(), begin[own].tobytes())
                steps = np.diff(chunk.label[sent], prepend=np.uint64(0))  # sorted by label
                rows.append((int(group[at[0]]), block, *documents, len(sent), _pack(steps, 8), _pack(chunk.place[sent] - base, 3), len(again), _pack(chunk.place[again] - base, 3)))
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


_DEALT = "grp long, block long, ids binary, prints binary, firsts binary, begins binary, n_sent long, labels binary, places binary, n_again long, again binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if c.endswith("long") else pa.binary() for c in _DEALT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _DEALT.split(", ")])


_REPORTS = "block long, ids binary, prints binary, counts binary, n_starts long, starts binary"


def repeats_of_subtree(table: pa.Table) -> pa.Table:
    """The suffixes of one group whose window starts earlier too, a row for each block that sent some.

    A row has the documents' ids and prints, how many suffixes each has, and these suffixes' starts in that order.
    """
    blocks, bases, ids, prints, labels, docs, starts, n = [], [0], [], [], [], [], [], 0
    gone_docs, gone_starts = [], []
    for row in zip(*(table.column(c).to_pylist() for c in ("block", "ids", "prints", "firsts", "begins", "n_sent", "labels", "places", "n_again", "again")), strict=True):
        own, own_prints, first, begin = (np.frombuffer(x, np.int64) for x in row[1:5])
        for size, data, to_docs, to_starts in ((row[5], row[7], docs, starts), (row[8], row[9], gone_docs, gone_starts)):
            place = _unpack(data, size, 3).astype(np.int64)
            d = np.searchsorted(first, place, "right") - 1
            to_docs.append((d + n).astype(np.uint32))
            to_starts.append((place - first[d] + begin[d]).astype(np.uint32))
        ids.append(own)
        prints.append(own_prints)
        labels.append(np.cumsum(_unpack(row[6], row[5], 8), dtype=np.uint64))
        n += len(own)
        blocks.append(row[0])
        bases.append(n)
    ids, prints, labels, docs, starts = (np.concatenate(x) for x in (ids, prints, labels, docs, starts))
    order = np.argsort(labels, kind="stable")
    labels = labels[order]
    deep = np.zeros(len(labels), dtype=bool)
    deep[1:] |= labels[1:] == labels[:-1]
    deep[:-1] |= labels[1:] == labels[:-1]
    labels, docs, starts = labels[deep], docs[order[deep]], starts[order[deep]]
    order = np.lexsort((starts, ids[docs], labels))
    labels, docs, starts = labels[order], docs[order], starts[order]
    fresh = np.ones(len(labels), dtype=bool)
    fresh[1:] = labels[1:] != labels[:-1]
    leader = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(labels) else order
    gone = (ids[docs] != ids[docs[leader]]) | (starts != starts[leader])
    docs, starts = np.concatenate([docs[gone], *gone_docs]), np.concatenate([starts[gone], *gone_starts])
    order = np.lexsort((starts, docs))
    docs, starts = docs[order].astype(np.int64), starts[order]
    told, counts = np.unique(docs, return_counts=True)
    at_doc, at_start = np.searchsorted(told, bases), np.searchsorted(docs, bases)
    out = []
    for k, block in enumerate(blocks):
        a, b, c, d = at_doc[k], at_doc[k + 1], at_start[k], at_start[k + 1]
        if a < b:
            out.append((block, ids[told[a:b]].tobytes(), prints[told[a:b]].tobytes(), counts[a:b].astype(np.int64).tobytes(), int(d - c), _pack(starts[c:d], 4)))
    return _table(out, _REPORTS)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(x, pa.int64() if kind == "long" else pa.binary()) for (name, kind), x in zip(fields, columns, strict=True)})


def runs_of_block(table: pa.Table) -> pa.Table:
    """id, print and runs (first window, number of windows) of each document of one block's reports."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("ids", "prints", "counts", "n_starts", "starts")), strict=True))
    counts = [np.frombuffer(r[2], np.int64) for r in rows]
    ids, prints = (np.concatenate([np.repeat(np.frombuffer(r[k], np.int64), n) for r, n in zip(rows, counts, strict=True)]) for k in (0, 1))
    starts = np.concatenate([_unpack(r[4], r[3], 4).astype(np.int64) for r in rows])
    order = np.lexsort((starts, prints, ids))
    ids, prints, starts = ids[order], prints[order], starts[order]
    other = np.ones(len(ids), dtype=bool)
    other[1:] = (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
    opens = other.copy()
    opens[1:] |= starts[1:] > starts[:-1] + 1
    first = np.flatnonzero(opens)
    end = np.append(first[1:] - 1, len(starts) - 1)
    runs = np.stack([starts[first], starts[end] - starts[first] + 1], axis=1)
    by_doc = np.flatnonzero(other[first])
    bounds = np.append(by_doc, len(first))
    return _table([(int(ids[first[a]]), int(prints[first[a]]), runs[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], "id long, print long, runs binary")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """id, print and runs: the windows of documents (id, print, text) that start earlier too, in one row a block."""
    spark = docs.sparkSession
    counts = cut(docs.mapInArrow(in_slices(_count_prefixes), "words long, prefix long, n long").groupBy("words", "prefix").agg(F.sum("n").alias("n")))
    total = counts.where("words = 0").agg(F.sum("n")).first()[0] or 0
    n_groups = max(LEAST_GROUPS, math.ceil(total / GROUP_SUFFIXES))
    often = counts.where(f"words > 0 and n > {GROUP_SUFFIXES // 8}").orderBy(F.desc("n")).limit(MOST_PREFIXES).collect()  # bounds only what is broadcast
    extended = [np.sort(np.array([r["prefix"] for r in often if r["words"] == n], dtype=np.int64).view(np.uint64)) for n in range(1, WINDOW + 1)]
    dealt = docs.mapInArrow(in_slices(_deal(extended, n_groups)), _DEALT)
    reports = dealt.repartition(n_groups, "grp").groupBy("grp").applyInArrow(repeats_of_subtree, _REPORTS)
    return reports.groupBy("block").applyInArrow(runs_of_block, "id long, print long, runs binary")


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, id, print, text) with the text's size and the text compressed, for the shuffle."""
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column(3)]
        packed = [_ZSTD.compress(t, asbytes=True) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t.size for t in texts], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "id", "print", "size", "text"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("first", pa.int64()), ("n_words", pa.int64())]))
    for batch in batches:
        out = []
        for doc_id, size, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = _ZSTD.decompress(text, size, asbytes=True).split()
            if not runs:
                out.append((doc_id, len(words), 0, b" ".join(words), []))
                continue
            parts = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 2) for r in runs])
            parts = parts[np.argsort(parts[:, 0], kind="stable")]
            reach = np.maximum.accumulate(parts.sum(axis=1) + WINDOW - 1)
            opens = np.flatnonzero(np.append(True, parts[1:, 0] > reach[:-1]))
            first, after = parts[opens, 0], reach[np.append(opens[1:] - 1, len(parts) - 1)]
            kept, done = [], 0
            for a, b in zip(first.tolist(), after.tolist(), strict=True):
                kept += words[done:a]
                done = b
            kept += words[done:]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept), [{"first": a, "n_words": b - a} for a, b in zip(first.tolist(), after.tolist(), strict=True)]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), span]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=["doc_id", "n_words", "n_removed", "kept", "repeats"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept (the words that stay, joined by a space) and repeats.

    ``repeats`` are the maximal repeats (first word, number of words) that were removed.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), F.xxhash64("text").alias("print"), "text")
    with dropping_shuffles(docs.sparkSession):  # the suffixes go before the texts are shuffled
        told = cut(repeated_windows(rows.select("id", "print", "text")).groupBy("id", "print").agg(F.collect_set("runs").alias("runs")))
    packed = rows.mapInArrow(in_slices(_compress), "doc_id long, id long, print long, size long, text binary")
    whole = packed.join(told, ["id", "print"], "left").select("doc_id", "size", "text", "runs")
    removed = whole.mapInArrow(in_slices(_remove), "doc_id long, n_words long, n_removed long, kept binary, repeats array<struct<first:long,n_words:long>>")
    return removed.withColumn("kept", F.col("kept").cast("string"))
