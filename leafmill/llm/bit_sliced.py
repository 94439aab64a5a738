"""Ranked lexical search with a bit-sliced impact index.

Documents are indexed in blocks inside the tasks that read them. A block numbers its documents by id and has, for
each term that is asked for, one bitmap per bit of the term's impact (its weight times its share of the score, an
integer): bit k of document d stands in bitmap k at place d. The score of an item in a whole block is the sum of its
terms' bitmaps by ripple-carry addition, repeats by shifts; the best k documents are found from the most significant
bitmap down, keeping the documents that are sure to be among them and those still level with each other.

Two scans: the first counts documents, terms and document frequencies (sums made in tasks, then one row per term);
the second builds the blocks, scores every item against them and keeps the best of each item a task. These are few rows,
ranked in two steps so that no task gets an item's rows of all tasks. Postings are never shuffled.

Items are sent to tasks in groups of about ``GROUP_BYTES`` of text, each group one pass, so what is broadcast is
bounded whatever the number of items.

Cases: null or empty texts have no terms; items without terms, or whose terms no document holds, have no rows; terms
that stand in all documents can have weight 0; repeated items are ranked each; equal scores go by id, null ids last;
repeated documents are ranked each; empty tables give an empty result; very long texts are counted in pieces cut
between terms; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.session import in_slices, ship_package

TOP = 20
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 2_000_000
GROUP_BYTES = 4_000_000
PIECE_BYTES = 1 << 20
#: Rows of an item are ranked in so many parts first.
RANK_PARTS = 32

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """Lists of the terms of a UTF-8 text, one list a piece: runs of ASCII letters, digits and other characters, A-Z lowered."""
    folded = (text or b"").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def count_terms(text: bytes | None, codes: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """How many terms a text has, and the occurrences of those with a code."""
    n, found = 0, Counter()
    for piece in terms_of(text):
        n += len(piece)
        for term, tf in Counter(piece).items():
            code = codes.get(term)
            if code is not None:
                found[code] += tf
    return n, found


def _document_counts(codes: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        df = np.zeros(len(codes), dtype=np.int64)
        for batch in batches:
            for value in batch.column(1):
                n, found = count_terms(value.as_py(), codes)
                docs, terms = docs + (n > 0), terms + n
                df[list(found)] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[docs, terms], df[held]]))], names=["code", "n"])

    return run


def add(total: list[int], planes: list[int], shift: int = 0) -> None:
    """Add bit-sliced numbers, times 2**shift, to a bit-sliced total in place."""
    total.extend([0] * (shift + len(planes) - len(total)))
    carry = 0
    for k, plane in enumerate(planes, shift):
        old = total[k]
        half = old ^ plane
        total[k] = half ^ carry
        carry = (old & plane) | (half & carry)
    k = shift + len(planes)
    while carry:
        if k == len(total):
            total.append(0)
        total[k], carry = total[k] ^ carry, total[k] & carry
        k += 1


def places(bits: int, most: int) -> list[int]:
    """The lowest ``most`` set places."""
    out = []
    while bits and len(out) < most:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def best(total: list[int], k: int) -> list[int]:
    """Places of the k greatest sums above 0, equal ones by place; not in order."""
    sure, level = 0, 0
    for plane in total:
        level |= plane
    if level.bit_count() <= k:
        return places(level, k)
    for plane in reversed(total):
        high = level & plane
        n = (sure | high).bit_count()
        if n > k:
            level = high
            continue
        sure |= high
        level ^= high
        if n == k:
            level = 0
            break
    return places(sure, k) + places(level, k - sure.bit_count())


def slice_postings(docs: np.ndarray, impacts: np.ndarray, n_docs: int) -> list[int]:
    """Bitmaps of the impacts of one term, by bit."""
    n_bits = int(impacts.max()).bit_length() if len(impacts) else 0
    if not n_bits:
        return []
    table = np.zeros((n_bits, n_docs), dtype=np.uint8)
    table[:, docs] = (impacts[None, :] >> np.arange(n_bits)[:, None]) & 1
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(table, axis=1, bitorder="little")]


class Block:
    """Documents (id, number of terms, occurrences by code) that become one block of the index."""

    def __init__(self) -> None:
        self.docs: list[tuple[int | None, int]] = []
        self.code: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.postings = 0

    def put(self, doc_id: int | None, n: int, found: dict[int, int]) -> bool:
        """Whether the block is full with this document."""
        self.docs.append((doc_id, n))
        self.code.append(np.fromiter(found.keys(), np.int64, len(found)))
        self.tf.append(np.fromiter(found.values(), np.int64, len(found)))
        self.postings += len(found)
        return len(self.docs) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS

    def index(self, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[list[int | None], dict[int, list[int]]]:
        """Ids by place, and the bitmaps by code."""
        order = sorted(range(len(self.docs)), key=lambda d: (self.docs[d][0] is None, self.docs[d][0] or 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        code, tf = np.concatenate(self.code), np.concatenate(self.tf)
        doc = np.repeat(np.arange(len(self.docs)), [len(c) for c in self.code])
        length = np.array([100 - 25 + (25 * n * n_docs) // n_terms for _, n in self.docs], dtype=np.int64)
        impact = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length[doc]))
        by_code = np.argsort(code, kind="stable")
        code, doc, impact = code[by_code], place[doc[by_code]], impact[by_code]
        bounds = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
        return [self.docs[d][0] for d in order], {int(code[a]): slice_postings(doc[a:b], impact[a:b], len(order)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)}


def score_item(planes: dict[int, list[int]], wanted: dict[int, int]) -> list[int]:
    """The bit-sliced scores of a block for an item (repeats by code)."""
    total: list[int] = []
    for code, repeats in wanted.items():
        for shift in places(repeats, repeats.bit_length()):
            if planes.get(code):
                add(total, planes[code], shift)
    return total


def _rank(items: list[dict[int, int]], codes: dict[bytes, int], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    order = lambda hit: (-hit[0], hit[1] is None, hit[1] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[int, int | None]]] = [[] for _ in items]

        def search(block: Block) -> None:
            if block.postings:
                ids, planes = block.index(weights, n_docs, n_terms)
                for k, wanted in enumerate(items):
                    total = score_item(planes, wanted)
                    hits = [(sum((plane >> p & 1) << b for b, plane in enumerate(total)), ids[p]) for p in best(total, top)]
                    kept[k] = heapq.nsmallest(top, kept[k] + hits, key=order)

        block = Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = count_terms(text, codes)
                if found and block.put(doc_id, n, found):
                    search(block)
                    block = Block()
        search(block)
        rows = [(k, doc_id, score) for k, hits in enumerate(kept) for score, doc_id in hits]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the ``top`` documents of each item (item_id, text) by score, then id."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    groups = math.ceil((asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) / GROUP_BYTES)
    empty = spark.createDataFrame([], asked.select("item_id").schema)
    ranked = empty.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for g in range(groups):
        group = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()  # about GROUP_BYTES
        codes: dict[bytes, int] = {}
        wanted = [Counter(codes.setdefault(t, len(codes)) for piece in terms_of(bytes(r["text"])) for t in piece) for r in group]
        counts = texts.mapInArrow(in_slices(_document_counts(codes)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        found = {r["code"]: r["n"] for r in counts.collect()}  # a row per term of the group
        n_docs, n_terms = found.get(-2, 0), found.get(-1, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(c, 0) + 1))) for c in range(len(codes))], dtype=np.int64)
        hits = texts.mapInArrow(in_slices(_rank(wanted, codes, weights, n_docs, n_terms, top)), "item long, doc_id long, score long")
        best_first = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS))], ["item"]):
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))).where(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(group)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}"))
        ranked = ranked.unionByName(hits.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return ranked
