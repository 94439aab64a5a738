"""SentencePiece encoding and decoding as a relational lattice.

Texts are normalised (a leading space, U+2581 as a space) and cut into words where no piece can reach across.
Words are encoded by relations:

* their substrings of bounded length are exploded and equi-joined to the piece table (broadcast: it has the
  vocabulary's size),
* the edges found are grouped by word,
* a higher-order ``aggregate`` folds the edges forward in Viterbi's way: every position keeps one arriving
  edge, looked up among the last ``longest`` positions only; a second fold walks back from the end.

So a word costs time and memory in proportion to its length, whatever that is. What differs between models is
which arriving edge a position keeps. Unigram models keep the one of the best score. For BPE models the
best-scoring path is not what merging by rank gives. But the merged segmentation of a prefix ends in exactly
one piece, namely the one that the merged segmentation before it does not disturb: no piece across the border
would have been merged while both of its halves stood alone. That is decided by the ranks at which the pieces
along the border are made and used up (``spines``), so the same fold gives the exact merges.

Words are cut further between characters that stand side by side in no piece. Texts are cut, and their words and parts
told apart and counted, on the Arrow buffers of a slice of rows, so a distinct word costs Python once a slice. The most
frequent parts (at most ``HOT_CHARS`` characters each, ``HOT_BYTES`` of text together) are encoded first and sent to
all tasks; which parts these are changes no result. A task then writes each text as part numbers, frequent ones low and
the whole compressed, and sends on the other parts with it, by row. The shuffle by row is the only one over the corpus:
lattice, fold and assembly of a row happen where the row is.

Cases: null and empty texts have no ids; repeated rows are encoded row by row; an empty table gives an empty
result; very long texts and very long words need memory in proportion to their length; ties of a unigram model
go to the longest arriving piece; columns other than the id and the text are ignored, whatever their names.
Characters outside the vocabulary become bytes. Rows are numbered as they are read: where rows come out of a
shuffle without an order, write them as a table first.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.session import cut, dropping_shuffles, in_slices, ship_package

SPACE = "▁"
#: Bytes of all frequent parts; their ids, four bytes each, are at most as many.
HOT_BYTES = 8 << 20
#: Tasks that encode them, so that each sorts few edges at once.
HOT_TASKS = 32
HOT_CHARS = 24
#: End positions of a block of a long word; edges of a slice of the fold; rows of which words are told apart at once.
BLOCK, SLICE = 64, 512
ROWS = 512
#: Characters that stand alone in many vocabularies; those that do in a given one cut words too.
LONERS = "\n\t\r0123456789"
NEVER = 2**31 - 1
#: Score of a character without a piece, below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Added to the code point of a character without a piece, where ids stand; ids are below.
UNKNOWN = 1 << 29


@dataclass(frozen=True)
class PieceModel:
    """A vocabulary: (piece, id, score) of ordinary pieces, ids of the byte pieces, and the kind of model."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    size: int
    unigram: bool

    @staticmethod
    def load(path: str) -> PieceModel:
        """The model of a file; it must have byte pieces for characters outside the vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        pieces = tuple((model.id_to_piece(k), k, float(model.get_score(k))) for k in ordinary)
        byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        if model.unk_id() in byte_ids:
            raise ValueError("the vocabulary has no byte pieces")
        if max(len(piece) for piece, _, _ in pieces) > 63:
            raise ValueError("a piece has over 63 characters")
        scores = [s for piece, _, s in pieces if len(piece) > 1]
        return PieceModel(pieces, byte_ids, model.get_piece_size(), any(s != round(s) for s in scores))  # BPE scores are negative ranks

    @property
    def longest(self) -> int:
        return max(len(piece) for piece, _, _ in self.pieces)

    def alone(self) -> bytes:
        """The characters of LONERS that stand alone in every piece: words end before and behind each."""
        inside = {c for piece, _, _ in self.pieces if len(piece) > 1 for c in piece}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _, _ in self.pieces):
            raise ValueError("a piece holds a space behind another character: texts cannot be cut at spaces")
        return "".join(c for c in LONERS if c not in inside).encode()

    def neighbours(self) -> frozenset[str]:
        """All pairs of characters that stand side by side in a piece; no piece reaches across any other pair."""
        return frozenset(piece[k : k + 2] for piece, _, _ in self.pieces for k in range(len(piece) - 1))


@lru_cache(maxsize=4)
def merge_tree(model: PieceModel) -> dict[str, int]:
    """The length of the left part of the last merge of every piece that merging by rank makes; 0 for single characters.

    Pieces of one rank merge from the left. Raises where a rank is lower than that of a part, which learnt merges rule out.
    """
    ranks = {piece: -score for piece, _, score in model.pieces if len(piece) > 1}
    left: dict[str, int] = {piece: 0 for piece, _, _ in model.pieces if len(piece) == 1}
    for piece in ranks:
        parts = list(piece)
        while len(parts) > 1:
            found = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if found is None:
                break
            k = found[1]
            at = len(parts[k])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) > 1:
            continue  # no merge order makes this piece
        left[piece] = at
        if any(ranks.get(part, -1) > ranks[piece] for part in (piece[:at], piece[at:])):
            raise ValueError(f"the rank of {piece!r} is lower than that of a part of it")
    return left


def spines(model: PieceModel) -> list[tuple[int, list[int], list[int]]]:
    """(id, right, left) per piece: for the pieces along its right and its left border, by length from 1, the rank that
    uses them up (-1 for a length that none of them has)."""
    left = merge_tree(model)
    ranks = {piece: int(-score) for piece, _, score in model.pieces}

    def border(piece: str, step: Callable[[str], str]) -> list[int]:
        used, death = [-1] * len(piece), NEVER
        while True:
            used[len(piece) - 1] = death
            if len(piece) == 1:
                return used
            death, piece = ranks[piece], step(piece)

    return [(k, border(p, lambda x: x[left[x] :]), border(p, lambda x: x[: left[x]])) for p, k, _ in model.pieces if p in left]


def piece_table(spark: SparkSession, model: PieceModel) -> DataFrame:
    """(piece, piece_id, split, rank) of all pieces that can stand in a result, spaces as in texts; at most the vocabulary's
    size in rows. Split and rank are those of a piece's last merge (BPE; rank -1: made by no merge)."""
    usable = {piece: (k, 0, -1) for piece, k, _ in model.pieces}
    if not model.unigram:
        left = merge_tree(model)
        usable = {piece: (k, left[piece], int(-score) if left[piece] else -1) for piece, k, score in model.pieces if piece in left}
    columns = [pa.array([p.replace(SPACE, " ") for p in usable], pa.string()), *(pa.array(x, pa.int32()) for x in zip(*usable.values(), strict=True))]
    return spark.createDataFrame(pa.table(columns, names=["piece", "piece_id", "split", "rank"]))


def vocabulary(spark: SparkSession, model: PieceModel) -> DataFrame:
    """One row with ``known``: by id, the score of each piece or, for BPE, its borders, as ``spines`` gives them. The last
    entry is that of a character without a piece."""
    known: list[dict | None] = [None] * model.size
    if model.unigram:
        fields = [("value", pa.float64())]
        for _, k, score in model.pieces:
            known[k] = {"value": score}
        unknown = {"value": min(score for _, _, score in model.pieces) - UNKNOWN_PENALTY}
    else:
        fields = [("right", pa.list_(pa.int32())), ("left", pa.list_(pa.int32()))]
        for k, right, left in spines(model):
            known[k] = {"right": right, "left": left}
        unknown = {"right": [NEVER], "left": [NEVER]}
    return spark.createDataFrame(pa.table({"known": pa.array([[*known, unknown]], pa.list_(pa.struct(fields)))}))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body refers to it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def lattice(blocks: DataFrame, keys: list[str], model: PieceModel) -> DataFrame:
    """The keys with ``edges``: every piece that stands in the word, and every character, by end, the longest first.

    ``blocks`` has the keys, block (number), lead (characters before the block's own) and part (lead and own
    characters). A key whose part is null has no edges. An edge's code is one number: its end, 63 less its length (6
    bits) and its piece's id, or UNKNOWN and its code point (30 bits). Split is where its last merge joins, rank when.
    Edges are made before they are grouped (the optimiser does not draw an explode into the aggregation), so only the
    keys and the edges are sorted.
    """
    longest = model.longest
    ends = blocks.select(*keys, "block", "lead", "part", F.explode_outer(F.when(F.col("part").isNotNull(), F.sequence(F.col("lead") + 1, F.length("part")))).alias("end"))
    spans = ends.select(*keys, "block", "lead", "part", "end", F.explode_outer(F.when(F.col("end").isNotNull(), F.sequence(F.lit(1), F.least(F.lit(longest), F.col("end"))))).alias("n"))
    at = (F.col("block") * BLOCK + F.col("end") - F.col("lead")).cast("long")
    place = at * (1 << 36) + (63 - F.col("n")) * F.lit(1 << 30).cast("long")
    pieces = spans.select(*keys, "n", place.alias("place"), (at - F.col("n")).alias("start"), F.substring("part", F.col("end") - F.col("n") + 1, F.col("n")).alias("piece"))
    found = pieces.join(F.broadcast(piece_table(blocks.sparkSession, model)), "piece", "left").where("piece_id is not null or n = 1 or n is null")
    code = F.col("place") + F.coalesce("piece_id", F.ascii("piece") + UNKNOWN)
    rank = F.coalesce("rank", F.lit(-1))
    edge = F.when(F.col("n").isNotNull(), F.struct(code.alias("code"), "start", (F.col("start") + F.coalesce("split", F.lit(0))).alias("split"), rank.alias("rank")))
    made = found.select(*keys, F.explode(F.array(edge)).alias("edge"))
    return made.groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def _end(code: Column) -> Column:
    return F.shiftright(code, 36)


def _start(code: Column) -> Column:
    return F.shiftright(code, 36) - 63 + F.shiftright(code, 30).bitwiseAND(F.lit(63))


def _known(known: Column, code: Column) -> Column:
    """The vocabulary's entry of an edge's piece; the last one for a character without a piece."""
    id = code.bitwiseAND(F.lit((1 << 30) - 1)).cast("int")
    return F.get(known, F.when(id < UNKNOWN, id).otherwise(F.size(known) - 1))


def _keep_bpe(known: Column) -> Callable:
    """Keeps the arriving edge that the merged segmentation before it does not disturb: the longest such; a
    character, which comes last, needs no proof, as one edge must fit.

    A piece that merging makes has one last merge, wherever it stands, so it is held against the one border that this
    merge joins: it disturbs if both its parts stand along that border and are not used up before its rank.
    """

    def reach(longer: Column, window: Column, edge: Column) -> Column:
        start = edge["start"]

        def disturbs(c: Column) -> Column:
            before = F.get(window, (start - _end(F.get(window, F.lit(0)))).cast("int"))
            left_part = c["rank"] < F.get(_known(known, before)["right"], (c["split"] - c["start"] - 1).cast("int"))
            right_part = c["rank"] <= F.get(_known(known, edge["code"])["left"], (_end(c["code"]) - c["split"] - 1).cast("int"))
            return (c["split"] == start) & F.coalesce(left_part & right_part, F.lit(False))

        fits = (edge["rank"] < 0) | (start == 0) | ~F.exists(longer, disturbs)
        return F.when(_end(_last(window)) == _end(edge["code"]), window).when(fits, F.array_append(window, edge["code"])).otherwise(window)

    return reach


def _keep_unigram(known: Column) -> Callable:
    """Keeps the arriving edge of the best total score, with that score; the longest of equals."""

    def reach(longer: Column, window: Column, edge: Column) -> Column:
        before = F.get(window, (edge["start"] - _end(F.get(window, F.lit(0))["code"])).cast("int"))
        total = before["value"] + _known(known, edge["code"])["value"]
        arrived = F.struct(edge["code"].alias("code"), total.alias("value"))
        return F.when(_end(_last(window)["code"]) < _end(edge["code"]), F.array_append(window, arrived)).when(
            _last(window)["value"] < total, F.array_append(F.slice(window, 1, F.size(window) - 1), arrived)
        ).otherwise(window)

    return reach


def fold(edges: Column, model: PieceModel, known: Column) -> Column:
    """The ids of a word from its edges, in order; a character without a piece is UNKNOWN and its code point.

    Forward, the edges come in slices; each position keeps an edge, and only the last ``longest`` kept edges and
    the longer edges that end among them go on to the next slice. Backward, the kept edges from the end are the
    segments. So a word of any length needs time in proportion to it. Structs, concatenation and ``_let`` cost most
    here, so none of them stands in what is done for each edge.
    """
    longest, nothing = model.longest, F.lit(63 << 30)  # an edge of no length that ends at 0
    if model.unigram:
        kind, root, codes, reach = "struct<code:bigint,value:double>", F.struct(nothing.alias("code"), F.lit(0.0).alias("value")), lambda kept: kept["code"], _keep_unigram(known)
    else:
        kind, root, codes, reach = "bigint", nothing, lambda kept: kept, _keep_bpe(known)
    start = F.struct(F.array(root).cast(f"array<{kind}>").alias("window"), F.array().cast("array<struct<code:bigint,start:bigint,split:bigint,rank:int>>").alias("longer"), F.array().cast("array<array<bigint>>").alias("out"))
    last_slice = F.floor((F.size(edges) - 1) / SLICE).cast("int")

    def forward(state: Column, k: Column) -> Column:
        def sliced(some: Column, longer: Column) -> Column:
            def closed(window: Column) -> Column:
                # the last position can still change; the first one of these was the last one before
                done = F.slice(window, F.size(state["window"]), F.size(window) - F.size(state["window"]))
                return F.struct(
                    F.slice(window, F.greatest(F.lit(1), F.size(window) - longest), F.lit(longest + 1)).alias("window"),
                    F.when(k == last_slice, state["longer"]).otherwise(F.filter(longer, lambda e: _end(e["code"]) > _end(codes(_last(window))) - longest)).alias("longer"),
                    F.array_append(state["out"], codes(done)).alias("out"),
                )

            return _let(F.aggregate(some, state["window"], lambda window, edge: reach(longer, window, edge)), closed)

        def with_longer(some: Column) -> Column:
            return _let(F.concat(state["longer"], F.filter(some, lambda e: e["rank"] >= 0)), lambda longer: sliced(some, longer))

        return _let(F.slice(edges, k * SLICE + 1, F.lit(SLICE)), with_longer)

    def backward(kept: Column, last: Column) -> Column:
        def slice_back(state: Column, some: Column) -> Column:
            def one(out: Column, code: Column) -> Column:
                return F.when(_end(code) == _start(_last(out)), F.array_append(out, code)).otherwise(out)

            return _let(F.aggregate(F.reverse(some), F.array(state["last"]), one), lambda d: F.struct(_last(d).alias("last"), F.array_append(state["out"], F.slice(d, F.lit(2), F.size(d))).alias("out")))

        at_end = F.struct(last.alias("last"), F.array(F.array(last)).alias("out"))
        ids = lambda found: F.transform(F.filter(found, lambda code: _end(code) > 0), lambda code: code.bitwiseAND(F.lit((1 << 30) - 1)).cast("int"))
        return F.aggregate(F.reverse(kept), at_end, slice_back, lambda s: ids(F.reverse(F.flatten(s["out"]))))

    return F.aggregate(F.sequence(F.lit(0), last_slice), start, forward, lambda state: backward(state["out"], codes(_last(state["window"]))))


def encode_blocks(blocks: DataFrame, keys: list[str], model: PieceModel) -> DataFrame:
    """The keys with ``ids`` (null where the key has no edges) as ``fold`` gives them."""
    # known is referred to once and stands above a filter, so the optimiser folds it into the last projection as one
    # value; folded into the aggregation instead, every row would carry a copy
    grouped = lattice(blocks, keys, model).where(F.size("edges") >= 0).withColumn("known", vocabulary(blocks.sparkSession, model).scalar())
    folded = _let(F.col("known"), lambda known: fold(F.col("edges"), model, known))
    return grouped.select(*keys, F.when(F.size("edges") > 0, folded).alias("ids"))


def expand(ids: np.ndarray, offsets: np.ndarray, byte_ids: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with characters without a piece as the ids of their bytes."""
    odd = np.flatnonzero(ids >= UNKNOWN)
    if not len(odd):
        return ids, offsets
    spelled = [[byte_ids[b] for b in chr(k - UNKNOWN).replace(" ", SPACE).encode()] for k in ids[odd].tolist()]
    more = np.zeros(len(ids) + 1, np.int64)
    more[odd + 1] = [len(x) - 1 for x in spelled]
    shift = np.cumsum(more)
    out = np.empty(len(ids) + int(shift[-1]), np.int32)
    plain = np.ones(len(ids), bool)
    plain[odd] = False
    out[(np.arange(len(ids)) + shift[:-1])[plain]] = ids[plain]
    for k, x in zip(odd.tolist(), spelled, strict=True):
        out[k + shift[k] : k + shift[k] + len(x)] = x
    return out, offsets + shift[offsets]


def strings(data: np.ndarray, at: np.ndarray) -> pa.StringArray:
    """The bytes between each two places, as strings, without a copy."""
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def flat_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, end to end, and where each text begins, and the end."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


class _Splitter:
    """Cuts texts into words, and words into parts where no piece reaches across."""

    def __init__(self, model: PieceModel):
        self.kind = np.zeros(256, np.uint8)
        self.kind[32], self.kind[list(model.alone())] = 1, 2
        self.pairs = np.array(sorted(ord(a) << 21 | ord(b) for a, b in (pair.replace(SPACE, " ") for pair in model.neighbours())) or [0], np.int64)

    def words(self, texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all texts and where each text begins among them, and the end. A word is a run of spaces and what
        follows it up to a space or a character that stands alone, or such a character, or a run of spaces before one."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), SPACE, " ")
        data, rows = flat_bytes(pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", " "), texts, ""))
        kind = self.kind[data]
        space, alone = kind == 1, kind == 2
        begins = space | alone
        begins[1:] &= ~(space[1:] & space[:-1])
        begins[1:] |= (kind[1:] == 0) & alone[:-1]
        begins[rows[:-1][rows[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(begins), len(data))
        return strings(data, at), np.searchsorted(at, rows)

    def parts(self, words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The parts of all words, none of which is empty, and where each word begins among them, and the end."""
        data, at = flat_bytes(words)
        if not len(data):
            return strings(data, at[:1]), at
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = chars[:-1] << 21 | chars[1:]
        apart = self.pairs[np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)] != pairs
        begins = np.zeros(len(data) + 1, bool)
        begins[np.flatnonzero((data & 0xC0) != 0x80)[1:][apart]] = True
        begins[at] = True
        cuts = np.flatnonzero(begins)
        return strings(data, cuts), np.searchsorted(cuts, at)


def frequent_parts(texts: DataFrame, splitter: _Splitter) -> DataFrame:
    """(part, times): frequent parts of words and how often they stand, at most HOT_BYTES of text.

    Counts share a bin by the eighth of their binary logarithm, so the choice needs no sort.
    """

    def run(batches):
        for batch in batches:
            coded = splitter.words(batch.column("text"))[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            parts, at = splitter.parts(coded.dictionary)
            told = parts.dictionary_encode()
            n = np.bincount(told.indices.to_numpy(), weights=np.repeat(n, np.diff(at)), minlength=len(told.dictionary)).astype(np.int64)
            some = pa.RecordBatch.from_arrays([told.dictionary, pa.array(n)], names=["part", "times"])
            yield some.filter(pc.less_equal(pc.utf8_length(told.dictionary), HOT_CHARS))
            pa.default_memory_pool().release_unused()

    spark = texts.sparkSession
    ship_package(spark)
    with dropping_shuffles(spark):
        counted = cut(texts.mapInArrow(in_slices(run, ROWS), "part string, times long").groupBy("part").agg(F.sum("times").alias("times")))
    size = F.floor(F.log2("times") * 8)
    bins = sorted(((r["bin"], r["bytes"]) for r in counted.groupBy(size.alias("bin")).agg(F.sum(F.octet_length("part")).alias("bytes")).collect()), reverse=True)  # at most 512
    total, least = 0, 1 << 20
    for at, held in bins:
        total += held
        if total > HOT_BYTES:
            break
        least = at
    return counted.where(size >= least)


def hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word, none of which is empty."""
    data, at = flat_bytes(words)
    if not len(data):
        return np.zeros(0, np.uint64)
    lengths = np.diff(at)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    return np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(at[:-1], lengths)], at[:-1])


class _Numbers:
    """The number of each frequent part. Tables of hashes take less memory than one of strings and none for each look-up;
    what they find is compared, and of two parts of one hash one is no frequent part."""

    def __init__(self, parts: pa.StringArray):
        self.parts, found = parts, hashes(parts)
        self.order = np.argsort(found).astype(np.int32)
        self.hashes = found[self.order]

    def of(self, parts: pa.StringArray) -> np.ndarray:
        """The number of each part; -1 for others than the frequent ones."""
        if not len(self.order):
            return np.full(len(parts), -1, np.int64)
        at = self.order[np.minimum(np.searchsorted(self.hashes, hashes(parts)), len(self.order) - 1)]
        return np.where(pc.equal(self.parts.take(pa.array(at)), parts).to_numpy(zero_copy_only=False), at, -1).astype(np.int64)


class _Hot:
    """Frequent parts' ids, end to end."""

    def __init__(self, ids: pa.Array, model: PieceModel):
        offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, offsets = expand(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), offsets, model.byte_ids)
        self.ids, self.offsets = flat.astype(np.uint16 if model.size <= 1 << 16 else np.int32), offsets.astype(np.int32)


def packed(numbers: np.ndarray) -> bytes:
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()  # equal bytes side by side compress
    return struct.pack("<q", len(planes)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], decompressed_size=struct.unpack("<q", data[:8])[0], codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``flat[offsets[k]:offsets[k + 1]]`` for every k of ``which``, end to end."""
    lengths = offsets[which + 1] - offsets[which]
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(offsets[which] - before, lengths) + np.arange(int(lengths.sum()))]


_ROW = "row_id long, word int, block int, lead int, part string, id {id}, numbers binary"


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``ids`` of the whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    splitter, longest = _Splitter(model), model.longest
    id_type = docs.schema[id_col].dataType.simpleString()
    hot_parts = frequent_parts(docs.select(F.col(text_col).alias("text")), splitter)
    hot_blocks = hot_parts.repartition(HOT_TASKS, "part").select(F.col("part").alias("text"), "times", F.lit(0).alias("block"), F.lit(0).alias("lead"), "part")
    table = encode_blocks(hot_blocks, ["text", "times"], model).toArrow()  # at most HOT_BYTES and their ids
    table = table.sort_by([("times", "descending")])
    sent_parts = spark.sparkContext.broadcast(_Numbers(table.column("text").combine_chunks()))
    sent_ids = spark.sparkContext.broadcast(_Hot(table.column("ids").combine_chunks(), model))
    byte_ids = model.byte_ids

    def number_words(batches):
        hot = sent_parts.value
        n_hot = len(hot.parts)
        for batch in batches:
            words, rows = splitter.words(batch.column("text"))
            coded = words.dictionary_encode()
            parts, at = splitter.parts(coded.dictionary)
            which = coded.indices.to_numpy()
            of_word = np.concatenate([[0], np.cumsum(np.diff(at)[which])])
            told = parts.dictionary_encode()
            used = gather(told.indices.to_numpy(), at.astype(np.int64), which)  # the parts of all texts, end to end
            codes, rows = hot.of(told.dictionary)[used], of_word[rows]
            # other parts have numbers of their own in each row
            other = np.flatnonzero(codes < 0)
            row = np.searchsorted(rows, other, "right") - 1
            own, inverse = np.unique(row * len(told.dictionary) + used[other], return_inverse=True)
            own_row, own_part = np.divmod(own, max(1, len(told.dictionary)))
            first = np.searchsorted(own_row, np.arange(batch.num_rows + 1))
            codes[other] = n_hot + inverse - first[row]
            row_ids, columns = batch.column("row_id").to_numpy(), [[] for _ in range(5)]
            for row_id, k, word in zip(row_ids[own_row].tolist(), (np.arange(len(own)) - first[own_row]).tolist(), told.dictionary.take(pa.array(own_part)).to_pylist(), strict=True):
                for block, begin in enumerate(range(0, len(word), BLOCK)):
                    lead = min(begin, longest)
                    for column, value in zip(columns, (row_id, k, block, lead, word[begin - lead : begin + BLOCK]), strict=True):
                        column.append(value)
            n, more = batch.num_rows, len(columns[0])
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            plain = [pa.array(row_ids), *(pa.array(np.full(n, k, np.int32)) for k in (-1, 0, 0)), pa.nulls(n, pa.string())]
            numbers = pa.array([packed(codes[rows[k] : rows[k + 1]]) for k in range(n)], pa.binary())
            arrays = [pa.concat_arrays([a, pa.array(c, t)]) for a, c, t in zip(plain, columns, types, strict=True)]
            arrays += [pa.concat_arrays([batch.column("id"), pa.nulls(more, batch.schema.field("id").type)]), pa.concat_arrays([numbers, pa.nulls(more, pa.binary())])]
            yield pa.RecordBatch.from_arrays(arrays, names=["row_id", "word", "block", "lead", "part", "id", "numbers"])
            pa.default_memory_pool().release_unused()

    def assemble(batches):
        hot = sent_ids.value
        n_hot = len(hot.offsets) - 1
        for batch in batches:
            own = batch.column("own")
            per_row, spelled = own.value_lengths().to_numpy(zero_copy_only=False), own.flatten().field("ids")
            flat, offsets = expand(spelled.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(spelled.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), byte_ids)
            rows = [unpacked(x) for x in batch.column("numbers").to_pylist()]
            sizes = np.array([len(x) for x in rows], np.int64)
            which = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            frequent = which < n_hot
            other = (which + np.repeat(np.cumsum(per_row) - per_row - n_hot, sizes))[~frequent]
            lengths = np.empty(len(which), np.int64)
            lengths[frequent], lengths[~frequent] = (hot.offsets[1:] - hot.offsets[:-1])[which[frequent]], np.diff(offsets)[other]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            ids, is_hot = np.empty(int(ends[-1]), np.int32), np.repeat(frequent, lengths)
            ids[is_hot], ids[~is_hot] = gather(hot.ids, hot.offsets, which[frequent]), gather(flat, offsets, other)
            at = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["id", "ids"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = numbered.mapInArrow(in_slices(number_words, ROWS), _ROW.format(id=id_type)).repartition("row_id")
    encoded = encode_blocks(rows, ["row_id", "word", "id", "numbers"], model)
    own = F.sort_array(F.collect_list(F.when(F.col("word") >= 0, F.struct("word", "ids"))))
    whole = encoded.groupBy("row_id").agg(F.max("id").alias("id"), F.max("numbers").alias("numbers"), own.alias("own"))
    return whole.select("id", "numbers", "own").mapInArrow(in_slices(assemble), f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; bytes are joined to characters, the leading space goes.

    The vocabulary's bytes, of fixed size, travel with the task. Null or empty ids give an empty text; an id
    outside the vocabulary spells nothing; bytes that are no UTF-8 become U+FFFD.
    """
    spelled = [b""] * (model.size + 1)
    for piece, k, _ in model.pieces:
        spelled[k] = piece.replace(SPACE, " ").encode()
    for value, k in enumerate(model.byte_ids):
        spelled[k] = bytes([value])
    flat, offsets = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)])
    at = encoded.columns.index(ids_col)
    ship_package(encoded.sparkSession)

    def run(batches):
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                which = np.array([], np.int64) if not ids.is_valid else ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                which = np.where((which >= 0) & (which < model.size), which, model.size)
                text = gather(flat, offsets, which).tobytes().decode("utf-8", "replace")
                texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(in_slices(run), f"{schema}, `{text_col}` string")
