"""Packing: vector bin packing of token runs by the dot-product heuristic.

Every example has a vector of demands: tokens, segments (one per piece) and loss-bearing tokens. A
sequence has a limit on each. Whole sequences' worth of tokens are cut off long examples first; what
remains of each example is placed by the dot-product heuristic: of the pieces that fit, the open
sequence takes the one whose demand vector points most along the capacity that is left. When no piece
fits but room is left, a piece is cut to fill the room exactly, as examples may be cut freely.

Packing is local to a task's rows, in groups of bounded size, so it needs no shuffle and no task sees
more than its own partition. What a partition's last groups leave over is closed at powers of two, where
sequences need no padding; all other sequences are full unless a limit on segments or loss closes them. A limit on
segments pads where examples are short: with ``segments`` pieces of a few tokens each a sequence holds no more.
``PLAIN`` has none of its own (as many segments as tokens), for data where segments are not masked apart.

Ids are those of ``tokenizers`` with byte_bpe_50k.json, made by tiktoken from the same ranks; the added token
<|endoftext|> in a text is one id, as there.

Cases: null and empty texts have the single end-of-text id; very long texts are cut into many pieces;
rows with a repeated or null id are packed row by row; of pieces that point alike the first in the group is taken;
an empty table gives an empty result; columns other than the used ones are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import in_slices, ship_package

#: Fixed: the public pattern of this vocabulary with possessive quantifiers; it splits alike and faster.
PRETOKEN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PIECE_SCHEMA = "doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long, loss_tokens long"

#: Fixed: the added token of byte_bpe_50k.json, which ``tokenizers`` finds in any text, by the number of ranks before it.
ADDED_TOKENS = {50256: {"<|endoftext|>": 50256}}

_encoders: dict[str, object] = {}


@dataclass(frozen=True)
class PackingLimits:
    """Limits of one sequence, and how many examples one group of the heuristic holds."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    group: int = 2048


PLAIN = PackingLimits(segments=1024)


def encoder(path: str):
    """The byte-level BPE of a ``*.tiktoken`` rank file, with the added tokens that its JSON form has."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens=ADDED_TOKENS.get(len(ranks), {}))
    return _encoders[path]


class _Packer:
    """Open pieces of one partition, and the sequences built from them."""

    def __init__(self, limits: PackingLimits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.placed: list[tuple[int, int, int, int, int, int]] = []  # row, start, length, sequence, offset, loss
        self.open: list[tuple[int, int, int, int]] = []  # row, start, length, loss-bearing prefix begins at

    def add(self, row: int, n: int, loss_from: int) -> None:
        """An example of n tokens, of which those from ``loss_from`` on bear loss."""
        width = min(self.limits.tokens, self.limits.loss_tokens)
        at = 0
        while n - at >= width:
            self._place_alone(row, at, width, loss_from)
            at += width
        if at < n:
            self.open.append((row, at, n - at, loss_from))

    def _loss(self, start: int, length: int, loss_from: int) -> int:
        return max(0, start + length - max(start, loss_from))

    def _place_alone(self, row: int, start: int, length: int, loss_from: int) -> None:
        self.placed.append((row, start, length, self.next_id, 0, self._loss(start, length, loss_from)))
        self.next_id += 1

    def pack(self, last: bool) -> None:
        """Fill sequences from the open pieces; unless this is the last call, a rest stays open."""
        limits = self.limits
        row, start, length, loss_from = (np.array(x, dtype=np.int64) for x in zip(*self.open, strict=True)) if self.open else (np.zeros(0, np.int64),) * 4
        alive = np.ones(len(row), dtype=bool)
        loss = np.maximum(0, start + length - np.maximum(start, loss_from))
        need = np.stack([length, np.ones_like(length), loss], axis=1).astype(np.float64)
        self.open = []
        n_alive = len(row)
        while n_alive:
            if not last and length[alive].sum() < 2 * limits.tokens:
                break
            if last and length[alive].sum() < limits.tokens:
                self._close_at_powers([(int(row[k]), int(start[k]), int(length[k]), int(loss_from[k])) for k in np.flatnonzero(alive)])
                n_alive = 0
                break
            left, offset = self.caps.copy(), 0
            while n_alive:
                fits = alive & (need <= left).all(axis=1)
                if fits.any():
                    among = np.flatnonzero(fits)
                    k = among[np.argmax((need[among] / self.caps) @ (left / self.caps))]
                    take = int(length[k])
                elif left[0] >= 1 and left[1] >= 1 and left[2] >= 1:  # no piece fits: cut one to fill the room
                    among = np.flatnonzero(alive)
                    k = among[np.argmax(length[among])]
                    take = int(min(left[0], length[k], max(0, loss_from[k] - start[k]) + left[2]))
                else:
                    break
                bears = self._loss(int(start[k]), take, int(loss_from[k]))
                self.placed.append((int(row[k]), int(start[k]), take, self.next_id, offset, bears))
                offset += take
                left -= (take, 1, bears)
                start[k] += take
                length[k] -= take
                if length[k]:
                    need[k] = (length[k], 1, self._loss(int(start[k]), int(length[k]), int(loss_from[k])))
                else:
                    alive[k], n_alive = False, n_alive - 1
                if left[0] < 1:
                    break
            self.next_id += 1
        for k in np.flatnonzero(alive) if n_alive else ():
            self.open.append((int(row[k]), int(start[k]), int(length[k]), int(loss_from[k])))

    def _close_at_powers(self, pieces: list[tuple[int, int, int, int]]) -> None:
        """Sequences whose lengths are powers of two, as far as the other limits allow."""
        total = sum(p[2] for p in pieces)
        pieces = pieces[::-1]
        while pieces:
            room, offset, segments, loss_left = 1 << (total.bit_length() - 1), 0, self.limits.segments, self.limits.loss_tokens
            while pieces and room and segments and loss_left:
                row, start, length, loss_from = pieces.pop()
                take = min(length, room, max(0, loss_from - start) + loss_left)
                bears = self._loss(start, take, loss_from)
                self.placed.append((row, start, take, self.next_id, offset, bears))
                offset, room, segments, loss_left, total = offset + take, room - take, segments - 1, loss_left - bears, total - take
                if take < length:
                    pieces.append((row, start + take, length - take, loss_from))
            self.next_id += 1


def _pack_batches(tokenizer_path: str, limits: PackingLimits, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_to_numpy
        packer = _Packer(limits, TaskContext.get().partitionId() << 40)
        ids: dict[int, np.ndarray] = {}
        keys: dict[int, object] = {}
        waiting = seen = 0

        def ready(last: bool) -> pa.RecordBatch:
            packer.pack(last)
            out: list[tuple] = []
            for row, start, length, sequence, offset, loss in packer.placed:
                tokens = ids[row]
                out.append((keys[row], len(tokens), start, length, zlib.crc32(tokens[start : start + length].tobytes()), sequence, offset, loss))
            packer.placed = []
            still = {p[0] for p in packer.open}
            for row in [r for r in ids if r not in still]:
                del ids[row], keys[row]
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset", "loss_tokens"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("id").type
            for key, prompt, text in zip(batch.column("id").to_pylist(), batch.column("prompt").to_pylist(), batch.column("text").to_pylist(), strict=True):
                head = encode(prompt, allowed_special="all") if prompt else np.zeros(0, np.uint32)
                body = encode(text, allowed_special="all") if text else np.zeros(0, np.uint32)
                ids[seen] = np.concatenate([head, body, [end_id]]).astype("<u4")
                keys[seen] = key
                packer.add(seen, len(ids[seen]), len(head))
                seen += 1
                waiting += len(ids[seen - 1])
                if seen % limits.group == 0 or waiting > 4_000_000:
                    waiting = 0
                    yield ready(last=False)
        yield ready(last=True)

    return run


def pack_examples(examples: DataFrame, tokenizer_path: str, limits: PackingLimits = PackingLimits(), id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: where it lies in its example and in its sequence.

    ``prompt_col`` names text that stands before ``text_col`` and bears no loss (instruction data). An
    example's ids are those of prompt and text, then ``end_id``; each id lies in exactly one piece.
    """
    ship_package(examples.sparkSession)
    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    rows = examples.select(F.col(id_col).alias("id"), prompt.alias("prompt"), F.col(text_col).alias("text"))
    id_type = examples.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(in_slices(_pack_batches(tokenizer_path, limits, end_id)), f"id {id_type}, {PIECE_SCHEMA}").withColumnRenamed("id", id_col)
