"""Vectorised tokenising and hashing of words, used inside Arrow batches.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
Everything works on the UTF-8 bytes of many texts at once, so no Python loop touches single words.
Texts are hashed in slices of bounded size, cut between words, so a very long text needs memory in
proportion to its words (8 bytes each), not to a multiple of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("A") : ord("Z") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_edges(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words begin and end."""
    flags = np.zeros(len(buf) + 2, dtype=np.int8)
    flags[1:-1] = _IS_WORD[buf]
    step = np.diff(flags)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of one buffer, equal for equal bytes wherever they stand."""
    up, down = _power_tables(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _slices(data: bytes) -> Iterator[bytes]:
    """Pieces of about SLICE_BYTES that end between words; a longer single word stays whole."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        if end < len(data):
            flags = _IS_WORD[np.frombuffer(data, np.uint8, end - at, at)]
            gaps = np.flatnonzero(~flags)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and _IS_WORD[data[end]]:
                    end += 1
        yield data[at:end]
        at = end


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the offsets at which each text's words begin.

    ``None`` counts as an empty text. The offsets have one entry more than there are texts.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    group: list[bytes] = []
    members: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, members, size
        if not group:
            return
        buf = np.frombuffer(b"\n".join(group), np.uint8)
        starts, ends = word_edges(buf)
        hashes.append(span_hashes(buf, starts, ends))
        bounds = np.cumsum([0] + [len(g) + 1 for g in group])
        found = np.searchsorted(starts, bounds)
        for k, doc in enumerate(members):
            counts[doc + 1] += found[k + 1] - found[k]
        group, members, size = [], [], 0

    for doc, text in enumerate(texts):
        if not text:
            continue
        for piece in _slices(text.lower().encode("utf-8", "replace")):
            if size and size + len(piece) > SLICE_BYTES:
                flush()
            group.append(piece)
            members.append(doc)
            size += len(piece)
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside each text, and each text's offsets into them."""
    lengths = np.maximum(np.diff(offsets) - (n - 1), 0)
    out_offsets = np.concatenate([[0], np.cumsum(lengths)])
    if len(words) < n:
        return np.zeros(0, np.uint64), out_offsets
    total = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        total = mix(total * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
    keep = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(keep, offsets[:-1][lengths > 0], 1)
    np.add.at(keep, (offsets[:-1] + lengths)[lengths > 0], -1)
    inside = np.cumsum(keep)[: len(total)] > 0
    return total[inside], out_offsets
