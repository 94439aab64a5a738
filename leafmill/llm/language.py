"""Language ID: script ranges narrow candidates, then Viterbi over per-word scores.

Words are runs of letters, digits and non-ASCII characters. The script of a word leaves only languages
that were seen to write words in that script. Each word is scored per language by smoothed byte n-grams
inside the word (with its ends marked), and Viterbi with a switching penalty labels every word, so spans
of mixed-language text come out with their ends. The predicted language holds most words of the path.

Counts for the model come from at most ``max_training_rows`` labelled rows (chosen by a hash of the id); what is
collected is bounded by their texts. It has ``4 * 2 ** bits`` numbers a language, 1 MB with the default (three
times that on the driver while it learns), whatever the number of languages.

The score is the share of lettered words that are of the predicted language and of a script that some learnt language
writes: a text in scripts that none of them writes scores 0.

Cases: ``und`` with score 0 for a null text, a text without a letter (Unicode category L; ``½`` is none), and
all texts when nothing could be learnt; rows of a null language teach nothing; repeated rows are predicted row
by row; ties go to the language first in order; an empty table gives an empty result; columns other than the
three used are ignored, whatever their names; very long texts are hashed in slices and keep a byte per word and
language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.session import held_out, in_slices, ship_package
from leafmill.llm.wordhash import SLICE_BYTES, _slices, mix, span_hashes, word_edges

#: Unicode ranges of scripts (first, last, script); letters elsewhere count as "other".
SCRIPT_RANGES = (
    (0x0041, 0x005A, "latin"), (0x0061, 0x007A, "latin"), (0x00C0, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"),
    (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x07BF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)
SCRIPTS = ["none", "latin", "other", *dict.fromkeys(s for _, _, s in SCRIPT_RANGES if s != "latin")]
ORDERS = (1, 2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
_CHUNK_CHARS = 6 << 20


@dataclass(frozen=True)
class LanguageSettings:
    bits: int = 16
    smoothing: float = 0.3
    switch_penalty: float = 9.0
    script_share: float = 0.002
    max_training_rows: int = 20_000


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities per order and bucket (rows) and language (columns); scripts each language writes."""

    languages: tuple[str, ...]
    table: np.ndarray
    writes: np.ndarray
    settings: LanguageSettings


def _script_codes() -> np.ndarray:
    """Script number by the first two bytes of a UTF-8 character."""
    codes = np.zeros(1 << 16, dtype=np.uint8)
    codes[0x80 << 8 :] = SCRIPTS.index("other")
    codes[0x80 << 8 : 0xC2 << 8] = 0  # continuation bytes
    for first, last, script in SCRIPT_RANGES:
        for point in range(first, last + 1, 1 if last < 0x800 else 16):
            data = (chr(point) + "  ").encode()
            if len(data) == 3:
                codes[data[0] << 8 : (data[0] << 8) + 256] = SCRIPTS.index(script)
            else:
                codes[data[0] << 8 | data[1]] = SCRIPTS.index(script)
    return codes


_CODES = _script_codes()


class Words:
    """The words of some texts: which distinct word stands at each place, and each text's offsets."""

    def __init__(self, texts: list[str | None]):
        hashes, spans, counts = [], [], np.zeros(len(texts) + 1, dtype=np.int64)
        group, members, size = [], [], 0

        def flush() -> None:
            nonlocal group, members, size
            if not group:
                return
            data = b"\n".join(group)
            buf = np.frombuffer(data, np.uint8)
            starts, ends = word_edges(buf)
            found = span_hashes(buf, starts, ends)
            distinct, first = np.unique(found, return_index=True)
            hashes.append(found)
            spans.append((distinct, [data[starts[k] : ends[k]] for k in first]))
            cuts = np.searchsorted(starts, np.cumsum([0] + [len(g) + 1 for g in group]))
            for k, doc in enumerate(members):
                counts[doc + 1] += cuts[k + 1] - cuts[k]
            group, members, size = [], [], 0

        for doc, text in enumerate(texts):
            for piece in _slices(text.lower().encode("utf-8", "replace")) if text else ():
                if size and size + len(piece) > SLICE_BYTES:
                    flush()
                group.append(piece)
                members.append(doc)
                size += len(piece)
        flush()
        self.offsets = np.cumsum(counts)
        all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.distinct, self.place = np.unique(all_hashes, return_inverse=True)
        self.spelled: list[bytes] = [b""] * len(self.distinct)
        for keys, words in spans:
            for k, word in zip(np.searchsorted(self.distinct, keys).tolist(), words, strict=True):
                self.spelled[k] = word

    def ngrams(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct word: bucket rows of its n-grams (orders x bytes), where each word begins, its script."""
        data = b" " + b" ".join(self.spelled) + b"    "
        buf = np.frombuffer(data, np.uint8)
        starts = np.cumsum([1] + [len(w) + 1 for w in self.spelled])[:-1] if self.spelled else np.zeros(0, np.int64)
        n = len(buf) - 4
        rows = np.empty((len(ORDERS), n), dtype=np.int64)
        packed = np.zeros(n, dtype=np.uint64)
        for k, order in enumerate(ORDERS):
            packed = packed << np.uint64(8) | buf[order - 1 : order - 1 + n].astype(np.uint64)
            rows[k] = (mix(packed + np.uint64(order << 40)) >> np.uint64(64 - bits)).astype(np.int64) + (k << bits)
        pairs = buf[:-1].astype(np.uint16) << np.uint16(8) | buf[1:]
        script = np.maximum.reduceat(_CODES[pairs], starts) if len(starts) else np.zeros(0, np.uint8)
        return rows[:, :n], starts - 1, script


def _count_batches(bits: int):
    """Sums of n-gram buckets and scripts by language, one set of rows per batch."""

    def run(batches):
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                words = Words([texts[k] for k in np.flatnonzero(langs == lang)])
                if not len(words.distinct):
                    continue
                times = np.bincount(words.place, minlength=len(words.distinct))
                rows, starts, script = words.ngrams(bits)
                letters = script > 0
                weight = np.repeat(times * letters, np.diff(np.append(starts, rows.shape[1])))
                sums = np.zeros(len(ORDERS) << bits, dtype=np.int64)
                for k in range(len(ORDERS)):
                    sums += np.bincount(rows[k][: len(weight)], weights=weight, minlength=len(sums)).astype(np.int64)
                used = np.flatnonzero(sums)
                by_script = np.bincount(script, weights=times, minlength=len(SCRIPTS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(used) + len(SCRIPTS)), pa.string()), pa.array(np.append(used, -1 - np.arange(len(SCRIPTS)))), pa.array(np.append(sums[used], by_script))],
                    names=["lang", "bucket", "n"],
                )

    return run


def train(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on rows with a language; give only rows that may be learnt from."""
    ship_package(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    total = rows.count()
    if total > settings.max_training_rows:
        share = settings.max_training_rows / total
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * share))
    counted = rows.select("lang", "text").mapInArrow(in_slices(_count_batches(settings.bits), 4096), "lang string, bucket long, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # of at most max_training_rows texts
    languages = tuple(sorted(sums["lang"].unique()))
    table = np.zeros((len(ORDERS) << settings.bits, len(languages)), dtype=np.float64)
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    column = sums["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64)
    bucket, n = sums["bucket"].to_numpy(np.int64), sums["n"].to_numpy(np.float64)
    table[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    scripts[-1 - bucket[bucket < 0], column[bucket < 0]] = n[bucket < 0]
    for k in range(len(ORDERS)):
        part = table[k << settings.bits : (k + 1) << settings.bits]
        part[:] = np.log((part + settings.smoothing) / (part.sum(axis=0) + settings.smoothing * (1 << settings.bits)))
    writes = scripts >= settings.script_share * np.maximum(scripts[1:].sum(axis=0), 1)
    return LanguageModel(languages, table.astype(np.float32), writes, settings)


def word_scores(words: Words, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each distinct word in each language, averaged over orders; and its script."""
    if not len(words.distinct):
        return np.zeros((0, len(model.languages)), np.float32), np.zeros(0, np.uint8)
    rows, starts, script = words.ngrams(model.settings.bits)
    total = np.zeros((len(starts), len(model.languages)), dtype=np.float32)
    for at in range(0, len(starts), 50_000):
        first, last = starts[at], starts[at + 50_000] if at + 50_000 < len(starts) else rows.shape[1]
        part = sum(model.table[rows[k, first:last]] for k in range(len(ORDERS)))
        total[at : at + 50_000] = np.add.reduceat(part, starts[at : at + 50_000] - first, axis=0) / 2
    allowed = model.writes[script]
    total[~allowed & allowed.any(axis=1, keepdims=True)] = -1e4
    total[script == 0] = 0
    return total, script


def viterbi(scores: np.ndarray, place: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word of every text; all texts advance together, longest first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = offsets[:-1][order], lengths[order]
    path = np.zeros(len(place), dtype=np.uint8 if scores.shape[1] < 256 else np.uint16)
    stay = np.zeros((len(place), scores.shape[1]), dtype=bool)
    best_before = np.zeros(len(place), dtype=path.dtype)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    value = np.zeros((len(order), scores.shape[1]))
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        v = value[:m]
        top = v.argmax(axis=1)
        switch = v[np.arange(m), top] - penalty
        keep = v >= switch[:, None]
        stay[at], best_before[at] = keep, top
        value[:m] = np.where(keep, v, switch[:, None]) + scores[place[at]]
    state = value.argmax(axis=1).astype(path.dtype)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        now = state[:m]
        path[at] = now
        state[:m] = np.where(stay[at, now], now, best_before[at])
    return path


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred``, ``score`` (share of words in it) and ``spans`` of words.

    ``spans`` lists runs of one language as ``lang:first:end`` in word numbers from 0, end exclusive.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def one_chunk(texts: list[str | None], model: LanguageModel):
        if not model.languages:
            yield from (("und", 0.0, "") for _ in texts)
            return
        words = Words(texts)
        scores, script = word_scores(words, model)
        path = viterbi(scores, words.place, words.offsets, model.settings.switch_penalty)
        lettered = script[words.place] > 0 if len(words.place) else np.zeros(0, bool)
        written = lettered & model.writes.any(axis=1)[script[words.place]] if len(words.place) else lettered
        n_langs = len(model.languages)
        for k, text in enumerate(texts):
            a, b = words.offsets[k], words.offsets[k + 1]
            if not text or a == b or not _LETTER.search(text):
                yield "und", 0.0, ""
                continue
            own, real, learnt = path[a:b], lettered[a:b], written[a:b]
            votes = np.bincount(own[learnt] if real.any() else own, minlength=n_langs)
            edges = np.flatnonzero(np.diff(own)) + 1
            bounds = [0, *edges.tolist(), len(own)]
            spans = ",".join(f"{model.languages[own[i]]}:{i}:{j}" for i, j in zip(bounds, bounds[1:], strict=False))
            yield model.languages[votes.argmax()], float(votes.max() / (real.sum() or b - a)), spans

    def run(batches):
        for batch in batches:
            texts, out, start, size = batch.column("text").to_pylist(), [], 0, 0
            for k, text in enumerate(texts):
                size += len(text or "")
                if size >= _CHUNK_CHARS or k + 1 == len(texts):
                    out += one_chunk(texts[start : k + 1], sent.value)
                    start, size = k + 1, 0
            lang, score, spans = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], names=["id", "lang_pred", "score", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(in_slices(run), f"id {id_type}, lang_pred string, score double, spans string").withColumnRenamed("id", id_col)


def language_report(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> DataFrame:
    """Predictions for all documents by a model learnt from those that are not held out."""
    model = train(docs.where(~held_out()), settings)
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
