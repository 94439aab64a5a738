"""Edge cases and brute-force comparisons of the corpus operators on small fixtures."""

import hashlib
import os
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from parity import compare

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node long"
WORDS = [f"word{k}" for k in range(400)]
BASE = " ".join(WORDS[:200])
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "b"), (3, BASE.replace("word7 ", "changed "), "en", "a"), (4, None, None, None), (5, "", "en", None),
    (6, " ".join(WORDS[200:]), "de", "c"), (7, "token = abcdefghijkl1234", None, "a"), (8, "x " * 5000, "en", "b"), (6, " ".join(WORDS[200:]), "de", "c"), (None, "no id here", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 9) for r in ROWS], SCHEMA)


def _shingle_set(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    runs = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    return {(r, runs[:k].count(r)) for k, r in enumerate(runs)}


@pytest.mark.parametrize("name", ["op8_secrets", "op10_exact_dedup"])
def test_sql_parity(spark, name):
    from leafmill.llm.queries import ORACLE_SQL, QUERIES

    compare(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_exact_dedup_cases(docs):
    from leafmill.llm.exact_dedup import exact_dedup

    rows = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert rows[2]["keep_id"] == 1 and not rows[2]["kept"] and rows[1]["group_size"] == 2
    assert rows[5]["keep_id"] == 4 and rows[4]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup(docs.limit(0)).count() == 0


def test_near_dedup_equals_brute_force(spark):
    from leafmill.llm.minhash import near_duplicates

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: _shingle_set(r["text"]) for r in docs.select("doc_id", "text").collect()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = texts[a], texts[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()} == {k: root(k) for k in ids}


def test_near_dedup_cases(docs):
    from leafmill.llm.minhash import near_duplicates

    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r["class_id"] for r in rows}
    assert found[1] == found[2] == found[3] == 1 and found[4] == 4 and found[5] == 5
    assert near_duplicates(docs.limit(0)).count() == 0


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmill.llm.packing import pack_examples

    rows = pack_examples(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] or "" for r in ROWS}
    filled = {}
    for r in rows:
        ids = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["doc_tokens"] == len(ids)
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 1)


def test_packing_ids_equal_tokenizers(spark):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from leafmill.llm.packing import encoder, pack_examples

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n\n z ", "<|endoftext|", "<|ENDOFTEXT|>"]
    parts = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u0085", "\x1c", "\u200b", "it's", "'LL", "'re", "12", "\u0664", "\u00bd", "e\u0301", "\u0905\u093f", "\u4e2d", "\U0001f600", "_", "...", "Ab", "\x00"]
    dice = random.Random(7)
    texts += ["".join(dice.choices(parts, k=dice.randrange(1, 30))) for _ in range(2000)]
    texts += ["".join(chr(dice.choice([dice.randrange(0x80), dice.randrange(0xD800), dice.randrange(0xE000, 0x110000)])) for _ in range(60)) for _ in range(500)]
    encode = encoder(path).encode_to_numpy
    assert [t for t in texts if encode(t, allowed_special="all").tolist() != tokenizer.encode(t, add_special_tokens=False).ids] == []
    rows = pack_examples(spark.createDataFrame(list(enumerate(texts[:5])), "doc_id long, text string"), path).collect()
    for k, text in enumerate(texts[:5]):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        pieces = [r for r in rows if r["doc_id"] == k]
        assert {r["doc_tokens"] for r in pieces} == {len(ids)} == {sum(r["length"] for r in pieces)}
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]]))


def test_secrets_cases(docs):
    from leafmill.llm.secrets import redact_secrets, scan_secrets

    rows = {r["doc_id"]: r for r in scan_secrets(docs).collect()}
    assert rows[7]["n_assign"] == 1 and rows[7]["spans"] == "assign:0:24" and rows[4]["spans"] == ""
    cleaned = redact_secrets(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    assert [r["text"] for r in cleaned.where("doc_id = 7").collect()] == ["[SECRET]"]


def test_embedding_dedup_equals_brute_force(spark):
    import numpy as np

    from leafmill.llm.embedding_dedup import embedding_near_duplicates

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: r["n_links"] for r in embedding_near_duplicates(table).collect()}
    data = table.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in data], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    assert rows == {r["vec_id"]: int(k) for r, k in zip(data, n, strict=True)}


def test_embedding_cases(spark):
    from leafmill.llm.embedding_dedup import embedding_near_duplicates

    rows = [(1, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (3, [0.0, 0.0], 5), (4, None, 5), (5, [float("nan"), 1.0], 5), (6, [], 5), (7, [0.0, 1.0], None)]
    found = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_sentencepiece_equals_library(docs):
    import public_tokenizers
    import sentencepiece

    from leafmill.llm.sentencepiece_lattice import PieceModel, decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library = PieceModel.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = decode(encode(docs.where("length(text) < 2000 or text is null"), model), model).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {r["doc_id"]: library.encode(texts[r["doc_id"]]) for r in rows}


def test_licenses_base_labels(docs, spark):
    from leafmill.llm.licenses import scan_licenses

    rows = spark.createDataFrame([(1, "The MIT License and the Apache  license."), (2, None), (3, "GNU General Public License v3")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in scan_licenses(rows).collect()}
    assert found[1]["base_labels"] == "apache,mit" and (found[1]["first_word"], found[1]["last_word"]) == (1, 5) and found[1]["n_words"] == 7
    assert found[2]["n_words"] == 0 and found[3]["base_labels"] == "gpl"


def _sample(parsed, dice):
    """A random text that a parsed pattern matches; what lookarounds ask for is left to the caller."""
    from re import _constants as c

    out = ""
    for op, of in parsed:
        if op is c.LITERAL:
            out += chr(of)
        elif op is c.IN:
            kind, value = dice.choice(of)
            out += " " if kind is c.CATEGORY else chr(value if kind is c.LITERAL else dice.choice([x for x in range(value[0], min(value[1], 0x2FF) + 1) if not 65 <= x <= 90]))
        elif op is c.SUBPATTERN:
            out += _sample(of[-1], dice)
        elif op is c.BRANCH:
            out += _sample(dice.choice(of[1]), dice)
        elif op in (c.MAX_REPEAT, c.POSSESSIVE_REPEAT):
            out += "".join(_sample(of[2], dice) for _ in range(dice.randint(of[0], min(of[1], of[0] + 20))))
        else:
            assert op is c.ASSERT_NOT, op
    return out


def test_licenses_gates_let_every_match_through():
    import random
    from re._parser import parse

    from leafmill.llm.licenses import _compiled, _gates, rules

    dice, automaton = random.Random(5), _compiled()[0]
    for rule in rules():
        parsed, matched = parse(rule.pattern), 0
        for _ in range(20):
            text = _sample(parsed, dice)
            if re.search(rule.pattern, text):
                matched += 1
                assert [g for g in _gates(rule) if g not in text.encode()] == [], (rule, text)
                assert _gates(rule)[0] in {literal for _, literal in automaton.iter(text)}, (rule, text)
        assert matched, rule


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("The software is provided as is, without warranty of any kind", "mit"),
        ("Berkeley Software Distribution", "bsd"), ("ASL 2.0", "apache-2.0"), ("Unauthorized copying of this file", "proprietary"), ("Free Software Foundation", "gpl"),
        ("either version 3 of the License, or (at your option) any later version", "gpl-3.0"), ("either version 2 of the License, or any later version", "gpl-2.0"),
        ("Mozilla Public\n *\n * ------------------\n * License, v. 2.0", "mpl-2.0"), ("SPDX-License-Identifier:" + " " * 40 + "MIT", "mit"), ("GPL 3.0" + " " * 30 + "+", "gpl-3.0-or-later"),
    ],
)
def test_licenses_phrases_alone_and_wide_gaps(text, label):
    from leafmill.llm.licenses import scan_text

    assert label in scan_text(text)["labels"].split(",")


def test_language_and_url_cases(docs, spark):
    from leafmill.llm.language import language_report
    from leafmill.llm.url_filter import filter_urls

    found = {r["doc_id"]: r for r in language_report(docs).collect()}
    assert found[4]["lang_pred"] == "und" and found[5]["lang_pred"] == "und"
    urls = [(1, "http://A.Example.org/es/x"), (2, "https://example.org/en/12?q"), (3, "http://x.com/fr/"), (4, None), (5, "plain"), (6, "http://a.net/zz")]
    rows = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert (rows[1]["host"], rows[1]["rule"], rows[1]["verdict"]) == ("a.example.org", "example.org/es/", "block")
    assert rows[2]["rule"] == "example.org/en/1" and rows[3]["rule"] == "com/fr/" and rows[4]["host"] == "" and rows[5]["rule"] is None


def test_toxicity_held_out(spark):
    from leafmill.llm.queries import op1_toxicity

    rows = {r["doc_id"]: r for r in op1_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(rows[k]["predicted"], v) for k, v in labels.items() if rows[k]["held_out"]]
    assert sum(p == y for p, y in judged) >= 0.9 * len(judged)


def test_pipeline_stages_with_repeated_ids(spark):
    from corpus_pipeline import exact_copies, near_copies

    near, lone = BASE.replace("word7 ", "changed "), " ".join(WORDS[200:])
    rows = [(1, BASE), (2, BASE), (2, lone), (3, "twice"), (3, "twice"), (4, " twice "), (5, "a  b"), (5, "a b"), (None, "no id"), (None, "no id"), (9, None), (9, "")]
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = exact_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
    assert found == sorted([(1, BASE), (2, lone), (4, " twice "), (5, "a  b"), (None, "no id"), (None, "no id"), (9, "")], key=str)
    rows = [(1, BASE), (2, near), (2, lone), (3, "of its own"), (3, "of its own"), (4, lone + " more")]
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], docs.schema)
    found = near_copies(spark, docs, SF).select("doc_id", "text").collect()
    groups = [{(1, BASE), (2, near)}, {(2, lone), (4, lone + " more")}, {(3, "of its own")}]
    assert len(found) == 3 and all(len(g & {tuple(r) for r in found}) == 1 for g in groups)
