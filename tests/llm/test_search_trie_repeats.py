"""Ranked search, the prefix trie and substring dedup against plain versions, and their limits."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from parity import compare

SF = "/root/testdata/sf0.001"
CLASH = ("code long, item long, node long, grp long, print long, at long, row long, digest string, rank int, `a.b` string", (1, 2, 3, 4, 5, 6, 7, "x", 8, "y"))


def table(spark, rows, schema):
    return spark.createDataFrame([(*r, *CLASH[1]) for r in rows], f"{schema}, {CLASH[0]}")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_prefix_trie", "op13_substring_dedup"])
def test_query_equals_sql(spark, name):
    from leafmill.llm.queries import ORACLE_SQL, QUERIES

    compare(spark, QUERIES[name], ORACLE_SQL[name], SF)


# ranked search


def plain_ranks(docs, items, top):
    split = lambda text: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    counts = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, c), n in zip(counts, sizes, strict=True):
            m = 75 + (25 * n * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return out


def test_search_equals_plain_sums(spark, monkeypatch):
    from leafmill.llm import bit_sliced

    monkeypatch.setattr(bit_sliced, "BLOCK_DOCS", 7)
    monkeypatch.setattr(bit_sliced, "PIECE_BYTES", 50)
    monkeypatch.setattr(bit_sliced, "GROUP_BYTES", 400)
    rng = random.Random(3)
    words = ["Alpha", "beta", "ÄRGER", "été", "x1", "the", "the", "the", "日本", "z"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", "-_-", "!"])) for k in range(60)]
    docs += [(7, None), (8, ""), (None, "beta the the"), (9, "beta the the"), (9, "beta the the"), (100, "the " * 3000 + "w" * 4000), (101, "日本" * 2000)]
    items = [(k, " ".join(rng.choices([*words, "nowhere"], k=rng.randint(1, 12)))) for k in range(12)] + [(3, "the the the beta"), (3, "the the the beta"), (None, "été"), (20, None), (21, ""), (22, "...")]
    d, i = table(spark, docs, "doc_id long, text string").repartition(3), table(spark, items, "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in bit_sliced.rank_documents(d, i, top=5).collect()), key=key)
    assert got == sorted(plain_ranks(docs, items, 5), key=key)
    assert bit_sliced.rank_documents(d.limit(0), i).count() == 0 and bit_sliced.rank_documents(d, i.limit(0)).count() == 0


def test_planes_add_and_best():
    from leafmill.llm.bit_sliced import add, best

    rng = random.Random(1)
    for _ in range(50):
        sums, total = [0] * 90, []
        for _ in range(rng.randint(1, 6)):
            values, shift = [rng.choice([0, 0, rng.randint(0, 1 << 30), 5]) for _ in sums], rng.randint(0, 3)
            planes = [sum((v >> b & 1) << p for p, v in enumerate(values)) for b in range(31)]
            add(total, planes, shift)
            sums = [s + (v << shift) for s, v in zip(sums, values, strict=True)]
        for k in (1, 5, 90):
            want = sorted((p for p, s in enumerate(sums) if s), key=lambda p: (-sums[p], p))[:k]
            assert sorted(best(total, k)) == sorted(want)


# prefix trie


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    inner = {p[:-1] for p in members if p}
    out = []
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in who if len(convs[c]) == len(path))
        out.append((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), sum(len(p) == len(path) + 1 for p in below),
            sum(p not in inner for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def turns_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    return {c: [(t[3], t[4]) for t in sorted(ts, key=lambda t: t[:3])] for c, ts in convs.items()}


def trie_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(40), -7, -5, 1000]:
        for turn in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", None, ""]), rng.choice(["hé", "yes", "", None])))
    rows += [(200, t, "user", f"t{t % 2}") for t in range(150)] + [(201, t, "user", f"t{t % 2}") for t in range(130)]
    return rows + [(2, 0, "user", "yes"), (2, 0, "user", "yes"), (None, 0, "user", "lost"), (90, None, None, None)] + [(c, 0, "user", "yes") for c in range(96, 100)]


def test_trie_equals_plain_version(spark):
    from leafmill.llm import prefix_trie

    rows = trie_rows()
    frame = table(spark, rows, "conv_id long, turn long, role string, text string").repartition(3)
    own = turns_of(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(frame).collect()), key=key) == sorted(plain_trie(own), key=key)
    again = {}
    for c, turns in own.items():
        h, family = zlib.crc32(str(c).encode()) % 9, int(c / 5) * 5
        again[c] = own.get(family, [])[:h] + turns[h:]
    assert any(not t for t in again.values())
    assert sorted((tuple(r) for r in prefix_trie.rebuilt_conversation_trie(frame).collect()), key=key) == sorted(plain_trie(again), key=key)
    assert prefix_trie.rebuilt_conversation_trie(frame.limit(0)).count() == 0


def test_trie_of_one_common_conversation_in_chunks(spark, monkeypatch):
    from leafmill.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    convs = {c: [("user", "hello"), ("bot", "hi")] if c % 3 else [("user", "hello"), ("bot", str(c))] for c in range(100)}
    frame = spark.createDataFrame([(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in prefix_trie.conversation_trie(frame).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain_trie(convs), key=key)


# substring dedup


def plain_repeats(docs, n=20):
    split = [re.findall("[^\x20\x09-\x0d]+", text or "") for _, text in docs]
    first = {}
    for (doc_id, _), words in zip(docs, split, strict=True):
        for s in range(len(words) - n + 1):
            at = ((1 << 63) - 1 if doc_id is None else doc_id, s)
            key = tuple(words[s : s + n])
            first[key] = min(first.get(key, at), at)
    out = []
    for (doc_id, _), words in zip(docs, split, strict=True):
        gone = set()
        for s in range(len(words) - n + 1):
            if ((1 << 63) - 1 if doc_id is None else doc_id, s) > first[tuple(words[s : s + n])]:
                gone |= set(range(s, s + n))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("sizes", [None, (64, 2000, 300)])
def test_repeats_equal_plain_version(spark, monkeypatch, sizes):
    from leafmill.llm import suffix_trees

    if sizes:
        monkeypatch.setattr(suffix_trees, "GROUP_SUFFIXES", sizes[0])
        monkeypatch.setattr(suffix_trees, "LEAST_GROUPS", 1)
        monkeypatch.setattr(suffix_trees, "BLOCK_BYTES", sizes[1])
        monkeypatch.setattr(suffix_trees, "CHUNK_WINDOWS", sizes[2])
        monkeypatch.setattr(suffix_trees, "_PIECE", 100)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["é日本", "a\x1cb", "\xa0", "W1"]
    passage = [rng.choice(words) for _ in range(60)]
    docs = []
    for k in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if k % 3 == 0:
            cut = rng.randint(0, 35)
            text[5:5] = passage[cut : cut + rng.randint(18, 40)]
        docs.append((k, rng.choice([" ", "\n", " \t\r\x0b\x0c "]).join(text)))
    docs += [(5, docs[9][1]), (5, docs[9][1]), (None, docs[12][1]), (None, " ".join(passage)), (200, None), (201, ""), (202, "same " * 500), (203, "x" * 5000), (7, "other " + docs[7][1]), (204, "one two " * 15 + "end")]
    frame = table(spark, docs, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in suffix_trees.remove_repeats(frame).collect()), key=str)
    assert got == sorted(plain_repeats(docs), key=str)
    spans = {r["doc_id"]: r["repeats"] for r in suffix_trees.remove_repeats(frame.where("doc_id = 202")).collect()}[202]
    assert [(s["first"], s["n_words"]) for s in spans] == [(1, 499)]
    assert suffix_trees.remove_repeats(frame.limit(0)).count() == 0


def test_common_passage_sends_one_suffix_a_block(spark):
    """A passage in every document: what a group gets of one window is one suffix a chunk, however many documents."""
    import pyarrow as pa

    from leafmill.llm import suffix_trees

    text = " ".join(f"p{k}" for k in range(40)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array([b"%d " % k + text for k in range(3000)])], names=["id", "print", "text"])
    rows = [r for b in suffix_trees._deal([__import__("numpy").zeros(0, "uint64")] * 20, 4)([batch]) for r in b.to_pylist()]
    assert sum(r["n_sent"] for r in rows) == 3000 + 21  # one window a document is its own
    assert sum(r["n_again"] for r in rows) == 2999 * 21
