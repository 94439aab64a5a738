"""The pipeline's stages against brute force, with repeated ids, nulls, empty tables and extra columns."""

import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage over the documents and some odd rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None, None, None, None), (-2, "", "en", "a", 0), (None, "no id " * 20, "en", "a", 120), (-3, "one text", "en", "a", 8), (-3, "another text altogether", "en", "a", 23), (-4, "one  text", "en", "b", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).checkpoint()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).checkpoint())
    return dict(zip(["documents", *(n for n, _ in corpus_pipeline.STAGES)], out, strict=True))


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def norm(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def shingles(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def test_stages_keep_the_columns_of_documents(stages):
    for name in ("toxicity", "exact_dedup", "near_dedup", "secrets"):
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go(spark, stages):
    kept = {k for k, _ in rows(stages["toxicity"])}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k, toxic in labels.items() if not toxic]
    assert sum(k in kept for k in clean) >= 0.98 * len(clean)
    assert Counter(rows(stages["toxicity"])) <= Counter(rows(stages["documents"]))


def test_one_row_of_equal_texts_stays(stages):
    before, after = rows(stages["toxicity"]), rows(stages["exact_dedup"])
    texts = {norm(t) for _, t in before}
    assert Counter(norm(t) for k, t in after if k is not None) == Counter({norm(t) for k, t in before if k is not None})
    assert {norm(t) for _, t in after} == texts and Counter(after) <= Counter(before)


def test_one_document_of_near_copies_stays(stages):
    before, after = rows(stages["exact_dedup"]), rows(stages["near_dedup"])
    sets = [shingles(t) for _, t in before]
    root = list(range(len(before)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            small, large = sorted((sum(a.values()), sum(b.values())))
            if small and small >= 0.8 * large and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k, row in enumerate(before):
        groups.setdefault(find(k), set()).add(row)
    kept = Counter(after)
    assert all(sum(kept[r] for r in g) == 1 for g in groups.values()) and sum(kept.values()) == len(groups)


def test_live_secrets_are_replaced(stages):
    from leafmill.llm.secrets import scan_secrets

    before, after = dict(rows(stages["near_dedup"])), rows(stages["secrets"])
    assert len(after) == stages["near_dedup"].count()
    live = {r["doc_id"]: r["n_live"] for r in scan_secrets(stages["near_dedup"]).collect()}
    for k, text in after:
        if not live[k]:
            assert text == before[k]
        elif k is not None:
            assert "[SECRET]" in text
    assert sum(1 for n in live.values() if n) > 0


def test_every_kept_document_is_packed(stages):
    packed = {}
    for r in stages["packing"].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert set(packed) == {k for k, _ in rows(stages["secrets"])}


def test_stages_take_empty_tables(spark, stages):
    import corpus_pipeline

    docs = stages["documents"].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
