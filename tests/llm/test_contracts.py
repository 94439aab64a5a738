"""Column names that clash, short texts and scripts that no model has learnt."""

import numpy as np
from pyspark.sql import functions as F


def odd_columns(spark, rows):
    frame = spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 3}", len(t or ""), 1, "h", "dot", "tick", "r") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __row_key int, __text_hash string, `a.b` string, `t``k` string, row string")
    return frame


def test_pipeline_stages_take_columns_of_any_name(spark):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (2, text), (2, text + " more words here"), (2, text), (3, text + " end"), (4, None), (None, text), (5, "password = abcdefghijkl12345")]
    docs = odd_columns(spark, rows)
    exact = corpus_pipeline.exact_copies(spark, docs, "")
    assert exact.columns == docs.columns and {(r["doc_id"], r["a.b"], r["t`k"], r["row"], r["__text_hash"]) for r in exact.collect()} == {(k, "dot", "tick", "r", "h") for k in (1, 2, 3, 4, None, 5)}
    near = corpus_pipeline.near_copies(spark, exact, "")
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {1, 4, None, 5}
    assert corpus_pipeline.secrets(spark, near, "").columns == docs.columns


def test_short_texts_leave_little_padding(spark):
    from leafmill.llm.packing import PLAIN, _Packer

    rng = np.random.default_rng(3)
    for low, high in ((1, 21), (5, 11), (3, 4), (1, 2), (1, 3000)):
        packer = _Packer(PLAIN, 0)
        for row, n in enumerate(rng.integers(low, high, 3000).tolist()):
            packer.add(row, n, 0)
            if row % 2048 == 2047:
                packer.pack(False)
        packer.pack(True)
        filled = {}
        for _, _, length, sequence, offset, _ in packer.placed:
            assert filled.get(sequence, 0) == offset
            filled[sequence] = offset + length
        padded = sum(0 if n & (n - 1) == 0 else 1024 - n for n in filled.values())
        assert padded == 0 and max(filled.values()) <= 1024


def test_language_of_scripts_that_nothing_taught(spark):
    from leafmill.llm.language import predict, train

    rows = [(k, "the cat sat on the mat and the dog ran", "en") for k in range(20)] + [(k, "der hund und die katze sind nicht hier", "de") for k in range(20, 40)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [(1, "собака бежит домой"), (2, "狗在这里"), (3, "the dog собака"), (4, "the cat and the dog"), (5, None), (6, "12 34")]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert found[1][1] == 0 and found[2][1] == 0 and found[3] == ("en", 2 / 3) and found[4] == ("en", 1.0) and found[5] == found[6] == ("und", 0.0)


def test_many_languages_keep_their_buckets(spark):
    from leafmill.llm.language import LanguageSettings, predict, train

    words = [f"q{a}x{b}" for a in "bcdfghjk" for b in "lmnpr"]
    rows = [(k, " ".join([w, w + "a", w + "e"] * 4), f"l{k:02d}") for k, w in enumerate(words)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 40 and model.settings.bits == LanguageSettings().bits
    docs = spark.createDataFrame([(k, f"{w}a {w}e {w}") for k, w in enumerate(words)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in predict(docs, model).collect()} == {k: f"l{k:02d}" for k in range(40)}


def test_hot_value_joins_can_be_split(spark):
    """Both sides of the joins that bring a value's or a text's class back come straight from their own exchanges."""
    from leafmill.llm.secrets import judge_candidates

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(3000).select(F.col("id").alias("row_id"), F.col("id").alias("doc_id"), (F.col("id") % 9).cast("string").alias("owner"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("value_hash"))
        judged = judge_candidates(rows)
        lines = judged._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
        assert not any("HashAggregate" in line for line in lines[at:])
        assert judged.where("value_hash = 'hot' and not live").count() == 1000 and judged.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
