"""A small full-text index: postings of tokens, and exact, prefix and id look-ups that fall back in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.running import cut

SEPARATORS = r"[\s\-_@#,.]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")


#: Characters of the texts whose terms a task counts.
PART_CHARS = 1_000_000


def _counted(texts: DataFrame, keys: list[str]) -> DataFrame:
    """term, the keys and tf of the tokens of texts (keys and ``__text``).

    Nearly every term of a row is a group of its own, so counting before the shuffle saves nothing and holds all of them;
    rows are dealt before they are taken apart, and terms before they are counted, by so many partitions that a task's
    share stays the same whatever the input's size and the files it comes in.
    """
    chars = texts.agg(F.sum(F.length("__text").cast("long"))).first()[0] or 0  # one row
    parts = 1 + max(chars // PART_CHARS, min(texts.sparkSession.sparkContext.defaultParallelism, chars // 50_000))
    terms = texts.repartition(parts, *keys, "__text").select(*keys, F.explode(tokens(F.col("__text"))).alias("term"))
    return terms.repartition(parts, "term", *keys).groupBy("term", *keys).agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key and tf."""
    return _counted(docs.select(F.col(key), F.col(text).alias("__text")), [key])


def query_terms(query: str) -> list[str]:
    return [t for t in query.strip().replace(":", " ").lower().split() if t]


def search(index: DataFrame, key: str, query: str, ids: DataFrame | None = None) -> DataFrame:
    """key and score (sum of tf) of the documents that have a term of the query; a trailing ``*`` is a prefix.

    Without hits the words over two letters become prefixes; without hits again, a query of over ten
    characters is looked up as an id (``ids`` has key and id_text). The term filter reaches the postings' scan.
    """

    def hits(terms: list[str]) -> DataFrame:
        fits = F.lit(False)
        for t in terms:
            fits = fits | (F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t)
        return index.where(fits).groupBy(key).agg(F.sum("tf").alias("score"))

    terms = query_terms(query)
    found = cut(hits(terms))
    if "*" in query or not found.isEmpty():
        return found
    found = cut(hits([t + "*" if len(t) > 2 else t for t in terms]))
    bare = query.strip().replace("_", "").replace("-", "").lower()
    if ids is None or len(bare) <= 10 or not found.isEmpty():
        return found
    plain = F.translate(F.lower("id_text"), "_-", "")
    return ids.where(plain == bare).select(key, F.lit(1).cast("long").alias("score"))


def field_postings(nodes: DataFrame, ref: str, id_col: str, title: str) -> DataFrame:
    """term, field (id, id2, title), ref and tf: the id as it is and without ``_`` and ``-``, and the title's tokens."""
    fields = F.array(
        F.struct(F.lit("id").alias("field"), F.col(id_col).cast("string").alias("text")),
        F.struct(F.lit("id2").alias("field"), F.translate(F.col(id_col).cast("string"), "_-", "").alias("text")),
        F.struct(F.lit("title").alias("field"), F.col(title).alias("text")),
    )
    each = nodes.select(F.col(ref).alias("ref"), F.inline(fields)).where("text is not null").withColumnRenamed("text", "__text")
    return _counted(each, ["field", "ref"])


def bm25(index: DataFrame, key: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the documents that have a term, by BM25 over the postings (term, key, tf)."""
    lengths = index.groupBy(key).agg(F.sum("tf").alias("length"))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    hits = index.where(F.col("term").isin(terms))
    often = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(often), "term").join(lengths, key).crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.groupBy(key).agg(F.sum(score).alias("score"))


def with_store(found: DataFrame, store: DataFrame, key: str, prefix: str) -> DataFrame:
    """The hits with the columns of the store, and the path under a prefix, best first."""
    return found.join(store, key).withColumn("path", F.concat(F.lit(prefix), F.col("path"))).orderBy(F.desc("score"), key)
