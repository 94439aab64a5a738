"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.language import language_report

    return language_report(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from leafmill.llm.packing import PLAIN, pack_examples

    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json
    pieces = pack_examples(_table(spark, sf_dir, "documents"), tokenizer_path, PLAIN)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.embedding_dedup import embedding_near_duplicates

    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    from leafmill.llm.sentencepiece_lattice import PieceModel, decode, encode

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    model = PieceModel.load(model_path)
    decoded = decode(encode(_table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.secrets import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.bit_sliced import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.prefix_trie import rebuilt_conversation_trie

    return rebuilt_conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.llm.suffix_trees import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}


def _secrets_sql() -> str:
    """The secret scan as SQL: matches and gaps by kind, running sums, ownership counts, spans.

    The base kinds have the contract's patterns, whose short matches the length condition drops.
    """
    from leafmill.llm.secrets import KINDS, MAX_LIVE_DOCS, MAX_LIVE_OWNERS

    contract = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    parts = []
    for k, kind in enumerate(KINDS):
        pattern = contract.get(kind.name, kind.pattern).replace("'", "''")
        parts.append(f"""
            SELECT doc_id, owner, {k} AS kind, '{kind.name}' AS name, {kind.least} AS least, {str(kind.base).lower()} AS base,
                   unnest(regexp_extract_all(text, '{pattern}', 0)) AS found, unnest(regexp_extract_all(text, '{pattern}', {kind.group})) AS value,
                   unnest(list_transform(string_split_regex(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}', 0))], lambda x: length(x))) AS gap,
                   unnest(range(len(regexp_extract_all(text, '{pattern}', 0)))) AS pos
            FROM docs""")
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(source, chr(1)) AS owner, coalesce(text, '') AS text FROM documents),
        matches AS ({" UNION ALL ".join(parts)}),
        placed AS (SELECT *, sum(gap + length(found)) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS end_at FROM matches),
        candidates AS (SELECT *, CAST(end_at - length(found) AS BIGINT) AS start, sha256(value) AS value_hash FROM placed WHERE length(value) >= least),
        owners AS (
            SELECT value_hash, count(DISTINCT owner) AS n_owners, count(DISTINCT concat(owner, chr(2), coalesce(CAST(doc_id AS VARCHAR), ''))) AS n_docs
            FROM candidates GROUP BY value_hash
        ),
        judged AS (SELECT c.*, n_owners <= {MAX_LIVE_OWNERS} AND n_docs <= {MAX_LIVE_DOCS} AS live, concat(name, ':', start, ':', CAST(end_at AS BIGINT)) AS span
                   FROM candidates c JOIN owners USING (value_hash)),
        kept AS (SELECT * FROM judged WHERE base OR live)
        SELECT d.doc_id, count(*) FILTER (k.name = 'assign') AS n_assign, count(*) FILTER (k.name = 'access') AS n_access,
               count(*) FILTER (k.name = 'hex') AS n_hex,
               sha256(coalesce(string_agg(k.span, ',' ORDER BY k.start, k.kind) FILTER (k.base), '')) AS base_sha256,
               coalesce(string_agg(k.span, ',' ORDER BY k.start, k.kind), '') AS spans,
               count(*) FILTER (k.live) AS n_live, count(*) FILTER (NOT k.live) AS n_shared
        FROM docs d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id
    """


ORACLE_SQL: dict[str, str] = {
    "op8_secrets": _secrets_sql(),
    "op10_exact_dedup": r"""
        WITH entries AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), ranked AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM entries
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
    """,
    "op11_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
        ), tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL
        ), w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n_docs
        ), i AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), scored AS (
            SELECT i.item_id, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(terms) * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM i JOIN tf USING (term) JOIN w USING (term) JOIN d USING (r), totals GROUP BY i.item_id, d.r, d.doc_id
        ), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= 20
    """,
    "op12_prefix_trie": r"""
        WITH base AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
            FROM conversations WHERE conv_id IS NOT NULL
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM base
        ), convs AS (
            SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS family,
                   xor(4294967295, list_reduce(list_prepend(4294967295, range(8 * length(CAST(conv_id AS VARCHAR)))),
                       lambda crc, j: xor(xor(crc, if(j % 8 = 0, ascii(substr(CAST(conv_id AS VARCHAR), CAST(j // 8 + 1 AS BIGINT), 1)), 0)) >> 1,
                           3988292384 * (xor(crc, if(j % 8 = 0, ascii(substr(CAST(conv_id AS VARCHAR), CAST(j // 8 + 1 AS BIGINT), 1)), 0)) & 1)))) % 9 AS h
            FROM base GROUP BY conv_id
        ), plan AS (
            SELECT c.conv_id, c.n, c.h, c.family, least(c.h, coalesce(f.n, 0)) AS lent FROM convs c LEFT JOIN convs f ON f.conv_id = c.family
        ), turns AS (
            SELECT p.conv_id, t.pos, t.digest, t.text FROM plan p JOIN placed t ON t.conv_id = p.family AND t.pos < p.lent
            UNION ALL
            SELECT p.conv_id, t.pos - p.h + p.lent, t.digest, t.text FROM plan p JOIN placed t ON t.conv_id = p.conv_id AND t.pos >= p.h
        ), prefixes AS (
            SELECT conv_id, 0 AS depth, '' AS path, 0 AS n_bytes FROM convs
            UNION ALL
            SELECT conv_id, pos + 1, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY pos), strlen(text) FROM turns
        ), lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id
        ), nodes AS (
            SELECT r.path, any_value(depth) AS depth, min(r.conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
                   sha256(coalesce(string_agg(CAST(r.conv_id AS VARCHAR), ',' ORDER BY r.conv_id) FILTER (r.depth = l.length), '')) AS ends_sha256
            FROM prefixes r JOIN lengths l USING (conv_id) GROUP BY r.path
        ), children AS (SELECT p.path, count(c.path) AS n_children FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND c.path[:64 * p.depth] = p.path GROUP BY p.path
        ), below AS (
            SELECT a.path, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n_bytes) AS saved_tokens
            FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) JOIN children k ON k.path = b.path GROUP BY a.path
        )
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN children k USING (path) JOIN below b USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:64 * (n.depth - 1)]
    """,
    "op13_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), windows AS (SELECT r, doc_id, start, array_to_string(words[start + 1:start + 20], ' ') AS window_words FROM (SELECT *, unnest(range(len(words) - 19)) AS start FROM d WHERE len(words) >= 20)
        ), firsts AS (SELECT window_words, min({'d': doc_id, 's': start}) AS first FROM windows GROUP BY window_words
        ), gone AS (
            SELECT r, list(DISTINCT start + k ORDER BY start + k) AS places FROM windows JOIN firsts USING (window_words), range(1, 21) AS t(k)
            WHERE {'d': doc_id, 's': start} > first GROUP BY r
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_where(words, list_transform(range(1, len(words) + 1), lambda i: NOT list_contains(coalesce(places, []), i))), ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (r)
    """,
}
