"""The registered queries of the document-sync operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import events, links, naming, search, snapshots, trees, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINKS = """links AS (
    SELECT page_id AS source, CAST(pos - 1 AS BIGINT) AS position, split_part(found[pos], '#', 1) AS target
    FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS pos
          FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS found FROM pages))
)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(_table(spark, sf_dir, "pages"), "page_id", "html")


@_query(f"WITH {_LINKS} SELECT target, count(DISTINCT source) AS n_sources, count(*) AS n_links FROM links GROUP BY target ORDER BY n_sources DESC, target LIMIT 50")
def link_backlink_rank(spark, sf_dir):
    return links.back_links(_links(spark, sf_dir)).orderBy(F.desc("n_sources"), "target").limit(50)  # a top-k report


@_query(f"WITH {_LINKS} SELECT * FROM links")
def link_extract(spark, sf_dir):
    return _links(spark, sf_dir)


@_query(f"WITH {_LINKS} SELECT target, count(DISTINCT source) AS n_sources, count(*) AS n_links FROM links GROUP BY target")
def link_backlinks(spark, sf_dir):
    return links.back_links(_links(spark, sf_dir))


@_query("SELECT url, arg_max(length(html), page_id) AS n_chars FROM (SELECT split_part(url, '?', 1) AS url, html, page_id FROM pages) GROUP BY url")
def link_upsert(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.substring_index("url", "?", 1).alias("url"), F.length("html").cast("long").alias("n_chars"), "page_id")
    return links.latest_links(pages, "url", "page_id", ("n_chars",))


@_query("""
    WITH RECURSIVE edges AS (
        SELECT n_nationkey AS source, (n_nationkey * 7 + 3) % 25 AS target FROM nation UNION SELECT n_nationkey, (n_nationkey * 2) % 25 FROM nation
    ), reach(node) AS (SELECT 0 UNION SELECT e.source FROM reach r JOIN edges e ON e.target = r.node)
    SELECT node FROM reach
""")
def link_closure(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("target"))
    edges = edges.union(nation.select("n_nationkey", (F.col("n_nationkey") * 2) % 25))
    return links.closure(edges, spark.range(1).select(F.col("id").cast("int"))).select("node")


@_query("""
    WITH counts AS (SELECT user_id, count(*) AS n_events FROM events GROUP BY user_id),
    sized AS (SELECT n_events, coalesce(sum(count(*)) OVER (ORDER BY n_events DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts GROUP BY n_events)
    SELECT user_id, n_events FROM counts JOIN sized USING (n_events) WHERE before <= 20
""")
def link_top_with_ties(spark, sf_dir):
    counts = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"))
    return links.top_with_ties(counts, "n_events", 20).select("user_id", "n_events")


@_query(f"""
    WITH {_LINKS}, paths AS (SELECT '/' || split_part(split_part(url, '://', 2), '/', 2) AS target, min(url) AS path FROM pages GROUP BY 1)
    SELECT source, count(*) AS n_links, count(path) AS n_known, string_agg(coalesce(path, '?' || target), ' ' ORDER BY position) AS links
    FROM links LEFT JOIN paths USING (target) GROUP BY source
""")
def link_rewrite(spark, sf_dir):
    rest = F.get(F.split("url", "://"), 1)
    paths = _table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), F.coalesce(F.get(F.split(rest, "/"), 1), F.lit(""))).alias("target"), F.col("url").alias("path"))
    return links.rewrite_links(_links(spark, sf_dir), paths, F.concat(F.lit("?"), F.col("target")))


@_query(r"""
    SELECT page_id, substr(lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(title, '&+', ' and ', 'g'), '[/,:()]+', ' ', 'g'), '[^\P{P}._]', ' ', 'g')), '\s+', '-', 'g')) || '.md', 1, 200) AS file_name
    FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
""")
def name_slug(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return _table(spark, sf_dir, "pages").select("page_id", T.file_name(title, F.lit("md")).alias("file_name"))


@_query(r"SELECT p_partkey, regexp_replace(name, '^([^.]*?)@[0-9]+(\.|$)', '\1\2') AS bare FROM (SELECT p_partkey, p_name || '@' || p_size || CASE WHEN p_size % 2 = 0 THEN '.md' ELSE '' END AS name FROM part)")
def name_strip_conflict(spark, sf_dir):
    name = F.concat("p_name", F.lit("@"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ".md").otherwise(""))
    return _table(spark, sf_dir, "part").select("p_partkey", T.strip_conflict(name).alias("bare"))


@_query("""
    SELECT p_partkey, p_brand, CASE WHEN n = 1 THEN p_name ELSE p_name || '@' || k END AS real_name
    FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name) AS n, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part)
""")
def name_conflicts(spark, sf_dir):
    return naming.resolve_conflicts(_table(spark, sf_dir, "part"), "p_name", "p_partkey", ("p_brand",)).select("p_partkey", "p_brand", "real_name")


@_query("SELECT p_name, count(*) AS members, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS member_keys FROM part GROUP BY p_name HAVING count(*) > 1")
def name_conflict_pages(spark, sf_dir):
    return naming.conflict_pages(_table(spark, sf_dir, "part"), "p_name", "p_partkey")


_SNAPSHOTS = """old AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0),
    new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings made of one table: rows come, go and change."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return orders.where("o_orderkey % 7 <> 0"), changed.where("o_orderkey % 11 <> 0")


@_query(f"""
    WITH {_SNAPSHOTS} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderstatus AS old_version, n.o_orderstatus AS new_version,
        CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus THEN 'same' ELSE 'changed' END AS status
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
""")
def sync_snapshot_diff(spark, sf_dir):
    return snapshots.snapshot_diff(*_snapshots(spark, sf_dir), "o_orderkey", "o_orderstatus")


@_query(f"""
    WITH {_SNAPSHOTS} SELECT * FROM new WHERE o_orderkey % 4 = 1
    UNION ALL SELECT o.* FROM old o JOIN new n USING (o_orderkey) WHERE o_orderkey % 4 <> 1
""")
def sync_partial(spark, sf_dir):
    return snapshots.partial_sync(*_snapshots(spark, sf_dir), "o_orderkey", F.col("o_orderkey") % 4 == 1)


@_query("SELECT d.doc_id, l.doc_id IS NULL AS missing, l.doc_id IS NULL OR d.n_chars > 5000 AS wanted FROM (SELECT doc_id, n_chars FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def sync_fetch_plan(spark, sf_dir):
    return snapshots.fetch_plan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id", F.col("n_chars") > 5000)


@_query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)")
def sync_unused_files(spark, sf_dir):
    files = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".odt")).alias("name"))
    return snapshots.unused_files(files, "name", _table(spark, sf_dir, "supplier"), "s_suppkey").select("p_partkey")


@_query("""
    SELECT o_custkey AS custkey, 'register' AS action FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY o_custkey
    UNION ALL SELECT c_custkey, 'unregister' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def sync_registrations(spark, sf_dir):
    old = _table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("custkey"))
    return snapshots.registrations(old, _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@_query("SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(c_name, s_name) AS name, coalesce(c_nationkey, s_nationkey) AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2")
def sync_merge_listing(spark, sf_dir):
    a = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return snapshots.merge_listings(a, b, "key")


ORACLE_SQL["sync_merge_listing"] = """
    SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name, coalesce(a.nation, b.nation) AS nation
    FROM (SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer) a
    FULL JOIN (SELECT s_suppkey * 2 AS key, s_name AS name, s_nationkey AS nation FROM supplier) b ON a.key = b.key
"""


@_query(f"""
    WITH {_SNAPSHOTS} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderstatus AS old_name, n.o_orderstatus AS new_name,
        CASE WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_orderkey IS NULL THEN 'created' WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus THEN 'touched' ELSE 'renamed' END AS event
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
""")
def name_events(spark, sf_dir):
    return naming.name_events(*_snapshots(spark, sf_dir), "o_orderkey", "o_orderstatus")


_REDIRECT_LOG = "SELECT user_id, event_type || '-' || (event_id % 50) AS path, ts, event_id FROM events"


@_query(f"""
    WITH log AS ({_REDIRECT_LOG}), latest AS (SELECT user_id, arg_max(path, (ts, event_id)) AS target FROM log GROUP BY user_id),
    owners AS (SELECT path, arg_max(user_id, (ts, event_id)) AS user_id FROM log GROUP BY path)
    SELECT path, target FROM owners JOIN latest USING (user_id) WHERE path NOT IN (SELECT target FROM latest)
""")
def name_redirects(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit("-"), (F.col("event_id") % 50).cast("string")).alias("path"), "ts", "event_id")
    return naming.redirects(log, "user_id", "path", ("ts", "event_id"))


@_query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def event_latest(spark, sf_dir):
    return events.latest_by(_table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), ("event_type", "event_id"))


@_query("""
    SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'signup')
    WHERE event_type <> 'view' OR k = 1
""")
def event_append(spark, sf_dir):
    kept = events.append_rules(_table(spark, sf_dir, "events"), "user_id", "event_type", ("ts", "event_id"), "view", F.col("event_type") == "signup")
    return kept.select("event_id", "user_id", "event_type")


@_query("SELECT event_id, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 10")
def event_log_page(spark, sf_dir):
    where = (F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return events.log_page(_table(spark, sf_dir, "events"), ("ts", "event_id"), where, True, 10, 100).select("event_id", "ts")


@_query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id")
def event_errors_by_user(spark, sf_dir):
    found = _table(spark, sf_dir, "events").where("event_type = 'error'")
    return found.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("errors"))


@_query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def event_quota_window(spark, sf_dir):
    return events.trailing_count(_table(spark, sf_dir, "events"), "event_type", "ts", 600).select("event_id", "n_recent")


@_query("SELECT event_id, round((lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts)) / 1e6, 1) AS seconds FROM events")
def event_durations(spark, sf_dir):
    return events.durations(_table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "ts").select("event_id", "seconds")


@_query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100")
def job_archive(spark, sf_dir):
    return events.archive(_table(spark, sf_dir, "events"), "event_type", ("ts", "event_id")).select("event_type", "event_id")


@_query("""
    SELECT event_id FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS since FROM events)
    WHERE since IS NULL OR since > 3600000000
""")
def job_without_repeats(spark, sf_dir):
    return events.without_repeats(_table(spark, sf_dir, "events"), ("user_id", "event_type"), ("ts", "event_id"), "ts", 3600).select("event_id")


@_query("SELECT n_nationkey, count(c_custkey) AS n_jobs FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def job_counts(spark, sf_dir):
    jobs = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return views.counted(_table(spark, sf_dir, "nation"), jobs, "n_nationkey", "n_jobs")


@_query("SELECT user_id, count(*) AS n_lines FROM events GROUP BY user_id HAVING bool_and(value < 4 * user_id)")
def change_all_pass(spark, sf_dir):
    return events.all_pass(_table(spark, sf_dir, "events"), "user_id", F.col("value") < 4 * F.col("user_id"))


@_query("""
    SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'N') THEN 'N' WHEN bool_or(l_returnflag = 'A') THEN 'A' END AS status, count(*) AS n_rows
    FROM lineitem GROUP BY l_orderkey
""")
def change_status(spark, sf_dir):
    return events.strongest_status(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ("R", "N", "A"))


_NODES = """nodes AS (
    SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier
)"""
_WALK = f"""WITH RECURSIVE {_NODES}, walk(id, path, depth) AS (
    SELECT id, name, CAST(0 AS BIGINT) FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, w.path || '/' || n.name, w.depth + 1 FROM walk w JOIN nodes n ON n.parent = w.id
)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, mark: str, key: str, name: str, above: tuple[str, str] | None) -> DataFrame:
        parent = F.concat(F.lit(above[0]), F.col(above[1]).cast("string")) if above else F.lit(None).cast("string")
        return _table(spark, sf_dir, table).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), parent.alias("parent"), F.col(name).alias("name"))

    return part("region", "r", "r_regionkey", "r_name", None).union(part("nation", "n", "n_nationkey", "n_name", ("r", "n_regionkey"))).union(part("supplier", "s", "s_suppkey", "s_name", ("n", "s_nationkey")))


@_query(f"{_WALK} SELECT * FROM walk")
def tree_paths(spark, sf_dir):
    return trees.tree_paths(_nodes(spark, sf_dir))


@_query(f"""
    WITH RECURSIVE {_NODES}, up(leaf, ancestor, distance) AS (
        SELECT id, parent, CAST(1 AS BIGINT) FROM nodes WHERE id LIKE 's%' AND parent IS NOT NULL
        UNION ALL SELECT u.leaf, n.parent, u.distance + 1 FROM up u JOIN nodes n ON n.id = u.ancestor WHERE n.parent IS NOT NULL
    ) SELECT * FROM up
""")
def tree_ancestors(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return trees.ancestors(nodes, nodes.where("id like 's%'").select("id"))


@_query(f"{_WALK} SELECT path, repeat('   ', depth) || '* ' || string_split(path, '/')[-1] AS line FROM walk")
def tree_contents(spark, sf_dir):
    return trees.contents(_nodes(spark, sf_dir))


@_query(f"WITH {_NODES} SELECT id, parent, 30 + 10 * (row_number() OVER (PARTITION BY parent ORDER BY id) - 1) AS weight FROM nodes")
def tree_menu(spark, sf_dir):
    return trees.menu(_nodes(spark, sf_dir))


@_query("""
    SELECT node, count(*) AS n_paths FROM (
        SELECT array_to_string(parts[1:k], '/') AS node FROM (
            SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT list_filter(string_split(split_part(split_part(url, '://', 2), '?', 1), '/'), lambda x: x <> '') AS parts FROM pages)))
    GROUP BY node
""")
def tree_changes(spark, sf_dir):
    path = F.substring_index(F.coalesce(F.get(F.split("url", "://"), 1), F.lit("")), "?", 1)
    return trees.change_tree(_table(spark, sf_dir, "pages").select(path.alias("path")), "path")


@_query(r"""
    SELECT term, p_partkey, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[\s\-_@#,.]+')) AS term FROM part)
    WHERE term <> '' GROUP BY term, p_partkey
""")
def search_postings(spark, sf_dir):
    return search.postings(_table(spark, sf_dir, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_brand")), "p_partkey", "t")


def _found(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return search.search(search.postings(part, "p_partkey", "p_name"), "p_partkey", query)


_FOUND = "SELECT p_partkey, count(*) AS score FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part) WHERE {} GROUP BY p_partkey"


@_query(_FOUND.format("term IN ('red', 'bolt')"))
def search_exact(spark, sf_dir):
    return _found(spark, sf_dir, " Red bolt ")


@_query(_FOUND.format("term LIKE 'wid%' OR term LIKE 'gea%'"))
def search_prefix(spark, sf_dir):
    return _found(spark, sf_dir, "wid:gea")


@_query("""
    SELECT event_id, value, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 60) * CASE (event_id % 5) WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 ELSE 604800 END END AS seconds FROM events
""")
def text_interval(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in T.UNIT_SECONDS]), (F.col("event_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", "value", T.interval_seconds(F.concat((F.col("event_id") % 60).cast("string"), F.when(F.col("event_id") % 7 == 0, "y").otherwise(unit))).cast("long").alias("seconds"))


@_query("SELECT page_id, split_part(url, '#', 1) AS bare, replace(regexp_extract(url, '#.+$', 0), '#heading=h.', '#_') AS hash FROM pages")
def text_url_hash(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.without_hash(F.col("url")).alias("bare"), T.url_hash(F.col("url")).alias("hash"))


@_query("SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents")
def text_md5(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.length("text").cast("long").alias("n"))


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def text_json_props(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
