"""Registered queries of links inside texts, rules, projections and look-ups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import links, texts, views
from leafmill.plans.queries import _LINKS, _links, _nodes, _query, _table
from leafmill.plans.sync_queries import ORACLE_SQL, QUERIES, _SHAPED, _shaped  # noqa: F401

# links inside texts


@_query(f"""
    WITH {_SHAPED}, t AS (SELECT page_id, CASE WHEN page_id % 9 < 7 THEN 'gdoc:' || id || CASE page_id % 9 WHEN 4 THEN '#_abc' ELSE '' END ELSE link END AS target FROM shaped)
    SELECT page_id, 'a [x](' || target || ') {{{{% m %}}}} [y](#z)' AS markdown, CASE WHEN contains(target, ':') AND NOT starts_with(target, '#') THEN target ELSE '' END AS links FROM t
""")
def text_native_markdown(spark, sf_dir):
    page = F.concat(F.lit("a [x]("), "link", F.lit(") *{{% m %}}* [y](#z)"))
    markdown, found = texts.native_markdown(page)
    return _shaped(spark, sf_dir).select("page_id", markdown.alias("markdown"), F.array_join(found, " ").alias("links"))


@_query(f"""
    WITH {_SHAPED}, t AS (SELECT page_id, CASE WHEN page_id % 9 < 7 THEN 'gdoc:' || id ELSE link END AS target FROM shaped)
    SELECT page_id, '<a xlink:href="' || target || '"/><a xlink:href="' || target || '">' AS svg, CASE WHEN target LIKE 'gdoc:%' THEN 1 ELSE 0 END AS n_links FROM t
""")
def text_svg_links(spark, sf_dir):
    svg, found = texts.svg_links(F.concat(F.lit('<a xlink:href="'), "link", F.lit('"/><a xlink:href="'), "link", F.lit('">')))
    return _shaped(spark, sf_dir).select("page_id", svg.alias("svg"), F.size(found).alias("n_links"))


@_query(f"""
    WITH {_SHAPED}, t AS (SELECT *, regexp_extract(link, '[^/]*$', 0) AS base FROM shaped)
    SELECT page_id, CASE WHEN regexp_matches(link, 'document/d/') THEN 'doc ' || regexp_extract(link, '/d/([^/]*)', 1) || ' of ' || link WHEN page_id % 4 = 0 THEN base || ':x' END AS text FROM t
""")
def text_rewrite_rules(spark, sf_dir):
    rules = (("A", "document/d/", "/d/([^/]*)", "doc $value of $href"), ("IMG", "", None, "$basename:$label"))
    tag = F.when(F.col("page_id") % 4 == 0, "IMG/").otherwise("A")
    shaped = _shaped(spark, sf_dir).withColumn("tag", F.when(F.col("link").contains("document/d/"), "A").otherwise(tag))
    return shaped.select("page_id", texts.rewrite_rules(F.col("tag"), F.col("link"), F.lit("x"), rules).alias("text"))


@_query(f"WITH {_LINKS} SELECT target AS link, arg_max('m' || position, (source, 'm' || position)) AS means FROM links GROUP BY target")
def link_header_map(spark, sf_dir):
    docs = _links(spark, sf_dir).select(F.col("source").alias("id"), F.create_map("target", F.concat(F.lit("m"), F.col("position").cast("string"))).alias("headers"))
    return texts.header_map(docs, "headers")


@_query("""
    SELECT p_partkey, '<p><a href="' || CASE WHEN p_size % 2 = 0 THEN 'https://drive.google.com/open?id=i' || p_size ELSE '../' || p_size || '.md' END || '">x</a> <a class="b" href="https://z">y</a></p>' AS html FROM part
""")
def link_uploaded(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    html = F.concat(F.lit('<p><a href="../'), F.col("p_size").cast("string"), F.lit('.md">x</a> <a class="b" href="https://z">y</a></p>'))
    pages = part.select(F.concat(F.lit("/a/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), html.alias("html"))
    ids = part.where("p_size % 2 = 0").select(F.concat(F.lit("/"), F.col("p_size").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("i"), F.col("p_size").cast("string")).alias("id")).distinct()
    return texts.uploaded_links(pages, ids).select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("p_partkey"), "html")


@_query("SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20 WHERE c.c_custkey % 7 = 0")
def git_companion_files(spark, sf_dir):
    picked = _table(spark, sf_dir, "customer").where("c_custkey % 7 = 0")
    found = texts.companion_files(picked, _table(spark, sf_dir, "orders"), "file.o_custkey = picked.c_custkey and file.o_totalprice > picked.c_acctbal * 20")
    return found.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


# listings and drives


@_query("SELECT p_partkey FROM part WHERE p_size % 4 = 1 AND p_size % 5 <> 0 AND (p_retailprice > 1200 OR p_size % 3 = 0)")
def sync_remote_predicate(spark, sf_dir):
    size = F.col("p_size")
    listing = _table(spark, sf_dir, "part").select(
        "p_partkey", F.array(F.concat(F.lit("f"), (size % 4).cast("string"))).alias("parents"), F.when(size % 5 == 0, True).when(size % 5 == 1, False).alias("trashed"),
        F.when(F.col("p_retailprice") > 1200, "2024-02").otherwise("2024-01").alias("modified"), F.when(size % 3 == 0, "application/vnd.google-apps.folder").otherwise("image/png").alias("media_type"),
    )
    return listing.where(views.remote_predicate("f1", "2024-01")).select("p_partkey")


@_query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE 'a' END AS keys FROM part")
def sync_params(spark, sf_dir):
    params = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.when(F.col("p_size") % 2 == 0, "2"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(views.without_nulls(params))), ",").alias("keys"))


@_query("SELECT c_custkey AS id, c_custkey AS folder_id, c_name AS name, c_custkey IN (SELECT o_custkey FROM orders) AS exists FROM customer")
def sync_drive_rows(spark, sf_dir):
    drives = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return views.drive_rows(drives, _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")))


@_query("SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS shared FROM customer")
def sync_split_drives(spark, sf_dir):
    drives = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", True).alias("s"))
    shared, rest = views.split_drives(drives, "s")
    return shared.select("id", F.lit(True).alias("shared")).unionByName(rest.select("id", F.lit(False).alias("shared")))


@_query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND p_size % 4 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0")
def sync_change_filters(spark, sf_dir):
    size = F.col("p_size")
    rows = _table(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 3 == 0, "application/vnd.google-apps.folder").when(size % 2 == 0, "image/png").alias("media"), F.when(size % 5 == 0, "/toc.md").when(size % 4 == 0, "a.assets/b.png").otherwise("/a.md").alias("path"),
        F.when(size % 7 != 0, "t").alias("title"),
    )
    return views.to_upload(views.without_assets(views.without_folders(rows, "media"), "path"), "path", "title").select("p_partkey")


@_query("SELECT 'UNKNOWN' AS id, 'UNKNOWN' AS parent_id, p_name AS path, p_name AS file_name, p_size % 2 = 0 AS is_folder FROM part")
def tree_unknown_children(spark, sf_dir):
    scan = _table(spark, sf_dir, "part").select(F.col("p_name").alias("real_name"), F.when(F.col("p_size") % 2 == 0, "directory").otherwise("md").alias("kind"))
    return views.unknown_children(scan)


@_query("SELECT 'root' AS id, NULL AS parent, 'all' AS name UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier")
def tree_root(spark, sf_dir):
    return views.root_and_items(_nodes(spark, sf_dir), "root", "all")


@_query("""
    SELECT lower(replace(r_name, ' ', '-')) || '/' || lower(replace(n_name, ' ', '-')) || '/' || s.slug AS path, CAST(2 AS BIGINT) AS depth
    FROM (SELECT *, lower(trim(regexp_replace(s_name, '[^A-Za-z0-9_.]+', '-', 'g'))) AS slug FROM supplier) s JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 3 = 0
""")
def tree_upload_plan(spark, sf_dir):
    local = _nodes(spark, sf_dir).select("id", "parent", T.slug(F.col("name")).alias("name"))
    return views.tree_upload_plan(local, local.where("id not like 's%' or cast(substring(id, 2) as bigint) % 3 <> 0"))


# look-ups


@_query("""
    WITH last AS (SELECT user_id AS id, arg_max(event_type || '-' || (event_id % 20), (ts, event_id)) AS path FROM events GROUP BY user_id),
    ids AS (SELECT range AS id FROM range(0, 400)), tree AS (SELECT DISTINCT event_type || '-' || (event_id % 20) AS path FROM events WHERE event_id % 2 = 0)
    SELECT i.id, l.path, CASE WHEN t.path IS NOT NULL THEN 't:' || t.path END AS title, c_name AS remote_name, CASE WHEN l.path LIKE 'view%' THEN 'M' END AS state
    FROM ids i LEFT JOIN last l USING (id) LEFT JOIN tree t ON t.path = l.path LEFT JOIN customer ON c_custkey = i.id AND c_custkey % 3 = 0
""")
def link_chained_lookup(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.concat("event_type", F.lit("-"), (F.col("event_id") % 20).cast("string")).alias("path"), "ts", "event_id")
    tree = log.where("event_id % 2 = 0").select("path", F.concat(F.lit("t:"), "path").alias("title")).distinct()
    remote = _table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    changes = log.where("path like 'view%'").select("path", F.lit("M").alias("state")).distinct()
    return views.chained_lookup(spark.range(400), log, tree, remote, changes, ("ts", "event_id"))


@_query("""
    SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'N' WHEN p_size % 3 = 0 THEN 'M' WHEN p_size % 2 = 0 THEN 'D' END AS status FROM part
""")
def tree_with_status(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("path", F.col("p_partkey").cast("string"))
    size = F.col("p_size")
    changes = part.where("p_size % 6 in (0, 2, 3, 4)").select("path", (size % 6 == 0).alias("is_new"), (size % 3 == 0).alias("is_modified"), (size % 2 == 0).alias("is_deleted"))
    return views.with_status(part.select("p_partkey", "path"), changes).select("p_partkey", "status")


@_query("SELECT count(*) FILTER (p_size % 3 = 0) AS n_ids FROM part")
def sync_ids_to_allocate(spark, sf_dir):
    return views.ids_to_allocate(_table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_partkey")).alias("id")), "id")


@_query("SELECT p_partkey || '.assets' AS path FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0")
def git_asset_folders(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    return views.asset_folders(part.where("p_partkey % 3 = 0").select(F.concat(key, F.lit(".md")).alias("path")), part.where("p_size % 2 = 0").select(F.concat(key, F.lit(".assets")).alias("path")))


@_query("SELECT path FROM (SELECT 'a' || p_partkey AS path FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'a' || p_partkey FROM part WHERE p_size % 3 = 0)")
def git_union_with_repeats(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("a"), F.col("p_partkey").cast("string")))
    return views.with_repeats(part.where("p_size % 2 = 0").select("path"), part.where("p_size % 3 = 0").select("path"))


@_query("SELECT DISTINCT p_brand AS pattern FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_brand FROM part WHERE p_size % 3 = 0")
def git_ignore_list(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumnRenamed("p_brand", "pattern")
    return views.without_repeats(part.where("p_size % 2 = 0").select("pattern"), part.where("p_size % 3 = 0").select("pattern"))


@_query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def job_first_waiting(spark, sf_dir):
    jobs = _table(spark, sf_dir, "events").withColumn("state", F.when(F.col("event_id") % 3 == 0, "waiting").when(F.col("event_id") % 3 == 1, "running").otherwise("done"))
    return views.first_waiting(views.active_jobs(jobs, "state"), "user_id", "state", "event_id", ("event_type",))


@_query("""
    WITH feed AS (SELECT user_id, max(event_id) AS version FROM events GROUP BY user_id), tree AS (SELECT user_id, max(event_id) AS version FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
    SELECT f.* FROM feed f JOIN tree t USING (user_id) WHERE t.version < f.version
""")
def job_retry_set(spark, sf_dir):
    log = _table(spark, sf_dir, "events")
    newest = lambda rows: rows.groupBy("user_id").agg(F.max("event_id").alias("version"))
    return views.retry_set(newest(log), newest(log.where("event_id % 3 = 0")), "user_id", "version")


@_query("SELECT event_id % 500 AS trace, arg_min(event_type, event_id) AS first_name, count(*) AS n_spans, string_agg(event_type, ',' ORDER BY event_id) AS names FROM events GROUP BY 1")
def event_traces(spark, sf_dir):
    return views.traces(_table(spark, sf_dir, "events").withColumn("trace", F.col("event_id") % 500), "trace", "event_id", "event_type")


@_query("""
    SELECT '{"main":[' || string_agg('{"identifier":"n' || n_nationkey || '","name":"' || n_name || '","weight":' || (30 + 10 * n_nationkey) || ',"parent":"r' || n_regionkey || '"}', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation
""")
def sink_menu_json(spark, sf_dir):
    key = F.col("n_nationkey")
    return views.menu_json(_table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), key.cast("string")).alias("identifier"), F.col("n_name").alias("name"), (30 + 10 * key).alias("weight"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent")))


@_query("""
    SELECT doc_id, CASE coalesce(lang, '-') WHEN 'en' THEN 'WdC6vNmys9zvcuY0hwVaWQ==' WHEN 'de' THEN 'y4wtorHL1unK/G7G9j7b9w==' WHEN 'fr' THEN 'Ft19fh2bsv+rlX+aK0wX8g==' WHEN 'es' THEN 'VWGhk7iUEpZxTFeqreLEVw==' WHEN '-' THEN 'a0/NXnWBepdSdc6Z6xpGxg==' END AS code,
        coalesce(lang, '-') AS back, sha256(coalesce(text, '')) AS cache_key FROM documents
""")
def text_encrypted(spark, sf_dir):
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    code = views.encrypted(F.coalesce("lang", F.lit("-")), key, iv)  # the SQL has what another program made of the same key and vector
    return _table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), views.decrypted(code, key, iv).alias("back"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("cache_key"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'b' || event_id ELSE '' END AS branch, CASE WHEN event_id % 3 = 0 THEN 'x y' ELSE '' END AS files, 'INPUT_' || upper(event_type) || '_NAME' AS variable FROM events")
def text_payload(spark, sf_dir):
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"branch": "b'), F.col("event_id").cast("string"), F.lit('", "files": ["x", "y"]}'))).when(F.col("event_id") % 3 == 1, "no json")
    from leafmill.functions.paths import input_keys

    name = F.get(F.map_keys(input_keys(F.create_map(F.concat("event_type", F.lit(" name")), F.lit("1")))), F.lit(0))
    rows = _table(spark, sf_dir, "events").select("event_id", views.payload_variables(payload).alias("v"), name.alias("variable"))
    return rows.select("event_id", "v.branch", "v.files", "variable")


@_query(r"""
    SELECT doc_id, regexp_replace(lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(head), '&+', ' and ', 'g'), '[/,:()]+', ' ', 'g'), '[^\P{P}._]', ' ', 'g')), '\s+', '-', 'g')), '[#*+~()''"!:@]', '', 'g') AS slug
    FROM (SELECT doc_id, replace(replace(replace(replace(replace(replace(coalesce(text, ''), 'ß', 'ss'), '$', 'dollar'), '%', 'percent'), '|', 'or'), '<', 'less'), '>', 'greater') AS head FROM documents)
""")
def name_slug_unicode(spark, sf_dir):
    from leafmill.functions.unicode import slug_unicode

    head = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", slug_unicode(head).alias("slug"))


@_query("SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_type = 'view'")
def event_find(spark, sf_dir):
    return views.find(_table(spark, sf_dir, "events"), user_id=7, event_type="view").select("event_id", "event_type")


@_query("SELECT event_id FROM (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 25)")
def event_second_page(spark, sf_dir):
    """Without bounds a descending page ends now; here now is given."""
    from leafmill.operators.events import log_page

    return log_page(_table(spark, sf_dir, "events"), ("ts", "event_id"), F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), True, 25, 50).select("event_id")


@_query(f"WITH {_LINKS} SELECT source, string_agg(target, ' ' ORDER BY first) AS targets FROM (SELECT source, target, min(position) AS first FROM links GROUP BY source, target) GROUP BY source")
def link_distinct(spark, sf_dir):
    """The distinct links of each document, in the order of their first place."""
    first = links.distinct_links(_links(spark, sf_dir))
    return first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "target"))), lambda x: x["target"]), " ").alias("targets"))
