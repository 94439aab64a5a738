"""More registered queries over the test tables, and their SQL: urls, names, links, listings, logs, jobs and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import paths as P
from leafmill.functions import text as T
from leafmill.operators import events, links, naming, search, snapshots, trees
from leafmill.plans.queries import ORACLE_SQL, QUERIES, _LINKS, _NODES, _SNAPSHOTS, _WALK, _links, _nodes, _query, _snapshots, _table  # noqa: F401
from leafmill.sinks import files as sinks
from leafmill.sources import files as sources
from leafmill.sources import git

_PATH = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1)"


def _page_path() -> object:
    return F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)?", 1)


# urls and paths

_SHAPED = """shaped AS (
    SELECT page_id, 'doc_' || page_id || '-x' AS id, CASE page_id % 9
        WHEN 0 THEN 'https://drive.google.com/drive/u/0/folders/' || 'doc_' || page_id || '-x' || '?usp=sharing'
        WHEN 1 THEN 'http://drive.google.com/open?id=' || 'doc_' || page_id || '-x'
        WHEN 2 THEN 'https://drive.google.com/open?id%3D' || 'doc_' || page_id || '-x' || '&a=b'
        WHEN 3 THEN 'https://docs.google.com/drawings/d/' || 'doc_' || page_id || '-x' || '/edit'
        WHEN 4 THEN 'https://docs.google.com/document/d/' || 'doc_' || page_id || '-x' || '/edit#heading=h.abc'
        WHEN 5 THEN '../../' || 'doc_' || page_id || '-x'
        WHEN 6 THEN 'drive.google.com/a/b/open?id=' || 'doc_' || page_id || '-x'
        WHEN 7 THEN 'https://drive.google.com/open?id=' || 'doc ' || page_id ELSE url END AS link FROM pages
)"""


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.concat(F.lit("doc_"), F.col("page_id").cast("string"), F.lit("-x"))
    forms = [
        ("https://drive.google.com/drive/u/0/folders/", "?usp=sharing"), ("http://drive.google.com/open?id=", ""), ("https://drive.google.com/open?id%3D", "&a=b"),
        ("https://docs.google.com/drawings/d/", "/edit"), ("https://docs.google.com/document/d/", "/edit#heading=h.abc"), ("../../", ""), ("drive.google.com/a/b/open?id=", ""),
    ]
    link = F.when(F.col("page_id") % 9 == 7, F.concat(F.lit("https://drive.google.com/open?id=doc "), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    for k, (before, after) in enumerate(forms):
        link = F.when(F.col("page_id") % 9 == k, F.concat(F.lit(before), id, F.lit(after))).otherwise(link)
    return _table(spark, sf_dir, "pages").select("page_id", id.alias("id"), link.alias("link"))


@_query(f"WITH {_SHAPED} SELECT page_id, CASE WHEN page_id % 9 < 7 THEN id END AS found FROM shaped")
def url_ids(spark, sf_dir):
    return _shaped(spark, sf_dir).select("page_id", P.url_to_id(F.col("link")).alias("found"))


@_query(f"WITH {_SHAPED} SELECT page_id, replace(replace(link, 'https://drive.google.com/open?id%3D', 'gdoc:'), 'https://drive.google.com/open?id=', 'gdoc:') AS found FROM shaped")
def url_links(spark, sf_dir):
    return _shaped(spark, sf_dir).select("page_id", P.urls_to_ids(F.col("link")).alias("found"))


_PAIRS = "pairs AS (SELECT page_id, '/' || s AS start, '/' || s2 || '/' || (page_id % 4) || '.md' AS target, s, s2 FROM (SELECT page_id, 'd' || (page_id % 3) AS s, 'd' || (page_id % 5) AS s2 FROM pages))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, folder = F.concat(F.lit("d"), (F.col("page_id") % 3).cast("string")), F.concat(F.lit("d"), (F.col("page_id") % 5).cast("string"))
    target = F.concat(F.lit("/"), folder, F.lit("/"), (F.col("page_id") % 4).cast("string"), F.lit(".md"))
    return _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), start).alias("start"), target.alias("target"))


@_query(f"WITH {_PAIRS} SELECT page_id, CASE WHEN s = s2 THEN (page_id % 4) || '.md' ELSE '../' || s2 || '/' || (page_id % 4) || '.md' END AS way FROM pairs")
def url_relative(spark, sf_dir):
    return _pairs(spark, sf_dir).select("page_id", P.relate_url(F.col("start"), F.col("target")).alias("way"))


@_query(f"WITH {_PAIRS} SELECT page_id, target AS back FROM pairs")
def url_absolute(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return pairs.select("page_id", P.absolute_document_path(F.col("start"), P.relate_url(F.col("start"), F.col("target"))).alias("back"))


@_query(f"""
    WITH {_PAIRS} SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://a.b/c.md' WHEN s = s2 THEN (page_id % 4) || '' ELSE '../' || s2 || '/' || (page_id % 4) END AS way FROM pairs
""")
def url_document_path(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    target = F.when(F.col("page_id") % 7 == 0, "https://a.b/c.md").otherwise(F.col("target"))
    return pairs.select("page_id", P.relative_document_path(target, F.concat("start", F.lit("/index.md")), "dirURLs").alias("way"))


@_query(f"""
    SELECT page_id, regexp_replace(path, '\\.md$', '') AS bare, regexp_replace(path, '\\.md$', '.html') AS html, path AS same
    FROM (SELECT page_id, {_PATH} || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '.png' END AS path FROM pages)
""")
def url_extension(spark, sf_dir):
    path = F.concat(_page_path(), F.when(F.col("page_id") % 2 == 0, ".md").otherwise(".png"))
    return _table(spark, sf_dir, "pages").select("page_id", P.convert_extension(path, "dirURLs").alias("bare"), P.convert_extension(path, "uglyURLs").alias("html"), P.convert_extension(path).alias("same"))


@_query(f"""
    SELECT page_id, CASE WHEN path LIKE '%/1%' THEN regexp_replace(path, '/1', '/one') WHEN regexp_matches(path, '[0-9]') THEN regexp_replace(path, '([0-9])', '<\\1>') ELSE path END AS preview
    FROM (SELECT page_id, {_PATH} || page_id || '7' AS path FROM pages)
""")
def url_preview(spark, sf_dir):
    path = F.concat(_page_path(), F.col("page_id").cast("string"), F.lit("7"))
    return _table(spark, sf_dir, "pages").select("page_id", P.preview_url(path, (("/1", "/one"), ("([0-9])", "<$1>"))).alias("preview"))


@_query("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$', 0) ELSE 'bin' END AS ext, regexp_replace(name, '/?[^/]*$', '') AS folder,
        (name = 'a/' || p_brand OR starts_with(name, 'a/' || p_brand || '/')) AS inside, regexp_matches(name, '(\\.txt|\\.gitignore|\\.ts|\\.css|\\.md)$') AS is_text,
        CASE regexp_extract(name, '[^.]*$', 0) WHEN 'md' THEN 'text/x-markdown' WHEN 'css' THEN 'text/css' END AS media
    FROM (SELECT *, 'a/' || p_brand || '/' || p_size || CASE p_size % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.css' WHEN 2 THEN '' ELSE '.odt' END AS name FROM part)
""")
def path_parts_of_files(spark, sf_dir):
    ending = F.when(F.col("p_size") % 4 == 0, ".md").when(F.col("p_size") % 4 == 1, ".css").when(F.col("p_size") % 4 == 2, "").otherwise(".odt")
    part = _table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("a/"), "p_brand", F.lit("/"), F.col("p_size").cast("string"), ending))
    name = F.col("name")
    return part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "").otherwise(T.extension_of(name)).alias("ext"), T.directory_of(name).alias("folder"), T.in_directory(name, F.concat(F.lit("a/"), "p_brand")).alias("inside"), P.is_text_file(name).alias("is_text"), P.media_type(name).alias("media"))


@_query(r"""
    SELECT doc_id, lower(trim(regexp_replace(head, '[^A-Za-z0-9_]+', ' ', 'g'))) AS words, rtrim(translate(to_base64(encode(head)), '+/', '-_'), '=') AS code, head AS back
    FROM (SELECT doc_id, coalesce(text, '') AS head FROM documents)
""")
def text_codes(spark, sf_dir):
    head = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", F.replace(P.anchor(head), F.lit("-"), F.lit(" ")).alias("words"), P.base64_url(head).alias("code"), P.unbase64_url(P.base64_url(head)).alias("back"))


@_query("""
    SELECT event_id, CASE WHEN ms <= 200 THEN '' WHEN ms > 1000 THEN (CASE WHEN round(ms / 100) % 10 = 0 THEN CAST(CAST(round(ms / 100) / 10 AS BIGINT) AS VARCHAR) ELSE printf('%.1f', round(ms / 100) / 10) END) || 's' ELSE ms || 'ms' END AS took,
        strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.') || printf('%03d', ms % 1000) || 'Z' AS iso
    FROM (SELECT event_id, CAST(event_id * 37 AS BIGINT) AS ms FROM events)
""")
def text_elapsed(spark, sf_dir):
    ms = F.col("event_id") * 37
    return _table(spark, sf_dir, "events").select("event_id", P.elapsed(ms, 200).alias("took"), P.iso_time(ms).alias("iso"))


@_query(r"""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE '' END AS title,
        CASE WHEN page_id % 3 = 0 THEN 'own/name-' || page_id ELSE '' END AS repo, page_id % 2 = 0 AS is_macro, CASE WHEN page_id % 2 = 0 THEN ' x ' ELSE '{{x}} x ' END AS bare
    FROM pages
""")
def text_shapes(spark, sf_dir):
    even = F.col("page_id") % 2 == 0
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    page = F.when(even, F.concat(F.lit("id: 1\ntitle: \""), title, F.lit("\"\ntitle: second\n"))).otherwise("subtitle: x\n")
    remote = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("git@github.com:own/name-"), F.col("page_id").cast("string"), F.when(even, ".git").otherwise(""))).otherwise("https://x.y/own/name.git")
    macro = F.when(even, "{{markdown}} x {{/markdown}}").otherwise("{{x}} x ")
    return _table(spark, sf_dir, "pages").select("page_id", P.title_of(page).alias("title"), P.repository_of(remote).alias("repo"), P.is_macro(macro).alias("is_macro"), P.without_macro(macro).alias("bare"))


# names

_KINDS = "CASE p_size % 5 WHEN 0 THEN 'application/vnd.google-apps.folder' WHEN 1 THEN 'application/vnd.google-apps.document' WHEN 2 THEN 'application/vnd.google-apps.drawing' WHEN 3 THEN 'application/vnd.google-apps.shortcut' ELSE 'image/png' END"


def _part_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    kind = F.when(k == 0, P.NATIVE["folder"]).when(k == 1, P.NATIVE["document"]).when(k == 2, P.NATIVE["drawing"]).when(k == 3, P.NATIVE["shortcut"]).otherwise("image/png")
    return _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), kind.alias("media_type"))


@_query(f"""
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'directory' WHEN 1 THEN 'md' WHEN 2 THEN 'drawing' WHEN 3 THEN 'shortcut' ELSE 'binary' END AS kind,
        replace(lower(p_name), ' ', '-') || CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '.md' WHEN 2 THEN '.svg' WHEN 3 THEN '.bin' ELSE '.png' END AS file_name,
        CASE p_size % 5 WHEN 1 THEN 'text/x-markdown' WHEN 2 THEN 'image/svg+xml' ELSE {_KINDS} END AS media_type FROM part
""")
def name_typed_files(spark, sf_dir):
    return naming.typed_files(_part_listing(spark, sf_dir)).select("p_partkey", "kind", "file_name", "media_type")


@_query(f"""
    SELECT p_partkey, unnest(CASE {_KINDS} WHEN 'application/vnd.google-apps.document' THEN ['odt'] WHEN 'application/vnd.google-apps.drawing' THEN ['svg', 'png']
        WHEN 'image/png' THEN ['asset'] ELSE []::VARCHAR[] END) AS format FROM part
""")
def sync_export_plan(spark, sf_dir):
    return snapshots.export_plan(_part_listing(spark, sf_dir), "media_type").select("p_partkey", "format")


_STORED = """files AS (SELECT p_partkey, p_name || '.md' AS name FROM part UNION ALL SELECT 1000000 + p_partkey, p_name || '@2.md' FROM part WHERE p_partkey % 97 = 0),
    stored AS (SELECT p_partkey, p_name || '@' || (p_partkey % 7 + 1) || '-' || p_partkey || '.md' AS real_name FROM part WHERE p_partkey % 5 = 0
               UNION ALL SELECT min(p_partkey), p_name || '@3.md' FROM part WHERE p_partkey % 5 <> 0 GROUP BY p_name)"""


@_query(f"""
    WITH {_STORED}, sized AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM files),
    kept AS (SELECT s.p_partkey, s.name, t.real_name FROM sized s JOIN stored t USING (p_partkey) WHERE s.n > 1 AND regexp_replace(t.real_name, '^([^.]*?)@[0-9]+(\\.|$)', '\\1\\2') = s.name AND t.real_name <> s.name),
    rest AS (SELECT s.*, row_number() OVER (PARTITION BY s.name ORDER BY s.p_partkey) AS i FROM sized s WHERE n > 1 AND p_partkey NOT IN (SELECT p_partkey FROM kept)),
    taken AS (SELECT DISTINCT regexp_replace(real_name, '^([^.]*?)@[0-9]+(\\.|$)', '\\1\\2') AS name, TRY_CAST(regexp_extract(real_name, '^[^.]*?@([0-9]+)\\.', 1) AS BIGINT) AS number
              FROM (SELECT real_name FROM kept UNION SELECT name FROM files) WHERE regexp_matches(real_name, '^[^.]*?@[0-9]+\\.')),
    free AS (SELECT name, k, row_number() OVER (PARTITION BY name ORDER BY k) AS i
             FROM (SELECT name, unnest(range(1, count(*) + 50)) AS k FROM rest GROUP BY name) c WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.name = c.name AND t.number = c.k))
    SELECT p_partkey, name AS real_name FROM sized WHERE n = 1 UNION ALL SELECT p_partkey, real_name FROM kept
    UNION ALL SELECT r.p_partkey, split_part(r.name, '.', 1) || '@' || f.k || '.md' FROM rest r JOIN free f ON f.name = r.name AND f.i = r.i
""")
def name_conflicts_stored(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    more = part.where("p_partkey % 97 = 0").select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.concat("p_name", F.lit("@2.md")).alias("name"))
    files = part.select("p_partkey", F.concat("p_name", F.lit(".md")).alias("name")).unionByName(more)
    odd = part.where("p_partkey % 5 = 0").select("p_partkey", F.concat("p_name", F.lit("@"), (F.col("p_partkey") % 7 + 1).cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("real_name"))
    first = part.where("p_partkey % 5 <> 0").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey", F.concat("p_name", F.lit("@3.md")).alias("real_name"))
    return naming.resolve_conflicts(files, "name", "p_partkey", (), odd.unionByName(first)).select("p_partkey", "real_name")


@_query("""
    WITH local AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'redir' WHEN 1 THEN 'conflict' ELSE 'md' END AS kind, CASE WHEN o_orderkey % 13 = 0 THEN '.' ELSE '' END || o_orderkey || '.md' AS real_name FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT real_name, CASE WHEN kind <> 'md' THEN 'page' WHEN id % 11 = 0 THEN 'gone' ELSE 'renamed' END AS reason, replace(real_name, '.md', '.assets') AS assets
    FROM local WHERE real_name NOT LIKE '.%' AND (kind <> 'md' OR id % 11 = 0 OR id % 4 = 0)
""")
def name_removal_plan(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    k = F.col("id") % 6
    name = F.concat(F.when(F.col("id") % 13 == 0, ".").otherwise(""), F.col("id").cast("string"), F.lit(".md"))
    local = orders.where("id % 3 <> 0").select("id", F.when(k == 0, "redir").when(k == 1, "conflict").otherwise("md").alias("kind"), name.alias("real_name"))
    generated = orders.where("id % 4 <> 0").select(name.alias("real_name"))
    return naming.removal_plan(local, orders.where("id % 11 <> 0"), generated, "id")


@_query("""
    SELECT real_name, CASE WHEN k = 0 AND p_size < 25 THEN 'id' || p_partkey WHEN k = 0 THEN 'TO_FILL' ELSE 'own' END AS id, CASE WHEN k = 0 AND p_size < 25 THEN 'f' ELSE 'g' END AS file_name, CASE WHEN k = 0 AND p_size < 25 THEN p_size ELSE 0 END AS modified
    FROM (SELECT p_partkey, p_size, p_partkey % 2 AS k, p_partkey || '.png' AS real_name FROM part)
""")
def name_fill_metadata(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("real_name", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")))
    local = part.select("real_name", F.when(F.col("p_partkey") % 2 == 0, naming.TO_FILL).otherwise("own").alias("id"), F.lit("g").alias("file_name"), F.lit(0).alias("modified"))
    known = part.where("p_size < 25").select("real_name", F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("id"), F.lit("f").alias("file_name"), F.col("p_size").alias("modified"))
    return naming.fill_metadata(local, known)


@_query("""
    WITH log AS (SELECT user_id, event_type || '-' || (event_id % 50) AS path, ts, event_id, CASE WHEN event_id % 9 = 0 THEN 'removed' ELSE 'touched' END AS event FROM events),
    latest AS (SELECT user_id, arg_max(path, (ts, event_id)) AS target, arg_max(event, (ts, event_id)) AS event FROM log GROUP BY user_id),
    owners AS (SELECT path, arg_max(user_id, (ts, event_id)) AS user_id, arg_max(event, (ts, event_id)) AS last FROM log GROUP BY path)
    SELECT path, target FROM owners JOIN latest USING (user_id) WHERE last <> 'removed' AND event <> 'removed' AND path NOT IN (SELECT target FROM latest WHERE event <> 'removed')
""")
def name_redirects_removed(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit("-"), (F.col("event_id") % 50).cast("string")).alias("path"), "ts", "event_id", F.when(F.col("event_id") % 9 == 0, "removed").otherwise("touched").alias("event"))
    return naming.redirects(log, "user_id", "path", ("ts", "event_id"), "event")


@_query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def name_first_entry(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("place"))
    return naming.first_by_key(rows, "user_id", "place").select("user_id", "event_id", "event_type")


@_query("SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'view'")
def event_without_path(spark, sf_dir):
    return naming.without_path(_table(spark, sf_dir, "events"), "event_type", "view").select("event_id")


# links and trees

_GDOC = f"{_LINKS}, gl AS (SELECT source, CASE WHEN position % 4 = 0 THEN target ELSE 'gdoc:' || (source + position) % 200 || CASE WHEN position % 2 = 0 THEN '#h' ELSE '' END END AS target, position FROM links)"


def _gdoc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.col("position")
    made = F.concat(F.lit("gdoc:"), ((F.col("source") + position) % 200).cast("string"), F.when(position % 2 == 0, "#h").otherwise(""))
    return _links(spark, sf_dir).select("source", position.alias("position"), F.when(position % 4 == 0, F.col("target")).otherwise(made).alias("target"))


@_query(f"""
    WITH {_GDOC}, counts AS (SELECT CAST(source AS VARCHAR) AS source, count(*) AS n FROM gl GROUP BY 1)
    SELECT CAST(gl.source AS VARCHAR) AS source, regexp_replace(substr(gl.target, 6), '#.*', '') AS target, coalesce(n, 0) AS n_target_links
    FROM gl LEFT JOIN counts c ON c.source = regexp_replace(substr(gl.target, 6), '#.*', '') WHERE gl.target LIKE 'gdoc:%'
""")
def link_documents(spark, sf_dir):
    return links.document_links(_gdoc_links(spark, sf_dir).select(F.col("source").cast("string").alias("source"), "target"))


@_query(f"""
    WITH {_GDOC}, log AS (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, (ts, event_id)) AS path, arg_max(event_id % 5, (ts, event_id)) AS last FROM events GROUP BY 1),
    named AS (SELECT source, position, target, regexp_replace(substr(target, 6), '#.*', '') AS id, CASE WHEN target LIKE '%#h' THEN '#_h' ELSE '' END AS hash FROM gl WHERE target LIKE 'gdoc:%')
    SELECT source, position, target, CASE WHEN path IS NULL OR last = 0 THEN 'https://drive.google.com/open?id=' || CASE WHEN hash = '' THEN n.id ELSE '0' || n.id END || replace(hash, '#_', '#heading=h.')
        ELSE CASE WHEN source % 2 = 0 THEN '../' ELSE '' END || path || '.md' || hash END AS link
    FROM named n LEFT JOIN log ON log.id = CASE WHEN hash = '' THEN n.id ELSE '0' || n.id END
""")
def link_rewrite_relative(spark, sf_dir):
    made = _gdoc_links(spark, sf_dir).where(F.col("target").startswith("gdoc:")).withColumn("base", F.when(F.col("source") % 2 == 0, "a/doc.md").otherwise("doc.md"))
    headers = made.select("target").where("target like '%#h'").distinct().select(F.col("target").alias("link"), F.concat(F.lit("gdoc:0"), F.expr("substring(replace(target, '#h', '#_h'), 6)")).alias("means"))
    log = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.concat("event_type", F.lit(".md")).alias("path"), F.when(F.col("event_id") % 5 == 0, "removed").otherwise("touched").alias("event"), "ts", "event_id")
    return links.rewritten_links(made, log, headers, ("ts", "event_id"))


@_query(f"WITH {_LINKS}, graph AS (SELECT DISTINCT l.source, p.page_id AS target FROM links l JOIN (SELECT page_id, '/' || split_part(split_part(url, '://', 2), '/', 2) AS path FROM pages) p ON p.path = l.target), reach AS (WITH RECURSIVE r(node) AS (SELECT min(page_id) FROM pages UNION SELECT g.source FROM r JOIN graph g ON g.target = r.node) SELECT node FROM r) SELECT node FROM reach")
def link_page_closure(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(2)))
    found = _links(spark, sf_dir).select("source", F.col("target").alias("name"))
    return links.closure_by_name(found, pages.select(F.col("page_id").alias("node"), path.alias("name")), pages.agg(F.min("page_id").alias("node"))).select("node")


@_query(f"{_WALK} SELECT id, path, depth FROM walk WHERE path = 'ASIA/NATION_12'")
def tree_find_path(spark, sf_dir):
    return trees.find_by_path(_nodes(spark, sf_dir), "ASIA/NATION_12")


@_query(f"{_WALK} SELECT w.id, 'r' || r_regionkey AS top FROM walk w JOIN region ON r_name = split_part(path, '/', 1)")
def tree_top_folders(spark, sf_dir):
    return trees.top_folders(_nodes(spark, sf_dir))


@_query(f"{_WALK} SELECT DISTINCT w.id FROM walk w JOIN walk s ON s.id LIKE 's%7' AND (s.path = w.path OR starts_with(s.path, w.path || '/'))")
def tree_pruned_listing(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return trees.pruned_listing(nodes, nodes.where("id like 's%7'").select("id")).select("id")


@_query(f"""
    WITH RECURSIVE {_NODES}, walk(id, place, depth) AS (
        SELECT id, '0' || lower(name) || chr(1) || id, 0 FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.id, w.place || chr(2) || CASE WHEN n.id LIKE 's%' THEN '1' ELSE '0' END || lower(n.name) || chr(1) || n.id, w.depth + 1 FROM walk w JOIN nodes n ON n.parent = w.id)
    SELECT place, repeat('   ', depth + 1) || '* ' || CASE WHEN id LIKE 's%' THEN '[' || name || '](gdoc:' || id || ')' ELSE name END AS line FROM walk JOIN nodes USING (id)
""")
def tree_contents_page(spark, sf_dir):
    return trees.contents_page(_nodes(spark, sf_dir).withColumn("kind", F.when(F.col("id").startswith("s"), "md").otherwise("directory")))


@_query(f"""
    SELECT parts[1] AS node, count(*) AS n_files, count(*) FILTER (page_id % 3 = 0) AS n_checked, bool_and(page_id % 3 = 0) AS all_checked
    FROM (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS parts FROM pages) WHERE len(parts) = 2 GROUP BY 1
""")
def tree_checked_folders(spark, sf_dir):
    two = F.size(T.path_parts(_page_path())) == 2
    return trees.checked_folders(_table(spark, sf_dir, "pages").where(two).withColumn("path", _page_path()), "path", F.col("page_id") % 3 == 0)


@_query("""
    SELECT n_nationkey AS doc, 's' || s_suppkey AS identifier, s_name AS name, 10 + 10 * (row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1) AS weight, CAST(NULL AS VARCHAR) AS parent
    FROM nation JOIN supplier ON s_nationkey = n_nationkey
""")
def tree_bullet_menu(spark, sf_dir):
    line = F.concat(F.lit("* ["), "s_name", F.lit("](s"), F.col("s_suppkey").cast("string"), F.lit(")"))
    plain = F.lit("* no link")
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), (F.col("s_suppkey") * 2).alias("no"), line.alias("line"))
    return trees.bullet_menu(rows.unionByName(rows.select("doc", (F.col("no") + 1).alias("no"), plain.alias("line"))), "doc", "no", "line")


# listings and snapshots


@_query("""
    SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'n' || c_nationkey END AS parent_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS BIGINT) END AS size,
        CASE WHEN c_custkey % 2 = 0 THEN c_name || ' <' || c_custkey || '@x>' ELSE c_name END AS last_author, '2024' AS modified FROM customer
""")
def sync_listing_rows(spark, sf_dir):
    key = F.col("c_custkey")
    parents = F.when(key % 4 != 0, F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    raw = _table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), parents.alias("parents"), F.when(key % 3 == 0, key.cast("string")).otherwise("none").alias("size"), F.col("c_name").alias("author_name"),
        F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit("@x"))).alias("author_mail"), F.lit("2024").alias("modified"),
    )
    return snapshots.listing_rows(raw)


@_query("""
    SELECT p_partkey, p_size % 3 <> 0 OR p_partkey % 10 = 0 AS wanted FROM part
""")
def sync_needed_files(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    name = lambda f: F.concat(F.col("p_partkey").cast("string"), F.lit("." + f))
    have = part.where("p_size % 3 <> 1").select(name("svg").alias("name")).unionByName(part.where("p_size % 3 <> 2").select(name("png").alias("name")))
    return snapshots.needed_files(part.select("p_partkey"), have, "p_partkey", ("svg", "png"), F.col("p_partkey") % 10 == 0)


_FEED = "feed AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS version, arg_max(event_type, (ts, event_id)) = 'error' AS trashed FROM events GROUP BY user_id), tree AS (SELECT user_id, max(event_id) AS version FROM events WHERE event_id % 3 = 0 AND user_id % 4 <> 0 GROUP BY user_id)"


def _feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = _table(spark, sf_dir, "events")
    feed = events.latest_by(log, "user_id", ("ts", "event_id"), ("event_id", "event_type")).select("user_id", F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("trashed"))
    return feed, log.where("event_id % 3 = 0 and user_id % 4 <> 0").groupBy("user_id").agg(F.max("event_id").alias("version"))


@_query(f"WITH {_FEED} SELECT f.* FROM feed f LEFT JOIN tree t USING (user_id) WHERE (t.version IS NULL AND NOT trashed) OR t.version < f.version")
def sync_pending_changes(spark, sf_dir):
    return snapshots.pending_changes(*_feed(spark, sf_dir), "user_id", "version")


@_query(f"WITH {_FEED} SELECT f.* FROM feed f JOIN tree t USING (user_id) WHERE t.version <> f.version")
def sync_changed_files(spark, sf_dir):
    return snapshots.changed_files(*_feed(spark, sf_dir), "user_id", "version")


@_query("""
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST((SELECT max(q.p_partkey) FROM part q WHERE lower(q.p_name) = lower(p.p_name) AND q.p_size % 2 = 1) AS BIGINT)
        ELSE CAST((SELECT max(q.p_partkey) FROM part q WHERE lower(q.p_name) = lower(p.p_name) AND q.p_size % 2 = 1) AS BIGINT) END AS remote_id FROM part p
""")
def sync_upload_plan(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    remote = part.where("p_size % 2 = 1").select("p_name", F.col("p_partkey").alias("remote_id"))
    return snapshots.upload_plan(part, remote, T.slug(F.col("p_name")), T.slug(F.col("p_name")), "remote_id", ("remote_id",)).select("p_partkey", "remote_id")


@_query("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 5 <> 0, lower(p_name), p_partkey) AS place FROM part")
def sync_listing_order(spark, sf_dir):
    """Folders first, then names without case, then keys; numbered over ranges of that order."""
    from leafmill.operators.running import running_sum

    rows = _table(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("all"), (F.col("p_size") % 5 != 0).alias("file"), F.lower("p_name").alias("name"))
    return running_sum(rows, ("all",), ("file", "name", "p_partkey"), F.lit(1), "place").select("p_partkey", "place")


@_query("SELECT c_custkey, coalesce(s, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def job_progress(spark, sf_dir):
    updates = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return events.progress(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), updates, "c_custkey", ("c_acctbal",))


# events and jobs


@_query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def event_errors_in_range(spark, sf_dir):
    inside = F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return _table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view") & inside).select("event_id", "event_type")


@_query("SELECT event_id FROM (SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-15', 0) ORDER BY ts DESC, event_id DESC LIMIT 100)")
def event_older_page(spark, sf_dir):
    import datetime

    return events.keyset_page(_table(spark, sf_dir, "events").select("ts", "event_id"), ("ts", "event_id"), (datetime.datetime(2024, 1, 15), 0), True, 100).select("event_id")


@_query("""
    SELECT user_id, arg_min(state, event_id) AS state, arg_min(round(ms / 100.0) / 10, event_id) AS seconds FROM (
        SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' ELSE 'running' END AS state, CAST(event_id % 5000 AS BIGINT) AS ms FROM events) WHERE state <> 'running' GROUP BY user_id
""")
def job_last_finished(spark, sf_dir):
    kind = F.col("event_type")
    jobs = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "error", "failed").when(kind == "view", "done").otherwise("running").alias("state"), F.lit(0).alias("started"), (F.col("event_id") % 5000).alias("finished"))
    return events.last_finished(jobs, "user_id", "event_id", "state", "started", "finished")


@_query("""
    WITH calls AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
    fold AS (WITH RECURSIVE f(user_id, event_type, k, event_id, until, taken) AS (
        SELECT user_id, event_type, k, event_id, event_id + 700, true FROM calls WHERE k = 1
        UNION ALL SELECT c.user_id, c.event_type, c.k, c.event_id, CASE WHEN c.event_id >= f.until THEN c.event_id + 700 ELSE f.until END, c.event_id >= f.until
        FROM f JOIN calls c ON c.user_id = f.user_id AND c.event_type = f.event_type AND c.k = f.k + 1) SELECT * FROM f)
    SELECT user_id, event_type, event_id FROM fold WHERE taken
""")
def job_active_dedupe(spark, sf_dir):
    calls = _table(spark, sf_dir, "events").select("user_id", "event_type", F.lit("").alias("payload"), "event_id", (F.col("event_id") + 700).alias("ended"))
    return events.active_dedupe(calls, "user_id", "event_type", "payload", "event_id", "ended").select("user_id", "event_type", "event_id")


@_query("""
    WITH RECURSIVE t AS (SELECT 'j' || n_nationkey AS a, 'j' || (n_nationkey * 2 + 1) % 25 AS b FROM nation), r(job) AS (SELECT b FROM t WHERE a = 'j3' UNION SELECT t.b FROM r JOIN t ON t.a = r.job)
    SELECT job FROM r WHERE job <> 'j3'
""")
def job_trigger_chain(spark, sf_dir):
    key = F.col("n_nationkey")
    triggers = _table(spark, sf_dir, "nation").select(F.concat(F.lit("j"), key.cast("string")).alias("on"), F.concat(F.lit("j"), ((key * 2 + 1) % 25).cast("string")).alias("job"))
    return events.trigger_chain(triggers, "j3").select("job")


@_query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS payload FROM events WHERE event_type = 'view' GROUP BY user_id")
def job_sync_payload(spark, sf_dir):
    from leafmill.streaming.changes import sync_jobs

    return sync_jobs(_table(spark, sf_dir, "events").where("event_type = 'view'"), "user_id", "event_id")


# version control as text

_CODES = "CASE l_returnflag WHEN 'R' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END"


def _git_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = _table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "R", "A").when(F.col("l_returnflag") == "N", "M").otherwise("D")
    path = F.concat(F.lit("d/"), F.col("l_partkey").cast("string"))
    named = line.select((F.col("l_orderkey") % 10).alias("doc"), F.concat(code, F.lit("\t"), path, F.lit(".md")).alias("line"))
    short = line.select((F.col("l_orderkey") % 10).alias("doc"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "?? ").otherwise(" M "), path, F.when(F.col("l_linenumber") % 3 == 0, ".assets/x.png").otherwise(".md")).alias("line"))
    return named, short


_GIT = f"""src AS (SELECT *, l_orderkey % 10 AS doc, 'd/' || l_partkey || '.md' AS path FROM lineitem),
    both_ AS (SELECT doc, path, CASE {_CODES} WHEN 'A' THEN 'N' ELSE {_CODES} END AS state, 0 AS att FROM src
              UNION ALL SELECT doc, path, CASE WHEN l_linenumber % 3 = 0 OR l_linenumber % 2 = 1 THEN 'M' ELSE 'N' END, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END FROM src)"""


@_query(f"WITH {_GIT} SELECT doc, path, bool_or(state = 'N') AS is_new, bool_or(state = 'M') AS is_modified, bool_or(state = 'D') AS is_deleted, CAST(sum(att) AS BIGINT) AS attachments FROM both_ GROUP BY doc, path")
def git_changes(spark, sf_dir):
    named, short = _git_lines(spark, sf_dir)
    return git.changes(git.name_status(named), git.short_status(short))


@_query(f"WITH {_GIT} SELECT doc, count(*) + count(*) FILTER ({_CODES} <> 'D') AS n_unstaged FROM src GROUP BY doc")
def git_unstaged(spark, sf_dir):
    named, short = _git_lines(spark, sf_dir)
    return git.unstaged_count(git.name_status(named), short)


@_query("SELECT o_custkey AS doc, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS author, CAST(o_orderkey * 7 AS BIGINT) AS seconds, 'first ' || o_orderstatus || chr(10) || 'second' AS message FROM orders")
def git_commits(spark, sf_dir):
    text = F.col("o_orderkey").cast("string")
    lines = [F.concat(F.lit("commit "), text), F.lit(""), F.concat(F.lit("Author: "), "o_orderpriority"), F.concat(F.lit("Date: "), (F.col("o_orderkey") * 7).cast("string")), F.lit(""), F.concat(F.lit("  first "), "o_orderstatus"), F.lit(" second "), F.lit("")]
    rows = _table(spark, sf_dir, "orders").withColumn("doc", F.col("o_custkey")).withColumn("place", F.col("o_orderkey"))
    made = rows.select("doc", F.posexplode(F.array(*lines)).alias("at", "line"), "place").select("doc", (F.col("place") * 100 + F.col("at")).alias("no"), "line")
    return git.commits(made)


@_query("""
    SELECT o_custkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'new-' ELSE 'old-' END || o_orderkey AS old_file, 'new-' || o_orderkey AS new_file, CAST(o_orderkey % 3 AS BIGINT) AS n_changed FROM orders
""")
def git_diff_files(spark, sf_dir):
    key = F.col("o_orderkey")
    text = key.cast("string")
    old = F.when(key % 2 == 0, "--- /dev/null").otherwise(F.concat(F.lit("--- a/old-"), text))
    lines = F.concat(F.array(F.lit("diff --git x y"), F.lit("index 1..2"), old, F.concat(F.lit("+++ b/new-"), text), F.lit("@@ -1 +1 @@"), F.lit(" same")), F.slice(F.array(F.lit("+added"), F.lit("-gone")), F.lit(1), (key % 3).cast("int")))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.posexplode(lines).alias("at", "line"), key.alias("place")).select("doc", (F.col("place") * 100 + F.col("at")).alias("no"), "line")
    return git.diff_files(rows).select("doc", "old_file", "new_file", "n_changed")


@_query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) AS ahead, (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0) AS behind")
def git_ahead_behind(spark, sf_dir):
    ids = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return git.ahead_behind(ids.where("id % 3 = 0"), ids.where("id % 4 = 0"))


@_query("""
    SELECT l_orderkey AS path FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_linenumber = 3 OR l_returnflag <> 'R')
""")
def git_auto_commit(spark, sf_dir):
    item = _table(spark, sf_dir, "lineitem").withColumn("path", F.col("l_orderkey"))
    body = F.when(F.col("l_returnflag") == "R", "text").when(F.col("l_returnflag") == "A", "version: 3").otherwise("date: x")
    lines = item.select("path", F.concat(F.when(F.col("l_linenumber") == 3, " ").when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), body).alias("line"))
    return git.auto_commit(item, lines, ("version:", "date:"))


@_query("SELECT path FROM (SELECT p_partkey || CASE WHEN p_size % 2 = 0 THEN '.md' ELSE '.assets/a.png' END AS path, p_partkey FROM part) WHERE p_partkey % 3 = 0")
def git_commit_files(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    changed = part.select(F.concat(key, F.when(F.col("p_size") % 2 == 0, ".md").otherwise(".assets/a.png")).alias("path"))
    return git.commit_files(changed, part.where("p_partkey % 3 = 0").select(F.concat(key, F.lit(".md")).alias("path")))


# texts that are read and written


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'conflict' ELSE CASE WHEN doc_id % 3 = 1 THEN 'redir' ELSE 'md' END END AS kind, CAST(doc_id AS VARCHAR) AS id, lang AS title, CAST(length(coalesce(text, '')) AS BIGINT) AS n_body FROM documents")
def text_front_matter(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "conflict")
    fields = {"id": F.col("doc_id"), "title": F.col("lang"), "type": kind, "redirectTo": F.when(F.col("doc_id") % 3 < 2, "x")}
    page = sinks.document_page(fields, F.col("text"))
    split = sources.split_front_matter(page)
    read = _table(spark, sf_dir, "documents").select("doc_id", split.alias("split"))
    header = F.col("split.header")
    return read.select("doc_id", sources.document_kind(header).alias("kind"), sources.header_field(header, "id").alias("id"), sources.header_field(header, "title").alias("title"), F.length("split.body").cast("long").alias("n_body"))


@_query("""
    SELECT user_id, '## ' || user_id || chr(10) || chr(10) || string_agg('* ' || CASE event_type WHEN 'error' THEN 'error' ELSE 'warn' END || ': m' || event_id || chr(10), '' ORDER BY event_id) AS page FROM events WHERE event_type IN ('error', 'view') GROUP BY user_id
""")
def sink_error_pages(spark, sf_dir):
    kind = F.col("event_type")
    log = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "error", "error").when(kind == "view", "warn").otherwise("info").alias("level"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"))
    return sinks.error_pages(log, "user_id", "event_id")


@_query("""
    SELECT p_brand, 'type: ''directory''' || chr(10) || 'fileMap:' || chr(10) || string_agg('  ''' || p_partkey || '.png'':' || chr(10) || '    id: ''' || p_partkey || '''' || chr(10) || '    fileName: ''' || p_name || '''' || chr(10), '' ORDER BY p_partkey || '.png') AS yaml
    FROM part GROUP BY p_brand
""")
def sink_directory_map(spark, sf_dir):
    files = _table(spark, sf_dir, "part").select("p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("real_name"), F.col("p_partkey").alias("id"), F.col("p_name").alias("file_name"))
    return sinks.directory_map(files, "p_brand")


@_query("""
    SELECT p_name AS name, '---' || chr(10) || 'id: ''conflict:' || p_name || '''' || chr(10) || 'title: ''Conflict: ' || p_name || '''' || chr(10) || 'type: ''conflict''' || chr(10) || '---' || chr(10) || 'There were two documents with the same name in the same folder:' || chr(10)
        || string_agg('* [' || p_brand || '](' || p_partkey || '.md)' || chr(10), '' ORDER BY p_partkey) AS page FROM part GROUP BY p_name HAVING count(*) > 1
""")
def sink_conflict_pages(spark, sf_dir):
    member = F.struct("p_partkey", F.col("p_brand").alias("title"), F.concat(F.col("p_partkey").cast("string"), F.lit(".md")).alias("real_name"))
    groups = _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    return groups.select("name", sinks.conflict_page(F.col("name"), F.col("members")).alias("page"))


@_query("SELECT doc_id, md5(coalesce(text, '')) || '.png' AS name FROM documents WHERE doc_id % 3 = 0")
def sink_asset_names(spark, sf_dir):
    k = F.col("doc_id") % 3
    path = F.concat(F.col("doc_id").cast("string"), F.when(k == 0, "/a.PNG").when(k == 1, "/Thumbnail.png").otherwise("/a.xml"))
    files = _table(spark, sf_dir, "documents").select(path.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return sinks.asset_names(files).select(F.col("folder").cast("bigint").alias("doc_id"), "name")


# search


@_query(r"""
    SELECT term, field, p_partkey AS ref, count(*) AS tf FROM (
        SELECT p_partkey, 'title' AS field, unnest(string_split(lower(p_name), ' ')) AS term FROM part
        UNION ALL SELECT p_partkey, 'id', unnest(string_split(lower(p_brand || '_' || p_partkey), '_')) FROM part WHERE NOT regexp_matches(p_brand, '[\s\-@#,.]')
        UNION ALL SELECT p_partkey, 'id', unnest(list_filter(regexp_split_to_array(lower(p_brand || '_' || p_partkey), '[\s\-_@#,.]+'), lambda x: x <> '')) FROM part WHERE regexp_matches(p_brand, '[\s\-@#,.]')
        UNION ALL SELECT p_partkey, 'id2', unnest(list_filter(regexp_split_to_array(lower(replace(p_brand, '-', '') || p_partkey), '[\s\-_@#,.]+'), lambda x: x <> '')) FROM part)
    GROUP BY ALL
""")
def search_field_postings(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("id", F.concat("p_brand", F.lit("_"), F.col("p_partkey").cast("string")))
    return search.field_postings(part, "p_partkey", "id", "p_name")


@_query("""
    WITH tok AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part) GROUP BY 1, 2),
    len AS (SELECT p_partkey, sum(tf) AS l FROM tok GROUP BY 1), tot AS (SELECT count(*) AS n, avg(l) AS m FROM len), df AS (SELECT term, count(*) AS d FROM tok GROUP BY 1)
    SELECT p_partkey, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM tok JOIN len USING (p_partkey) JOIN df USING (term), tot WHERE term IN ('red', 'bolt') GROUP BY p_partkey
""")
def search_bm25(spark, sf_dir):
    index = search.postings(_table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return search.bm25(index, "p_partkey", ["red", "bolt"]).select("p_partkey", F.round("score", 6).alias("score"))


@_query("SELECT p_partkey, '/x/' || p_brand AS path, count(*) AS score FROM (SELECT p_partkey, p_brand, unnest(string_split(lower(p_name), ' ')) AS term FROM part) WHERE term = 'red' GROUP BY 1, 2")
def search_with_store(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    found = search.search(search.postings(part, "p_partkey", "p_name"), "p_partkey", "red")
    return search.with_store(found, part.select("p_partkey", F.col("p_brand").alias("path")), "p_partkey", "/x/").select("p_partkey", "path", "score")


@_query(f"WITH {_SNAPSHOTS} SELECT o_orderkey FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def sync_removed(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return naming.name_events(old, new, "o_orderkey", "o_orderstatus").where("event = 'removed'").select("o_orderkey")
