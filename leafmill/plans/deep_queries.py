"""Registered queries of traversals, job histories, change states, stored files and nested values, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import paths as P
from leafmill.operators import events, links, naming, ordering, running, search, trees, variants
from leafmill.operators.term_index import TermIndex
from leafmill.plans.queries import _LINKS, _links, _nodes, _query, _table
from leafmill.plans.view_queries import ORACLE_SQL, QUERIES  # noqa: F401
from leafmill.sinks import files as sinks
from leafmill.sources import files as sources
from leafmill.streaming.changes import ChangeState

# traversals: regions, nations and customers, which share few names

_MARKETS = """nodes AS (
    SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_mktsegment FROM customer
), ranked AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name, id) AS place FROM nodes
), walk(id, parent, name, place, depth, places) AS (
    SELECT id, parent, name, place, CAST(0 AS BIGINT), [place] FROM ranked WHERE parent IS NULL
    UNION ALL SELECT r.id, r.parent, r.name, r.place, w.depth + 1, list_append(w.places, r.place) FROM walk w JOIN ranked r ON r.parent = w.id
), numbered AS (SELECT *, row_number() OVER (ORDER BY places) - 1 AS pre FROM walk
), sized AS (
    SELECT id, sum(n) AS n FROM (
        SELECT id, 1 AS n FROM walk UNION ALL SELECT parent, 1 FROM walk WHERE parent IS NOT NULL
        UNION ALL SELECT p.parent, 1 FROM walk c JOIN walk p ON p.id = c.parent WHERE p.parent IS NOT NULL
    ) GROUP BY id
), looked AS (
    SELECT w.*, CAST(w.pre + s.n - 1 AS BIGINT) AS last, row_number() OVER (ORDER BY coalesce(p.pre, -1), w.place) - 1 AS visit
    FROM numbered w JOIN sized s USING (id) LEFT JOIN numbered p ON p.id = w.parent
)"""


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(table: str, mark: str, key: str, name: str, above: tuple[str, str] | None) -> DataFrame:
        parent = F.concat(F.lit(above[0]), F.col(above[1]).cast("string")) if above else F.lit(None).cast("string")
        return _table(spark, sf_dir, table).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), parent.alias("parent"), F.col(name).alias("name"))

    return part("region", "r", "r_regionkey", "r_name", None).union(part("nation", "n", "n_nationkey", "n_name", ("r", "n_regionkey"))).union(part("customer", "c", "c_custkey", "c_mktsegment", ("n", "c_nationkey")))


@_query(f"WITH RECURSIVE {_MARKETS} SELECT id, parent, place, pre, last, depth, visit FROM looked")
def tree_traversal(spark, sf_dir):
    """Every node's depth-first numbers, and its turn where siblings are looked at before what is below them."""
    return trees.visits(trees.tour(_markets(spark, sf_dir)))


@_query(f"WITH RECURSIVE {_MARKETS} SELECT name, arg_min(id, visit) AS id FROM looked GROUP BY name")
def tree_find_first(spark, sf_dir):
    """The first node of each name that stands in the tree."""
    nodes = _markets(spark, sf_dir)
    return trees.find_first(trees.tour(nodes), nodes.select("name", "id"), "name")


@_query(f"WITH RECURSIVE {_MARKETS} SELECT id, depth FROM looked WHERE id = 'r2' OR parent = 'r2' OR parent IN (SELECT id FROM nodes WHERE parent = 'r2')")
def tree_below(spark, sf_dir):
    return trees.below(trees.tour(_markets(spark, sf_dir)), "r2").select("id", "depth")


@_query(f"""
    WITH RECURSIVE {_MARKETS}, steps AS (
        SELECT 2 * pre - depth AS "at", CASE WHEN place > 1 THEN ',' ELSE '' END || '{{"id":"' || id || '","name":"' || name || '","children":[' AS value FROM looked
        UNION ALL SELECT 2 * last + 1 - depth, ']}}' FROM looked UNION ALL SELECT -1, '[' UNION ALL SELECT 2 * count(*), ']' FROM looked
    ) SELECT "at" AS line_at, value FROM steps
""")
def sink_tree_lines(spark, sf_dir):
    """The lines of a nested tree file, in the order of ``line_at``."""
    nodes = _markets(spark, sf_dir)
    return sinks.tree_lines(trees.tour(nodes), nodes).withColumnRenamed("at", "line_at")


# jobs and changes

_CALLS = """calls AS (
    SELECT user_id % 40 AS drive, event_id, CASE event_id * 7 % 11 % 5 WHEN 3 THEN 'start' WHEN 4 THEN 'finish' ELSE 'schedule' END AS op,
           CASE event_id * 13 % 17 % 7 WHEN 0 THEN 'sync_all' WHEN 1 THEN 'git_push' WHEN 2 THEN 'transform' WHEN 3 THEN 'run_action' ELSE 'sync' END AS type, 'p' || (event_id * 5 % 7 % 3) AS payload FROM events
)"""


@_query(f"""
    WITH RECURSIVE {_CALLS}, steps AS (
        SELECT *, type || ':' || CASE WHEN type IN ('sync', 'run_action') THEN payload ELSE '' END AS slot, row_number() OVER (PARTITION BY drive ORDER BY event_id) AS n FROM calls
    ), states(drive, n, waiting, running, taken) AS (
        SELECT DISTINCT drive, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false FROM steps
        UNION ALL
        SELECT drive, n, CASE
                WHEN op = 'schedule' AND NOT ok THEN waiting WHEN op = 'schedule' AND type = 'sync_all' THEN [slot]
                WHEN op = 'schedule' THEN list_append(waiting, slot) ELSE list_filter(waiting, lambda x: x <> slot) END,
            CASE WHEN op = 'start' THEN list_append(list_filter(running, lambda x: x <> slot), slot) WHEN op = 'finish' THEN list_filter(running, lambda x: x <> slot) ELSE running END,
            op = 'schedule' AND ok
        FROM (
            SELECT s.drive, t.n, t.op, t.type, t.slot, s.waiting, s.running,
                t.type = 'run_action' OR NOT (list_contains(s.waiting, t.slot) OR list_contains(s.running, t.slot) OR (t.type = 'sync' AND (list_contains(s.waiting, 'sync_all:') OR list_contains(s.running, 'sync_all:')))) AS ok
            FROM states s JOIN steps t ON t.drive = s.drive AND t.n = s.n + 1
        )
    ), told AS (SELECT steps.*, taken FROM steps JOIN states USING (drive, n)),
    moves AS (SELECT a.drive, a.event_id, min(b.n) AS n FROM told a JOIN told b ON b.drive = a.drive AND b.slot = a.slot AND b.op <> 'schedule' AND b.n > a.n GROUP BY ALL),
    flushes AS (SELECT a.drive, a.event_id, min(b.n) AS n FROM told a JOIN told b ON b.drive = a.drive AND b.type = 'sync_all' AND b.taken AND b.n > a.n WHERE a.type <> 'sync_all' GROUP BY ALL)
    SELECT t.drive, t.event_id, CASE WHEN NOT t.taken THEN 'dropped' WHEN m.n IS NOT NULL AND (f.n IS NULL OR m.n < f.n) THEN CASE b.op WHEN 'start' THEN 'started' ELSE 'finished' END
        WHEN f.n IS NOT NULL THEN 'replaced' ELSE 'waiting' END AS outcome
    FROM told t LEFT JOIN moves m USING (drive, event_id) LEFT JOIN flushes f USING (drive, event_id) LEFT JOIN told b ON b.drive = t.drive AND b.n = m.n WHERE t.op = 'schedule'
""")
def job_schedule(spark, sf_dir):
    """What becomes of each call that schedules a job, with jobs of several types in one drive."""
    key = F.col("event_id")
    by_op, by_type = key * 7 % 11 % 5, key * 13 % 17 % 7
    kind = F.when(by_type == 0, "sync_all").when(by_type == 1, "git_push").when(by_type == 2, "transform").when(by_type == 3, "run_action").otherwise("sync")
    calls = _table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("drive"), "event_id", F.when(by_op == 3, "start").when(by_op == 4, "finish").otherwise("schedule").alias("op"), kind.alias("type"), F.concat(F.lit("p"), (key * 5 % 7 % 3).cast("string")).alias("payload"),
    )
    return events.job_schedule(calls, "drive", "event_id")


@_query("""
    WITH last AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id)
    SELECT user_id, event_id, event_type FROM last JOIN events USING (user_id, event_id) WHERE user_id % 5 <> 0 OR event_id % 3 <> 0
""")
def event_change_state(spark, sf_dir):
    """Events in three batches merged into a change state, then pruned against a tree that holds some of them."""
    log = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lit(False).alias("trashed"))
    state = ChangeState(spark, f"{running.shared_dir(spark).rstrip('/')}/change-state-{uuid.uuid4().hex}", "user_id", ("event_id",), log.schema, n_buckets=8)
    for batch in range(3):
        state.merge(log.where(F.col("event_id") % 3 == batch), batch)
    held = state.read().where("user_id % 5 = 0 and event_id % 3 = 0").select("user_id", "event_id")
    state.prune(held, "event_id")
    return state.read().drop("trashed")


# anchors in texts

_ANCHORED = r"""docs AS (
    SELECT 'd' || doc_id AS id, replace(coalesce(text, ''), chr(10), chr(10) || ' <a id="s' || (doc_id % 50) || '"></a>' || chr(10)) || ' <a id="top"></a>gdoc:d' || (doc_id * 3 % 200) || '#top gdoc:d' || (doc_id % 97) || '#s' || (doc_id % 7) AS text,
           length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS n_lines, doc_id FROM documents
), linked AS (SELECT DISTINCT 'd' || (doc_id * 3 % 200) AS id, 'top' AS name FROM documents UNION SELECT DISTINCT 'd' || (doc_id % 97), 's' || (doc_id % 7) FROM documents)"""


@_query(rf"""
    WITH {_ANCHORED}, judged AS (SELECT d.*, t.id IS NULL AS no_top, s.id IS NULL AND n_lines > 0 AS no_line FROM docs d LEFT JOIN linked t ON t.id = d.id AND t.name = 'top' LEFT JOIN linked s ON s.id = d.id AND s.name = 's' || (doc_id % 50)),
    topless AS (SELECT *, CASE WHEN no_top THEN replace(replace(text, chr(10) || ' <a id="top"></a>', chr(10)), ' <a id="top"></a>', '') ELSE text END AS first FROM judged)
    SELECT id, sha256(CASE WHEN no_line THEN replace(first, chr(10) || ' <a id="s' || (doc_id % 50) || '"></a>' || chr(10), chr(10)) ELSE first END) AS text_sha256, CAST(CASE WHEN no_top THEN 1 ELSE 0 END + CASE WHEN no_line THEN n_lines ELSE 0 END AS BIGINT) AS n_dropped FROM topless
""")
def link_anchor_sweep(spark, sf_dir):
    """Anchors that no document links to, taken out of all documents."""
    key = F.col("doc_id")
    anchor = F.concat(F.lit('\n <a id="s'), (key % 50).cast("string"), F.lit('"></a>\n'))
    named = lambda n, name: F.concat(F.lit("gdoc:d"), n.cast("string"), F.lit("#"), name)
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), anchor), F.lit(' <a id="top"></a>'), named(key * 3 % 200, F.lit("top")), F.lit(" "), named(key % 97, F.concat(F.lit("s"), (key % 7).cast("string"))))
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), key.cast("string")).alias("id"), text.alias("text"))
    found = links.anchors(docs)
    swept = links.sweep_anchors(docs, found, links.unreferenced(found, links.place_links(docs)))
    return swept.select("id", F.sha2("text", 256).alias("text_sha256"), "n_dropped")


# stored files and nested values


@_query("SELECT p_brand, p_partkey || '''s: \"x\".png' AS real_name, CAST(p_partkey AS VARCHAR) AS id, p_name AS file_name FROM part WHERE p_brand NOT LIKE '%3'")
def text_file_map(spark, sf_dir):
    """The file map that directory files store, read back; directories without an id store none."""
    files = _table(spark, sf_dir, "part").select(
        "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit("'s: \"x\".png")).alias("real_name"), F.col("p_partkey").alias("id"), F.col("p_name").alias("file_name"), F.when(~F.col("p_brand").endswith("3"), F.col("p_brand")).alias("own"),
    )
    return sources.stored_file_map(sinks.directory_map(files, "p_brand", "own"), "p_brand", "yaml")


@_query("""
    SELECT p_partkey, repeat('a[0].', CAST(p_size % 6 AS INTEGER)) || 'l' AS path, 'gdoc:' || p_partkey AS link FROM part
    UNION ALL SELECT p_partkey, repeat('a[0].', CAST(p_size % 6 AS INTEGER)) || 'm[' || k || '].u', 'https://x/' || k FROM part, range(1, 3) AS r(k) WHERE p_size % 4 = 0
""")
def text_variant_links(spark, sf_dir):
    """Links in JSON texts nested in up to thirteen levels."""
    n = (F.col("p_size") % 6).cast("int")
    more = F.when(F.col("p_size") % 4 == 0, F.lit(',"m":[{"v":"http"},{"u":"https://x/1"},{"u":"https://x/2"}]')).otherwise(F.lit(',"m":null'))
    json = F.concat(F.repeat(F.lit('{"a":['), n), F.lit('{"l":"gdoc:'), F.col("p_partkey").cast("string"), F.lit('"'), more, F.lit("}"), F.repeat(F.lit("]}"), n))
    part = _table(spark, sf_dir, "part").select("p_partkey", json.alias("json"))
    return variants.links_inside(variants.traverse(part, "p_partkey", F.col("json")), "p_partkey")


@_query("""
    SELECT p_partkey, 'body.content[0].p[' || k || '].inlineObjectElement' AS path, 'i' || p_size || '-' || k AS image, CASE WHEN p_size % 3 = 0 THEN 'https://docs/' || p_size END AS url
    FROM part, range(0, 2) AS r(k) WHERE p_size % 2 = 0
""")
def text_inline_images(spark, sf_dir):
    size = F.col("p_size").cast("string")
    style = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(',"textStyle":{"link":{"url":"https://docs/'), size, F.lit('"}}'))).otherwise("")
    element = lambda k: F.concat(F.lit('{"inlineObjectElement":{"inlineObjectId":"i'), size, F.lit(f'-{k}"'), style, F.lit("}}"))
    json = F.concat(F.lit('{"body":{"content":[{"p":['), F.when(F.col("p_size") % 2 == 0, F.concat(element(0), F.lit(","), element(1))).otherwise('{"textRun":"x"}'), F.lit("]}]}}"))
    part = _table(spark, sf_dir, "part").select("p_partkey", json.alias("json"))
    return variants.inline_images(variants.traverse(part, "p_partkey", F.col("json")), "p_partkey")


# orders and numbers

_NAMED = "CASE p_size % 4 WHEN 0 THEN 'É' WHEN 1 THEN 'e' WHEN 2 THEN 'Z' ELSE 'étage' END || CASE p_partkey % 3 WHEN 0 THEN upper(replace(p_name, ' ', '')) ELSE lower(replace(p_name, ' ', '')) END"
#: How the names of these queries sort without case: letters without marks, then the marks.
_SORTED = "strip_accents(lower(name)), lower(name)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("p_size") % 4 == 0, "É").when(F.col("p_size") % 4 == 1, "e").when(F.col("p_size") % 4 == 2, "Z").otherwise("étage")
    bare = F.replace("p_name", F.lit(" "), F.lit(""))
    return _table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(head, F.when(F.col("p_partkey") % 3 == 0, F.upper(bare)).otherwise(F.lower(bare))).alias("name"))


@_query(f"SELECT p_partkey, row_number() OVER (ORDER BY p_size % 5 <> 0, {_SORTED}, p_partkey) AS place FROM (SELECT *, {_NAMED} AS name FROM part)")
def sync_listing_collated(spark, sf_dir):
    """Folders first, then names with accents and in any case as a reader sorts them."""
    return ordering.listing_order(_named(spark, sf_dir), (), F.col("p_size") % 5 == 0, "name", "p_partkey").select("p_partkey", "place")


@_query(f"SELECT id, row_number() OVER (PARTITION BY parent ORDER BY p_size % 3 <> 0, {_SORTED}, id) AS place FROM (SELECT *, p_partkey AS id, p_size % 7 AS parent, {_NAMED} AS name FROM part)")
def tree_contents_collated(spark, sf_dir):
    """Places among siblings in a table of contents."""
    nodes = _named(spark, sf_dir).select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("parent"), "name", F.when(F.col("p_size") % 3 == 0, "directory").otherwise("md").alias("kind"))
    return ordering.contents_order(nodes).select("id", "place")


@_query(f"SELECT path, row_number() OVER (ORDER BY strip_accents(lower(path)), lower(path), path = upper(path), path) AS place FROM (SELECT DISTINCT CASE p_partkey % 2 WHEN 0 THEN lower(name) ELSE upper(name) END AS path FROM (SELECT *, {_NAMED} AS name FROM part))")
def git_change_order(spark, sf_dir):
    """Changed paths as a reader sorts them: of paths that differ in case alone the lower one first."""
    paths = _named(spark, sf_dir).select(F.when(F.col("p_partkey") % 2 == 0, F.lower("name")).otherwise(F.upper("name")).alias("path")).distinct()
    return ordering.change_order(paths, "path")


@_query("""
    WITH items AS (SELECT user_id, event_id, event_type, 1 + event_id % 3 AS level, event_id % 5 = 0 AND event_id % 4 <> 0 AS starts FROM events), placed AS (
        SELECT i.*, (SELECT max(r.event_id) FROM items r WHERE r.user_id = i.user_id AND r.event_type = i.event_type AND r.starts AND r.level <= i.level AND r.event_id <= i.event_id) AS since FROM items i
    )
    SELECT a.event_id, count(*) AS number FROM placed a JOIN items b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.level = a.level AND b.event_id <= a.event_id AND (a.since IS NULL OR b.event_id >= a.since) GROUP BY ALL
""")
def text_list_numbers(spark, sf_dir):
    """Events as list items of a document a user: numbers by style and level, with lists that start anew or go on."""
    key = F.col("event_id")
    items = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("style"), (1 + key % 3).cast("int").alias("level"), (key % 5 == 0).alias("opens"), (key % 4 == 0).alias("continues"))
    return ordering.list_numbers(items, "user_id", "event_id").select("event_id", "number")


@_query("""
    SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'n' ELSE r_name END END AS color, coalesce(CASE WHEN c_custkey % 5 = 0 THEN '9' END, CASE WHEN n_nationkey % 2 = 0 THEN '10' END) AS size
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def tree_effective(spark, sf_dir):
    """What customers inherit from their nation and region, property by property."""
    number = F.substring("id", 2, 20).cast("long")
    kind = F.substring("id", 1, 1)
    color = F.when(kind == "r", F.col("name")).when((kind == "n") & (number % 3 == 0), "n").when((kind == "c") & (number % 2 == 0), "c")
    size = F.when((kind == "n") & (number % 2 == 0), "10").when((kind == "c") & (number % 5 == 0), "9")
    props = F.map_from_entries(F.filter(F.array(F.struct(F.lit("text.color").alias("k"), color.alias("v")), F.struct(F.lit("text.size").alias("k"), size.alias("v"))), lambda e: e["v"].isNotNull()))
    found = trees.effective(_markets(spark, sf_dir).select("id", "parent", props.alias("props")))
    return found.where("id like 'c%'").select("id", F.col("props")["text.color"].alias("color"), F.col("props")["text.size"].alias("size"))


@_query("""
    WITH items AS (SELECT user_id, event_id, event_id % 3 AS level, trim(event_type) AS name, CASE WHEN event_id % 4 <> 0 THEN 'x' || event_id % 30 END AS link FROM events WHERE event_id % 11 <> 0),
    named AS (
        SELECT *, 30 + 10 * (row_number() OVER w - 1) AS weight, coalesce(link, 'header_' || count(*) FILTER (link IS NULL) OVER w) AS identifier FROM items WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    ), placed AS (SELECT n.*, (SELECT arg_max(p.identifier, p.event_id) FROM named p WHERE p.user_id = n.user_id AND p.level = n.level - 1 AND p.event_id < n.event_id) AS parent FROM named n)
    SELECT user_id, identifier, arg_max(name, event_id) AS name, arg_max(weight, event_id) AS weight, arg_max(coalesce(parent, ''), event_id) AS parent FROM placed GROUP BY user_id, identifier
""")
def tree_legacy_menu(spark, sf_dir):
    """Events as items of nested lists, a document a user."""
    key = F.col("event_id")
    url = F.when(key % 4 != 0, F.concat(F.lit("https://drive.google.com/open?id=x"), (key % 30).cast("string")))
    items = _table(spark, sf_dir, "events").select("user_id", "event_id", (key % 3).alias("level"), F.when(key % 11 != 0, F.concat(F.lit(" "), "event_type")).otherwise(" ").alias("text"), url.alias("url"))
    return trees.legacy_menu(items, "user_id", "event_id").withColumn("parent", F.coalesce("parent", F.lit("")))


@_query(r"""
    SELECT event_id, 'a b' || event_type AS shell, 'a\"b' || event_type AS log, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS time, CASE WHEN event_id % 3 > 0 THEN CAST(epoch_us(ts) // 1000000 * 1000 AS BIGINT) END AS ms FROM events
""")
def text_safe(spark, sf_dir):
    """Texts made safe for a command and a log, and times from epoch seconds and to milliseconds."""
    bad = F.concat(F.lit('a; |"b'), "event_type")
    time = F.when(F.col("event_id") % 3 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("no time")
    rows = _table(spark, sf_dir, "events")
    return rows.select(
        "event_id", P.shell_safe(bad).alias("shell"), P.log_safe(F.concat(F.lit('a\n"\rb'), "event_type")).alias("log"),
        F.date_format(P.time_of_seconds(F.col("event_id").cast("string")), "yyyy-MM-dd HH:mm:ss").alias("time"), P.millis_of(time).alias("ms"),
    )


@_query("""
    SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_und_' || p_size || '_prozent_oder_gruen' AS de, replace(p_name, ' ', '-') || '-y-' || p_size || '-por-ciento-o-grun' AS es, replace(p_name, ' ', '') || 'and' || p_size || 'percentorgrun' AS strict FROM part
""")
def name_slugify(spark, sf_dir):
    """Slugs in two languages and without any sign but letters and digits."""
    from leafmill.functions.unicode import slugify

    size = F.col("p_size").cast("string")
    name = F.concat(F.lit(" "), "p_name", F.lit(" & "), size, F.lit(" % | grün ^ "))
    return _table(spark, sf_dir, "part").select("p_partkey", slugify(name, "de", "_", lower=True).alias("de"), slugify(name, "es").alias("es"), slugify(F.replace(name, F.lit(" "), F.lit("")), strict=True).alias("strict"))


@_query("SELECT event_id FROM (SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 100)")
def event_default_page(spark, sf_dir):
    """A descending page without bounds ends now; here now is given."""
    fits = events.default_range("ts", F.lit("2024-01-10").cast("timestamp_ntz"), True)
    return events.log_page(_table(spark, sf_dir, "events"), ("ts", "event_id"), fits, True, 0, 100).select("event_id")


# the stored index


@_query("""
    WITH words AS (SELECT p_partkey, p_brand, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS ref, count(*) AS score FROM words WHERE starts_with(word, 'p') OR word = '7' GROUP BY p_partkey
""")
def search_stored(spark, sf_dir):
    """An index of two segments, of which the second brings some documents anew, merged and searched by prefix and term."""
    part = _table(spark, sf_dir, "part").select("p_partkey", F.lit(None).cast("string").alias("id"), F.col("p_name").alias("title"))
    index = TermIndex(spark, f"{running.shared_dir(spark).rstrip('/')}/term-index-{uuid.uuid4().hex}", 500)
    index.add(part.withColumn("title", F.when(F.col("p_partkey") % 2 == 0, "p old words").otherwise(F.col("title"))), "p_partkey", "id", "title")
    index.add(part.where("p_partkey % 2 = 0"), "p_partkey", "id", "title")
    index.merge()
    return index.search("p* 7")


# files that Spark writes and reads again


def _folder(spark: SparkSession, name: str) -> str:
    return f"{running.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size % 2 = 0 AS trashed, 'f' || p_size AS parent FROM part")
def source_listing(spark, sf_dir):
    """Folder listings, a JSON array a file, read with a fixed schema."""
    item = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("trashed"), F.array(F.concat(F.lit("f"), F.col("p_size").cast("string"))).alias("parents"), F.lit("x").alias("more"))
    pages = _table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("page")).agg(F.to_json(F.collect_list(item)).alias("value"))
    pages.select("value").write.option("maxRecordsPerFile", 1).text(path := _folder(spark, "listing"))
    return sources.read_listing(spark, path).select("id", "name", "trashed", F.get("parents", F.lit(0)).alias("parent"))


@_query("SELECT DISTINCT CAST(p_size + 1 AS BIGINT) AS size FROM part")
def source_file_sizes(spark, sf_dir):
    """Sizes of files, whose contents are not read."""
    _table(spark, sf_dir, "part").select(F.repeat(F.lit("x"), F.col("p_size").cast("int")).alias("value")).distinct().write.option("maxRecordsPerFile", 1).text(path := _folder(spark, "sizes"))
    return sources.read_metadata(spark, path).where("path like '%/part-%' and size > 0").select("size")


@_query("""
    WITH log AS (SELECT event_id, 'id' || user_id AS id, event_type FROM events WHERE user_id % 10 <> 3), firsts AS (SELECT id, min(event_id) AS first FROM log GROUP BY id)
    SELECT row_number() OVER (ORDER BY event_id) AS place, event_id, l.id FROM log l JOIN firsts f ON f.id = l.id WHERE event_type <> 'view' OR event_id = first
""")
def event_file_order(spark, sf_dir):
    """An event table written in several files, read in their order, and appended anew under the rules of the log."""
    event = F.when(F.col("event_type") == "view", "touched").otherwise("created")
    id_ = F.when(F.col("user_id") % 10 == 3, "TO_FILL").otherwise(F.concat(F.lit("id"), F.col("user_id").cast("string")))
    log = _table(spark, sf_dir, "events").select(F.concat(F.lit("/"), F.col("event_id").cast("string")).alias("filePath"), F.lit(1).cast("long").alias("mtime"), id_.alias("id"), F.lit("md").alias("type"), event.alias("event"), F.col("event_id").alias("seq"))
    sinks.write_events(log, path := _folder(spark, "events"))
    placed = running.running_sum(sources.read_events(spark, path, append=True), (), ("seq",), F.lit(1).cast("long"), "place")
    return placed.select("place", F.expr("cast(substring(filePath, 2) as bigint)").alias("event_id"), "id")


@_query(f"""WITH {_LINKS} SELECT CAST(source AS VARCHAR) AS source, 'page; "' || source || '"' AS name, target AS dest FROM links WHERE target <> ''""")
def link_file(spark, sf_dir):
    """A link table written and read again; values hold the separator and quotes."""
    name = F.concat(F.lit('page; "'), F.col("source").cast("string"), F.lit('"'))
    rows = _links(spark, sf_dir).where("target <> ''").select(F.col("source").cast("string").alias("source"), name.alias("name"), F.col("target").alias("dest"))
    sinks.write_links(rows, path := _folder(spark, "links"))
    return sources.read_links(spark, path)


@_query("""
    SELECT 'm' || event_id AS message, CASE WHEN event_id % 3 = 0 THEN 'j1' END AS job, CASE WHEN event_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events WHERE event_id % 3 <> 0 OR user_id % 5 = 1
""")
def sink_job_logs(spark, sf_dir):
    """Lines with a job by job, all others by day; one job's lines and the daily ones read again."""
    job = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("j"), (F.col("user_id") % 5).cast("string")))
    lines = _table(spark, sf_dir, "events").select(F.lit("info").alias("level"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), job.alias("jobId"))
    sinks.write_logs(lines, by_job := _folder(spark, "by-job"), daily := _folder(spark, "daily"))
    own = sources.read_job_log(spark, by_job, "j1").unionByName(sources.read_job_log(spark, by_job, "j9"))
    days = spark.read.schema("message string, day string").json(daily)
    return own.select("message", "job", F.lit(None).cast("string").alias("day")).unionByName(days.select("message", F.lit(None).cast("string").alias("job"), "day"))


# pages, names and look-ups


@_query("""
    SELECT p_partkey, '---' || chr(10) || 'title: ''' || replace(p_name, ' ', '''''') || '''' || chr(10) || 'redirectTo: ''../p' || p_size || '.md''' || chr(10) || '---' || chr(10)
        || 'Redirecting to ../p' || p_size || '.md' || chr(10) AS page FROM part
""")
def sink_redirect_pages(spark, sf_dir):
    target = F.concat(F.lit("../p"), F.col("p_size").cast("string"), F.lit(".md"))
    return _table(spark, sf_dir, "part").select("p_partkey", sinks.redirect_page(F.replace("p_name", F.lit(" "), F.lit("'")), target).alias("page"))


@_query("""
    SELECT CASE p_size % 5 WHEN 0 THEN 'n' || p_partkey || '.md' WHEN 1 THEN 'n' || p_partkey || '.svg' WHEN 2 THEN 'n' || p_partkey || '.png' ELSE 'n' || p_partkey END AS real_name,
        CASE p_size % 5 WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'conflict' ELSE 'binary' END WHEN 1 THEN 'drawing' WHEN 2 THEN 'binary' ELSE 'directory' END AS kind,
        CASE WHEN p_size % 5 = 0 AND p_partkey % 3 < 2 THEN 'i' || p_partkey ELSE 'TO_FILL' END AS id
    FROM part WHERE p_size % 5 < 4
""")
def sync_scan_directory(spark, sf_dir):
    """A folder's files as typed rows; reserved names, assets and debug files are left out."""
    kind, key = F.col("p_size") % 5, F.col("p_partkey").cast("string")
    name = F.concat(F.lit("/a/n"), key)
    path = F.when(kind == 0, F.concat(name, F.lit(".md"))).when(kind == 1, F.concat(name, F.lit(".svg"))).when(kind == 2, F.concat(name, F.lit(".png"))).when(kind == 3, F.concat(name, F.lit("/")))
    odd = F.when(F.col("p_partkey") % 3 == 0, F.lit("/a/toc.md")).when(F.col("p_partkey") % 3 == 1, F.concat(name, F.lit(".assets"))).otherwise(F.concat(name, F.lit(".debug.xml")))
    header = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "type: 'conflict'\n")
    text = F.coalesce(F.concat(F.lit("---\nid: 'i"), key, F.lit("'\n"), header, F.lit("---\nbody")), F.lit("no header"))
    files = _table(spark, sf_dir, "part").select(F.coalesce(path, odd).alias("path"), ((kind == 3) | ((kind == 4) & (F.col("p_partkey") % 3 == 1))).alias("is_dir"), text.alias("text"))
    return sources.scan_directory(files, ("toc.md",))


@_query("SELECT p_partkey, CAST(1 AS BIGINT) AS score FROM part WHERE p_partkey = 17")
def search_by_id(spark, sf_dir):
    """A query without hits, of over ten letters, is looked up as an id without its dashes."""
    part = _table(spark, sf_dir, "part")
    ids = part.select("p_partkey", F.concat(F.lit("Doc_id-long-"), F.col("p_partkey").cast("string")).alias("id_text"))
    return search.search(search.postings(part, "p_partkey", "p_name"), "p_partkey", "docid-long_17", ids)


@_query("""SELECT doc_id, '"' || coalesce(text, '') || '''' || chr(10) || '"''' AS text FROM documents""")
def text_quotes(spark, sf_dir):
    curly = F.concat(F.lit("“"), F.coalesce("text", F.lit("")), F.lit("’\u000b”‘"))
    return _table(spark, sf_dir, "documents").select("doc_id", P.straight_quotes(curly).alias("text"))


@_query("""
    WITH kept AS (SELECT s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA')
    SELECT 's' || s_suppkey AS id, 'node' AS kind FROM kept UNION ALL SELECT 'n' || n_nationkey, 'node' FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'
    UNION ALL SELECT 'r' || r_regionkey, 'node' FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 's' || s_suppkey, 'log' FROM kept
""")
def tree_delete_path(spark, sf_dir):
    """A folder that is deleted goes with all below it, and so do the log rows of their paths."""
    nodes = _nodes(spark, sf_dir)
    log = trees.tree_paths(nodes).where("id like 's%'").select("id", "path")
    left, rows = naming.delete_path(nodes, log, "ASIA")
    return left.select("id", F.lit("node").alias("kind")).unionByName(rows.select("id", F.lit("log").alias("kind")))


@_query("SELECT c_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def name_transform_tasks(spark, sf_dir):
    """Local files with the last remote row of their id."""
    remote = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state"))
    return naming.transform_tasks(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), remote, ("state", "version"))
