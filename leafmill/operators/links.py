"""The link graph: extraction, back links, closure, ranking and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.paths import LINK_SCHEME, relative_document_path
from leafmill.functions.text import url_hash, without_hash
from leafmill.operators.running import cut

HREF = 'href="([^"]*)"'


def extract_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """source, position and target (hash removed) of every href; null pages have none."""
    found = F.regexp_extract_all(F.col(html), F.lit(HREF), 1)
    each = pages.select(F.col(key).alias("source"), F.posexplode(found).alias("position", "href"))
    return each.select("source", F.col("position").cast("long").alias("position"), without_hash(F.col("href")).alias("target"))


def back_links(links: DataFrame) -> DataFrame:
    """target, n_sources (distinct sources) and n_links. Pre-aggregated by pair, so a hub costs a row per source."""
    pairs = links.groupBy("target", "source").agg(F.count("*").alias("n"))
    return pairs.groupBy("target").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_links"))


def distinct_links(links: DataFrame) -> DataFrame:
    """source, target and first: the distinct targets of each source, with their first place."""
    return links.groupBy("source", "target").agg(F.min("position").alias("first"))


def latest_links(links: DataFrame, key: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """Upsert by key: the values of the last row of each key."""
    return links.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def closure(links: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """node and distance of all nodes from which a seed can be reached; ``links`` has source and target.

    Each round follows the frontier's back links and drops visited nodes, so cycles end it. Edges and frontiers are
    checkpointed once each, as a lost executor must not replay all rounds before; what was seen is their union.
    """
    edges = cut(links.select("source", "target").distinct())
    frontier = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("distance", F.lit(0).cast("long")))
    seen = frontier
    for distance in range(1, max_rounds + 1):
        reached = edges.join(frontier.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(distance).cast("long")))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if distance % 16 == 0:
            seen = cut(seen)  # else the plan would grow with the rounds
    raise RuntimeError(f"the closure did not end in {max_rounds} rounds")


def closure_by_name(links: DataFrame, names: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """node and distance as ``closure`` gives them, where a link (source, name) leads to all nodes of the name.

    ``names`` has node and name; a node can have several, null ones count as none. Links to a name and nodes of it are
    never paired, as that would cost their product: names are closed over names, and a node is as far as the nearest
    name that it links to.
    """
    named = names.where("name is not null").select("node", "name")
    pairs = cut(links.select("source", "name").distinct().join(named.select("name").distinct(), "name", "left_semi").select("source", "name"))
    between = pairs.join(named.select(F.col("node").alias("source"), F.col("name").alias("__own")), "source").select(F.col("__own").alias("source"), F.col("name").alias("target"))
    first = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    reached = closure(between, named.join(first, "node", "left_semi").select("name"), max_rounds).select(F.col("node").alias("name"), "distance")
    led = pairs.join(reached, "name").select(F.col("source").alias("node"), (F.col("distance") + 1).alias("distance"))
    return led.unionByName(first.withColumn("distance", F.lit(0).cast("long"))).groupBy("node").agg(F.min("distance").alias("distance"))


def document_links(links: DataFrame) -> DataFrame:
    """source, target and n_target_links of links (source, target) between documents: the scheme and the hash are taken off.

    Repeated links stay; n_target_links counts the links of the target, 0 for none.
    """
    own = links.where(F.col("target").startswith(LINK_SCHEME)).select("source", F.regexp_replace(F.expr(f"substring(target, {len(LINK_SCHEME) + 1})"), "#.*", "").alias("target"))
    counts = links.groupBy(F.col("source").alias("target")).agg(F.count("*").alias("n_target_links"))
    return own.join(counts, "target", "left").select("source", "target", F.coalesce("n_target_links", F.lit(0)).alias("n_target_links"))


def rewritten_links(links: DataFrame, log: DataFrame, headers: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """source, position, target and link: links between documents as relative paths.

    ``links`` has source, position, base (the path of the document they stand in) and target (``gdoc:id#hash``);
    ``log`` has id, path, event and the order columns; ``headers`` maps a link with a hash to the one it means.
    A target goes to the path of its id's last log row unless that is removed; else to the address that opens
    it. Headers without an entry keep their hash.
    """
    mapped = links.join(headers.select(F.col("link").alias("target"), "means"), "target", "left").withColumn("full", F.coalesce("means", "target"))
    named = mapped.withColumn("id", F.regexp_replace(F.substring_index("full", "#", 1), f"^{LINK_SCHEME}", "")).withColumn("hash", url_hash(F.col("full")))
    last = log.groupBy("id").agg(F.max_by(F.struct("path", "event"), F.struct(*order)).alias("last"))
    found = named.join(last, "id", "left")
    live = F.col("last").isNotNull() & (F.col("last.event") != "removed")
    inside = F.concat(relative_document_path(F.col("last.path"), F.col("base")), F.col("hash"))
    outside = F.concat(F.lit("https://drive.google.com/open?id="), F.col("id"), F.replace(F.col("hash"), F.lit("#_"), F.lit("#heading=h.")))
    return found.select("source", "position", "target", F.when(live, inside).otherwise(outside).alias("link"))


def top_with_ties(counts: DataFrame, n: str, limit: int = 20) -> DataFrame:
    """Rows by count, descending, whole groups of equal counts at a time, until more than ``limit`` rows are in.

    The window runs over one row per distinct count, not over the rows.
    """
    groups = counts.groupBy(n).agg(F.count("*").alias("__g"))
    before = F.sum("__g").over(Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1))
    wanted = groups.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") <= limit).select(n)
    return counts.join(wanted, n, "left_semi")


def rewrite_links(links: DataFrame, paths: DataFrame, unknown: Column) -> DataFrame:
    """source, n_links, n_known and links: each target replaced by its path (first by source), in order.

    ``paths`` has target and path; ``unknown`` is what stands for a target without a path.
    """
    first = paths.groupBy("target").agg(F.min("path").alias("path"))
    named = links.join(first, "target", "left").select("source", "position", F.col("path").isNotNull().cast("long").alias("known"), F.coalesce("path", unknown).alias("link"))
    rows = F.array_sort(F.collect_list(F.struct("position", "link")))
    return named.groupBy("source").agg(F.count("*").alias("n_links"), F.sum("known").alias("n_known"), F.array_join(F.transform(rows, lambda x: x["link"]), " ").alias("links"))


#: An invisible anchor with the blanks and line ends that go with it.
ANCHOR = r'\n? ?<a id="([^"]*)"></a>\n?'
#: Fixed value: a link to a place in a document.
PLACE_LINK = r"gdoc:[A-Za-z0-9_-]+#[^'\")\s]*"


def anchors(docs: DataFrame) -> DataFrame:
    """id, position and link (``gdoc:id#name``) of the anchors that stand in the texts of documents (id, text)."""
    found = docs.where("id is not null").select("id", F.posexplode(F.regexp_extract_all("text", F.lit(ANCHOR), 1)).alias("position", "name"))
    return found.select("id", "position", F.concat(F.lit(LINK_SCHEME), "id", F.lit("#"), "name").alias("link"))


def place_links(docs: DataFrame) -> DataFrame:
    """link: the places of documents that any text links to, each once. A place that a third of all links name costs a
    row a task."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(PLACE_LINK), 0)).alias("link")).distinct()


def unreferenced(found: DataFrame, linked: DataFrame) -> DataFrame:
    """The anchors to whose place nothing links."""
    return found.join(linked.select("link"), "link", "left_anti").select("id", "position", "link")


def sweep_anchors(docs: DataFrame, found: DataFrame, dropped: DataFrame) -> DataFrame:
    """id, text and n_dropped of documents (id, text; ids are unique) without those of their anchors that are ``dropped``.

    ``found`` are all anchors, ``dropped`` some of them. A line end beside an anchor stays as one line end; a blank
    before it goes. The texts are joined once, with one list of marks a document as long as its anchors, and taken
    apart and put together inside the row.
    """
    gone = dropped.select("id", "position", F.lit(True).alias("gone"))
    marks = found.join(gone, ["id", "position"], "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", F.coalesce("gone", F.lit(False)).alias("gone")))).alias("__marks"))
    rows = docs.join(marks, "id", "left")
    parts = F.arrays_zip(F.split("text", ANCHOR).alias("gap"), F.regexp_extract_all("text", F.lit(ANCHOR), 0).alias("anchor"), F.col("__marks").alias("mark"))
    kept = F.transform(parts, lambda x: F.concat(x["gap"], F.when(x["mark"]["gone"], F.when(F.contains(x["anchor"], F.lit("\n")), "\n").otherwise("")).otherwise(F.coalesce(x["anchor"], F.lit("")))))
    n_dropped = F.size(F.filter("__marks", lambda m: m["gone"]))
    return rows.select("id", F.when(F.col("__marks").isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("text"), F.when(F.col("__marks").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"))
