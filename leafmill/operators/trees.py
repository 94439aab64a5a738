"""Hierarchies as flat rows (id, parent, name): paths, ancestors, contents, look-ups and menus.

Paths and ancestors are found by pointer doubling: each round joins every open row with the row it points to, so
rounds grow with the logarithm of the depth, whatever that is. Rows on a cycle never end; the rounds do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.paths import url_to_id
from leafmill.functions.text import path_parts
from leafmill.operators.running import Rounds, cut, running_last, running_sum, running_sums


def tree_paths(nodes: DataFrame) -> DataFrame:
    """id, path and depth (from 0) of every node that a root (null parent) reaches; nodes are id, parent, name.

    Nodes of a cycle, below one, or below a parent that is no node, are reached by no root and have no row.
    """
    state = cut(nodes.select("id", F.col("parent").alias("up"), F.col("name").alias("path"), F.lit(0).cast("long").alias("depth")))
    done, ahead = state.where("up is null"), state.where("up is not null")
    for _ in range(math.ceil(math.log2(state.count() + 1)) + 1):
        if ahead.isEmpty():
            break
        above = done.unionByName(ahead).select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("path").alias("__path"), F.col("depth").alias("__depth"))
        moved = ahead.join(above, "up")
        moved = cut(moved.select("id", F.col("__up").alias("up"), F.concat("__path", F.lit("/"), "path").alias("path"), (F.col("depth") + F.col("__depth") + 1).alias("depth")))
        done, ahead = done.unionByName(moved.where("up is null")), moved.where("up is not null")
    return done.select("id", "path", "depth")


def ancestors(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, ancestor and distance, upward from each leaf (a table with id), itself left out.

    On a cycle each ancestor counts once, with its smallest distance.
    """
    jumps = cut(nodes.where("parent is not null").select("id", F.col("parent").alias("up")))
    rounds = math.ceil(math.log2(jumps.count() + 1)) + 1
    pairs = cut(leaves.select(F.col("id").alias("leaf")).distinct().join(jumps.select(F.col("id").alias("leaf"), "up"), "leaf").select("leaf", F.col("up").alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    for k in range(rounds):
        farther = pairs.join(jumps.select(F.col("id").alias("ancestor"), "up"), "ancestor").select("leaf", F.col("up").alias("ancestor"), (F.col("distance") + (1 << k)).alias("distance"))
        farther = cut(farther.join(pairs, ["leaf", "ancestor"], "left_anti").groupBy("leaf", "ancestor").agg(F.min("distance").alias("distance")))
        if farther.isEmpty():
            break
        pairs = cut(pairs.unionByName(farther))
        jumps = cut(jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("__up")), "up").select("id", F.col("__up").alias("up")))
    return pairs


def top_folders(nodes: DataFrame) -> DataFrame:
    """id and top: the root above every node that has one (itself for a root)."""
    pairs = ancestors(nodes, nodes.where("parent is not null").select("id"))
    roots = nodes.where("parent is null").select(F.col("id").alias("ancestor"))
    below = pairs.join(roots, "ancestor").select(F.col("leaf").alias("id"), F.col("ancestor").alias("top"))
    return below.unionByName(roots.select(F.col("ancestor").alias("id"), F.col("ancestor").alias("top")))


def pruned_listing(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes that are wanted (a table with id) or lie above one: the folders that a partial listing must open."""
    above = ancestors(nodes, wanted).select(F.col("ancestor").alias("id"))
    return nodes.join(above.unionByName(wanted.select("id")).distinct(), "id", "left_semi")


def find_by_path(nodes: DataFrame, path: str) -> DataFrame:
    """The rows (id, path, depth) at a path."""
    return tree_paths(nodes).where(F.col("path") == path)


def tour(nodes: DataFrame, order: tuple[str, ...] = ("name",)) -> DataFrame:
    """id, parent, place, pre, last and depth of every node that a root reaches: its depth-first numbers.

    Siblings are visited in ``order``, then by id; ``place`` counts them from 1. ``pre`` counts nodes from 0 in the
    order of entering them and ``last`` is the greatest number below, so a subtree is ``pre between a.pre and a.last``.

    Each node is entered and left once, and each such step of the Euler tour knows the next: the first child or its
    own leaving, then the next sibling or the parent's leaving. Ranks on this list come from pointer doubling: a
    round joins every step with the one it points to, and each is pointed to once, so no key is frequent whatever
    the shape of the tree; rounds grow with the logarithm of the number of nodes. Steps that never end, on cycles
    and below parents that are no nodes, have no row. Hot parents are ordered by running sums over ranges.
    """
    spark = nodes.sparkSession
    rounds = Rounds(spark, "tour")
    placed = rounds.put(running_sum(nodes.select("id", "parent", *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]), ("parent",), (*[f"__o{i}" for i in range(len(order))], "id"), F.lit(1).cast("long"), "place").select("id", "parent", "place"))
    first = placed.where("place = 1 and parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    sibling = placed.select(F.col("parent").alias("__parent"), (F.col("place") - 1).alias("__place"), F.col("id").alias("sibling"))
    enter = placed.join(first, "id", "left").select("id", F.lit(False).alias("out"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().alias("to_out"))
    following = placed.join(sibling, F.col("parent").eqNullSafe(F.col("__parent")) & (F.col("place") == F.col("__place")), "left")
    leave = following.select("id", F.lit(True).alias("out"), F.coalesce("sibling", "parent").alias("to"), F.col("sibling").isNull().alias("to_out"))
    steps = rounds.put(enter.unionByName(leave).select("*", (~F.col("out")).cast("long").alias("entered"), F.col("out").cast("long").alias("left")))
    for _ in range(math.ceil(math.log2(2 * placed.count() + 1)) + 1):
        ahead = steps.where("to is not null")
        if ahead.isEmpty():
            break
        target = steps.select(F.col("id").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("__to"), F.col("to_out").alias("__to_out"), F.col("entered").alias("__entered"), F.col("left").alias("__left"))
        moved = ahead.join(target, ["to", "to_out"]).select("id", "out", F.col("__to").alias("to"), F.col("__to_out").alias("to_out"), (F.col("entered") + F.col("__entered")).alias("entered"), (F.col("left") + F.col("__left")).alias("left"))
        moved = rounds.put(steps.where("to is null").unionByName(moved))
        rounds.drop(steps)
        steps = moved
    ranks = steps.where("to is null")
    total = F.broadcast(ranks.where("not out").agg(F.count("*").alias("__n")))  # one row
    both = ranks.groupBy("id").agg(F.max(F.when(~F.col("out"), F.col("entered"))).alias("__from"), F.max(F.when(~F.col("out"), F.col("left"))).alias("__open"), F.max(F.when(F.col("out"), F.col("entered"))).alias("__to"))
    numbers = both.crossJoin(total).select("id", (F.col("__n") - F.col("__from")).alias("pre"), (F.col("__n") - F.col("__to") - 1).alias("last"), (F.col("__open") - F.col("__from")).alias("depth"))
    return numbers.join(placed, "id").select("id", "parent", "place", "pre", "last", "depth")


def visits(walk: DataFrame) -> DataFrame:
    """A tour with ``visit``, from 0: all children of a folder are looked at in order, before what is below the first.

    Folders are opened in the order of the tour, so a node's turn follows from its parent's number and its place.
    """
    opened = walk.join(walk.select(F.col("id").alias("parent"), F.col("pre").alias("__opened")), "parent", "left")
    rows = opened.select(*walk.columns, F.coalesce("__opened", F.lit(-1)).alias("__opened"))
    return running_sum(rows, (), ("__opened", "place"), F.lit(1).cast("long"), "__visit").select(*walk.columns, (F.col("__visit") - 1).alias("visit"))


def find_first(walk: DataFrame, found: DataFrame, wanted: str) -> DataFrame:
    """``wanted`` and id: of the nodes that fit each wanted value (``found`` has it and id), the one that is looked at
    first, siblings before what is below them."""
    opened = walk.select(F.col("id").alias("parent"), F.col("pre").alias("__opened"))
    turn = F.struct(F.coalesce("__opened", F.lit(-1)), "place")
    rows = found.select(wanted, "id").join(walk.select("id", "parent", "place"), "id").join(opened, "parent", "left")
    return rows.groupBy(wanted).agg(F.min_by("id", turn).alias("id"))


def below(walk: DataFrame, id_: str) -> DataFrame:
    """The rows of a tour in the subtree of a node, itself included."""
    top = F.broadcast(walk.where(F.col("id") == id_).select(F.col("pre").alias("__from"), F.col("last").alias("__to")))  # one row
    return walk.join(top, F.col("pre").between(F.col("__from"), F.col("__to"))).drop("__from", "__to")


def effective(nodes: DataFrame, props: str = "props") -> DataFrame:
    """id and props: each node's properties with those of the nodes above it where it has none of its own.

    ``props`` is a map of text by path (``font.size``), so that nested properties are inherited one by one. Pointer
    doubling: a round puts what the pointed-to node has gathered below what the row has, so rounds grow with the
    logarithm of the depth. Nodes that no root reaches, on or below a cycle, have no row.
    """
    rounds = Rounds(nodes.sparkSession, "effective")
    state = rounds.put(nodes.select("id", F.col("parent").alias("up"), F.coalesce(props, F.expr("cast(map() as map<string,string>)")).alias("props")))
    for _ in range(math.ceil(math.log2(state.count() + 1)) + 1):
        ahead = state.where("up is not null")
        if ahead.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("props").alias("__props"))
        own = F.map_keys("props")
        whole = F.map_concat(F.map_filter("__props", lambda k, _: ~F.array_contains(own, k)), "props")
        moved = rounds.put(state.where("up is null").unionByName(ahead.join(above, "up").select("id", F.col("__up").alias("up"), whole.alias("props"))))
        rounds.drop(state)
        state = moved
    return state.where("up is null").select("id", "props")


def contents(nodes: DataFrame) -> DataFrame:
    """path and line: a bullet per node, three spaces per level; order by path to read them."""
    return tree_paths(nodes).select("path", F.concat(F.repeat(F.lit("   "), F.col("depth").cast("int")), F.lit("* "), F.substring_index("path", "/", -1)).alias("line"))


def contents_page(nodes: DataFrame) -> DataFrame:
    """place and line of a table of contents: nodes have id, parent, name and kind (directory, md or other).

    Directories come before documents, by lower-cased name, each followed by what it holds; a document is a link
    to its id, other kinds are left out. ``place`` is the sort key: order by it to write the page.
    """
    mark = F.concat(F.when(F.col("kind") == "directory", "0").otherwise("1"), F.lower("name"), F.lit("\u0001"), F.col("id").cast("string"))
    walked = tree_paths(nodes.select("id", "parent", mark.alias("name")))
    shown = walked.join(nodes.select("id", "name", "kind"), "id").where("kind in ('directory', 'md')")
    text = F.when(F.col("kind") == "directory", F.col("name")).otherwise(F.concat(F.lit("["), "name", F.lit("](gdoc:"), F.col("id").cast("string"), F.lit(")")))
    return shown.select(F.replace("path", F.lit("/"), F.lit("\u0002")).alias("place"), F.concat(F.repeat(F.lit("   "), F.col("depth").cast("int") + 1), F.lit("* "), text).alias("line"))


def menu(nodes: DataFrame, start: int = 30, step: int = 10) -> DataFrame:
    """id, parent and weight; weights rise in steps by (parent, id), per parent."""
    placed = running_sum(nodes, ("parent",), ("id",), F.lit(1).cast("long"), "__place")
    return placed.select("id", "parent", (F.lit(start) + step * (F.col("__place") - 1)).alias("weight"))


def legacy_menu(items: DataFrame, doc: str, at: str, start: int = 30, step: int = 10) -> DataFrame:
    """doc, identifier, name, weight and parent of the items of nested lists (doc, at, level from 0, text, url).

    An item is named by the id in its url, or ``header_1``, ``header_2``, ... where it has none; weights rise over all
    items of a document; the parent is the last item a level up before it. Of items of one name the last stays.
    Items without text are left out. Counts and parents are sums and last values over ranges, so a document of any
    length is spread over tasks.
    """
    shown = items.where("trim(text) <> ''").withColumn("__id", F.when(F.col("url").isNotNull(), url_to_id(F.col("url"))))
    counted = running_sums(shown, (doc,), (at,), {"__n": F.lit(1).cast("long"), "__headers": F.col("url").isNull().cast("long")})
    named = counted.withColumn("identifier", F.when(F.col("url").isNull(), F.concat(F.lit("header_"), F.col("__headers").cast("string"))).otherwise(F.col("__id")))
    own = named.select(doc, at, "identifier", F.trim("text").alias("name"), (F.lit(start) + step * (F.col("__n") - 1)).alias("weight"), F.col("level").alias("__level"), F.lit(True).alias("__own"))
    asked = own.unionByName(own.withColumn("__level", F.col("__level") + 1).withColumn("__own", F.lit(False)))
    found = running_last(asked, (doc, "__level"), (at,), {"parent": F.when(~F.col("__own"), F.coalesce("identifier", F.lit("null")))}).where("__own")
    last = found.groupBy(doc, "identifier").agg(F.max_by(F.struct("name", "weight", "parent"), at).alias("x"))
    return last.select(doc, "identifier", "x.name", "x.weight", "x.parent")


def bullet_menu(lines: DataFrame, doc: str, line_no: str, line: str, start: int = 10, step: int = 10, depth: int = 12) -> DataFrame:
    """doc, identifier, name, weight and parent of the linked bullets of Markdown navigation documents.

    A bullet's level is its indent in threes; its parent is the last linked bullet before it of a lower level, if that is
    one level up. Weights rise over the linked bullets of a document. Both are last values and sums over ranges of
    (doc, line), so a document of any length is read by many tasks. Levels from ``depth`` on end the job.
    """
    level = F.floor(F.length(F.regexp_extract(line, r"^( *)\* ", 1)) / 3).cast("int")
    level = F.when(level < depth, level).otherwise(F.raise_error(F.lit(f"bullets nested in {depth} levels or more")).cast("int"))
    link = F.regexp_extract(line, r"^ *\* \[([^\]]*)\]\(([^)]*)\)", 2)
    name = F.regexp_extract(line, r"^ *\* \[([^\]]*)\]\(([^)]*)\)", 1)
    rows = lines.select(doc, line_no, link.alias("identifier"), name.alias("name"), level.alias("level")).where("identifier <> ''")
    at_level = {f"__last{n}": F.when(F.col("level") == n, F.struct(F.col(line_no).alias("at"), F.col("level").alias("level"), F.col("identifier").alias("id"))) for n in range(depth)}
    found = running_last(rows, (doc,), (line_no,), at_level)
    nearest = F.array_max(F.array(*[F.when(F.col("level") > n, F.col(c)) for n, c in enumerate(at_level)]))
    placed = running_sum(found.withColumn("parent", F.when(nearest["level"] == F.col("level") - 1, nearest["id"])), (doc,), (line_no,), F.lit(1).cast("long"), "__n")
    return placed.select(doc, "identifier", "name", (F.lit(start) + step * (F.col("__n") - 1)).alias("weight"), "parent")


def change_tree(paths: DataFrame, path: str) -> DataFrame:
    """node and n_paths: every prefix of the paths, and how many paths go through it."""
    parts = path_parts(F.col(path))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.where(F.size(parts) > 0).select(F.explode(prefixes).alias("node"))
    return each.groupBy("node").agg(F.count("*").alias("n_paths"))


def checked_folders(files: DataFrame, path: str, checked: Column) -> DataFrame:
    """node, n_files, n_checked and all_checked of every folder above the files (folders only, not the files)."""
    parts = path_parts(F.col(path))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("node"), checked.alias("checked"))
    summed = each.groupBy("node").agg(F.count("*").alias("n_files"), F.count_if("checked").alias("n_checked"))
    return summed.withColumn("all_checked", F.col("n_files") == F.col("n_checked"))
