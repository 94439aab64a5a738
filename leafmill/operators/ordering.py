"""Orders under a collation, and numbers of list items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.running import running_last, running_sum

#: How names are compared: by the letters of all scripts, without case.
NAMES = "UNICODE_CI"
PATHS = "UNICODE"


def collated_order(rows: DataFrame, keys: tuple[str, ...], by: tuple[Column, ...], unique: str, name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in each group of ``keys`` by the columns ``by`` (collated or not), then by ``unique``.

    Rows are dealt by ranges of the collated order itself, so a folder of any size is ordered by many tasks.
    """
    columns = rows.columns
    keyed = rows.select("*", *[c.alias(f"__by{i}") for i, c in enumerate(by)])
    order = (*[f"__by{i}" for i in range(len(by))], unique)
    return running_sum(keyed, keys, order, F.lit(1).cast("long"), name).select(*columns, name)


def listing_order(files: DataFrame, keys: tuple[str, ...], is_folder: Column, file_name: str, unique: str) -> DataFrame:
    """Files with ``place``: folders first, then names as a reader sorts them; a null name comes before others."""
    return collated_order(files, keys, (~is_folder, F.collate(file_name, NAMES)), unique)


def contents_order(nodes: DataFrame, unique: str = "id") -> DataFrame:
    """Nodes (id, parent, name, kind) with ``place`` among their siblings: directories first, then names without case."""
    return collated_order(nodes, ("parent",), (F.col("kind") != "directory", F.collate("name", NAMES)), unique)


def change_order(changes: DataFrame, path: str) -> DataFrame:
    """Changed files with ``place``, by path as a reader sorts it, and by code points where that is equal."""
    return collated_order(changes, (), (F.collate(path, PATHS),), path)


def diff_order(files: DataFrame, path: str) -> DataFrame:
    """Files of a diff with ``place``: a document before the files of its ``.assets`` folder, else by path as a reader sorts it."""
    document = F.regexp_replace(path, r"\.assets/.*$", ".md")
    return collated_order(files, (), (F.collate(document, PATHS), (F.col(path) != document), F.collate(path, PATHS)), path)


def list_numbers(items: DataFrame, doc: str, at: str, depth: int = 10) -> DataFrame:
    """The list items with ``number``.

    ``items`` have doc, at (unique in a doc), style, level (from 1), opens (the item opens a list) and continues (that
    list goes on from an earlier one). Each (style, level) of a document counts; a list that opens without going on
    starts its level and those below it anew. An item counts those of its style and level since the last such start: the
    starts are last values over ranges of (doc, style, at), the counts sums over ranges of the spans between them, so a
    document of any length is numbered by many tasks. Levels over ``depth`` end the job; null levels have no number.
    """
    level = F.when(F.coalesce(F.col("level") <= depth, F.lit(True)), F.col("level")).otherwise(F.raise_error(F.lit(f"lists nested over {depth} deep")).cast("int"))
    columns = items.columns
    starts = F.coalesce("opens", F.lit(False)) & ~F.coalesce("continues", F.lit(False))
    checked = items.withColumn("__level", level)
    since = {f"__since{n}": F.when(starts & (F.col("__level") == n), F.col(at)) for n in range(1, depth + 1)}
    found = running_last(checked, (doc, "style"), (at,), since, own=True)
    last = F.array_max(F.array(*[F.when(F.col("__level") >= n, F.col(f"__since{n}")) for n in range(1, depth + 1)]))
    counted = running_sum(found.withColumn("__span", last), (doc, "style", "__level", "__span"), (at,), F.lit(1).cast("long"), "__number")
    return counted.select(*columns, F.when(F.col("level").isNotNull(), F.col("__number")).alias("number"))
