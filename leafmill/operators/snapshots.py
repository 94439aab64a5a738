"""Snapshot differences and fetch plans: what a new listing adds, changes and removes against an old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.paths import NATIVE

#: The formats in which native documents are fetched.
EXPORTS = {"document": ("odt",), "drawing": ("svg", "png"), "spreadsheet": ("ods", "xlsx", "csv"), "presentation": ("odp", "pptx", "pdf"), "form": ("zip",), "script": ("gs",)}


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """key and status (added, changed, removed, same); versions are compared null-safely. One shuffle per side."""
    before = old.select(F.col(key).alias("k"), F.col(version).alias("old_version"), F.lit(True).alias("was"))
    after = new.select(F.col(key).alias("k"), F.col(version).alias("new_version"), F.lit(True).alias("now"))
    joined = before.join(after, "k", "full")
    status = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(F.col("old_version").eqNullSafe(F.col("new_version")), "same").otherwise("changed")
    )
    return joined.select(F.col("k").alias(key), status.alias("status"), "old_version", "new_version")


def partial_sync(old: DataFrame, new: DataFrame, key: str, selected: Column) -> DataFrame:
    """New rows of the selected keys; of the other keys the old rows, and none where the old listing has none.

    ``selected`` is a predicate over the columns of ``new``; both listings have the same columns.
    """
    kept_old = new.where(~selected).select(key)
    return new.where(selected).unionByName(old.join(kept_old, key, "left_semi"))


def fetch_plan(listing: DataFrame, inventory: DataFrame, key: str, forced: Column) -> DataFrame:
    """key, missing and wanted: a row is wanted when the inventory lacks it or it is forced."""
    have = inventory.select(F.col(key)).distinct().withColumn("have", F.lit(True))
    missing = F.col("have").isNull()
    return listing.join(have, key, "left").select(key, missing.alias("missing"), (missing | forced).alias("wanted"))


def unused_files(files: DataFrame, name: str, listing: DataFrame, key: str) -> DataFrame:
    """Files whose name up to the first dot is no key of the listing: an equi anti-join, not a prefix comparison."""
    return files.join(listing.select(F.col(key).cast("string").alias("__key")), F.substring_index(F.col(name), ".", 1) == F.col("__key"), "left_anti")


def registrations(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and action: register what only ``new`` has, unregister what only ``old`` has."""
    added = new.select(key).join(old, key, "left_anti").distinct().withColumn("action", F.lit("register"))
    return added.unionByName(old.select(key).join(new, key, "left_anti").distinct().withColumn("action", F.lit("unregister")))


def merge_listings(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Full outer merge by key; every column of ``preferred`` wins where it is not null."""
    columns = [c for c in preferred.columns if c != key]
    a = preferred.select(key, *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = other.select(key, *[F.col(c).alias(f"__b_{c}") for c in columns])
    return a.join(b, key, "full").select(key, *[F.coalesce(f"__a_{c}", f"__b_{c}").alias(c) for c in columns])


def pending_changes(changes: DataFrame, tree: DataFrame, key: str, version: str, trashed: str = "trashed") -> DataFrame:
    """Changes whose key the tree lacks, unless they are trashed, or holds in an older version."""
    known = tree.select(F.col(key), F.col(version).alias("__held"))
    lacking = F.col("__held").isNull() & ~F.coalesce(F.col(trashed), F.lit(False))
    return changes.join(known, key, "left").where(lacking | (F.col("__held") < F.col(version))).drop("__held")


def changed_files(changes: DataFrame, tree: DataFrame, key: str, version: str) -> DataFrame:
    """Changes whose key the tree holds in another version, older or newer; all of them where the tree is empty."""
    known = tree.select(F.col(key), F.col(version).alias("__held"))
    empty = tree.limit(1).agg((F.count("*") == 0).alias("__empty"))
    joined = changes.join(known, key, "left").crossJoin(F.broadcast(empty))  # one row
    return joined.where(F.col("__empty") | (F.col("__held") != F.col(version))).drop("__held", "__empty")


def upload_plan(local: DataFrame, remote: DataFrame, local_name: Column, remote_name: Column, order: str, values: tuple[str, ...]) -> DataFrame:
    """Local rows that have no remote row of the same name: the last remote row of a name counts."""
    named = remote.groupBy(remote_name.alias("__name")).agg(*[F.max_by(v, order).alias(v) for v in values])
    return local.withColumn("__name", local_name).join(named, "__name", "left").drop("__name")


def export_plan(listing: DataFrame, media_type: str) -> DataFrame:
    """The listing with ``format``, one row per format that a document is fetched in: shortcuts and folders none, others ``asset``."""
    table = listing.sparkSession.createDataFrame([(NATIVE[k], f) for k, formats in EXPORTS.items() for f in formats], "media string, format string")
    plain = ~F.col(media_type).isin(*[NATIVE[k] for k in (*EXPORTS, "folder", "shortcut")]) | F.col(media_type).isNull()
    known = listing.join(F.broadcast(table), F.col(media_type) == F.col("media")).drop("media")
    return known.unionByName(listing.where(plain).withColumn("format", F.lit("asset")))


def listing_rows(raw: DataFrame) -> DataFrame:
    """Rows of a remote listing (id, name, parents, size, author_name, author_mail, modified) in the form the engine keeps:
    the first parent, a numeric size, and the last author with the mail address where there is one."""
    mail = F.concat("author_name", F.lit(" <"), "author_mail", F.lit(">"))
    return raw.select("id", "name", F.get("parents", F.lit(0)).alias("parent_id"), F.col("size").try_cast("bigint").alias("size"), F.coalesce(mail, "author_name").alias("last_author"), "modified")


def needed_files(listing: DataFrame, inventory: DataFrame, key: str, formats: tuple[str, ...], forced: Column) -> DataFrame:
    """key and wanted: a document is fetched when one of the files ``key.format`` is missing or it is forced."""
    files = inventory.select("name").distinct().withColumn("__have", F.lit(True))
    each = listing.withColumn("__forced", forced).select(key, "__forced", F.explode(F.array(*[F.lit(f) for f in formats])).alias("__format"))
    found = each.join(files.withColumnRenamed("name", "__name"), F.concat(F.col(key).cast("string"), F.lit("."), "__format") == F.col("__name"), "left")
    return found.groupBy(key).agg((F.bool_or("__forced") | F.bool_or(F.col("__have").isNull())).alias("wanted"))
