"""Small projections and look-ups over listings, jobs and changes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.paths import NATIVE
from leafmill.operators.trees import tree_paths


def remote_predicate(folder: str | None = None, since: str | None = None) -> Column:
    """The rows of a listing that a partial listing asks for: in a folder, not trashed, newer than a time or folders."""
    fits = ~F.coalesce(F.col("trashed"), F.lit(False))
    if folder is not None:
        fits = fits & F.array_contains("parents", folder)
    if since is not None:
        fits = fits & ((F.col("modified") > since) | (F.col("media_type") == NATIVE["folder"]))
    return fits


def find(rows: DataFrame, **values: object) -> DataFrame:
    """The rows whose columns have the given values, of which null is one; filters reach the scan."""
    fits = F.lit(True)
    for name, value in values.items():
        fits = fits & (F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return rows.where(fits)


def with_repeats(*lists: DataFrame) -> DataFrame:
    """The rows of all lists, one after the other; rows that several have are repeated."""
    return functools.reduce(DataFrame.unionByName, lists)


def without_repeats(*lists: DataFrame) -> DataFrame:
    """The rows that any list has, each once; repeats go inside tasks before they are sent."""
    return with_repeats(*lists).distinct()


def counted(owners: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """key and ``name`` of each owner: how many rows have its key, 0 for none. A frequent key is one row a task."""
    found = rows.groupBy(key).agg(F.count("*").alias("__n"))
    return owners.select(key).join(found, key, "left").select(key, F.coalesce("__n", F.lit(0)).alias(name))


def without_nulls(params: Column) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(params, lambda k, v: v.isNotNull())


def split_drives(drives: DataFrame, shared: str) -> tuple[DataFrame, DataFrame]:
    """Shared drives, and all others."""
    is_shared = F.coalesce(F.col(shared), F.lit(False))
    return drives.where(is_shared), drives.where(~is_shared)


def drive_rows(drives: DataFrame, registered: DataFrame) -> DataFrame:
    """id, folder_id, name and exists of the drives."""
    known = registered.select("id").distinct().withColumn("__known", F.lit(True))
    return drives.join(known, "id", "left").select("id", F.col("id").alias("folder_id"), "name", F.col("__known").isNotNull().alias("exists"))


def active_jobs(jobs: DataFrame, state: str) -> DataFrame:
    return jobs.where(F.col(state).isin("waiting", "running"))


def first_waiting(jobs: DataFrame, drive: str, state: str, order: str, values: tuple[str, ...]) -> DataFrame:
    """The first waiting job of each drive."""
    waiting = jobs.where(F.col(state) == "waiting")
    return waiting.groupBy(drive).agg(F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values])


def without_folders(changes: DataFrame, media_type: str) -> DataFrame:
    return changes.where(~F.col(media_type).eqNullSafe(NATIVE["folder"]))


def without_assets(changes: DataFrame, path: str) -> DataFrame:
    return changes.where(~F.col(path).contains(".assets/"))


def to_upload(files: DataFrame, path: str, title: str) -> DataFrame:
    """Files that are uploaded: with a title, and no contents page."""
    return files.where((F.col(path) != "/toc.md") & F.col(title).isNotNull())


def unknown_children(scan: DataFrame) -> DataFrame:
    """Scanned files (real_name, kind) as tree items whose ids are not known."""
    return scan.select(F.lit("UNKNOWN").alias("id"), F.lit("UNKNOWN").alias("parent_id"), F.col("real_name").alias("path"), F.col("real_name").alias("file_name"), (F.col("kind") == "directory").alias("is_folder"))


def root_and_items(items: DataFrame, root_id: str, name: str) -> DataFrame:
    """The items (id, parent, name) below a root row; items without a parent hang below it."""
    root = items.sparkSession.range(1).select(F.lit(root_id).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(name).alias("name"))
    return root.unionByName(items.select("id", F.coalesce("parent", F.lit(root_id)).alias("parent"), "name"))


def chained_lookup(ids: DataFrame, log: DataFrame, tree: DataFrame, remote: DataFrame, changes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """id, path, title, remote_name and state: what the last log row, the tree at its path, the remote listing and the
    changed files say of each id; null where one of them says nothing."""
    last = log.groupBy("id").agg(F.max_by("path", F.struct(*order)).alias("path"))
    found = ids.join(last, "id", "left").join(tree.select("path", "title"), "path", "left")
    found = found.join(remote.select("id", F.col("name").alias("remote_name")), "id", "left")
    return found.join(changes.select("path", "state"), "path", "left").select("id", "path", "title", "remote_name", "state")


def with_status(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Tree items (path, ...) with the status of their change: N, else M, else D."""
    status = F.when(F.col("is_new"), "N").when(F.col("is_modified"), "M").when(F.col("is_deleted"), "D")
    return items.join(changes.select("path", status.alias("status")), "path", "left")


def tree_upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """path and depth of the local nodes (id, parent, name: slugs) whose path no remote node has; parents come first by depth."""
    there = tree_paths(remote).select("path").distinct()
    return tree_paths(local).join(there, "path", "left_anti").select("path", "depth")


def ids_to_allocate(files: DataFrame, id_col: str) -> DataFrame:
    """One row: n_ids, the files without an id."""
    return files.agg(F.count_if(F.col(id_col).isNull()).alias("n_ids"))


def asset_folders(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """path of the asset folders, among those there are, of documents that are committed."""
    return documents.select(F.regexp_replace("path", r"\.md$", ".assets").alias("path")).join(folders, "path", "left_semi")


def retry_set(changes: DataFrame, tree: DataFrame, key: str, version: str) -> DataFrame:
    """Changes whose key the tree holds in an older version."""
    return changes.join(tree.select(key, F.col(version).alias("__held")), key).where(F.col("__held") < F.col(version)).drop("__held")


def traces(spans: DataFrame, trace: str, at: str, name: str) -> DataFrame:
    """Per trace: the name of its first span, and how many spans and names in order it has."""
    return spans.groupBy(trace).agg(F.min_by(name, at).alias("first_name"), F.count("*").alias("n_spans"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, name))), lambda x: x[name]), ",").alias("names"))


def menu_json(menu: DataFrame) -> DataFrame:
    """One row: the menu (identifier, name, weight, parent) as JSON, by weight. A menu is a page's navigation, not a corpus."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("weight", "identifier", "name", "parent"))), lambda x: F.struct(x["identifier"].alias("identifier"), x["name"].alias("name"), x["weight"].alias("weight"), x["parent"].alias("parent")))
    return menu.agg(F.to_json(F.struct(rows.alias("main"))).alias("json"))


def encrypted(text: Column, key: bytes, iv: bytes) -> Column:
    """AES-CBC with a fixed vector, in base64, without the vector in front."""
    whole = F.aes_encrypt(F.encode(text, "UTF-8"), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv))
    return F.translate(F.base64(F.substring(whole, 17, 2_147_483_647)), "\r\n", "")  # long codes come in lines


def decrypted(code: Column, key: bytes, iv: bytes) -> Column:
    return F.decode(F.aes_decrypt(F.concat(F.lit(iv), F.unbase64(code)), F.lit(key), F.lit("CBC"), F.lit("PKCS")), "UTF-8")


def payload_variables(payload: Column) -> Column:
    """branch, message and files (joined by spaces) of a JSON payload; empty where it has none or is no JSON."""
    x = F.from_json(payload, "branch string, message string, files array<string>")
    return F.struct(F.coalesce(x["branch"], F.lit("")).alias("branch"), F.coalesce(x["message"], F.lit("")).alias("message"), F.coalesce(F.array_join(x["files"], " "), F.lit("")).alias("files"))
