"""Names inside folders: conflict numbers, conflict pages, and what names say about old and new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.paths import NATIVE, media_extension
from leafmill.functions.text import MAX_NAME, append_conflict, slug, strip_conflict
from leafmill.operators.running import cut, running_sum
from leafmill.operators.trees import tree_paths

#: What stands for an id that is not known yet.
TO_FILL = "TO_FILL"


def desired_name(name: Column, media_type: Column) -> Column:
    """The file name of a remote document: its slug with the extension of its kind, cut to 200 characters after that."""
    bare = slug(name)
    named = (
        F.when(media_type == NATIVE["document"], F.concat(bare, F.lit(".md")))
        .when(media_type == NATIVE["drawing"], F.concat(bare, F.lit(".svg")))
        .when((media_type == NATIVE["folder"]) | bare.contains(".") | media_type.isNull(), bare)
        .otherwise(F.concat(bare, F.lit("."), media_extension(media_type, bare)))
    )
    return F.substring(named, 1, MAX_NAME)


def typed_files(listing: DataFrame) -> DataFrame:
    """Remote rows (id, name, media_type, ...) with ``kind``, ``file_name`` and the media type that the local file has."""
    t = F.col("media_type")
    kind = F.when(t == NATIVE["folder"], "directory").when(t == NATIVE["document"], "md").when(t == NATIVE["drawing"], "drawing").when(t == NATIVE["shortcut"], "shortcut").otherwise("binary")
    local = F.when(t == NATIVE["document"], "text/x-markdown").when(t == NATIVE["drawing"], "image/svg+xml").otherwise(t)
    return listing.withColumn("kind", kind).withColumn("file_name", desired_name(F.col("name"), t)).withColumn("media_type", local)


def resolve_conflicts(files: DataFrame, name: str, order: str, folder: tuple[str, ...] = (), stored: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """The rows of ``files`` with ``real_name``, unique in its folder; ``order`` is unique in a folder.

    A file alone with its name has the bare name. In a group, a member that is stored (rows of ``stored``:
    folder, the order column, real_name) under a name that without its number is the group's name keeps it, and all
    others get ``@1``, ``@2``, ... in order, past numbers that are taken. The bare name is left to the conflict page
    where the group's first member is of kind ``md``, and everywhere without ``kind``. Files of a null name have none.
    """
    keys = (*folder, name)
    sizes = files.groupBy(*keys).agg(F.count("*").alias("__n"), *([F.min_by(kind, order).alias("__kind")] if kind else []))
    grouped = files.join(sizes, [*keys])
    page = F.col("__kind").eqNullSafe(F.lit("md")) if kind else F.lit(True)
    single = grouped.where("__n = 1").withColumn("real_name", F.col(name))
    group = grouped.where("__n > 1").withColumn("__page", page)
    group = group.withColumn("real_name", F.lit(None).cast("string"))
    if stored is not None:
        held = stored.select(*folder, order, F.col("real_name").alias("__held")).groupBy(*folder, order).agg(F.min("__held").alias("__held"))
        joined = group.drop("real_name").join(held, [*folder, order], "left")
        keeps = (strip_conflict(F.col("__held")) == F.col(name)) & ~(F.col("__page") & (F.col("__held") == F.col(name)))
        group = joined.withColumn("real_name", F.when(keeps, F.col("__held"))).drop("__held")
    columns = [*files.columns, "real_name"]
    group = cut(group.select(*columns))
    kept, rest = group.where("real_name is not null"), group.where("real_name is null")
    # numbers that are taken: kept names of the group, and other bare names that read like numbered ones
    number = F.regexp_extract("real_name", "^[^.]*?@([0-9]+)(?:\\.|$)", 1).try_cast("bigint")
    bare = files.select(*folder, F.col(name).alias("real_name")).distinct()
    named = kept.select(*folder, "real_name").unionByName(bare).where(number > 0).select(*folder, strip_conflict(F.col("real_name")).alias(name), number.alias("__number"))
    taken = named.distinct().join(rest.select(*keys).distinct(), [*keys], "left_semi")
    rank = running_sum(taken, keys, ("__number",), F.lit(1), "__rank")  # a taken number t stands behind t - rank free ones
    behind = rank.select(*keys, (F.col("__number") - F.col("__rank")).alias("__at"), F.lit(0).alias("__free"), "__number", *[F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns if c not in keys])
    counted = running_sum(rest.select(*files.columns), keys, (order,), F.lit(1), "__at")
    free = counted.select(*keys, "__at", F.lit(1).alias("__free"), F.lit(0).cast("bigint").alias("__number"), *[c for c in files.columns if c not in keys])
    # the i-th free number is i plus the taken numbers that have fewer than i free ones before them
    both = running_sum(behind.withColumn("__at", F.col("__at") + 1).unionByName(free), keys, ("__at", "__free", "__number"), 1 - F.col("__free"), "__shift")
    fresh = both.where("__free = 1").withColumn("real_name", append_conflict(F.col(name), F.col("__at") + F.col("__shift")))
    return single.select(*columns).unionByName(kept.select(*columns)).unionByName(fresh.select(*columns))


def conflict_pages(files: DataFrame, name: str, key: str, folder: tuple[str, ...] = ()) -> DataFrame:
    """One row per name that several files want: the name, how many, and their keys in order, joined by commas."""
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k.cast("string")), ",")
    return files.groupBy(*folder, name).agg(F.count("*").alias("members"), keys.alias("member_keys")).where("members > 1")


def name_events(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """key and event: created, renamed or touched for every new row, removed for old rows without a new one."""
    before = old.select(key, F.col(name).alias("old_name"), F.lit(True).alias("was"))
    after = new.select(key, F.col(name).alias("new_name"), F.lit(True).alias("now"))
    event = (
        F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull(), "created")
        .when(F.col("old_name").eqNullSafe(F.col("new_name")), "touched").otherwise("renamed")
    )
    return before.join(after, key, "full").select(key, event.alias("event"), "old_name", "new_name")


def removal_plan(local: DataFrame, remote: DataFrame, generated: DataFrame, key: str) -> DataFrame:
    """real_name and reason of local rows (key, real_name, kind) to remove: ``gone`` without a remote row, ``page`` for
    redirects and conflict pages, ``renamed`` where no generated row has the name; the first that holds. Dot files stay.

    ``assets`` is the folder that goes with a removed document.
    """
    there = remote.select(key).distinct().withColumn("__there", F.lit(True))
    made = generated.select("real_name").distinct().withColumn("__made", F.lit(True))
    joined = local.where(~F.col("real_name").startswith(".")).join(there, key, "left").join(made, "real_name", "left")
    reason = F.when(F.col("kind").isin("redir", "conflict"), "page").when(F.col("__there").isNull(), "gone").when(F.col("__made").isNull(), "renamed")
    assets = F.when(F.col("real_name").endswith(".md"), F.regexp_replace("real_name", "\\.md$", ".assets"))
    return joined.select("real_name", reason.alias("reason"), assets.alias("assets")).where("reason is not null")


def fill_metadata(local: DataFrame, known: DataFrame) -> DataFrame:
    """Local rows (real_name, id, file_name, modified) whose id is to be filled, filled from ``known`` by real name."""
    by_name = known.select("real_name", *[F.col(c).alias(f"__{c}") for c in ("id", "file_name", "modified")])
    fill = (F.col("id") == TO_FILL) & F.col("__id").isNotNull()
    return local.join(by_name, "real_name", "left").select("real_name", *[F.when(fill, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("id", "file_name", "modified")])


def redirects(log: DataFrame, key: str, path: str, order: tuple[str, ...], event: str | None = None) -> DataFrame:
    """path and target for every logged path that is no file's latest path: the latest path of the path's last owner.

    With ``event``, paths whose last row is ``removed`` have no redirect, and removed files are no target.
    """
    last = F.struct(*order)
    kind = F.max_by(event, last) if event else F.lit("")
    latest = log.groupBy(key).agg(F.max_by(path, last).alias("target"), kind.alias("__event"))
    owners = log.groupBy(path).agg(F.max_by(key, last).alias(key), kind.alias("__last"))
    live = latest.where("__event <> 'removed'")
    here = live.select(F.col("target").alias(path)).distinct()
    return owners.where("__last <> 'removed'").join(here, path, "left_anti").join(live, key).select(path, "target")


def first_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; aggregated before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__row")).select(key, "__row.*")


def without_path(log: DataFrame, path: str, removed: str) -> DataFrame:
    """The log without the rows of one path."""
    return log.where(~F.col(path).eqNullSafe(F.lit(removed)))



def delete_path(nodes: DataFrame, log: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, parent, name) and log (with path) without what lies at a path or below it."""
    inside = lambda c: F.coalesce((F.col(c) == path) | F.col(c).startswith(path + "/"), F.lit(False))
    doomed = tree_paths(nodes).where(inside("path")).select("id")
    return nodes.join(doomed, "id", "left_anti"), log.where(~inside("path"))


def transform_tasks(local: DataFrame, remote: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Local rows with the values of the remote row of their id, null where it is gone; of rows of one id the last version
    counts."""
    newest = remote.groupBy("id").agg(F.max_by(F.struct(*values), "version").alias("__remote"))
    return local.join(newest, "id", "left").select(*local.columns, *[F.col(f"__remote.{v}").alias(v) for v in values])
