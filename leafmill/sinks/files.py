"""Writers of link and event tables, document pages and logs, and the texts that they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_links(links: DataFrame, path: str) -> None:
    """source, name and dest as a ``;`` table with a header; values that hold ``;`` are quoted."""
    links.select("source", "name", "dest").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """The event log in the order of ``seq``, by ranges of it, as a ``;`` table with a header."""
    events.repartitionByRange("seq").sortWithinPartitions("seq").select("filePath", "mtime", "id", "type", "event").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").json(path)


def tree_lines(walk: DataFrame, names: DataFrame) -> DataFrame:
    """at and value: the lines of a nested tree (an array of items with ``children``), two for each node of a tour.

    ``at`` follows from the tour's numbers, so a file of any size is written by ranges of it, and no line holds a subtree.
    """
    item = F.to_json(F.struct("id", "name"))
    opened = F.concat(F.when(F.col("place") > 1, ",").otherwise(""), F.expr("substring(item, 1, length(item) - 1)"), F.lit(',"children":['))
    rows = walk.join(names.select("id", "name"), "id").withColumn("item", item)
    both = rows.select((2 * F.col("pre") - F.col("depth")).alias("at"), opened.alias("value")).unionByName(rows.select((2 * F.col("last") + 1 - F.col("depth")).alias("at"), F.lit("]}").alias("value")))
    ends = walk.agg((2 * F.count("*")).alias("at"), F.lit("]").alias("value")).unionByName(walk.sparkSession.createDataFrame([(-1, "[")], "at long, value string"))
    return both.unionByName(ends)


def write_tree(walk: DataFrame, names: DataFrame, path: str) -> None:
    """The tree of a tour (``trees.tour``) with the nodes' names; the files, one after the other, are one JSON text."""
    tree_lines(walk, names).repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def write_logs(lines: DataFrame, by_job: str, daily: str) -> None:
    """Lines with a jobId by job, all others by day."""
    lines.where("jobId is not null").withColumn("job", F.col("jobId")).write.mode("append").partitionBy("job").json(by_job)
    lines.where("jobId is null").withColumn("day", F.to_date(F.timestamp_millis("ts"))).write.mode("append").partitionBy("day").json(daily)


def quoted(value: Column) -> Column:
    """A value in single quotes, as front matter has it."""
    return F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))


def front_matter(fields: dict[str, Column]) -> Column:
    """A header of ``name: 'value'`` lines between ``---`` lines; null values have no line."""
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{name}: "), quoted(value)) for name, value in fields.items()]))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("---\n"))


def document_page(fields: dict[str, Column], body: Column, without_version: bool = False) -> Column:
    """A document's header and body; date, version and author are left out on demand."""
    dropped = ("date", "version", "lastAuthor") if without_version else ()
    return F.concat(front_matter({k: v for k, v in fields.items() if k not in dropped}), F.coalesce(body, F.lit("")))


def conflict_page(name: Column, members: Column) -> Column:
    """The page of a name that several files want; members: array<struct<id, title, real_name>>."""
    bullets = F.transform(members, lambda m: F.concat(F.lit("* ["), m["title"], F.lit("]("), m["real_name"], F.lit(")\n")))
    header = front_matter({"id": F.concat(F.lit("conflict:"), name), "title": F.concat(F.lit("Conflict: "), name), "type": F.lit("conflict")})
    return F.concat(header, F.lit("There were two documents with the same name in the same folder:\n"), F.array_join(bullets, ""))


def redirect_page(title: Column, target: Column) -> Column:
    """The page at a document's old path; a null target ends the job."""
    checked = F.coalesce(target, F.raise_error(F.lit("a redirect needs a target")).cast("string"))
    return F.concat(front_matter({"title": title, "redirectTo": checked}), F.lit("Redirecting to "), checked, F.lit("\n"))


def directory_map(files: DataFrame, folder: str, folder_id: str | None = None) -> DataFrame:
    """folder and yaml: the file map of each folder, by real name; files have real_name, id and file_name, and their
    folder's id in the column ``folder_id``, if it is named."""
    entry = F.concat(F.lit("  "), quoted(F.col("real_name")), F.lit(":\n    id: "), quoted(F.col("id")), F.lit("\n    fileName: "), quoted(F.col("file_name")), F.lit("\n"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("real_name", entry.alias("entry")))), lambda x: x["entry"]), "")
    own = F.coalesce(F.concat(F.lit("id: "), quoted(F.max(folder_id)), F.lit("\n")), F.lit("")) if folder_id else F.lit("")
    return files.groupBy(folder).agg(F.concat(F.lit("type: 'directory'\n"), own, F.lit("fileMap:\n"), rows).alias("yaml"))


def error_pages(log: DataFrame, file: str, order: str) -> DataFrame:
    """file and page: a heading and the messages of a file's errors and warnings, in order."""
    messages = F.transform(F.array_sort(F.collect_list(F.struct(order, "level", "message"))), lambda x: F.concat(F.lit("* "), x["level"], F.lit(": "), x["message"], F.lit("\n")))
    kept = log.where(F.col("level").isin("error", "warn"))
    return kept.groupBy(file).agg(F.array_join(messages, "").alias("lines")).select(file, F.concat(F.lit("## "), F.col(file).cast("string"), F.lit("\n\n"), F.col("lines")).alias("page"))


def asset_names(assets: DataFrame) -> DataFrame:
    """name, folder and content of pictures (path, content) under the name that their content gives: md5 and extension.

    Thumbnails and other files are left out.
    """
    ending = F.lower(F.substring_index("path", ".", -1))
    kept = assets.where(ending.isin("png", "jpg") & ~F.lower("path").contains("thumbnail"))
    return kept.select(F.concat(F.md5("content"), F.lit("."), ending).alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "content")
