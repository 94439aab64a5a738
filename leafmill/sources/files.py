"""Readers of listings, link and event tables, trees, rotated logs and Markdown files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.events import append_rules
from leafmill.operators.running import running_last, running_sum

LISTING = "id string, name string, mimeType string, modifiedTime string, parents array<string>, size string, version string, trashed boolean"
LINKS = "source string, name string, dest string"
EVENTS = "filePath string, mtime bigint, id string, type string, event string"
LOG = "level string, message string, timestamp string, filename string, driveId string, jobId string"
#: How far the date in a log's name may lie outside the asked range.
LOG_DAYS = 3


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Folder listings (JSON arrays, one or many files) with a fixed schema; rows that are no objects are dropped."""
    return spark.read.schema(LISTING).option("multiLine", True).json(path).where("id is not null")


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """A nested tree file (an array of items with ``children``) as flat rows: id, parent, name, ordinal.

    A level is exploded at a time, as far as there are children. The nested form holds whole subtrees in a value,
    so it is read through its text.
    """
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("items"))
    item = "id string, name string, children array<string>"
    level = text.select(F.lit(None).cast("string").alias("parent"), F.posexplode("items").alias("ordinal", "item"))
    rows = None
    while not level.isEmpty():
        parsed = level.select("parent", "ordinal", F.from_json("item", item).alias("x")).select("parent", "ordinal", "x.*").cache()
        flat = parsed.select("id", "parent", "name", "ordinal")
        rows = flat if rows is None else rows.unionByName(flat)
        level = parsed.select(F.col("id").alias("parent"), F.posexplode("children").alias("ordinal", "item"))
    return rows if rows is not None else spark.createDataFrame([], "id string, parent string, name string, ordinal int")


def in_file_order(rows: DataFrame, name: str = "seq") -> DataFrame:
    """Rows of a file source with their place, from 0, in the order of the files' names and of the lines in them.

    Files that Spark wrote go by the number of their part. A file may be read in several splits and by many tasks.
    """
    columns = rows.columns
    placed = rows.select(
        *columns, F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("int"), F.lit(-1)).alias("__part_no"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__line"),
    )
    counted = running_sum(placed, (), ("__part_no", "__file", "__split", "__line"), F.lit(1).cast("long"), name)
    return counted.select(*columns, (F.col(name) - 1).alias(name))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """source, name and dest of a link table (``;``, with a header). Blank lines are no rows; a source's name is that
    of its first row."""
    rows = in_file_order(spark.read.schema(LINKS).option("sep", ";").option("header", True).csv(path)).where("source is not null")
    first = rows.groupBy("source").agg(F.min_by("name", "seq").alias("name"))
    return rows.select("source", "dest").join(first, "source").select("source", "name", "dest")


def read_events(spark: SparkSession, path: str, append: bool = False) -> DataFrame:
    """The rows of an event table (``;``, with a header), with ``seq``: their order in the files.

    With ``append`` they are appended anew: rows whose id is still to be filled are left out, and so is a ``touched`` row
    of an id that was logged before.
    """
    rows = in_file_order(spark.read.schema(EVENTS).option("sep", ";").option("header", True).csv(path)).where("filePath is not null")
    return append_rules(rows, "id", "event", ("seq",), "touched", F.coalesce(F.col("id") == "TO_FILL", F.lit(True))) if append else rows


def read_tree_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, parent, name and ordinal of a nested tree that ``sinks.write_tree`` wrote: each line opens or closes an item.

    A line's level is a running sum over the lines; an item's parent is the last item before it that was opened a level
    up. Both go by ranges of lines, so neither a subtree nor a file is ever one value.
    """
    lines = in_file_order(spark.read.text(path))
    opens = F.col("value").rlike(r"^,?\{")
    step = F.when(opens, 1).when(F.col("value") == "]}", -1).otherwise(0)
    levels = running_sum(lines, (), ("seq",), step.cast("long"), "level").where(opens)
    item = F.from_json(F.concat(F.regexp_replace("value", "^,", ""), F.lit("]}")), "id string, name string")
    items = levels.select("seq", "level", item.alias("x")).select("seq", "level", "x.*")
    asked = items.withColumn("own", F.lit(True)).unionByName(items.withColumn("level", F.col("level") + 1).withColumn("own", F.lit(False)))
    found = running_last(asked, ("level",), ("seq",), {"parent": F.when(~F.col("own"), F.col("id"))}).where("own")
    return running_sum(found.select("id", "parent", "name", "seq"), ("parent",), ("seq",), F.lit(1).cast("long"), "ordinal").select("id", "parent", "name", (F.col("ordinal") - 1).cast("int").alias("ordinal"))


def read_logs(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None, level: str | None = None) -> DataFrame:
    """Lines of dated log files (JSON lines, also gzipped) with ``ts`` in epoch milliseconds, inside a range.

    Files whose name begins with a date over LOG_DAYS days outside the range are not opened, and lines that are no
    JSON objects are dropped. ``path`` is the folder; files are named ``yyyy-MM-dd-...``.
    """
    names = spark.read.format("binaryFile").load(path).select("path")  # names only: contents are not read
    day = F.try_to_timestamp(F.substring(F.substring_index("path", "/", -1), 1, 10), F.lit("yyyy-MM-dd"))
    kept = names.where(day.isNotNull())
    if since is not None:
        kept = kept.where(day >= F.lit(since - timedelta(days=LOG_DAYS)))
    if until is not None:
        kept = kept.where(day <= F.lit(until + timedelta(days=LOG_DAYS)))
    files = [r["path"] for r in kept.collect()]  # one name per file and day
    if not files:
        return spark.createDataFrame([], f"{LOG}, ts bigint")
    lines = spark.read.schema(LOG).json(files).withColumn("ts", F.unix_millis(F.try_to_timestamp("timestamp"))).where("ts is not null")
    if since is not None:
        lines = lines.where(F.col("ts") >= int(since.timestamp() * 1000))
    if until is not None:
        lines = lines.where(F.col("ts") <= int(until.timestamp() * 1000))
    return lines.where(F.col("level") == level) if level else lines


def read_job_log(spark: SparkSession, path: str, job: str) -> DataFrame:
    """The lines of one job, from logs written by job (a partition column ``job``); none where the job wrote none.

    Only the job's own folder is opened, with a fixed schema.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/job={job}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{LOG}, job string")
    return spark.read.schema(LOG).json(place.toString()).withColumn("job", F.lit(job))


def split_front_matter(text: Column) -> Column:
    """struct(header, body): what stands between the leading ``---`` lines, and the rest; no header without them."""
    pattern = r"(?s)^---\r?\n(.*?)(?:\r?\n)?---\r?\n?(.*)$"
    has = text.rlike(r"(?s)^---\r?\n(?:.*?\r?\n)?---(?:\r?\n|$)")
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("header"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def header_field(header: Column, name: str) -> Column:
    """A field of a flat header, without quotes; null where it has none."""
    found = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*)$", 1)
    return F.when(header.rlike(rf"(?m)^{name}:"), F.regexp_replace(F.trim(found), "^(['\"])(.*)\\1$", "$2"))


def document_kind(header: Column) -> Column:
    """conflict, redir or md of a document by its header; null without an id. A conflict wins over a redirect."""
    kind = F.when(header_field(header, "type") == "conflict", "conflict").when(header_field(header, "redirectTo").isNotNull(), "redir").otherwise("md")
    return F.when(header_field(header, "id").isNotNull(), kind)


def yaml_rows(docs: DataFrame, doc: str, text: str, step: int = 2, depth: int = 8) -> DataFrame:
    """doc, line_no, path and value of the ``key: value`` lines of block YAML; a key that opens a block has no value.

    ``path`` are the keys from the outermost block to the line's. A level is indented by ``step`` blanks. The block that
    a line stands in at a level is the last line of that level before it, unless a line of a lower level came since:
    last values over ranges of (doc, line), so a file of any length is read by many tasks. Keys and values may be plain
    or in quotes; comments, blank lines and lines that are no ``key: value`` are left out; levels from ``depth`` on end the job.
    """
    line = docs.select(doc, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    key = r'''^( *)('(?:[^']|'')*'|"(?:[^"\\]|\\.)*"|[^\s'"#:-][^:]*?) *:(?:[ \t]+(.*?))?[ \t]*$'''
    found = line.where(F.col("line").rlike(key)).select(doc, "line_no", F.floor(F.length(F.regexp_extract("line", key, 1)) / step).cast("int").alias("level"), yaml_scalar(F.regexp_extract("line", key, 2)).alias("key"), F.nullif(F.regexp_extract("line", key, 3), F.lit("")).alias("value"))
    found = found.withColumn("level", F.when(F.col("level") < depth, F.col("level")).otherwise(F.raise_error(F.lit(f"YAML nested in {depth} blocks or more")).cast("int")))
    open_at = [f"__open{i}" for i in range(depth)]
    rows = running_last(found, (doc,), ("line_no",), {c: F.when(F.col("level") == i, F.struct("line_no", "key")) for i, c in enumerate(open_at)}, own=True)
    keys, since = [], F.lit(-1)
    for i, c in enumerate(open_at):
        inside = (F.col("level") >= i) & (F.col(f"{c}.line_no") > since)
        keys.append(F.when(inside, F.col(f"{c}.key")))
        since = F.when(inside, F.col(f"{c}.line_no")).otherwise(since)
    return rows.select(doc, "line_no", F.array_compact(F.array(*keys)).alias("path"), yaml_scalar(F.col("value")).alias("value"))


def yaml_scalar(text: Column) -> Column:
    """A plain or quoted scalar as text; plain null and ~ are null."""
    double = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
    single = F.replace(F.regexp_extract(text, r"(?s)^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return F.when(text.startswith("'"), single).when(text.startswith('"'), double).when(text.isin("null", "~"), None).otherwise(F.regexp_replace(text, r"[ \t]+#.*$", ""))


def stored_file_map(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, real_name, id and file_name of the files that stored directory files (YAML) name.

    Only files of type ``directory`` with an id count; a file without a map names none.
    """
    rows = yaml_rows(docs, doc, text)
    field = lambda *path: F.max(F.when(F.col("path") == F.array(*[F.lit(p) for p in path]), F.col("value")))
    whole = rows.groupBy(doc).agg(field("type").alias("__type"), field("id").alias("__id")).where("__type = 'directory' and __id <> ''").select(doc)
    named = rows.where("size(path) = 3 and path[0] = 'fileMap'").select(doc, F.get("path", F.lit(1)).alias("real_name"), F.get("path", F.lit(2)).alias("field"), "value")
    files = named.groupBy(doc, "real_name").agg(F.max(F.when(F.col("field") == "id", F.col("value"))).alias("id"), F.max(F.when(F.col("field") == "fileName", F.col("value"))).alias("file_name"))
    return files.join(whole, doc, "left_semi")


def scan_directory(files: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    """real_name, kind and id of the files (path, is_dir, text) of a folder.

    Reserved names, ``.assets`` folders and debug XML are left out. Documents are of the kind that their header says;
    drawings are ``svg``; the id of a binary is not known here.
    """
    name = F.substring_index(F.regexp_replace("path", "/$", ""), "/", -1)
    rows = files.withColumn("real_name", name).where(~F.col("real_name").isin(*reserved) & ~(F.col("is_dir") & F.col("real_name").endswith(".assets")) & ~F.col("real_name").endswith(".debug.xml"))
    header = split_front_matter(F.col("text"))["header"]
    document = F.col("real_name").endswith(".md")
    kind = F.when(F.col("is_dir"), "directory").when(document, F.coalesce(document_kind(header), F.lit("binary"))).when(F.col("real_name").endswith(".svg"), "drawing").otherwise("binary")
    return rows.select("real_name", kind.alias("kind"), F.when(document & ~F.col("is_dir"), F.coalesce(header_field(header, "id"), F.lit("TO_FILL"))).otherwise("TO_FILL").alias("id"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, size and modified of the files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
