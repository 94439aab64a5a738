"""Tables of what version control prints: changes, diffs, logs and counts. Lines have ``no`` (their order) and ``line``.

Blocks are found by carrying the last header line forward, over a running count of headers (``block_of``), so a
block of any size is spread over tasks by ranges of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.running import parts_of, running_sum


def block_of(lines: DataFrame, header: Column, doc: str = "doc") -> DataFrame:
    """The lines with ``block``: how many header lines of the document stand up to the line, itself included."""
    return running_sum(lines, (doc,), ("no",), header.cast("int"), "block")


def dealt_blocks(lines: DataFrame, header: Column) -> DataFrame:
    """The lines of blocks, dealt by block to as many partitions as the lines ask for."""
    return block_of(lines, header).where("block > 0").repartition(parts_of(lines), "doc", "block")


def name_status(lines: DataFrame) -> DataFrame:
    """doc, path and state (N, M, D) of ``diff --name-status`` lines; other lines are no changes."""
    state = F.when(F.col("line").rlike(r"^A\s"), "N").when(F.col("line").rlike(r"^M\s"), "M").when(F.col("line").rlike(r"^D\s"), "D")
    return lines.select("doc", F.element_at(F.split("line", r"\s"), -1).alias("path"), state.alias("state"), F.lit(0).alias("attachments")).where("state is not null")


def short_status(lines: DataFrame, include_assets: bool = False) -> DataFrame:
    """doc, path, state and attachments of ``status --short`` lines; a changed asset is an attachment of its document."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("line", r"\s+", " ")), '^"', ""), '"$', ""), " ")
    rows = lines.where(F.trim("line") != "").select("doc", F.get(words, F.lit(0)).alias("code"), F.get(words, F.lit(1)).alias("path"))
    asset = F.col("path").contains(".assets/") & F.lit(not include_assets)
    state = F.when(asset, "M").when(F.col("code") == "D", "D").when(F.col("code") == "M", "M").otherwise("N")
    path = F.when(asset, F.concat(F.substring_index("path", ".assets/", 1), F.lit(".md"))).otherwise(F.col("path"))
    return rows.select("doc", path.alias("path"), state.alias("state"), F.when(asset, 1).otherwise(0).alias("attachments"))


def changes(named: DataFrame, short: DataFrame) -> DataFrame:
    """doc, path, is_new, is_modified, is_deleted and attachments: the union of both tables, folded by path."""
    both = named.unionByName(short)
    flags = [F.bool_or(F.col("state") == s).alias(n) for s, n in (("N", "is_new"), ("M", "is_modified"), ("D", "is_deleted"))]
    return both.groupBy("doc", "path").agg(*flags, F.sum("attachments").alias("attachments"))


def unstaged_count(named: DataFrame, status_lines: DataFrame) -> DataFrame:
    """doc and n_unstaged: status lines plus added and modified files; a file in both counts twice."""
    one = status_lines.where(F.trim("line") != "").select("doc").unionByName(named.where("state in ('N', 'M')").select("doc"))
    return one.groupBy("doc").agg(F.count("*").alias("n_unstaged"))


def diff_files(lines: DataFrame) -> DataFrame:
    """doc, block, old_file, new_file and n_changed of each file of a diff; a missing side has the other's name."""
    blocks = dealt_blocks(lines, F.col("line").startswith("diff --git "))
    old, new = F.max(F.when(F.col("line").startswith("--- a/"), F.expr("substring(line, 7)"))), F.max(F.when(F.col("line").startswith("+++ b/"), F.expr("substring(line, 7)")))
    changed = F.count_if(F.col("line").rlike(r"^[+-](?!\+\+ |-- )"))
    return blocks.groupBy("doc", "block").agg(F.coalesce(old, new).alias("old_file"), F.coalesce(new, old).alias("new_file"), changed.alias("n_changed"))


def commits(lines: DataFrame) -> DataFrame:
    """doc, id, author, seconds and message of a log's commits; a message is its lines, trimmed, in order."""
    blocks = dealt_blocks(lines, F.col("line").startswith("commit "))
    kind = F.when(F.col("line").startswith("commit "), "commit").when(F.col("line").startswith("Author: "), "author").when(F.col("line").startswith("Date: "), "date").when(F.trim("line") != "", "text")
    rows = blocks.withColumn("kind", kind)
    text = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("no", F.trim("line").alias("line")))))
    return rows.groupBy("doc", "block").agg(
        F.max(F.when(F.col("kind") == "commit", F.get(F.split("line", " "), F.lit(1)))).alias("id"), F.max(F.when(F.col("kind") == "author", F.trim(F.expr("substring(line, 9)")))).alias("author"),
        F.max(F.when(F.col("kind") == "date", F.trim(F.expr("substring(line, 7)")).try_cast("bigint"))).alias("seconds"), F.array_join(F.transform(text, lambda x: x["line"]), "\n").alias("message"),
    ).drop("block")


def ahead_behind(own: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: ahead and behind, the commits (id) that only one side has."""
    ahead = own.select("id").distinct().join(remote, "id", "left_anti").agg(F.count("*").alias("ahead"))
    return ahead.crossJoin(F.broadcast(remote.select("id").distinct().join(own, "id", "left_anti").agg(F.count("*").alias("behind"))))  # one row each


def auto_commit(files: DataFrame, lines: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """path of the files whose every changed line (path, line with its sign) begins with a prefix, in no file that fails."""
    body = F.expr("substring(line, 2)")
    allowed = F.lit(False)
    for p in prefixes:
        allowed = allowed | body.startswith(p)
    judged = lines.where(F.col("line").rlike("^[+-]")).groupBy("path").agg(F.bool_and(allowed).alias("passes"))
    failed = judged.where("not passes")
    return files.select("path").distinct().join(failed, "path", "left_anti")


def commit_files(all_changes: DataFrame, selected: DataFrame) -> DataFrame:
    """The changes (path) to commit: selected paths, and assets whose document is selected."""
    key = F.regexp_replace("path", r"\.assets/.*$", ".md")
    return all_changes.withColumn("__key", key).join(selected.select(F.col("path").alias("__key")), "__key", "left_semi").drop("__key")


def diff_order(path: Column) -> tuple[Column, Column, Column]:
    """Sort keys of a diff: documents before their own assets, else by path."""
    document = F.regexp_replace(path, r"\.assets/.*$", ".md")
    return document, path.contains(".assets/"), path
