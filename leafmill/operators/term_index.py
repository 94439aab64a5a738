"""A stored full-text index: segments of postings sorted by term, with a dictionary of which file holds which terms."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.search import field_postings

POSTINGS = "term string, field string, ref string, tf long"
FILES = "segment string, file string, first string, last string, n long"
DOCS = "ref string"


@dataclass(frozen=True)
class TermIndex:
    """An index in a folder of a shared file system.

    A segment is written by ranges of terms, so each of its files holds the terms between a first and a last one; these
    bounds stand in a dictionary beside it, one row a file. A look-up reads the dictionaries, which are small, and opens
    only the files whose range holds the term or meets the prefix. Documents that are added again live in the segment
    that came last; ``merge`` makes one segment of all.
    """

    spark: SparkSession
    path: str
    rows_a_file: int = 1_000_000

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def segments(self) -> list[str]:
        """The whole segments, oldest first."""
        system, place = self._fs(f"{self.path.rstrip('/')}/segment-*/files/_SUCCESS")
        return sorted(f.getPath().getParent().getParent().getName() for f in system.globStatus(place) or ())

    def _write(self, postings: DataFrame, docs: DataFrame, after: list[str]) -> str:
        number = int(after[-1].split("-")[1]) + 1 if after else 0
        segment = f"segment-{number:08d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path.rstrip('/')}/{segment}"
        n_files = max(1, math.ceil(postings.count() / self.rows_a_file))
        postings.repartitionByRange(n_files, "term").sortWithinPartitions("term", "ref").write.parquet(f"{at}/postings")
        docs.write.parquet(f"{at}/docs")
        rows = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings").select("term", F.col("_metadata.file_name").alias("file"))
        rows.groupBy("file").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("n")).select(F.lit(segment).alias("segment"), "file", "first", "last", "n").coalesce(1).write.parquet(f"{at}/files")
        return segment

    def add(self, nodes: DataFrame, ref: str, id_col: str, title: str) -> str:
        """Index the ids and titles of tree nodes as one segment."""
        rows = field_postings(nodes, ref, id_col, title).select("term", "field", F.col("ref").cast("string").alias("ref"), "tf")
        return self._write(rows, nodes.select(F.col(ref).cast("string").alias("ref")).distinct(), self.segments())

    def dictionary(self) -> DataFrame:
        """segment, file, first, last and n of every file."""
        found = [f"{self.path.rstrip('/')}/{s}/files" for s in self.segments()]
        return self.spark.read.schema(FILES).parquet(*found) if found else self.spark.createDataFrame([], FILES)

    def files_for(self, first: str, last: str | None) -> list[str]:
        """Paths of the files whose range meets the terms from ``first`` up to, without it, ``last`` (null: the term alone)."""
        fits = (F.col("last") >= first) & ((F.col("first") < last) if last is not None else (F.col("first") <= first))
        return [f"{self.path.rstrip('/')}/{r['segment']}/postings/{r['file']}" for r in self.dictionary().where(fits).select("segment", "file").collect()]

    def _newest(self) -> DataFrame:
        """ref and segment: where each document lives."""
        found = [(s, f"{self.path.rstrip('/')}/{s}/docs") for s in self.segments()]
        rows = None
        for segment, place in found:
            one = self.spark.read.schema(DOCS).parquet(place).withColumn("segment", F.lit(segment))
            rows = one if rows is None else rows.unionByName(one)
        return rows.groupBy("ref").agg(F.max("segment").alias("segment"))

    def look_up(self, term: str) -> DataFrame:
        """term, field, ref and tf of the postings of a term, or of all terms with a prefix where it ends with ``*``."""
        prefix = term.endswith("*")
        first = term.rstrip("*") if prefix else term
        paths = self.files_for(first, first + "\U0010ffff" if prefix else None)
        if not paths:
            return self.spark.createDataFrame([], POSTINGS)
        rows = self.spark.read.schema(POSTINGS).parquet(*paths)
        hits = rows.where(F.col("term").startswith(first) if prefix else F.col("term") == first)
        placed = hits.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"(segment-[^/]*)/postings", 1))
        return placed.join(self._newest(), ["ref", "segment"]).select("term", "field", "ref", "tf")

    def search(self, query: str) -> DataFrame:
        """ref and score (sum of tf) of the documents that hold any term of a query."""
        from leafmill.operators.search import query_terms

        found = None
        for term in query_terms(query):
            rows = self.look_up(term)
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], "ref string, score long")
        return found.groupBy("ref").agg(F.sum("tf").alias("score"))

    def merge(self) -> None:
        """Write one segment of all, then delete the others. A merge that is cut off leaves the old ones; one that ended
        before the deletion is read rightly, as its documents are the newest."""
        old = self.segments()
        if len(old) < 2:
            return
        parts = [self.spark.read.schema(POSTINGS).parquet(f"{self.path.rstrip('/')}/{s}/postings").withColumn("segment", F.lit(s)) for s in old]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        newest = self._newest()
        self._write(rows.join(newest, ["ref", "segment"]).select("term", "field", "ref", "tf"), newest.select("ref"), old)
        for segment in old:
            system, place = self._fs(f"{self.path.rstrip('/')}/{segment}")
            system.delete(place, True)
