"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Patterns find candidates in whole texts. The hash of each candidate value is then counted over the whole
corpus: by distinct documents of an owner (a document stands for a repository) and by distinct sources (owners).
A value that many owners share, or that stands in many documents even of one owner, is a copied example; a value
held by few of both looks like a live credential. Spans of the three base kinds are always reported; spans of
the further kinds are added where they look live.

One scan reads the texts; only the matches and the lengths of what stands between them travel on. The
place of a match is the running sum of those lengths, taken in a window over the matches of one row, so
a text may hold any number of matches. Counts are pre-aggregated before their shuffle, and a value that a
third of all rows share costs one row per task and document there.

Cases: null text counts as empty; texts without matches have counts 0 and empty spans; a null owner is an
owner of its own, and a null id a document of its own; repeated rows are scanned row by row; spans that begin
at one place are in the order of their kinds; an empty table gives an empty result; very long texts are scanned
whole; other columns are ignored by the scan and kept by the redaction, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.session import cut


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: its pattern, the group that is its value, and the least length of that value."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = False


#: The base kinds, in their order, then the kinds that the method adds.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),  # a shorter run of these characters holds no match either
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]+)", 1, 20),
    Kind("prefixed", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|npm_|pypi-|AIza)[A-Za-z0-9_-]+", 0, 24),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    Kind("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----[A-Za-z0-9+/=\s]+", 0, 48),
    Kind("url_login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._-]+:([A-Za-z0-9._~!$&*+=-]+)@", 1, 8),
)
#: A value held by at most so many owners, in at most so many documents of them, looks live.
MAX_LIVE_OWNERS = 4
MAX_LIVE_DOCS = 50
MATCH_FIELDS = "array<struct<kind:int,pos:int,gap:int,found:string>>"


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """All leftmost non-overlapping matches with the code points since the match before; else an empty array."""
    pieces = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(found.alias("found"), F.transform(pieces, F.length).alias("gap")),
        lambda x, k: F.struct(F.lit(number).alias("kind"), k.cast("int").alias("pos"), x["gap"].alias("gap"), x["found"].alias("found")),
    )
    return F.when(text.rlike(kind.pattern), F.filter(rows, lambda x: x["found"].isNotNull())).otherwise(F.array().cast(MATCH_FIELDS))


def find_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per input row: row_id, id, owner and all pattern matches, before any length is checked."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00none")) if owner_col in docs.columns else F.lit("\x00none")
    rows = docs.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = F.concat(*[_matches(F.col("text"), k, kind) for k, kind in enumerate(kinds)])
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", found.alias("matches"))


def candidates(rows: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per candidate: row_id, doc_id, owner, kind, start and end_at (code points) and value_hash."""
    each = rows.select("row_id", "doc_id", "owner", F.inline("matches"))
    before = Window.partitionBy("row_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end_at", F.sum(F.col("gap") + F.length("found")).over(before)).withColumn("start", F.col("end_at") - F.length("found"))
    value = F.lit(None).cast("string")
    enough = F.lit(False)
    for k, kind in enumerate(kinds):
        own = F.regexp_extract("found", kind.pattern, kind.group)
        value = F.when(F.col("kind") == k, own).otherwise(value)
        enough = F.when(F.col("kind") == k, F.length(own) >= kind.least).otherwise(enough)
    return placed.where(enough).select("row_id", "doc_id", "owner", "kind", "start", "end_at", F.sha2(value, 256).alias("value_hash"))


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: how many distinct documents of owners and how many distinct owners hold it."""
    per_owner = found.groupBy("value_hash", "owner", "doc_id").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count("*").alias("docs"))
    return per_owner.groupBy("value_hash").agg(F.sum("docs").alias("n_docs"), F.count("*").alias("n_owners"))


def judge_candidates(found: DataFrame, max_live_owners: int = MAX_LIVE_OWNERS, max_live_docs: int = MAX_LIVE_DOCS) -> DataFrame:
    """The candidates with n_docs, n_owners and ``live`` of their values.

    What is known of the values is written first: a join with an aggregate's own output could not be split for a value
    that many candidates have.
    """
    live = (F.col("n_owners") <= max_live_owners) & (F.col("n_docs") <= max_live_docs)
    return found.join(cut(ownership(found)), "value_hash").withColumn("live", live)


def _joined(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end_at"].cast("string"))), ",")


def _count_of(kind: int) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_live_owners: int = MAX_LIVE_OWNERS, max_live_docs: int = MAX_LIVE_DOCS, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per input row: doc_id, counts of base kinds, base_sha256, spans, and counts of live and shared values."""
    rows = cut(find_matches(docs, id_col, text_col, owner_col, kinds))
    found = cut(candidates(rows, kinds))
    base = [k for k, kind in enumerate(kinds) if kind.base]
    kept = judge_candidates(found, max_live_owners, max_live_docs).where(F.col("kind").isin(base) | F.col("live"))
    per_row = kept.groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end_at", "live"))).alias("found"),
    )
    full = rows.select("row_id", "doc_id").join(per_row, "row_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end_at:bigint,live:boolean>>")))
    counts = [_count_of(k).alias(f"n_{kinds[k].name}") for k in base]
    base_spans = F.filter("found", lambda x: x["kind"].isin(base))
    return full.select(
        "doc_id", *counts, F.sha2(_joined(base_spans, kinds), 256).alias("base_sha256"), _joined(F.col("found"), kinds).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_shared"),
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", max_live_owners: int = MAX_LIVE_OWNERS, max_live_docs: int = MAX_LIVE_DOCS, mark: str = "[SECRET]", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The input rows, all of them, with every live-looking span of the text replaced by ``mark``.

    Spans of overlapping kinds are replaced as one. Spans go back to the rows by id, owner and text, so rows that
    repeat all three share them. Columns, whatever their names, and their order stay.
    """
    owner = F.col(owner_col).cast("string") if owner_col in docs.columns else F.lit(None).cast("string")
    key = F.sha2(F.to_json(F.struct(F.col(id_col).cast("string").alias("i"), owner.alias("o"), F.col(text_col).alias("t"))), 256)
    keyed = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), owner.alias("owner"), F.col(text_col).alias("text"), key.alias("key"))
    matches = find_matches(keyed.withColumn("both", F.struct("key", "id")), "both", "text", "owner", kinds)
    found = cut(candidates(cut(matches.where(F.size("matches") > 0)), kinds))
    judged = judge_candidates(found.withColumn("key", F.col("doc_id.key")).withColumn("doc_id", F.col("doc_id.id")), max_live_owners, max_live_docs)
    live = judged.where("live").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end_at"))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        since = F.substring("text", (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        ahead = span["start"] >= done["at"]
        return F.struct(F.greatest(done["at"], span["end_at"]).alias("at"), F.when(ahead, F.concat(done["out"], since, F.lit(mark))).otherwise(done["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda x: F.concat(x["out"], F.substring("text", (x["at"] + 1).cast("int"), F.lit(2_147_483_647))))
    joined = keyed.join(live, "key", "left").withColumn("clean", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean))
    return joined.select(*[(F.col("clean") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
