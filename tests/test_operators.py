import gzip
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from leafmill.functions import paths as P
from leafmill.functions import text as T
from leafmill.operators import links, naming, search, snapshots, trees
from leafmill.sinks import files as sinks
from leafmill.sources import files as sources
from leafmill.sources import git
from leafmill.streaming.changes import ChangeState, latest_changes, read_changes, read_latest, start_latest


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("name,want", [("Neat Page #1: My first (& only_page)", "neat-page-1-my-first-and-only_page"), ("Injection/Immunization", "injection-immunization"), (".navigation", ".navigation"), (None, None)])
def test_slug(spark, name, want):
    assert value(spark, T.slug(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("7", 0), ("7s", 7), ("7m", 420), ("7h", 25200), ("7d", 604800), ("7w", 4233600), ("", 0)])
def test_interval(spark, text, want):
    assert value(spark, T.interval_seconds(F.lit(text))) == want


@pytest.mark.parametrize("start,target,want", [("/etc/http", "/var/log", "../../var/log"), ("/a/b", "/a/b", "./"), ("/a/b.md", "/a/c.md", "c.md")])
def test_relative_path(spark, start, target, want):
    assert value(spark, T.relative_path(F.lit(start), F.lit(target))) == want


def test_conflicts(spark):
    files = spark.createDataFrame([("id1", "test-file.md"), ("id2", "test-file.md"), ("id3", "other.md")], "id string, name string")
    assert {r["id"]: r["real_name"] for r in naming.resolve_conflicts(files, "name", "id").collect()} == {"id1": "test-file@1.md", "id2": "test-file@2.md", "id3": "other.md"}
    assert value(spark, T.strip_conflict(F.lit("test-file@12.md"))) == "test-file.md"


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1), (5, 6)], "source long, target long")
    found = links.closure(edges, spark.createDataFrame([(1,)], "id long"))
    assert {r["node"] for r in found.collect()} == {1, 2, 3, 9}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, v string")
    assert snapshots.snapshot_diff(empty, empty, "k", "v").count() == 0
    assert links.back_links(links.extract_links(empty, "k", "v")).count() == 0


def test_search_falls_back(spark):
    docs = spark.createDataFrame([(1, "blue widget"), (2, "red bolt")], "k long, t string")
    index = search.postings(docs, "k", "t")
    ids = spark.createDataFrame([(2, "abc_def-ghi_jk")], "k long, id_text string")
    assert [r["k"] for r in search.search(index, "k", "wid").collect()] == [1]
    assert [r["k"] for r in search.search(index, "k", "abcdef-ghijk", ids).collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    start_latest(read_changes(spark, str(tmp_path / "in"), rows.schema), "k", ("seq",), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    found = read_latest(spark, str(tmp_path / "out")).select("k", "v")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in latest_changes(rows, "k", ("seq",), ("v",)).collect()}


def test_stream_prunes_what_the_tree_holds(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, False), (2, 5, False), (3, 5, True), (4, 5, False)], "k long, version long, trashed boolean")
    rows.write.parquet(str(tmp_path / "in"))
    tree = spark.createDataFrame([(1, 5), (2, 4)], "k long, version long")
    start_latest(read_changes(spark, str(tmp_path / "in"), rows.schema), "k", ("version",), str(tmp_path / "out"), str(tmp_path / "ck"), tree, "version").awaitTermination()
    assert {r["k"] for r in read_latest(spark, str(tmp_path / "out")).collect()} == {2, 4}


def test_closure_by_name_pairs_no_links_with_nodes(spark):
    """As the closure over paired links, nodes of several and of no names included; a name of many links and nodes costs their sum."""
    links_ = spark.createDataFrame([(2, "a"), (3, "b"), (4, "c"), (1, "c"), (9, "c"), (5, "none"), (6, None), (7, "b"), (8, "d")], "source long, name string")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (2, "x"), (3, "c"), (7, "c"), (4, "d"), (6, None), (8, "z")], "node long, name string")
    seeds = spark.createDataFrame([(1,)], "id long")
    want = links.closure(links_.join(names, "name").select("source", F.col("node").alias("target")), seeds)
    got = {tuple(r) for r in links.closure_by_name(links_, names, seeds).select("node", "distance").collect()}
    assert got == {tuple(r) for r in want.select("node", "distance").collect()} == {(1, 0), (2, 1), (3, 2), (7, 2), (4, 3), (9, 3), (8, 4)}
    many = spark.range(1, 300_001)
    found = links.closure_by_name(many.select(F.col("id").alias("source"), F.lit("hub").alias("name")), many.select(F.col("id").alias("node"), F.lit("hub").alias("name")), seeds)
    assert found.count() == 300_000 and found.agg(F.max("distance")).first()[0] == 1


def test_page_closure_of_odd_urls(spark, tmp_path):
    from leafmill.plans.deep_queries import ORACLE_SQL, QUERIES
    from parity import compare

    pages = [(0, "https://h/en/1", ""), (1, None, '<a href="/en">'), (2, "no scheme", None), (3, "https://h", '<a href="/">'), (4, "https://h/fr?q", '<a href="/en">'), (5, "https://h/fr", '<a href="/en">'), (6, "a://b/d://e/f", '<a href="/fr">'), (7, "x://y", '<a href="/d:">'), (8, "x://y/z", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    compare(spark, QUERIES["link_page_closure"], ORACLE_SQL["link_page_closure"], str(tmp_path))


def largest_share(df):
    """Rows of the largest partition of a result, and all its rows."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes), sum(sizes)


def test_running_sums_keep_tasks_small(spark, monkeypatch):
    """A task's rows don't grow with the input: in one large group, in many small ones, without keys; nulls are a group."""
    from leafmill.operators import running

    monkeypatch.setattr(running, "PART_ROWS", 1000, raising=False)
    rows = spark.range(20_000).selectExpr("case when id % 4 = 0 then null when id < 18000 then 'hub' else cast(id as string) end as g", "id as at", "id % 3 as v")
    for keys in (("g",), ()):
        found = running.running_sum(rows, keys, ("at",), F.col("v"), "sum")
        most, total = largest_share(found)
        assert total == 20_000 and most <= 3000
        wanted = {}
        for r in found.orderBy("at").collect():
            g = r["g"] if keys else 0
            wanted[g] = wanted.get(g, 0) + r["v"]
            assert r["sum"] == wanted[g]
    before = running.running_last(rows, ("g",), ("at",), {"b": F.when(F.col("v") == 1, F.col("at"))})
    last = {}
    for r in before.orderBy("at").collect():
        assert r["b"] == last.get(r["g"])
        last[r["g"]] = r["at"] if r["v"] == 1 else last.get(r["g"])


def test_diff_files_keep_tasks_small(spark, monkeypatch):
    from leafmill.operators import running

    monkeypatch.setattr(running, "PART_ROWS", 1000, raising=False)
    text = "case id % 4 when 0 then 'diff --git x y' when 1 then '--- a/o' || id div 4 when 2 then '+++ b/n' || id div 4 else '+x' end as line"
    found = git.diff_files(spark.range(20_000).selectExpr("'d' as doc", "id as no", text))
    most, total = largest_share(found)
    assert total == 5000 and most <= total / 8
    assert found.where("old_file = concat('o', block - 1) and new_file = concat('n', block - 1) and n_changed = 1").count() == 5000


def test_active_dedupe_keeps_tasks_small(spark, monkeypatch):
    from leafmill.operators import events, running

    monkeypatch.setattr(running, "PART_ROWS", 1000, raising=False)
    calls = spark.range(12_000).selectExpr("case when id % 3 = 0 then null else id % 400 end as d", "'k' as kind", "cast(null as string) as p", "id as at", "case when id = 11000 then null else id + id * 7 % 900 end as until")
    found = events.active_dedupe(calls, "d", "kind", "p", "at", "until")
    most, total = largest_share(found)
    until, want = {}, []
    for d, at, end in sorted(((r["d"], r["at"], r["until"]) for r in calls.collect()), key=lambda r: r[1]):
        if at >= until.get(d, 0):
            until[d] = float("inf") if end is None else end
            want.append((d, at))
    assert sorted((r["at"], str(r["d"])) for r in found.collect()) == sorted((at, str(d)) for d, at in want)
    assert total == len(want) and most <= total / 3


def test_postings_keep_tasks_small(spark, monkeypatch):
    """One file of many rows and one frequent term: dealt before rows are taken apart, so by the texts' size."""
    monkeypatch.setattr(search, "PART_CHARS", 10_000, raising=False)
    docs = spark.range(6000).selectExpr("id % 5000 as k", "concat('id_', id) as n", "concat('red red t', id % 5000) as t").coalesce(1)
    found = search.field_postings(docs, "k", "n", "t")
    most, total = largest_share(found)
    assert most <= total / 8
    got = {(r["ref"], r["term"]): r["tf"] for r in found.where("field = 'title'").collect()}
    assert got == {(k, t): n * (2 if k < 1000 else 1) for k in range(5000) for t, n in (("red", 2), (f"t{k}", 1))}
    assert search.postings(docs.withColumnRenamed("k", "text"), "text", "t").where("term = 'red'").agg(F.sum("tf")).first()[0] == 12_000


def folder_rows(spark, path, kind):
    return sum(spark.read.parquet(str(p)).count() for p in path.glob(f"{kind}-*"))


def test_change_state_writes_what_a_batch_touches(spark, tmp_path):
    """1,000 keys, then batches of 10: each is written as 10 rows, buckets rarely again; a batch that comes again changes nothing."""
    schema = "k long, seq long, v string"
    state = ChangeState(spark, str(tmp_path / "s"), "k", ("seq",), spark.createDataFrame([], schema).schema, n_buckets=4)
    state.merge(spark.range(1000).selectExpr("id as k", "0L as seq", "'first' as v"), 0)
    assert folder_rows(spark, tmp_path / "s", "base") == 1000
    for batch in (1, 2):
        state.merge(spark.range(10).selectExpr("id * 7 as k", f"{batch}L as seq", f"'b{batch}' as v"), batch)
        assert spark.read.parquet(str(tmp_path / "s" / f"delta-{batch:010d}")).count() == 10 and not (tmp_path / "s" / f"base-{batch:010d}").exists()
    before = sorted(map(tuple, state.read().collect()))
    state.merge(spark.range(10).selectExpr("id as k", "9L as seq", "'again' as v"), 2)
    assert state.version() == 2 and sorted(map(tuple, state.read().collect())) == before
    assert len(before) == 1000 and {r[0] for r in before if r[2] == "b2"} == {k * 7 for k in range(10)}
    state.merge(spark.createDataFrame([(5, -1, "late"), (None, 3, "null key"), (2000, 1, "new"), (2000, 2, "newer")], schema), 3)
    found = {r["k"]: r["v"] for r in ChangeState.open(spark, str(tmp_path / "s")).read().collect()}
    assert found[5] == "first" and found[None] == "null key" and found[2000] == "newer" and len(found) == 1002
    state.merge(spark.range(600).selectExpr("id as k", "10L as seq", "'more' as v"), 4)
    state.merge(spark.range(600).selectExpr("id as k", "11L as seq", "'most' as v"), 5)
    assert {r["k"]: r["v"] for r in state.read().collect()} == found | {k: "most" for k in range(600)}
    assert (tmp_path / "s" / "base-0000000005").exists() and (tmp_path / "s" / "delta-0000000001").exists()  # the version before names it
    assert state.read(4).count() == 1002
    state.merge(spark.createDataFrame([(1, 12, "last")], schema), 6)
    assert not (tmp_path / "s" / "delta-0000000001").exists() and {r["k"]: r["v"] for r in state.read().collect()} == found | {k: "last" if k == 1 else "most" for k in range(600)}


def test_change_state_after_a_cut_off_batch_and_pruning(spark, tmp_path):
    schema = "k long, version long, trashed boolean"
    state = ChangeState(spark, str(tmp_path / "s"), "k", ("version",), spark.createDataFrame([], schema).schema, n_buckets=3)
    state.merge(spark.createDataFrame([(k, 5, False) for k in range(20)], schema), 0)
    spark.createDataFrame([(1, 9, False, False, 0)], f"{schema}, __gone boolean, __bucket int").write.partitionBy("__bucket").parquet(str(tmp_path / "s" / "delta-0000000001"))  # no manifest
    assert {r["version"] for r in state.read().collect()} == {5}
    state.merge(spark.createDataFrame([(1, 6, False)], schema), 1)
    assert {r["k"]: r["version"] for r in state.read().collect()} == {k: 6 if k == 1 else 5 for k in range(20)}
    state.prune(spark.createDataFrame([(1, 5), (2, 5), (3, 7)], "k long, version long"), "version")
    assert {r["k"] for r in state.read().collect()} == set(range(20)) - {2, 3}
    state.merge(spark.createDataFrame([(2, 8, False)], schema), 2)
    assert {r["k"] for r in state.read().collect()} == set(range(20)) - {3}
    assert state.read(state.version() - 1).count() == 18


def test_change_state_ends_keys_by_changes_of_the_same_order(spark, tmp_path):
    """A later change of the same order wins, in whatever order the files are read: here the later, larger file comes first."""
    schema = "k long, seq long, v string"
    state = ChangeState(spark, str(tmp_path / "s"), "k", ("seq",), spark.createDataFrame([], schema).schema, n_buckets=1)
    state.merge(spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], schema), 0)
    state.merge(spark.range(1, 5000).selectExpr("id as k", "5L as seq", "concat('later', id) as v"), 1, F.col("k") == 1)
    found = {r["k"]: r["v"] for r in state.read().where("k < 4").collect()}
    assert found == {2: "later2", 3: "later3"}


def test_stream_polls(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1), (2, 1)], "k long, seq long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = start_latest(read_changes(spark, str(tmp_path / "in"), rows.schema), "k", ("seq",), str(tmp_path / "out"), str(tmp_path / "ck"), n_buckets=2, every="1 second")
    try:
        stream.processAllAvailable()
        spark.createDataFrame([(1, 2)], "k long, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert {tuple(r) for r in read_latest(spark, str(tmp_path / "out")).collect()} == {(1, 2), (2, 1)}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    first = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"))
    first.repartition(2).write.parquet(str(tmp_path / "in"))
    run = lambda: start_latest(read_changes(spark, str(tmp_path / "in"), first.schema), "k", ("seq",), str(tmp_path / "out"), str(tmp_path / "ck"), n_buckets=4).awaitTermination()
    run()
    more = spark.range(100, 130).select((F.col("id") % 5).alias("k"), F.col("id").alias("seq"))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert {tuple(r) for r in read_latest(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in latest_changes(first.union(more), "k", ("seq",), ("seq",)).collect()}


RELATIVE = [
    ("https://example.com/path", "https://example.com/path", "./"), ("https://example.com/path", "https://example.com/path.md", "../path.md"),
    ("https://example.com/path", "https://example2.com/path.md", "https://example2.com/path.md"), ("/etc/http", "/var/log", "../../var/log"), ("/etc/http", "/etc/log", "../log"),
    ("content/functions/a/b/c.md", "content/functions/a/d/e.md", "../d/e.md"), ("somefile.md", "https://youtube.be/v/xxx", "https://youtube.be/v/xxx"),
    ("somefile.md", "https://youtube.be/v/xxx?que&r=y", "https://youtube.be/v/xxx?que&r=y"), ("/a/b", "/", "/"), ("/a/b.md", "/a/c.md", "c.md"),
]


@pytest.mark.parametrize(("start", "target", "want"), RELATIVE)
def test_relate_url(spark, start, target, want):
    assert value(spark, P.relate_url(F.lit(start), F.lit(target))) == want


ABSOLUTE = [
    ("https://example.com/path", "", "https://example.com/path"), ("https://example.com/path", ".", "https://example.com/path"), ("https://example.com/path", "..", "https://example.com/"),
    ("https://example.com/path", "../..", "https://example.com/"), ("https://example.com/path", "path2", "https://example.com/path/path2"), ("https://example.com/path/path2", "../..", "https://example.com/"),
    ("https://example.com/path/path2", "../../path3", "https://example.com/path3"), ("https://example.com/path/path2", "../../../path3", "https://example.com/path3"),
    ("https://example.com/aaa/bbb/ccc.odt", "./doc1.svg", "https://example.com/aaa/bbb/doc1.svg"), ("https://example.com/aaa/bbb/ccc.odt", "doc2.svg", "https://example.com/aaa/bbb/doc2.svg"),
]


@pytest.mark.parametrize(("full", "relative", "want"), ABSOLUTE)
def test_absolutize_url(spark, full, relative, want):
    assert value(spark, P.absolutize_url(F.lit(full), F.lit(relative))) == want


@pytest.mark.parametrize(("base", "relative", "want"), [("/aaa/bbb/ccc.odt", "./doc1.svg", "/aaa/bbb/doc1.svg"), ("/aaa/bbb/ccc.odt", "../subdir/diagram.svg", "/aaa/subdir/diagram.svg"), ("a", "http://x", "")])
def test_absolute_document_path(spark, base, relative, want):
    assert value(spark, P.absolute_document_path(F.lit(base), F.lit(relative))) == want


@pytest.mark.parametrize(("ms", "want"), [(100, ""), (300, "300ms"), (1000, "1000ms"), (1234, "1.2s"), (2000, "2s")])
def test_elapsed(spark, ms, want):
    assert value(spark, P.elapsed(F.lit(ms), 200)) == want


def test_conflict_first_run_then_renamed(spark):
    """Two files of one name, then both renamed: the numbers go."""
    files = spark.createDataFrame([("id1", "test-file.md"), ("id2", "test-file.md")], "id string, name string")
    first = naming.resolve_conflicts(files, "name", "id")
    assert {r["id"]: r["real_name"] for r in first.collect()} == {"id1": "test-file@1.md", "id2": "test-file@2.md"}
    renamed = spark.createDataFrame([("id1", "example-1.md"), ("id2", "example-2.md")], "id string, name string")
    second = naming.resolve_conflicts(renamed, "name", "id", (), first.select("id", "real_name"))
    assert {r["id"]: r["real_name"] for r in second.collect()} == {"id1": "example-1.md", "id2": "example-2.md"}


def test_conflicts_never_share_a_name(spark):
    rows = [(1, "a.md"), (2, "a.md"), (3, "a@1.md"), (4, "a.md"), (5, "b"), (6, None), (7, "a.md")]
    files = spark.createDataFrame(rows, "id long, name string")
    stored = spark.createDataFrame([(4, "a@3.md"), (7, "other.md"), (1, "a.md")], "id long, real_name string")
    found = {r["id"]: r["real_name"] for r in naming.resolve_conflicts(files, "name", "id", (), stored).collect()}
    assert found == {1: "a@2.md", 2: "a@4.md", 3: "a@1.md", 4: "a@3.md", 5: "b", 7: "a@5.md"}
    assert naming.resolve_conflicts(files.limit(0), "name", "id").count() == 0


def test_conflict_group_of_half_the_files(spark):
    files = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("name"))
    found = naming.resolve_conflicts(files, "name", "id").where("name = 'same'").orderBy("id").collect()
    assert [r["real_name"] for r in found] == [f"same@{k}" for k in range(1, 1501)]


def test_deep_trees_and_cycles(spark):
    chain = [(k, k - 1 if k else None, f"n{k}") for k in range(1000)] + [(5000, 5001, "x"), (5001, 5000, "y"), (5002, 5001, "below"), (6000, 9999, "orphan")]
    nodes = spark.createDataFrame(chain, "id long, parent long, name string")
    found = {r["id"]: (r["depth"], len(r["path"].split("/"))) for r in trees.tree_paths(nodes).collect()}
    assert found == {k: (k, k + 1) for k in range(1000)}
    above = trees.ancestors(nodes, spark.createDataFrame([(999,), (5002,)], "id long")).collect()
    assert {(r["ancestor"], r["distance"]) for r in above if r["leaf"] == 999} == {(k, 999 - k) for k in range(999)}
    assert {(r["ancestor"], r["distance"]) for r in above if r["leaf"] == 5002} == {(5001, 1), (5000, 2)}


def test_bullet_menu_levels(spark):
    lines = ["* [A](a)", "   * [B](b)", "      * [C](c)", "   * no link", "   * [D](d)", "* [E](e)"]
    found = trees.bullet_menu(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc int, no int, line string"), "doc", "no", "line")
    assert {r["identifier"]: (r["weight"], r["parent"]) for r in found.collect()} == {"a": (10, None), "b": (20, "a"), "c": (30, "b"), "d": (40, "a"), "e": (50, None)}


def test_links_and_events_round_trip(spark, tmp_path):
    rows = [("1", "a;b", "gdoc:2"), ("1", "a;b", "gdoc:3#x"), ("2", "c", "http://x")]
    sinks.write_links(spark.createDataFrame(rows, "source string, name string, dest string"), str(tmp_path / "l"))
    assert sorted(tuple(r) for r in sources.read_links(spark, str(tmp_path / "l")).collect()) == sorted(rows)
    log = [(f"p{k}", k, f"id{k % 3}", "md", "touched", k) for k in range(20)]
    sinks.write_events(spark.createDataFrame(log, "filePath string, mtime long, id string, type string, event string, seq long"), str(tmp_path / "e"))
    found = sources.read_events(spark, str(tmp_path / "e")).orderBy("seq").collect()
    assert [r["filePath"] for r in found] == [r[0] for r in log]


def test_listings_and_trees(spark, tmp_path):
    (tmp_path / "files.json").write_text('[{"id": "1", "name": "a", "parents": ["p"], "size": "3"}, {"id": "2", "name": "b", "extra": 1}]')
    assert {(r["id"], r["size"]) for r in sources.read_listing(spark, str(tmp_path / "files.json")).collect()} == {("1", "3"), ("2", None)}
    (tmp_path / "tree.json").write_text('[{"id": "1", "name": "a", "children": [{"id": "2", "name": "b", "children": [{"id": "3", "name": "c"}]}]}, {"id": "4", "name": "d"}]')
    assert {(r["id"], r["parent"]) for r in sources.read_tree(spark, str(tmp_path / "tree.json")).collect()} == {("1", None), ("2", "1"), ("3", "2"), ("4", None)}


def test_rotated_logs(spark, tmp_path):
    def line(day, level="info", **more):
        return json.dumps({"level": level, "message": "m", "timestamp": f"2024-03-{day:02d}T00:00:00Z", **more})

    (tmp_path / "2024-03-10-combined.log").write_text(line(10) + "\nnot json\n" + line(11, "error") + "\n")
    with gzip.open(tmp_path / "2024-03-12-combined.log.gz", "wt") as out:
        out.write(line(12) + "\n")
    (tmp_path / "2024-03-25-combined.log").write_text(line(11) + "\n")  # too far from the range to be opened
    since, until = datetime(2024, 3, 10, tzinfo=UTC), datetime(2024, 3, 12, tzinfo=UTC)
    found = sources.read_logs(spark, str(tmp_path), since, until)
    assert sorted(r["timestamp"][8:10] for r in found.collect()) == ["10", "11", "12"]
    assert sources.read_logs(spark, str(tmp_path), since, until, "error").count() == 1
    sinks.write_logs(found.withColumn("jobId", F.when(F.col("level") == "error", "j1")), str(tmp_path / "jobs"), str(tmp_path / "days"))
    assert sources.read_job_log(spark, str(tmp_path / "jobs"), "j1").count() == 1 and spark.read.json(str(tmp_path / "days")).count() == 2


def test_front_matter_cases(spark):
    texts = ["---\nid: 'a'\ntitle: \"T\"\n---\nbody\n---\nmore", "no header", "---\n---\nx", "---\nid: b\n", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", sources.split_front_matter(F.col("t")).alias("s")).select("k", "s.*", sources.header_field(F.col("s.header"), "title").alias("title"))
    found = {r["k"]: (r["header"], r["body"], r["title"]) for r in rows.collect()}
    assert found[0] == ("id: 'a'\ntitle: \"T\"", "body\n---\nmore", "T") and found[1] == (None, "no header", None)
    assert found[2][1] == "x" and found[3] == (None, "---\nid: b\n", None) and found[4] == (None, None, None)


def test_directory_scan(spark):
    rows = [("d/a.md", False, "---\nid: '1'\n---\nx"), ("d/b.md", False, "---\nid: '2'\ntype: 'conflict'\n---\n"), ("d/c.svg", False, None), ("d/c.assets/", True, None), ("d/.private", False, None), ("d/x.debug.xml", False, None), ("d/sub/", True, None)]
    found = sources.scan_directory(spark.createDataFrame(rows, "path string, is_dir boolean, text string"), (".private",))
    assert {r["real_name"]: (r["kind"], r["id"]) for r in found.collect()} == {"a.md": ("md", "1"), "b.md": ("conflict", "2"), "c.svg": ("drawing", "TO_FILL"), "sub": ("directory", "TO_FILL")}


def test_redirect_needs_a_target(spark):
    assert "redirectTo: 'x'" in value(spark, sinks.redirect_page(F.lit("t"), F.lit("x")))
    with pytest.raises(Exception, match="a redirect needs a target"):
        value(spark, sinks.redirect_page(F.lit("t"), F.lit(None).cast("string")))


def test_changed_files_without_a_tree(spark):
    changes = spark.createDataFrame([(1, 2)], "k long, version long")
    assert snapshots.changed_files(changes, changes.limit(0), "k", "version").count() == 1


def test_git_diff_order_and_statuses(spark):
    paths = spark.createDataFrame([("b.md",), ("a.assets/1.png",), ("a.md",), ("c.txt",)], "path string")
    assert [r["path"] for r in paths.orderBy(*git.diff_order(F.col("path"))).collect()] == ["a.md", "a.assets/1.png", "b.md", "c.txt"]
    lines = spark.createDataFrame([("x", ' M "a b.md"'), ("x", "?? new.md"), ("x", " D gone.md"), ("x", "")], "doc string, line string")
    assert {(r["path"], r["state"]) for r in git.short_status(lines).collect()} >= {("new.md", "N"), ("gone.md", "D")}


@pytest.mark.parametrize(("name", "locale", "want"), [("Größe & Maß", None, "grosse-and-mass"), ("Größe", "de", "groesse"), ("Łódź: café", None, "lodz-cafe"), ("日本 ガ", None, "日本-ガ"), (None, None, None)])
def test_slug_of_other_letters(spark, name, locale, want):
    from leafmill.functions.unicode import slug_unicode

    found = value(spark, slug_unicode(F.lit(name).cast("string"), locale))
    assert found == (want.replace("ガ", "カ") if want else None)


def test_file_metadata(spark, tmp_path):
    (tmp_path / "a.txt").write_text("12345")
    assert [r["size"] for r in sources.read_metadata(spark, str(tmp_path)).collect()] == [5]
