"""Traversals, job rules, stored files and nested values on small, deep, wide and odd inputs."""

import json
import random

from pyspark.sql import functions as F

from leafmill.operators import events, links, ordering, trees, variants
from leafmill.operators.running import running_last, running_sums
from leafmill.operators.term_index import TermIndex
from leafmill.sinks import files as sinks
from leafmill.sources import files as sources


def walked(rows):
    """Per id that a root reaches: parent, place, pre, last and depth; and the order of looking."""
    below, numbers, looked = {}, {}, []
    for i, p, name in rows:
        below.setdefault(p, []).append((name, i))
    stack, count = [(None, 0, iter(enumerate(sorted(below.get(None, [])), 1)))], 0
    while stack:
        parent, depth, rest = stack[-1]
        place, (_, i) = next(rest, (None, (None, None)))
        if place is None:
            stack.pop()
            if parent is not None:
                numbers[parent][3] = count - 1
            continue
        numbers[i] = [parent, place, count, None, depth]
        count += 1
        stack.append((i, depth + 1, iter(enumerate(sorted(below.get(i, [])), 1))))
    todo = [None]
    while todo:
        children = sorted(below.get(todo.pop(), []))
        looked += [i for _, i in children]
        todo += [i for _, i in reversed(children)]
    return numbers, looked


def test_tour_equals_a_walk(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", None if rng.random() < 0.03 or not i else f"n{rng.randrange(i)}", rng.choice("abcdef")) for i in range(150)]
    lost = [("c1", "c2", "x"), ("c2", "c1", "y"), ("c3", "c1", "y"), ("m", "missing", "x"), ("m2", "m", "x")]
    got = trees.visits(trees.tour(spark.createDataFrame(rows + lost, "id string, parent string, name string"))).collect()
    numbers, looked = walked(rows)
    assert {r["id"]: [r["parent"], r["place"], r["pre"], r["last"], r["depth"]] for r in got} == numbers
    assert [r["id"] for r in sorted(got, key=lambda r: r["visit"])] == looked
    assert trees.tour(spark.createDataFrame([], "id string, parent string, name string")).count() == 0


def test_tour_of_a_deep_chain(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("x").alias("name"))
    walk = trees.tour(chain)
    assert walk.where("pre <> id or depth <> id or place <> 1").count() == 0 and walk.where(f"last = {n - 1}").count() == n


def test_first_of_siblings_before_what_is_below(spark):
    rows = [("a", None, "a"), ("b", None, "b"), ("a1", "a", "x"), ("a11", "a1", "hit"), ("b1", "b", "hit"), ("a2", "a", "y"), ("c", None, "only")]
    nodes = spark.createDataFrame(rows, "id string, parent string, name string")
    walk = trees.tour(nodes)
    first = {r["name"]: r["id"] for r in trees.find_first(walk, nodes.select("name", "id"), "name").collect()}
    assert first["hit"] == "a11" and first["only"] == "c"  # a's subtree is opened before b's
    assert {r["id"] for r in trees.below(walk, "a").collect()} == {"a", "a1", "a11", "a2"}


def test_tree_file_round_trip(spark, tmp_path):
    rng = random.Random(4)
    wide = [("top", None, "t")] + [(f"w{i}", "top", f"{i:03d}") for i in range(300)]
    deep = [("d0", None, "d")] + [(f"d{i}", f"d{i - 1}", 'quote " and \\ ]}') for i in range(1, 120)]
    more = [(f"m{i}", None if not i else f"m{rng.randrange(i)}", rng.choice(["é", "b", ",{"])) for i in range(80)]
    for k, rows in enumerate((wide + deep + more, [("one", None, "x")], [])):
        nodes = spark.createDataFrame(rows, "id string, parent string, name string")
        path = tmp_path / f"tree{k}"
        sinks.write_tree(trees.tour(nodes), nodes, str(path))
        found = sources.read_tree_lines(spark, str(path)).collect()
        assert {(r["id"], r["parent"], r["name"]) for r in found} == set(rows)
        numbers, _ = walked(rows)
        assert {r["id"]: r["ordinal"] + 1 for r in found} == {i: x[1] for i, x in numbers.items()}
        whole = json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))
        assert len(whole) == sum(p is None for _, p, _ in rows)


def test_event_order_over_files_of_unequal_size(spark, tmp_path):
    log = [(f"/f{i}.md", i, f"id{i % 50}" if i % 7 else "TO_FILL", "md", "touched" if i % 3 else "created", i) for i in range(4000)]
    sinks.write_events(spark.createDataFrame(log, "filePath string, mtime long, id string, type string, event string, seq long").repartition(3), str(tmp_path / "e"))
    found = sources.read_events(spark, str(tmp_path / "e")).collect()
    assert [r["filePath"] for r in sorted(found, key=lambda r: r["seq"])] == [x[0] for x in log]
    (tmp_path / "odd").mkdir()
    head, at, rest = "filePath;mtime;id;type;event\n", 0, list(log)
    for name, n in (("a.csv", 3), ("b.csv", 2500), ("c.csv", 1), ("d.csv", 1496)):
        (tmp_path / "odd" / name).write_text(head + "".join(f"{x[0]};{x[1]};{x[2]};{x[3]};{x[4]}\n" for x in rest[at : at + n]))
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        split = sources.read_events(spark, str(tmp_path / "odd")).collect()
        appended = sources.read_events(spark, str(tmp_path / "odd"), append=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["filePath"] for r in sorted(split, key=lambda r: r["seq"])] == [x[0] for x in log]
    seen, want = set(), []
    for x in log:
        if x[2] != "TO_FILL" and (x[4] != "touched" or x[2] not in seen):
            want.append(x[0])
        seen |= {x[2]} - {"TO_FILL"}
    assert [r["filePath"] for r in sorted(appended, key=lambda r: r["seq"])] == want


def test_running_values_with_nulls_and_one_group(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, "a", "b"]), i, rng.choice([None, None, i])) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, i long, v long").repartition(4)
    got = {r["i"]: r for r in running_last(frame, ("g",), ("i",), {"before": F.col("v")}).collect()}
    own = {r["i"]: r for r in running_last(frame, ("g",), ("i",), {"upto": F.col("v")}, own=True).collect()}
    sums = {r["i"]: r for r in running_sums(frame, (), ("i",), {"n": F.lit(1), "s": F.col("v")}).collect()}
    last, total = {}, 0
    for g, i, v in rows:
        total += v or 0
        assert got[i]["before"] == last.get(g) and sums[i]["n"] == i + 1 and (sums[i]["s"] or 0) == total
        last[g] = v if v is not None else last.get(g)
        assert own[i]["upto"] == last[g]


def test_job_rules_step_by_step(spark):
    def outcomes(*calls):
        rows = [(1, i, op, kind, payload) for i, (op, kind, payload) in enumerate(calls)]
        found = events.job_schedule(spark.createDataFrame(rows, "drive long, at long, op string, type string, payload string"), "drive", "at").collect()
        return [r["outcome"] for r in sorted(found, key=lambda r: r["at"])]

    ask, start, end = (lambda kind, payload=None, op=op: (op, kind, payload) for op in ("schedule", "start", "finish"))
    assert outcomes(ask("sync", "a"), ask("sync", "a"), ask("sync", "b"), ask("sync_all"), ask("sync", "a"), ask("sync_all")) == ["replaced", "dropped", "replaced", "waiting", "dropped", "dropped"]
    assert outcomes(ask("sync", "a"), start("sync", "a"), ask("sync_all"), ask("sync", "a"), end("sync", "a"), start("sync_all"), end("sync_all"), ask("sync", "a")) == ["started", "started", "dropped", "waiting"]
    assert outcomes(ask("git_push"), ask("git_push", "other"), start("git_push"), ask("git_push"), end("git_push"), ask("git_push")) == ["started", "dropped", "dropped", "waiting"]
    assert outcomes(ask("run_action", "x"), ask("run_action", "x"), ask("sync_all"), ask("run_action", "x")) == ["replaced", "replaced", "waiting", "waiting"]
    assert outcomes(ask("sync", "a"), start("sync", "a"), ask("sync", "a"), ask("sync_all"), ask("git_push"), end("sync", "a"), end("sync_all"), ask("sync", "a")) == ["started", "dropped", "finished", "waiting", "waiting"]


def test_anchor_sweep_keeps_line_ends_and_hub_places(spark):
    hub = [(f"d{k}", f"see gdoc:hub#top {k}") for k in range(200)]
    docs = spark.createDataFrame([("hub", '<a id="top"></a>a\n <a id="x"></a>\nb <a id="y"></a> c<a id="z"></a>\n<a id="x"></a>'), ("none", None), ("empty", ""), *hub], "id string, text string")
    found = links.anchors(docs)
    swept = {r["id"]: (r["text"], r["n_dropped"]) for r in links.sweep_anchors(docs, found, links.unreferenced(found, links.place_links(docs))).collect()}
    assert swept["hub"] == ('<a id="top"></a>a\nb c\n', 4) and swept["none"] == (None, 0) and swept["empty"] == ("", 0) and swept["d7"] == ("see gdoc:hub#top 7", 0)


def test_yaml_blocks(spark):
    text = "# c\ntype: directory\nid: 'it''s'\nfileMap:\n  'a b.md':\n    id: \"x\\\"y\"\n    fileName: plain text # note\n    deep:\n      more: 1\n  plain.md:\n    id: ~\n\nother: z\n"
    docs = spark.createDataFrame([("a", text), ("b", "type: 'directory'\nfileMap:\n  q:\n    id: '1'\n"), ("c", None), ("d", ""), ("e", "type: directory\nid: e\n")], "k string, t string")
    rows = {(r["k"], ".".join(r["path"])): r["value"] for r in sources.yaml_rows(docs, "k", "t").collect()}
    assert rows["a", "fileMap.a b.md.deep.more"] == "1" and rows["a", "fileMap.plain.md.id"] is None and rows["a", "other"] == "z" and rows["a", "id"] == "it's"
    assert {tuple(r) for r in sources.stored_file_map(docs, "k", "t").collect()} == {("a", "a b.md", 'x"y', "plain text"), ("a", "plain.md", None, None)}


def test_traverse_skips_what_is_empty(spark):
    docs = spark.createDataFrame([(1, '{"a":[0,null,"",false,"false","0",{"c":"gdoc:x"}]}'), (2, "no json"), (3, None), (4, "[]"), (5, "7")], "k long, t string")
    rows = variants.traverse(docs, "k", F.col("t"))
    assert {(r["k"], r["path"], r["value"]) for r in rows.collect()} == {(1, "", None), (1, "a", None), (1, "a[4]", "false"), (1, "a[5]", "0"), (1, "a[6]", None), (1, "a[6].c", "gdoc:x"), (4, "", None), (5, "", "7")}
    assert variants.traverse(docs.limit(0), "k", F.col("t")).count() == 0


def test_list_numbers_reset_go_on_and_nest(spark):
    rows = [  # doc, at, style, level, opens, continues, number
        ("d", 1, "a", 1, True, False, 1), ("d", 2, "a", 2, True, False, 1), ("d", 3, "a", 2, False, False, 2), ("d", 4, "a", 1, False, False, 2), ("d", 5, "a", 2, True, False, 1),
        ("d", 6, "b", 1, True, False, 1), ("d", 7, "a", 1, True, True, 3), ("d", 8, "a", 2, True, True, 2), ("d", 9, "a", 1, True, False, 1), ("d", 10, "a", 2, False, False, 1),
        ("d", 11, "b", 1, False, None, 2), ("d", 12, None, 1, None, None, 1), ("e", 1, "a", 3, False, False, 1), ("e", 2, "a", None, False, False, None),
    ]
    items = spark.createDataFrame([r[:6] for r in rows], "doc string, at long, style string, level int, opens boolean, continues boolean")
    found = {(r["doc"], r["at"]): r["number"] for r in ordering.list_numbers(items, "doc", "at").collect()}
    assert found == {r[:2]: r[6] for r in rows}


def test_effective_properties_of_a_deep_chain_and_a_cycle(spark):
    rows = [(0, None, {"a": "0", "b": "0"})] + [(i, i - 1, {"a": str(i)} if i % 100 == 0 else {}) for i in range(1, 1000)] + [(2000, 2001, {"a": "x"}), (2001, 2000, {}), (2002, 2001, {}), (3000, None, None)]
    found = {r["id"]: r["props"] for r in trees.effective(spark.createDataFrame(rows, "id long, parent long, props map<string,string>")).collect()}
    assert set(found) == {*range(1000), 3000} and found[3000] == {}
    assert all(found[i] == {"a": str(i // 100 * 100), "b": "0"} for i in range(1000))


def test_collated_orders(spark):
    names = ["b", "Éa", "ea", "Eb", "éa", "Z", "a", None]
    files = spark.createDataFrame([(i, n, i % 2 == 0) for i, n in enumerate(names)], "k long, name string, folder boolean")
    placed = sorted(ordering.listing_order(files, (), F.col("folder"), "name", "k").collect(), key=lambda r: r["place"])
    assert [r["name"] for r in placed] == ["a", "b", "ea", "éa", None, "Éa", "Eb", "Z"]
    diff = spark.createDataFrame([("b.assets/x.png",), ("b.md",), ("B.md",), ("a.md",), ("b.assets/a.png",), ("é.md",), ("f.md",)], "path string")
    assert [r["path"] for r in sorted(ordering.diff_order(diff, "path").collect(), key=lambda r: r["place"])] == ["a.md", "b.md", "b.assets/a.png", "b.assets/x.png", "B.md", "é.md", "f.md"]


def test_stored_index_opens_only_the_files_of_a_range(spark, tmp_path):
    nodes = spark.createDataFrame([(f"/p{i}", f"id_{i}", f"alpha w{i:03d} {'zebra' if i % 10 == 0 else 'yak'}") for i in range(200)], "path string, id string, title string")
    index = TermIndex(spark, str(tmp_path / "index"), 100)
    index.add(nodes, "path", "id", "title")
    every = index.dictionary().count()
    assert every >= 8 and 1 <= len(index.files_for("w01", "w02")) <= 2 and len(index.files_for("zebra", None)) <= 2 and index.files_for("~", None) == []
    assert {r["ref"] for r in index.look_up("w01*").collect()} == {f"/p{i}" for i in range(10, 20)}
    assert {r["ref"] for r in index.look_up("zebra").collect()} == {f"/p{i}" for i in range(0, 200, 10)} and index.look_up("nothing").count() == 0
    index.add(spark.createDataFrame([("/p10", "id_10", "now other"), ("/new", None, "zebra")], "path string, id string, title string"), "path", "id", "title")
    want = {f"/p{i}" for i in range(0, 200, 10) if i != 10} | {"/new"}
    assert {r["ref"] for r in index.search("zebra").collect()} == want and len(index.segments()) == 2
    index.merge()
    assert {r["ref"] for r in index.search("zebra").collect()} == want and len(index.segments()) == 1 and index.look_up("w010").count() == 0
    assert index.search(": ").count() == 0 and TermIndex(spark, str(tmp_path / "none")).search("x").count() == 0


def test_active_calls_equal_a_fold(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), "k", rng.choice(["p", None]), at, rng.choice([None] + [at + rng.randint(0, 9)] * 30)) for at in sorted(rng.randint(0, 300) for _ in range(250))]
    want, until = [], {}
    for d, k, p, at, end in sorted(rows, key=lambda r: (r[3], r[4] is not None, r[4] or 0)):
        if (d, p) not in until or (until[d, p] is not None and at >= until[d, p]):
            until[d, p] = end
            want.append((d, k, p, at))
    frame = spark.createDataFrame(rows, "drive long, kind string, payload string, at long, ended long").repartition(3)
    assert sorted(map(tuple, events.active_dedupe(frame, "drive", "kind", "payload", "at", "ended").collect()), key=str) == sorted(want, key=str)
    assert events.active_dedupe(frame.limit(0), "drive", "kind", "payload", "at", "ended").count() == 0
