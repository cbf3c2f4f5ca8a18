import os

import pytest
from pyspark.sql import functions as F

from valuegrain.operators import detect, export, graph, record
from valuegrain.operators.extract import extract
from valuegrain.functions.text import absolute_path, relative_path
from valuegrain.sources import staging, store, tables
from valuegrain.streaming import capture

SOURCE = "source_id long, file_path string, mtime timestamp, file_size long, content_hash string, last_checked_at timestamp, identity string"


def test_record_again_keeps_what_is_still_there(spark):
    """500 stays fresh, 100 and what derives from it go stale, 200 is new."""
    docs = lambda text: extract(tables.texts(spark.createDataFrame([("f", text)], "p string, t string"), "p", "t"))

    def nodes(text, at):
        when = F.to_timestamp(F.lit(at))
        return record.roots_of(docs(text)).drop("file_path").withColumns({"source_id": F.lit(1).cast("bigint"), "is_stale": F.lit(False), "stale_reason": F.lit(None).cast("string"), "created_at": when, "updated_at": when})

    old, new, now = nodes("a,100\nb,500", "2020-01-01"), docs("a,200\nb,500"), F.to_timestamp(F.lit("2020-02-01"))
    hundred = old.filter("number_val = 100").first().id
    child = old.filter("number_val = 100").withColumns({"id": F.lit("child"), "node_type": F.lit("DERIVED"), "number_val": F.lit(200.5)})
    edges = spark.createDataFrame([(1, hundred, "child", "EXPRESSION", "a * 2")], "edge_id long, parent_id string, child_id string, operation string, expression string")
    row = lambda h, at: spark.createDataFrame([(1, "f", None, 1, h, at, None)], "source_id long, file_path string, mtime timestamp, file_size long, content_hash string, last_checked_at string, identity string").withColumn("last_checked_at", F.to_timestamp("last_checked_at"))
    caps = spark.createDataFrame([], "node_id string, agent string")
    out, sources, credited = record.record_batch(old.unionByName(child), edges, row("h1", "2020-01-01"), caps, new, row("h2", "2020-02-01"), now, spark.createDataFrame([("f", "codex")], "file_path string, agent string"))
    assert {(r.number_val, r.is_stale, r.stale_reason) for r in out.collect()} == {(100.0, True, graph.MODIFIED), (200.5, True, graph.STALE_PARENT), (500.0, False, None), (200.0, False, None)}
    assert sources.first().content_hash == "h2" and credited.count() == 2
    same, _, _ = record.record_batch(old.unionByName(child), edges, row("h1", "2020-01-01"), caps, new, row("h1", "2020-02-01"), now)
    assert same.filter("is_stale").count() == 0


def test_record_a_renamed_file(spark):
    """old.csv had 100 and 500 and is new.csv now, with 100 and 501: 100 stays fresh under both names, 500 goes stale, one source is left."""
    docs = lambda path, text: extract(tables.texts(spark.createDataFrame([(path, text)], "p string, t string"), "p", "t"))
    row = lambda i, path, h, at: spark.createDataFrame([(i, path, None, 1, h, at, "7:8")], SOURCE.replace("timestamp", "string")).withColumns({c: F.to_timestamp(c) for c in ("mtime", "last_checked_at")})
    empty = {k: spark.createDataFrame([], v) for k, v in capture.STORE.items()}
    at = lambda d: F.to_timestamp(F.lit(d))
    nodes, sources, _ = record.record_batch(empty["nodes"], empty["edges"], empty["sources"], empty["captures"], docs("old.csv", "a,100\nb,500"), row(1, "old.csv", "h1", "2020-01-01"), at("2020-01-01"))
    for new_id in (2, 1):  # a caller may also give the new path the id that it had
        out, kept, _ = record.record_batch(nodes, empty["edges"], sources, empty["captures"], docs("new.csv", "a,100\nb,501"), row(new_id, "new.csv", "h2", "2020-02-01"), at("2020-02-01"))
        assert [(r.source_id, r.file_path, r.content_hash) for r in kept.collect()] == [(new_id, "new.csv", "h2")]
        assert sorted((r.number_val, r.is_stale, r.source_id) for r in out.collect()) == [(100.0, False, new_id), (100.0, False, new_id), (500.0, True, new_id), (501.0, False, new_id)]


def test_disclosed_paths(spark):
    paths = ["<stdin>", "./a.csv", "a/./b.csv", ".", "/p/a.csv", "/p/../x", "../x", "/q/a", "/p"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", relative_path(F.col("p"), "/p").alias("r"), absolute_path(F.col("p"), "/p").alias("a"))
    assert {x.p: (x.r, x.a) for x in df.collect()} == {
        "<stdin>": (None, None), "./a.csv": ("a.csv", "/p/./a.csv"), "a/./b.csv": ("a/b.csv", "/p/a/./b.csv"), ".": (None, "/p/."), "/p/a.csv": ("a.csv", "/p/a.csv"), "/p/../x": (None, "/p/../x"),
        "../x": (None, "/p/../x"), "/q/a": (None, "/q/a"), "/p": (None, "/p"),
    }


def test_change_classes(spark):
    ts = "2020-01-01 00:00:00"
    rows = [(1, "same", ts, 1, "h", ts, "i"), (2, "gone", ts, 1, "h", ts, None), (3, "locked", ts, 1, "h", ts, None), (4, "touched", ts, 1, "h", ts, None), (5, "edited", ts, 1, "h", ts, None), (6, "old", ts, 1, "h", "2019-12-31 00:00:00", None), (7, "moved", ts, 1, "h", ts, "i"), (8, tables.VIRTUAL, ts, 1, "h", ts, None)]
    text = SOURCE.replace("timestamp", "string")
    stored = spark.createDataFrame(rows, text).withColumns({c: F.to_timestamp(c) for c in ("mtime", "last_checked_at")})
    now = F.to_timestamp(F.lit("2020-01-01 00:30:00"))
    current = spark.createDataFrame([("same", ts, 1, None, None), ("locked", ts, 1, None, "denied"), ("touched", "2020-01-02 00:00:00", 1, None, None), ("edited", ts, 2, None, None), ("old", ts, 1, None, None), ("moved", ts, 1, "j", None)], "file_path string, mtime string, file_size long, identity string, read_error string").withColumn("mtime", F.to_timestamp("mtime"))
    first = detect.suspects(stored, current, now)
    assert {r.file_path for r in first.filter("must_read").collect()} == {"touched", "edited", "old", "moved"}
    contents = spark.createDataFrame([(p, p) for p in ("same", "locked", "touched", "edited", "old")], "file_path string, content string")
    assert {r.file_path for r in detect.hash_suspects(first, contents).collect()} == {"touched", "edited", "old"}
    assert {r.file_path: r.status for r in detect.detect(stored.withColumn("content_hash", F.sha2(F.lit("touched"), 256)), current, contents, now).collect()}["touched"] == "VERIFIED_UNCHANGED"
    hashes = spark.createDataFrame([("touched", "h"), ("edited", "g"), ("old", "h"), ("same", "zzz")], "file_path string, content_hash string")
    got = {r.file_path: r.status for r in detect.classify(first, hashes).collect()}
    assert got == {"same": "UNCHANGED", "gone": "FILE_NOT_FOUND", "locked": "CHECK_FAILED", "touched": "VERIFIED_UNCHANGED", "edited": "CHANGED", "old": "VERIFIED_UNCHANGED", "moved": "CHECK_FAILED"}


def test_files_gate_and_snapshots(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x 1\n")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff\xfe")
    found = tables.files(spark, f"{tmp_path}/in")
    good, bad = tables.utf8_gate(found)
    assert [(r.file_size, r.content) for r in good.collect()] == [(4, "x 1\n")] and [r.status for r in bad.collect()] == ["UNSUPPORTED"]
    df = spark.range(3)
    tables.write_snapshot({"nodes": df, "edges": df.limit(1)}, f"{tmp_path}/store")
    tables.write_snapshot({"nodes": df.limit(2), "edges": df.limit(1)}, f"{tmp_path}/store")
    (tmp_path / "store" / "v-000000000009").mkdir()  # another writer was first
    with pytest.raises(Exception, match="(?i)exist"):
        monkeypatch.setattr(tables, "versions", lambda *_: [8])
        tables.write_snapshot({"nodes": df}, f"{tmp_path}/store")
    monkeypatch.undo()
    (tmp_path / "store" / "v-000000000009").rmdir()
    now = tables.read_snapshot(spark, f"{tmp_path}/store")
    assert set(now) == {"nodes", "edges"} and now["nodes"].count() == 2


def test_export_guards_and_text_file(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "ROOT", "NUMBER", 2.0, None, None, None, 1, True, "X"), ("a", "ROOT", "DURATION", None, None, 90, None, 2, False, None)], "id string, node_type string, value_kind string, number_val double, date_val timestamp, duration_secs long, source_id long, line_number int, is_stale boolean, stale_reason string")
    edges = spark.createDataFrame([(1, "a", "b", "EXPRESSION", "a")], "edge_id long, parent_id string, child_id string, operation string, expression string")
    lines = export.as_dot(nodes, edges)
    export.write_lines(lines, f"{tmp_path}/dot")
    assert [r.value for r in spark.read.text(f"{tmp_path}/dot").coalesce(1).collect()] == ["digraph Values {", '    "a" [label="DURATION: 1m 30s", color=black];', '    "a" -> "b" [label="EXPRESSION"];', '    "b" [label="NUMBER: 2", color=red];', "}"]
    value, edge = F.col("seq") == "", F.col("seq") != ""
    lines = lines.filter("section = 1")
    assert export.publish(lines, f"{tmp_path}/good", value, edge, export.Limits(2, 1, 1000)) == {"n_values": 2, "n_edges": 1, "n_bytes": sum(len(r.line) + 1 for r in lines.collect()), "refused": None}
    assert spark.read.text(f"{tmp_path}/good").count() == 3
    for limits, reason in ((export.Limits(values=1), "VALUES"), (export.Limits(edges=0), "EDGES"), (export.Limits(bytes=10), "BYTES")):
        assert export.publish(lines, f"{tmp_path}/bad", value, edge, limits)["refused"] == reason
    assert not [p.name for p in tmp_path.iterdir() if "bad" in p.name]
    with pytest.raises(Exception, match="(?i)exist"):
        export.publish(lines, f"{tmp_path}/good", value, edge, export.Limits())


def test_a_scope_leaves_what_it_keeps(spark, tmp_path):
    with staging.Scope(spark) as outer:
        with staging.Scope(spark) as inner:
            first = staging.stage(spark.range(3), "first")
            path = first.inputFiles()[0].removeprefix("file:").removeprefix("//")
            kept = inner.keep(first.withColumn("x", F.lit(1)))
            assert os.path.exists(path)
        assert not os.path.exists(path) and kept.count() == 3
        assert len(outer.made) == 1
    with pytest.raises(Exception):
        kept.count()


def store_of(spark, path, buckets=4):
    return store.Store(spark, f"{path}/set", {"rows": store.Table("k string, v long", ("k",), buckets), "more": store.Table("k string, n string", ("k", "n"), 2)})


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    own = store_of(spark, tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    assert own.read("rows").count() == 0
    own.commit({"rows": rows(*[(f"k{i}", i) for i in range(40)])}, batch=0)
    before = own.manifest()["tables"]["rows"]
    wrote = own.commit({"rows": rows(("k3", 300), ("new", 1))}, {"rows": spark.createDataFrame([("k4",)], "k string")}, batch=1)
    after = own.manifest()["tables"]["rows"]
    changed = {int(b) for b in after if after[b] != before.get(b)}
    assert changed == set(wrote["rows"]) and len(changed) <= 3 < len(after) + 1
    assert {r.k: r.v for r in own.read("rows").collect()} == {**{f"k{i}": i for i in range(40) if i != 4}, "k3": 300, "new": 1}
    assert {r.k: r.v for r in own.read("rows", 1).collect()} == {f"k{i}": i for i in range(40)}  # a reader of the version before
    assert own.commit({"rows": rows(("k3", 0))}, batch=1) == {} and own.read("rows").filter("v = 300").count() == 1  # tried again
    assert store_of(spark, tmp_path, 9).tables["rows"].buckets == 4  # the first version's


def test_old_versions_go_and_null_keys_stay_one(spark, tmp_path):
    own = store_of(spark, tmp_path)
    for i in range(6):
        own.commit({"more": spark.createDataFrame([(None, "x"), (f"k{i}", None), (f"k{i}", None)], "k string, n string")})
    assert own.versions() == [4, 5, 6]
    assert own.read("more").filter("k is null").count() == 1 and own.read("more").count() == 7
    folders = {p.name for p in (tmp_path / "set" / "more").iterdir() if any(p.iterdir())}
    assert folders == {f.split("/")[1] for v in own.versions() for f in own.manifest(v)["tables"]["more"].values()}
    own.commit({}, {"more": own.read("more").select("k", "n")})
    assert own.read("more").count() == 0


def test_turtle_in_order_and_counted_without_sorting_or_grouping_lines(spark):
    """Repeated rows and a parent named twice too; the plans move rows, not the lines they give."""
    from pyspark.sql import functions as F

    from valuegrain.operators import export

    nodes = spark.createDataFrame([(i, "ROOT", "NUMBER", v, None, None, 1, 2, False, None) for i, v in (("b", 1.0), ("a", 2.0), ("a", 3.0))], "id string, node_type string, value_kind string, number_val double, date_val timestamp, duration_secs long, source_id long, line_number int, is_stale boolean, stale_reason string")
    edges = spark.createDataFrame([(1, "a", "b", "EXPRESSION", "a"), (2, "a", "b", "EXPRESSION", "a")], "edge_id long, parent_id string, child_id string, operation string, expression string")
    sources = spark.createDataFrame([(1, "x.csv")], "source_id long, file_path string")
    captures = spark.createDataFrame([("a", "codex")], "node_id string, agent string")
    head, sections = export.turtle_sections("p", "/home", nodes, edges, sources, captures)
    plain = export.turtle("p", "/home", nodes, edges, sources, captures)
    want = {r.line: r["count"] for r in plain.groupBy("line").count().collect()}
    got = export.line_counts(head, sections).collect()
    assert {r.line: r.n for r in got} == want and len(got) == len(want) and max(want.values()) == 2
    one = nodes.filter("number_val <> 3.0")
    head, sections = export.turtle_sections("p", "/home", one, edges.limit(1), sources, captures)
    sorted_lines = [r.line for r in export.turtle("p", "/home", one, edges.limit(1), sources, captures).orderBy("section", "key", "seq").collect()]
    assert [r.line for r in export.in_order(head, sections).select("line").collect()] == sorted_lines
    rows = sections[1].rendered(sections[1].rows.orderBy(F.col("id")))._jdf.queryExecution().optimizedPlan().toString()
    assert rows.index("Generate") < rows.index("Sort")


MIXED = ["node_drv_" + "0a" * 16, "node_drv_" + "0b" * 16, "node_drv_0", "node_drv_", "f" * 32, "F" * 32, "é" + "1" * 32, "S:1:2", "a", "a!", "", "0" * 31, None]


def test_packed_ids_are_exact_and_short(spark):
    from valuegrain.functions.values import packed_id, unpacked_id

    rows = spark.createDataFrame([(x,) for x in MIXED], "x string").select("x", packed_id(F.col("x")).alias("p")).select("x", "p", unpacked_id(F.col("p")).alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] and len({bytes(r.p) for r in rows}) == len(MIXED)
    assert max(len(r.p) for r in rows if r.x and r.x.startswith("node_drv_")) == 26


def test_turtle_rows_are_dealt_out_narrow_and_counted_by_digests(spark, monkeypatch):
    """Order over ids of all kinds; no IRI and no row for each parent is sorted; digests that clash change no count."""
    from valuegrain.functions.values import duration_id

    ids = [x for x in MIXED if x]
    dates = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, n long")
    row = "id", "node_type", "value_kind", "number_val", "date_val", "duration_secs", "source_id", "line_number", "is_stale", "stale_reason"
    roots = dates.selectExpr("id", "'ROOT'", "'DATE'", "cast(null as double)", "timestamp_seconds(n)", "cast(null as bigint)", "cast(1 as bigint)", "1", "false", "cast(null as string)").toDF(*row)
    made = spark.range(30).withColumn("parents", F.array(F.lit(ids[0]), F.lit("a"))).withColumn("parents", F.when(F.col("id") == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("parents"))).withColumn("i", duration_id(F.col("parents"), F.lit("DATE_DIFF"), F.col("id")))
    derived = made.selectExpr("i", "'DERIVED'", "'DURATION'", "cast(null as double)", "cast(null as timestamp)", "id", "cast(null as bigint)", "cast(null as int)", "false", "cast(null as string)").toDF(*row)
    edges = made.select(F.posexplode("parents").alias("at", "parent_id"), F.col("i").alias("child_id")).select(F.col("at").cast("bigint").alias("edge_id"), "parent_id", "child_id", F.lit("DATE_DIFF").alias("operation"), F.lit(None).cast("string").alias("expression"))
    own = roots.unionByName(derived), edges, spark.createDataFrame([(1, "x.csv")], "source_id long, file_path string"), spark.createDataFrame([("a", "codex"), ("é" + "1" * 32, "codex")], "node_id string, agent string")
    plain = export.turtle("p", "/home", *own)
    head, sections = export.turtle_sections("p", "/home", *own)
    assert [r.line for r in export.in_order(head, sections).collect()] == [r.line for r in plain.orderBy("section", "key", "seq").collect()]
    usages = sections[4].sorted()
    assert usages.count() == 30 and set(usages.columns) == {"id", "parents"}
    assert all("_iri" not in c for s in sections for c in s.sorted().columns)
    want = {r.line: r["count"] for r in plain.groupBy("line").count().collect()}
    for digest in (F.xxhash64, lambda *_: F.lit(1)):
        monkeypatch.setattr(export.F, "xxhash64", digest)
        got = export.line_counts(head, sections).collect()
        assert {r.line: r.n for r in got} == want and len(got) == len(want) and max(want.values()) == 2


def test_turtle_queries_stage_a_row_for_each_order_only(spark, monkeypatch):
    from valuegrain.plans import graph_queries

    staged, stage = [], graph_queries.stage
    monkeypatch.setattr(graph_queries, "stage", lambda df, name, *o: staged.append(name) or stage(df, name, *o))
    graph_queries._identified(spark, "/root/testdata/sf0.001")
    assert staged == ["orders", "lines"]
