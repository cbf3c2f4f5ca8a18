import random

import pytest
from pyspark.sql import functions as F

from valuegrain.operators import contract, graph, order, record

NODE = "id string, node_type string, value_kind string, number_val double, date_val timestamp, duration_secs long, source_id long, line_number int, is_stale boolean, stale_reason string"


def frames(spark, edges, stale=(), ids=()):
    names = sorted({x for e in edges for x in e} | set(stale) | set(ids))
    nodes = spark.createDataFrame([(n, "ROOT", "NUMBER", 1.0, None, None, None, 1, n in stale, "X" if n in stale else None) for n in names], NODE)
    return nodes, spark.createDataFrame([(i, a, b, "EXPRESSION", "a") for i, (a, b) in enumerate(edges)], "edge_id long, parent_id string, child_id string, operation string, expression string")


def reached(edges, starts):
    out, todo = set(starts), list(starts)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_gc_and_reach_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 24
    edges = sorted({(f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(40)) if a < b})
    starts = [f"n{i:02d}" for i in rng.sample(range(n), 3)]
    nodes, e = frames(spark, edges, ids=[f"n{i:02d}" for i in range(n)])
    s = spark.createDataFrame([(x, "R") for x in starts], "id string, reason string")
    got = {r.id: r.stale_reason for r in graph.cascade(nodes, e, s).filter("is_stale").collect()}
    assert got == {x: "R" if x in starts else graph.STALE_PARENT for x in reached(edges, starts)}
    each = graph.reach(e, s.select(F.col("id").alias("root"), "id"))
    assert {(r.root, r.id) for r in each.collect()} == {(x, y) for x in starts for y in reached(edges, [x])}
    stale = {f"n{i:02d}" for i in rng.sample(range(n), 16)}
    own, e = frames(spark, edges, stale, [f"n{i:02d}" for i in range(n)])
    left, links = {f"n{i:02d}" for i in range(n)}, set(edges)
    while gone := {x for x in left & stale if not any(a == x for a, _ in links)}:
        left -= gone
        links = {(a, b) for a, b in links if b not in gone}
    kept, kept_edges, removed = graph.collect_garbage(own, e)
    assert {r.id for r in kept.collect()} == left and {(r.parent_id, r.child_id) for r in kept_edges.collect()} == links and removed.count() == n - len(left)


def test_cycles(spark):
    nodes, e = frames(spark, [("a", "b"), ("b", "c")])
    new = spark.createDataFrame([("c", "a"), ("d", "d"), ("a", "c"), ("c", "d")], "parent_id string, child_id string")
    good, bad = graph.reject_cycles(e, new)
    assert {tuple(r) for r in good.collect()} == {("c", "d")} and {tuple(r) for r in bad.collect()} == {("c", "a"), ("d", "d"), ("a", "c")}
    assert graph.is_acyclic(e).first().acyclic
    assert not graph.is_acyclic(frames(spark, [("a", "b"), ("b", "a")])[1]).first().acyclic


def test_lineage_is_cycle_safe_and_ordered(spark):
    nodes, e = frames(spark, [("a", "c"), ("b", "c"), ("c", "a")])
    rows = graph.lineage(nodes, e, spark.createDataFrame([("c",), ("nowhere",)], "id string")).orderBy("step").collect()
    assert [(r.id, r.depth, r.step, r.parents) for r in rows] == [("c", 0, 1, ["a", "b"]), ("a", 1, 2, ["c"]), ("b", 1, 3, [])]


def test_upserts_and_limits(spark):
    old = spark.createDataFrame([(7, "a", "b", "X", "e")], "edge_id long, parent_id string, child_id string, operation string, expression string")
    new = spark.createDataFrame([(9, "a", "b", "Y", None), (10, "c", "c", "Y", None)], old.schema)
    assert [tuple(r) for r in record.upsert_edges(old, new).collect()] == [(7, "a", "b", "Y", None)]
    caps = record.add_captures(spark.createDataFrame([], "node_id string, agent string"), spark.createDataFrame([("n", "claude"), ("n", "claude-code"), ("n", "?")], "node_id string, agent string"))
    assert [tuple(r) for r in caps.collect()] == [("n", "claude-code")]
    values = spark.createDataFrame([("p", i, 0) for i in range(5)], "file_path string, line int, occurrence int")
    assert {r.line: r.kept for r in record.within_limit(values, 2).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_empty_tables(spark):
    nodes, e = frames(spark, [("a", "b")])
    none = spark.createDataFrame([], "id string, reason string")
    assert graph.cascade(nodes, e, none).filter("is_stale").count() == 0
    assert graph.collect_garbage(nodes.limit(0), e.limit(0))[0].count() == 0 and graph.is_acyclic(e.limit(0)).first().acyclic
    assert graph.reject_cycles(e, e.limit(0).select("parent_id", "child_id"))[0].count() == 0
    assert nodes.filter(F.col("id").isNull()).count() == 0


def depths(pairs, start, most=10**9):
    out, depth, todo = {}, {start: 0}, [start]
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    for x in todo:
        for b in out.get(x, []) if depth[x] < most else []:
            if b not in depth:
                depth[b] = depth[x] + 1
                todo.append(b)
    return depth


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "parent_id string, child_id string")


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("concat('n', id) as parent_id", "concat('n', id + 1) as child_id")
    out = {r.id: r.depth for r in graph.reach(chain, spark.createDataFrame([("n0",)], "id string")).collect()}
    assert out == {f"n{i}": i for i in range(n + 1)}
    assert graph.is_acyclic(chain).first().acyclic
    closed = chain.unionByName(edges_of(spark, [("n9000", "n17")]))
    found = {r.id: r.component for r in contract.strong_components(closed).collect()}
    assert set(found) == {f"n{i}" for i in range(17, 9001)} and set(found.values()) == {min(found)}


def test_a_layered_graph_of_sixty_levels(spark):
    rng = random.Random(9)
    pairs = [(f"l{i}_{j}", f"l{i + 1}_{k}") for i in range(60) for j in range(30) for k in rng.sample(range(30), 3)]
    got = {r.id: r.depth for r in graph.reach(edges_of(spark, pairs), spark.createDataFrame([("l0_0",)], "id string")).collect()}
    assert got == depths(pairs, "l0_0")
    up = {r.id: r.depth for r in graph.reach(edges_of(spark, pairs), spark.createDataFrame([("l60_0",)], "id string"), down=False).collect()}
    assert up == depths([(b, a) for a, b in pairs], "l60_0")


@pytest.mark.parametrize("core", [0, 10**6])
def test_searches_beyond_the_levels(spark, monkeypatch, core):
    rng = random.Random(5)
    monkeypatch.setattr(graph, "LEVELS", 2)
    monkeypatch.setattr(graph, "TABLES", 2)
    monkeypatch.setattr(contract, "CORE", core)
    pairs = [(f"v{i}", f"v{i + 1}") for i in range(25)] + [(f"v{rng.randrange(26)}", f"v{rng.randrange(26)}") for _ in range(8)] + [("v20", f"w{i}") for i in range(40)] + [("x", "y"), ("y", "x"), ("y", "z")]
    e = edges_of(spark, pairs)
    assert {r.id: r.depth for r in graph.reach(e, spark.createDataFrame([("v0",)], "id string")).collect()} == depths(pairs, "v0")
    assert {r.id: r.depth for r in graph.reach(e, spark.createDataFrame([("v0",)], "id string"), max_depth=5).collect()} == depths(pairs, "v0", 5)
    many = graph.reach(e, spark.createDataFrame([("v0", "v0"), ("v7", "v7"), ("x", "x")], "root string, id string")).collect()
    assert {(r.root, r.id): r.depth for r in many} == {(s, i): d for s in ("v0", "v7", "x") for i, d in depths(pairs, s).items()} and len(many) == len({(r.root, r.id) for r in many})


@pytest.mark.parametrize("core", [0, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_cycles(spark, seed, core):
    rng = random.Random(seed)
    pairs = {(f"v{rng.randrange(30):02d}", f"v{rng.randrange(30):02d}") for _ in range(36)}
    pairs |= {(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)} | {("s", "s"), ("r0", "t0")} | {(f"t{i}", f"t{i + 1}") for i in range(9)} | {("t9", "r3")} if seed == 1 else {("q", "q0"), ("q0", "q1"), ("q1", "q")}
    pairs = sorted(pairs)
    nodes = sorted({x for p in pairs for x in p})
    down = {x: set(depths(pairs, x)) for x in nodes}
    want = {x: min(y for y in down[x] if x in down[y]) for x in nodes if any(x in down[y] and y in down[x] and (y != x or (x, x) in pairs) for y in nodes)}
    assert {r.id: r.component for r in contract.strong_components(edges_of(spark, pairs), core).collect()} == want


def test_kept_order_checks_a_band_only(spark, tmp_path):
    """A batch of a thousand edges at one end of a graph of 200 levels: the scan is asked for the levels of that end."""
    pairs = [(f"l{i:03d}_{j}", f"l{i + 1:03d}_{(j + k) % 10}") for i in range(200) for j in range(10) for k in (0, 3)]
    levels = spark.createDataFrame([(f"l{i:03d}_{j}", i) for i in range(201) for j in range(10)], "id string, level long")
    order.levelled(edges_of(spark, pairs), levels).sort("parent_level").write.option("parquet.block.size", 1 << 14).parquet(f"{tmp_path}/edges")
    stored = spark.read.parquet(f"{tmp_path}/edges")
    new = [(f"l{190 + i % 5:03d}_{i % 10}", f"new{i}") for i in range(990)] + [(f"l195_{j}", f"l194_{j}") for j in range(10)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = order.band(stored, 194, 195)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(parent_level,194)" in plan and "LessThanOrEqual(child_level,195)" in plan
    assert order.band(stored, 194, 195).count() == 20
    batch = order.admit(stored, levels, edges_of(spark, new))
    refused = {tuple(r) for r in batch.refused.collect()}
    assert refused == {(f"l195_{j}", f"l194_{j}") for j in range(10)}  # each l194 node leads to the l195 node of its number
    assert {r.id for r in batch.changed.collect()} == {f"new{i}" for i in range(990)}
    assert order.admit(stored, levels, edges_of(spark, [("l200_0", "fresh"), ("fresh", "l000_0"), ("a", "b")])).refused.count() == 2


def test_kept_order_over_batches_equals_the_whole_check(spark):
    rng = random.Random(3)
    edges, levels = order.ordered(edges_of(spark, [("a", "b"), ("b", "c"), ("k", "k")]))
    plain = {("a", "b"), ("b", "c")}
    for _ in range(3):
        new = [(x, y) for x, y in ((rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(6))]
        batch = order.admit(edges, levels, edges_of(spark, new))
        good, bad = graph.reject_cycles(edges_of(spark, sorted(plain)), edges_of(spark, new))
        assert sorted(map(tuple, batch.accepted.collect())) == sorted(map(tuple, good.collect())) and sorted(map(tuple, batch.refused.collect())) == sorted(map(tuple, bad.collect()))
        plain |= {tuple(r) for r in good.collect()}
        edges, levels = order.applied(edges, levels, batch)
        assert {(r.parent_id, r.child_id) for r in edges.collect()} == plain and edges.filter("parent_level >= child_level").count() == 0
    assert order.admit(edges, levels, edges_of(spark, [])).changed.count() == 0


def test_many_starts_as_bits(spark):
    """Three words of starts over shared ancestors, a cycle, a null root and repeated rows; depths, counts and what a level carries."""
    rng = random.Random(11)
    pairs = [(f"l{i}_{j:03d}", f"l{i + 1}_{k:03d}") for i in range(5) for j in range(150) for k in rng.sample(range(150), 2)] + [("l5_000", "l2_007"), ("l2_007", "l5_000")]
    roots = [f"l0_{j:03d}" for j in range(150)]
    e, want = edges_of(spark, pairs), {r: depths(pairs, r) for r in roots}
    out = graph.reach(e, spark.createDataFrame([(r, r) for r in roots + roots[:5]] + [(None, "l0_000")], "root string, id string")).collect()
    assert {(r.root, r.id): r.depth for r in out} == {(r, i): d for r, own in [*want.items(), (None, want["l0_000"])] for i, d in own.items()} and len(out) == sum(map(len, want.values())) + len(want["l0_000"])
    least = graph.reach(e, spark.createDataFrame([(r, r) for r in roots], "root string, id string"), max_depth=2).collect()
    assert {(r.root, r.id): r.depth for r in least} == {(r, i): d for r in roots for i, d in depths(pairs, r, 2).items()}
    counts = {r.id: r.n_starts for r in graph.start_counts(e, spark.createDataFrame([(r,) for r in roots], "id string")).collect()}
    assert counts == {i: sum(i in own for own in want.values()) for i in {i for own in want.values() for i in own}}
    from valuegrain.operators import bits

    steps = e.selectExpr("parent_id as _near", "child_id as _far").distinct()
    sets = bits.search(steps, spark.createDataFrame([(r, r) for r in roots], "root string, id string"), None)
    assert sets.found.count() * 4 < sum(map(len, want.values()))
    none = spark.createDataFrame([], "root string, id string")
    assert graph.reach(e, none).count() == 0 and graph.start_counts(e, none.select("id")).count() == 0


def test_start_counts_beyond_the_levels(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEVELS", 2)
    pairs = [(f"v{i}", f"v{i + 1}") for i in range(9)] + [("a", "v3"), ("v9", "v5")]
    got = {r.id: r.n_starts for r in graph.start_counts(edges_of(spark, pairs), spark.createDataFrame([("v0",), ("a",)], "id string")).collect()}
    want = [depths(pairs, s) for s in ("v0", "a")]
    assert got == {i: sum(i in d for d in want) for i in {*want[0], *want[1]}}


def test_shortcuts_and_loops_in_long_chains_contract(spark, monkeypatch):
    """What is left after chains are contracted is long too; it must not be searched edge by edge or peeled node by node."""
    n = 1500
    chain = [(f"k{i}", f"k{i + 1}") for i in range(n)] + [(f"k{i}", f"k{i + 10}") for i in range(0, n - 10, 10)]
    back = [(f"k{i + 12}", f"k{i + 6}") for i in range(0, n - 20, 20)] + [(f"k{i + 16}", f"k{i + 11}") for i in range(0, n - 20, 40)] + [("k7", "k7")]
    rounds = []
    plain = contract.stage
    monkeypatch.setattr(contract, "stage", lambda df, name, *more: rounds.append(name) or plain(df, name, *more))
    steps = edges_of(spark, chain).selectExpr("parent_id as _near", "child_id as _far")
    first = spark.createDataFrame([("k0", "k0", 0)], "root string, id string, depth int")
    assert {r.id: r.depth for r in contract.deep_reach(steps, first, core=0).collect()} == depths(chain, "k0")
    assert len(rounds) < 60
    rounds.clear()
    want = {}
    for i in range(0, n - 20, 20):
        own = [f"k{j}" for j in range(i + 6, i + (17 if i % 40 == 0 else 13))]
        want |= dict.fromkeys(own, min(own))
    assert {r.id: r.component for r in contract.strong_components(edges_of(spark, chain + back), 0).collect()} == want
    assert len(rounds) < 120


def test_fixture_graph_equals_its_views(spark):
    """Nodes and edges made from one pass over the lines are those of the views; kinds asked for alone are the same rows."""
    from valuegrain.plans import fixtures as fx

    folder = "/root/testdata/sf0.001"
    own = fx.Graph(spark, folder)
    made = {"fx_nodes": own.nodes().withColumn("date_secs", F.unix_seconds("date_val")), "fx_edges": own.edges()}
    for name, df in made.items():
        want = fx.view(spark, folder, name)
        cols = [c for c in want.columns if c != "number_val"]
        got = df.select(*[F.col(c).cast(want.schema[c].dataType) for c in cols])
        assert got.exceptAll(want.select(*cols)).isEmpty() and want.select(*cols).exceptAll(got).isEmpty()
    assert {x.split("#")[0] for x in own._known} == {"lines", "sums", "customers", "places", "nodes-OSPDTCNR", "edges-DTCNR"}
    assert own.nodes("D").exceptAll(own.nodes().filter("id like 'D:%'")).isEmpty() and own.nodes("D").count() == own.gaps().count()


def test_links_and_marked_nodes_are_made_without_a_staged_copy(spark):
    """Links have no order to sort for; seeds meet the roots only, so nodes without a source don't meet in one task; both equal the former ways."""
    from valuegrain.operators import export
    from valuegrain.plans import fixtures as fx

    folder = "/root/testdata/sf0.001"
    own = fx.Graph(spark, folder)
    links, marked = own.links(), fx.marked(spark, folder, own)
    assert not any(k.startswith(("nodes", "edges")) for k in own._known)
    assert "Window" not in links._jdf.queryExecution().toString()
    want = own.edges().select(links.columns)
    assert links.exceptAll(want).isEmpty() and want.exceptAll(links).isEmpty()
    seeds = fx.view(spark, folder, "fx_seeds").select(F.col("source_id").alias("_s"), "reason")
    joined = own.nodes().join(seeds, F.col("source_id") == F.col("_s"), "left").withColumns({"is_stale": F.col("_s").isNotNull(), "stale_reason": F.col("reason")}).select(marked.columns)
    assert marked.filter("is_stale").count() > 0 and marked.exceptAll(joined).isEmpty() and joined.exceptAll(marked).isEmpty()
    for kind in (export.as_text, export.as_mermaid, export.as_dot):
        whole, checked = kind(marked, links, whole=True), kind(marked, links)
        assert whole.exceptAll(checked).isEmpty() and checked.exceptAll(whole).isEmpty()


def test_a_search_keeps_nothing_of_its_steps(spark):
    """Edges are dealt out once for all levels of a search and let go afterwards."""
    from valuegrain.sources.staging import Scope

    nodes, edges = frames(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with Scope(spark) as scope:
        starts = spark.createDataFrame([("n0",), ("n3",)], "id string")
        assert graph.reach(edges, starts).count() == 7
        assert graph.reach(edges, starts.select(F.col("id").alias("root"), "id")).count() == 11
        assert graph.start_counts(edges, starts).count() == 7
        assert not any("table-steps-" in path for path in scope.made)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_exported_lines_name_nulls(spark):
    from valuegrain.operators import export

    nodes = spark.createDataFrame([("a", "ROOT", None, None, None, None, None, 1, False, None)], NODE)
    edges = spark.createDataFrame([("a", "b", None), ("lost", "b", "SUM")], "parent_id string, child_id string, operation string")
    lines = {r.line for r in export.as_dot(nodes, edges).collect()}
    assert lines == {"digraph Values {", '    "a" [label="null: null", color=black];', '    "a" -> "b" [label="null"];', "}"}


def shuffled(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_evidence_deals_a_node_out_once_for_its_edges_and_finds_unfit_parents(spark):
    from valuegrain.functions.values import duration_id
    from valuegrain.operators.export import evidence

    n, roots = 3000, [("d0", "DATE"), ("d1", "DATE"), ("x", "NUMBER")]
    pairs = spark.range(n).select("id", F.when(F.col("id") % 10 == 1, F.array(F.lit("d0"), F.lit("x"))).when(F.col("id") % 10 == 2, F.array(F.lit("d0"), F.lit("gone"))).otherwise(F.array(F.lit("d0"), F.lit("d1"))).alias("parents"))
    made = pairs.select(F.col("id").alias("k"), "parents", duration_id(F.col("parents"), F.lit("DATE_DIFF"), F.col("id")).alias("id")).cache()
    nodes = spark.createDataFrame([(i, "ROOT", k, None, None) for i, k in roots], "id string, node_type string, value_kind string, number_val double, duration_secs long").unionByName(
        made.select("id", F.lit("DERIVED").alias("node_type"), F.lit("DURATION").alias("value_kind"), F.lit(None).cast("double").alias("number_val"), F.col("k").alias("duration_secs"))
    )
    each = made.select("k", "id", F.posexplode("parents").alias("at", "parent_id"))
    operation = F.when((F.col("k") % 10 == 3) & (F.col("at") == 1), "DURATION_SUM").when((F.col("k") % 10 == 4) & (F.col("at") == 1), F.lit(None)).otherwise("DATE_DIFF")
    edges = each.select(F.col("at").cast("bigint").alias("edge_id"), "parent_id", F.col("id").alias("child_id"), operation.alias("operation"), F.lit(None).cast("string").alias("expression"))
    before = shuffled(spark)
    found = evidence(nodes, edges).join(made.select("k", F.col("id").alias("_i")).hint("broadcast"), F.col("id") == F.col("_i")).select("k", "supported").collect()
    dealt = shuffled(spark) - before
    assert len(found) == n and {r.k for r in found if r.supported} == {k for k in range(n) if k % 10 not in (1, 2, 3)}
    assert dealt < 3.5 * n, dealt  # nodes twice, their edges once; no row for each edge


@pytest.mark.parametrize("blocks", [1, 3, 100_000])
def test_stretches_are_spans_merged(spark, monkeypatch, blocks):
    monkeypatch.setattr(order, "BLOCKS", blocks)
    rng = random.Random(blocks)
    spans = [(a, a + rng.choice((0, 1, 4, 9))) for a in (rng.randrange(0, 400) for _ in range(60))]
    covered = sorted({(lo, hi) for lo, hi in spans})
    want = []
    for lo, hi in covered:
        if want and lo <= want[-1][1]:
            want[-1] = (want[-1][0], max(hi, want[-1][1]))
        else:
            want.append((lo, hi))
    low, high = min(lo for lo, _ in spans), max(hi for _, hi in spans)
    against = spark.createDataFrame([(hi, lo) for lo, hi in spans], "parent_level long, child_level long")
    parts = order.stretches(against, low, high)
    assert sorted(map(tuple, parts.collect())) == want
    pairs = [(x, y) for x in range(low - 3, high + 4, 2) for y in (x + 1, x + 3, x - 2)]
    edges = spark.createDataFrame([(f"p{x}", f"c{y}", x, y) for x, y in pairs], "parent_id string, child_id string, parent_level long, child_level long")
    got = sorted(map(tuple, order._inside(edges, parts, low, high).collect()))
    assert got == sorted((f"p{x}", f"c{y}") for x, y in pairs if any(lo <= x <= hi and lo <= y <= hi for lo, hi in want))


@pytest.mark.parametrize("few", [0, 1000])
def test_a_batch_all_over_the_order_is_not_searched(spark, monkeypatch, few):
    """Edges back all along a chain: only stretches are looked at, and those without a search if it wouldn't leave out much. Both ways judge as the whole check does."""
    searched, reach = [], order.reach
    monkeypatch.setattr(order, "reach", lambda *a: searched.append(a[0].count()) or reach(*a))
    monkeypatch.setattr(order, "FEW", few)
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)] + [(f"n{i:03d}", f"n{i + 20:03d}") for i in range(0, 180, 20)]
    levels = spark.createDataFrame([(f"n{i:03d}", i) for i in range(201)], "id string, level long")
    new = [(f"n{i + 9:03d}", f"n{i + 4:03d}") for i in range(0, 200, 20)] + [(f"n{i + 11:03d}", f"n{i + 8:03d}") for i in range(0, 200, 40)] + [("n050", "n050"), ("n003", "n190"), ("n020", "x")]
    batch = order.admit(order.levelled(edges_of(spark, chain), levels), levels, edges_of(spark, new))
    good, bad = graph.reject_cycles(edges_of(spark, chain), edges_of(spark, new))
    assert sorted(map(tuple, batch.accepted.collect())) == sorted(map(tuple, good.collect())) and sorted(map(tuple, batch.refused.collect())) == sorted(map(tuple, bad.collect()))
    assert len(searched) == (few == 0) and all(n < 100 for n in searched)


def test_loops_take_turns_by_their_length(spark, monkeypatch):
    staged, plain = [], contract.stage
    monkeypatch.setattr(contract, "stage", lambda df, name, *more: staged.append(name) or plain(df, name, *more))
    n, size = 900, 7
    pairs = [(f"k{i}_{j}", f"k{i}_{(j + 1) % size}") for i in range(n) for j in range(size)] + [(f"t{i}_{j}", f"k{i}_0" if j == 0 else f"t{i}_{j - 1}") for i in range(0, n, 100) for j in range(5)]
    climbed = contract.climb(spark.createDataFrame(pairs, "id string, up string"))
    assert len(staged) <= 7, staged
    rows = {r.id: r for r in climbed.looping.collect()}
    assert climbed.settled.isEmpty() and len(rows) == len(pairs) and {r.up[0] for r in rows.values()} == {"k"}
    assert all(rows[f"k{i}_{j}"].least == f"k{i}_0" for i in range(n) for j in range(size)) and {rows[f"k{i}_{j}"].up for i in range(n) for j in range(size)} == {f"k{i}_{j}" for i in range(n) for j in range(size)}
