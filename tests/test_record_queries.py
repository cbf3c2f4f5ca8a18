from __spark_entry__ import SMOKE_DIR
from valuegrain.plans import record_queries


def test_a_batch_reads_the_lines_once(spark, monkeypatch):
    """The old values and the batch's come from one staged pass over the lines, and no table is staged that isn't read."""
    seen, staged, view, stage = [], [], record_queries.fx.view, record_queries.stage
    monkeypatch.setattr(record_queries.fx, "view", lambda s, d, name: seen.append(name) or view(s, d, name))
    monkeypatch.setattr(record_queries, "stage", lambda df, name, *o: staged.append(name) or stage(df, name, *o))
    monkeypatch.setattr(record_queries.record, "record_batch", lambda nodes, edges, sources, captures, *_: (nodes, sources, captures))
    record_queries.q_record_batch(spark, SMOKE_DIR)
    assert seen.count("fx_lines") == 1 and staged == ["lines", "old", "recorded"]


def test_a_batch_deals_nodes_and_sources_out_few_times(spark):
    """Rows dealt out by the whole query, without broadcasts, as on large tables: each line and each source a few times, not at every step."""
    from test_graph import shuffled

    lines = spark.read.parquet(f"{SMOKE_DIR}/lineitem.parquet").count()
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    known = {n: spark.conf.get(n, None) for n in names}
    before = shuffled(spark)
    try:
        for n in names:
            spark.conf.set(n, "-1")
        assert record_queries.q_record_batch(spark, SMOKE_DIR).count() > 0
    finally:
        for n, v in known.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    dealt = (shuffled(spark) - before) / lines
    assert dealt < 12, dealt


def test_packed_fingerprints(spark):
    from pyspark.sql import functions as F

    from valuegrain.functions.values import packed_hex, unpacked_hex

    texts = ["ab" * 32, "AB", "abc", "", "h1", "zz", None, "é"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", packed_hex(F.col("x")).alias("p")).select("x", "p", unpacked_hex(F.col("p")).alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] and len({r.p and bytes(r.p) for r in rows}) == len(texts) and len(rows[0].p) == 33
