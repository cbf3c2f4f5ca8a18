"""Queries on recording, sources, change detection, attributions and events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.functions.text import command_path
from valuegrain.functions.values import number_text, root_id
from valuegrain.operators import detect, graph, record
from valuegrain.plans import fixtures as fx
from valuegrain.plans.registry import query, sql_digest, sql_number
from valuegrain.sources import tables
from valuegrain.sources.staging import PACKED, prepared, shared_dir, stage
from valuegrain.streaming import capture, events

T0, T1 = "2020-01-01 00:00:00", "2020-02-01 00:00:00"


def _str(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _root_sql(price: str) -> str:
    return sql_digest("node_raw_", "'orders/' || k || '.csv'", "CAST(n + 1 AS VARCHAR)", "'0'", "'NUMBER'", sql_number(price))


#: Version 2 of an order's file has other prices where k % 5 = 0; files with k % 7 = 0 aren't recorded again.
NEW_PRICE = "CASE WHEN k % 5 = 0 AND n % 2 = 0 THEN price + 1 ELSE price END"
SUMS = f"old_roots AS (SELECT k, n, {_root_sql('price')} AS id FROM fx_lines), new_roots AS (SELECT k, n, {_root_sql(NEW_PRICE)} AS id FROM fx_lines WHERE k % 7 <> 0)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(fx.view(spark, sf_dir, "fx_lines").select("k", "n", "price"), "lines", PACKED)


def _versions(own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old nodes, new nodes, edges) of the lines: price values of two versions, and one derived node for each order that has a first line."""
    new_price = F.when((F.col("k") % 5 == 0) & (F.col("n") % 2 == 0), F.col("price") + 1).otherwise(F.col("price"))

    def roots(df: DataFrame, price: Column, at: str) -> DataFrame:
        when = F.to_timestamp(F.lit(at))
        return df.select(
            root_id(_str("orders/", F.col("k"), ".csv"), F.col("n") + 1, F.lit(0), F.lit("NUMBER"), number_text(price)).alias("id"), F.lit("ROOT").alias("node_type"), F.lit("NUMBER").alias("value_kind"), price.alias("number_val"),
            F.lit(None).cast("timestamp").alias("date_val"), F.lit(None).cast("bigint").alias("duration_secs"), F.col("k").alias("source_id"), (F.col("n") + 1).cast("int").alias("line_number"), F.lit(False).alias("is_stale"),
            F.lit(None).cast("string").alias("stale_reason"), when.alias("created_at"), when.alias("updated_at"),
        )

    # ids take four times the room of all else in a row, so they are made whenever they are read
    old, new = roots(stage(own.select("k", "n", "price"), "old", PACKED), F.col("price"), T0), roots(own.filter("k % 7 <> 0"), new_price, T1)
    child = old.filter("line_number = 3").select(F.lit(1).cast("bigint").alias("edge_id"), F.col("id").alias("parent_id"), _str("E:", F.col("source_id")).alias("child_id"), F.lit("EXPRESSION").alias("operation"), F.lit("a").alias("expression"))
    derived = child.select(F.col("child_id").alias("id")).distinct().select(
        "id", F.lit("DERIVED").alias("node_type"), F.lit("NUMBER").alias("value_kind"), F.lit(1.0).alias("number_val"), F.lit(None).cast("timestamp").alias("date_val"), F.lit(None).cast("bigint").alias("duration_secs"), F.lit(None).cast("bigint").alias("source_id"),
        F.lit(None).cast("int").alias("line_number"), F.lit(False).alias("is_stale"), F.lit(None).cast("string").alias("stale_reason"), F.to_timestamp(F.lit(T0)).alias("created_at"), F.to_timestamp(F.lit(T0)).alias("updated_at"),
    )
    return old.unionByName(derived), new, child


@query(fx.ctes(SUMS) + "SELECT id FROM old_roots WHERE k % 7 <> 0 AND k % 5 = 0 AND id NOT IN (SELECT id FROM new_roots)")
def q_record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _ = _versions(_lines(spark, sf_dir))
    changed = fx.view(spark, sf_dir, "fx_sources").filter("source_id % 5 = 0 and source_id % 7 <> 0").select("source_id")
    return record.vanished(old, new.select("id"), changed).select("id")


@query(fx.ctes(SUMS) + f"""SELECT id, CASE WHEN max(v) = 1 THEN '{T1[:10]}' ELSE '{T0[:10]}' END AS updated, CASE WHEN min(v) = 0 THEN '{T0[:10]}' ELSE '{T1[:10]}' END AS created
FROM (SELECT id, 0 AS v FROM old_roots UNION ALL SELECT id, 1 FROM new_roots) GROUP BY id""")
def q_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, _ = _versions(_lines(spark, sf_dir))
    out = record.upsert_nodes(old.filter("node_type = 'ROOT'"), new)
    return out.select("id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"), F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(fx.ctes() + """SELECT parent_id, child_id, CASE WHEN child_id LIKE 'D:%' AND parent_id LIKE 'O:%' AND CAST(substr(parent_id, 3) AS BIGINT) % 3 = 0 THEN 'RENAMED' ELSE operation END AS operation, edge_id FROM fx_edges""")
def q_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fx.edges(spark, sf_dir)
    again = edges.filter(F.col("parent_id").startswith("O:") & (F.substring("parent_id", 3, 20).try_cast("bigint") % 3 == 0)).withColumns({"edge_id": F.col("edge_id") + 1000, "operation": F.lit("RENAMED")})
    loops = edges.filter("child_id like 'C:%'").withColumn("parent_id", F.col("child_id"))
    return record.upsert_edges(edges, again.unionByName(loops)).select("parent_id", "child_id", "operation", F.col("edge_id").cast("bigint").alias("edge_id"))


@query(fx.ctes("""aliased AS (SELECT source_id, source_id % 1000 AS identity, checked FROM fx_sources)""", "survivors AS (SELECT identity, arg_max(source_id, (checked, source_id)) AS survivor FROM aliased WHERE identity <> 0 GROUP BY identity)")
    + "SELECT n.id, CAST(coalesce(v.survivor, n.source_id) AS VARCHAR) AS source_id FROM fx_nodes n LEFT JOIN aliased a ON n.source_id = a.source_id LEFT JOIN survivors v ON a.identity = v.identity")
def q_alias_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.sources(spark, sf_dir).withColumn("identity", F.when(F.col("source_id") % 1000 == 0, "0:0").otherwise((F.col("source_id") % 1000).cast("string")))
    moved, _ = record.rekey_aliases(fx.nodes(spark, sf_dir), own)
    return moved.select("id", F.col("source_id").cast("string").alias("source_id"))


#: k % 11: 0 gone, 1 unreadable, 2 other time and content, 3 other time and same content, 4 other size; the rest as before, checked long ago if k % 11 = 5.
STATUS = "CASE source_id % 11 WHEN 0 THEN 'FILE_NOT_FOUND' WHEN 1 THEN 'CHECK_FAILED' WHEN 2 THEN 'CHANGED' WHEN 3 THEN 'VERIFIED_UNCHANGED' WHEN 4 THEN 'CHANGED' WHEN 5 THEN 'VERIFIED_UNCHANGED' ELSE 'UNCHANGED' END"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    m, now = F.col("source_id") % 11, F.to_timestamp(F.lit(T1))
    stored = fx.sources(spark, sf_dir).withColumn("last_checked_at", F.when(m == 5, now - F.expr("interval 2 hours")).otherwise(now - F.expr("interval 1 minute")))
    current = stored.filter(m != 0).select(
        "file_path", F.when(m.isin(2, 3), F.col("mtime") + F.expr("interval 1 second")).otherwise(F.col("mtime")).alias("mtime"), F.when(m == 4, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"),
        F.when(m == 6, F.lit(None).cast("string")).otherwise(F.col("identity")).alias("identity"), F.when(m == 1, "permission denied").alias("read_error"),
    )
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    same = F.concat("o_orderstatus", seconds.cast("string"))
    contents = tables.table(spark, sf_dir, "orders").select(_str("orders/", F.col("o_orderkey"), ".csv").alias("file_path"), F.when((F.col("o_orderkey") % 11).isin(2, 4), F.concat(same, F.lit("\n"))).otherwise(same).alias("content"))
    virtual = stored.limit(1).withColumns({"file_path": F.lit(tables.VIRTUAL), "source_id": F.lit(-1).cast("bigint")})
    return stored.unionByName(virtual), current, contents, now


@query(fx.ctes() + f"SELECT source_id, {STATUS} AS status FROM fx_sources")
def q_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, current, contents, now = _snapshots(spark, sf_dir)
    return detect.detect(stored, current, contents, now).select("source_id", "status")


@query(fx.ctes(f"verdicts AS (SELECT source_id, {STATUS} AS status FROM fx_sources)", "starts AS (SELECT id, CASE WHEN status = 'CHANGED' THEN 'SOURCE_FILE_MODIFIED' ELSE 'FILE_DELETED' END AS reason FROM fx_nodes n JOIN verdicts v ON n.source_id = v.source_id WHERE status IN ('CHANGED', 'FILE_NOT_FOUND'))",
    "reached AS (SELECT id FROM starts UNION SELECT e.child_id FROM reached r JOIN fx_edges e ON e.parent_id = r.id)")
    + """SELECT 'node' AS kind, r.id, coalesce(s.reason, 'PARENT_NODE_STALE') AS state FROM reached r LEFT JOIN starts s ON r.id = s.id
UNION ALL SELECT 'source', CAST(source_id AS VARCHAR), CASE WHEN status = 'CHECK_FAILED' THEN 'touched' ELSE 'refreshed' END FROM verdicts WHERE status IN ('CHANGED', 'VERIFIED_UNCHANGED', 'CHECK_FAILED')""")
def q_sync_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, current, contents, now = _snapshots(spark, sf_dir)
    verdicts = stage(detect.detect(stored, current, contents, now), "verdicts")
    known = fx.Graph(spark, sf_dir)
    nodes, own = detect.sync(known.nodes(), known.edges(), stored, verdicts, current, now)
    checked = own.filter(F.col("last_checked_at") == now).join(verdicts.select("source_id", "status"), "source_id")
    state = F.when(F.col("status") == "CHECK_FAILED", "touched").otherwise("refreshed")
    return nodes.filter("is_stale").select(F.lit("node").alias("kind"), "id", F.col("stale_reason").alias("state")).unionByName(checked.select(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("id"), state.alias("state")))


#: Files recorded again under another path; their rows come with new ids.
RENAMED, NEW_ID = "k % 11 = 3", 1_000_000_000
_MOVED_ROOT = _root_sql(f"({NEW_PRICE})").replace("'orders/'", "'moved/'")


@query(fx.ctes(SUMS, "gone AS (SELECT id FROM old_roots WHERE k % 7 <> 0 AND k % 5 = 0 AND id NOT IN (SELECT id FROM new_roots))", f"moved_roots AS (SELECT k, n, {_MOVED_ROOT} AS id FROM fx_lines WHERE k % 7 <> 0 AND {RENAMED})")
    + f"""SELECT 'stale' AS kind, id, 'SOURCE_FILE_MODIFIED' AS state FROM gone WHERE id NOT IN (SELECT id FROM moved_roots) UNION SELECT 'stale', 'E:' || k, 'PARENT_NODE_STALE' FROM old_roots WHERE n = 2 AND id IN (SELECT id FROM gone)
UNION SELECT 'source', CASE WHEN k % 7 <> 0 AND {RENAMED} THEN 'moved/' ELSE 'orders/' END || k || '.csv', CAST(CASE WHEN k % 7 <> 0 AND {RENAMED} THEN k + {NEW_ID} ELSE k END AS VARCHAR) FROM (SELECT source_id AS k FROM fx_sources)
UNION SELECT 'rekeyed', id, CAST(k + {NEW_ID} AS VARCHAR) FROM old_roots WHERE k % 7 <> 0 AND {RENAMED} UNION SELECT 'rekeyed', id, CAST(k + {NEW_ID} AS VARCHAR) FROM moved_roots""")
def q_record_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes stale, the sources afterwards, and the nodes that have another source than before; a ninth of the files is renamed."""
    priced = _lines(spark, sf_dir)
    old, _, edges = _versions(priced)
    stored = fx.sources(spark, sf_dir)
    renamed = F.col("k") % 11 == 3
    path = _str(F.when(renamed, "moved/").otherwise("orders/"), F.col("k"), ".csv")
    again = stored.filter("source_id % 7 <> 0").withColumn("k", F.col("source_id")).withColumns({
        "file_path": path, "source_id": F.when(renamed, F.col("k") + NEW_ID).otherwise(F.col("k")),
        "content_hash": F.when(F.col("k") % 5 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")), "last_checked_at": F.to_timestamp(F.lit(T1)),
    }).drop("k")
    lines = priced.filter("k % 7 <> 0")
    price = F.when((F.col("k") % 5 == 0) & (F.col("n") % 2 == 0), F.col("price") + 1).otherwise(F.col("price"))
    values = lines.select(path.alias("file_path"), (F.col("n") + 1).cast("int").alias("line"), F.lit(0).alias("occurrence"), F.lit("NUMBER").alias("value_kind"), price.alias("number_val"), F.lit(None).cast("timestamp").alias("date_val"))
    none = spark.createDataFrame([], "node_id string, agent string")
    agents = again.select("file_path", F.lit("codex").alias("agent"))
    nodes, sources, _ = record.record_batch(old, edges, stored, none, values, again, F.to_timestamp(F.lit(T1)), agents)
    nodes = stage(nodes.select("id", "is_stale", "stale_reason", "source_id").filter(F.col("is_stale") | (F.col("source_id") >= NEW_ID)), "recorded", PACKED)
    return (
        nodes.filter("is_stale").select(F.lit("stale").alias("kind"), "id", F.col("stale_reason").alias("state"))
        .unionByName(sources.select(F.lit("source").alias("kind"), F.col("file_path").alias("id"), F.col("source_id").cast("string").alias("state")))
        .unionByName(nodes.filter(F.col("source_id") >= NEW_ID).select(F.lit("rekeyed").alias("kind"), "id", F.col("source_id").cast("string").alias("state")))
    )


FAULTS = ("TYPED_COLUMN", "NODE_TYPE", "LINE_NUMBER", "DERIVED_SOURCE", "NO_SOURCE")


@query(fx.ctes() + """, n AS (SELECT id, source_id AS s FROM fx_nodes WHERE id LIKE 'O:%')
SELECT id, 'TYPED_COLUMN' AS fault FROM n WHERE s % 50 = 0 UNION ALL SELECT id, 'NODE_TYPE' FROM n WHERE s % 50 = 1 UNION ALL SELECT id, 'LINE_NUMBER' FROM n WHERE s % 50 = 2
UNION ALL SELECT id, 'DERIVED_SOURCE' FROM n WHERE s % 50 = 3 UNION ALL SELECT id, 'NO_SOURCE' FROM n WHERE s % 50 = 4
UNION ALL SELECT child_id, 'NO_PARENT' FROM fx_edges WHERE parent_id LIKE 'O:%' AND CAST(substr(parent_id, 3) AS BIGINT) % 50 = 5
UNION ALL SELECT CAST('O:' || s AS VARCHAR), 'NO_VALUE' FROM n WHERE s % 50 = 5""")
def q_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.coalesce(F.when(F.col("id").startswith("O:"), F.col("source_id") % 50), F.lit(-1))
    own = fx.nodes(spark, sf_dir).filter(m != 5).withColumns({
        "number_val": F.when(m == 0, 1.0).otherwise(F.col("number_val")), "node_type": F.when(m == 1, "OTHER").when(m == 3, "DERIVED").otherwise(F.col("node_type")),
        "line_number": F.when(m == 2, 0).otherwise(F.col("line_number")), "source_id": F.when(m == 4, -F.col("source_id") - 1).otherwise(F.col("source_id")),
    })
    own = stage(own, "faulty")
    captures = fx.view(spark, sf_dir, "fx_sources").filter("source_id % 50 = 5").select(_str("O:", F.col("source_id")).alias("node_id"), F.lit("codex").alias("agent"))
    return record.integrity(own).unionByName(record.dangling(own, fx.edges(spark, sf_dir), fx.sources(spark, sf_dir), captures))


# Sources


@query("""SELECT 'documents/' || doc_id AS file_path, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS file_size, CASE doc_id % 4 WHEN 0 THEN 'eu' WHEN 1 THEN 'us' ELSE 'auto' END AS number_format FROM documents""")
def q_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepared(spark) and tables.table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 4
    form = tables.number_format(F.when(m == 0, "EU").when(m == 2, "none"), F.when(m == 1, "us"))
    return tables.texts(own, F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), "text", form).drop("content")


@query("SELECT doc_id, doc_id % 9 <> 0 AS valid, CASE WHEN doc_id % 9 <> 0 THEN length(text) ELSE 0 END AS n_chars FROM documents")
def q_utf8_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepared(spark) and tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C328FF")))).otherwise(F.col("text").cast("binary")).alias("content"))
    good, bad = tables.utf8_gate(own)
    return good.select("doc_id", F.lit(True).alias("valid"), F.char_length("content").cast("bigint").alias("n_chars")).unionByName(bad.select("doc_id", F.lit(False).alias("valid"), F.lit(0).cast("bigint").alias("n_chars")))


@query()
def q_file_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.files(prepared(spark), sf_dir, "*.parquet").select(F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_size", "mtime")


# Events

DIALECTS = ("claude-code", "codex", "cursor", "windsurf", "copilot", "gemini", "opencode", "vibe", "pi", "hermes", "claude_code", "nobody", "gemini-cli")
_PATH, _CONTENT = "'/data/' || user_id || '.csv'", "'value,' || event_id"
AGENT = f"list_extract([{', '.join(repr(d) for d in DIALECTS)}], CAST(user_id % 13 AS INT) + 1)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as completed-read events: agents in turn, errors failed, sign-ups before the read."""
    own = prepared(spark) and tables.table(spark, sf_dir, "events")
    agent = F.element_at(F.array(*[F.lit(d) for d in DIALECTS]), (F.col("user_id") % 13 + 1).cast("int"))
    path, content = _str("/data/", F.col("user_id"), ".csv"), _str("value,", F.col("event_id"))
    before, failed = F.col("event_type") == "signup", F.col("event_type") == "error"
    name = F.when(before, "PreToolUse").otherwise("PostToolUse")
    flags = F.when(failed, ',"success":false').otherwise("")
    read = F.concat(F.lit('{"hook_event_name":"'), name, F.lit('","tool_name":"Read","tool_input":{"file_path":"'), path, F.lit('"},"tool_response":{"file":{"content":"'), content, F.lit('"}}'), flags, F.lit("}"))
    shell = F.concat(F.lit('{"event":"'), name, F.lit('","toolName":"exec","tool_input":{"command":"head -n 3 '), path, F.lit('"},"tool_response":{"stdout":"'), content, F.lit('"}'), flags, F.lit("}"))
    seen = F.concat(F.lit('{"agent_action_name":"post_read_code","tool_info":{"file_path":"'), path, F.lit('"}'), flags, F.lit("}"))
    args = F.concat(F.lit('{"event":"'), name, F.lit('","toolArgs":"{\\"path\\":\\"'), path, F.lit('\\"}"'), flags, F.lit("}"))
    native = F.concat(F.lit('{"event":"tool.execute.after","tool":"read","args":{"filePath":"'), path, F.lit('"},"result":{"output":"x","metadata":{"truncated":false,"display":{"truncated":false,"type":"file","path":"'), path, F.lit('","text":"'), content, F.lit('","lineStart":1,"lineEnd":1,"totalLines":1}}}'), flags, F.lit("}"))
    payload = (
        F.when(F.col("event_id") % 29 == 0, "{broken").when(agent == "windsurf", seen).when(agent == "copilot", args).when(agent == "opencode", native).when(agent.isin("codex", "gemini", "vibe", "pi", "hermes", "gemini-cli"), shell)
        .otherwise(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("﻿"), read)).otherwise(read))
    )
    return own.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", record.canonical_agent(agent).alias("agent"), agent.alias("named"), payload.alias("payload")).filter("named <> 'nobody'")


_KNOWN = f"""ev AS (SELECT *, {AGENT} AS named FROM events), own AS (SELECT *, CASE named WHEN 'claude_code' THEN 'claude-code' WHEN 'gemini-cli' THEN 'gemini' ELSE named END AS agent, event_id % 29 = 0 AS broken FROM ev WHERE named <> 'nobody')"""
_PHASE = "CASE WHEN agent IN ('windsurf', 'opencode') AND NOT (agent = 'opencode' AND event_type = 'error') THEN 'After' WHEN agent = 'opencode' THEN 'After' WHEN event_type = 'signup' THEN 'Before' ELSE 'After' END"
_HAS = "agent NOT IN ('windsurf', 'copilot') AND NOT (agent = 'opencode' AND event_type = 'error')"
_NORMAL = f"""normal AS (SELECT event_id, agent, user_id, event_type, broken,
    CASE WHEN NOT broken AND NOT (agent = 'opencode' AND event_type = 'error') THEN {_PATH} END AS path, CASE WHEN NOT broken AND {_HAS} THEN {_CONTENT} END AS content,
    CASE WHEN NOT broken THEN {_PHASE} END AS phase,
    CASE WHEN broken THEN NULL WHEN event_type = 'error' THEN 'Failed' WHEN {_HAS} THEN 'CompletedResult' WHEN agent = 'windsurf' THEN 'ExplicitSuccess' ELSE 'Unknown' END AS outcome,
    CASE WHEN NOT broken THEN event_type <> 'error' AND agent IN ('claude-code', 'codex', 'opencode') END AS complete FROM own)"""


@query(f"WITH {_KNOWN}, {_NORMAL} SELECT event_id, agent, path, content, phase, outcome, complete FROM normal")
def q_event_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalise(_events(spark, sf_dir)).select("event_id", "agent", "path", "content", "phase", "outcome", "complete")


@query(f"WITH {_KNOWN}, {_NORMAL} SELECT event_id, coalesce(phase = 'After' AND outcome IN ('CompletedResult', 'ExplicitSuccess') AND complete AND content IS NOT NULL, false) AS eligible FROM normal")
def q_event_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.normalise(_events(spark, sf_dir)).select("event_id", events.eligible().alias("eligible"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path's file as its last event saw it, some with a last line feed."""
    own = tables.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("e"))
    return own.select(_str("/data/", F.col("user_id"), ".csv").alias("file_path"), F.sha2(F.concat(F.lit("value,"), F.col("e").cast("string"), F.when(F.col("user_id") % 2 == 0, "\n").otherwise("")), 256).alias("content_hash"))


@query(f"WITH {_KNOWN}, {_NORMAL}, top AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY user_id) SELECT event_id, content IS NOT NULL AND event_id = e AS matches FROM normal JOIN top USING (user_id)")
def q_event_snapshot_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.snapshot_matches(events.normalise(_events(spark, sf_dir)), _stored(spark, sf_dir)).select("event_id", "matches")


@query(f"WITH {_KNOWN} SELECT DISTINCT 'O:' || user_id AS node_id, agent FROM own")
def q_capture_assoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).select(_str("O:", F.col("user_id")).alias("node_id"), F.col("named").alias("agent"))
    none = spark.createDataFrame([], "node_id string, agent string")
    wrong = own.withColumn("agent", F.lit("nobody"))
    return record.add_captures(none, own.unionByName(wrong))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'a/' || user_id WHEN 1 THEN 'b' || event_id WHEN 2 THEN NULL WHEN 3 THEN 'q' || user_id || '.py' WHEN 4 THEN 'z' WHEN 5 THEN NULL WHEN 6 THEN 'n' || event_id ELSE NULL END AS path FROM events""")
def q_command_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepared(spark) and tables.table(spark, sf_dir, "events")
    m, e, u = F.col("event_id") % 8, F.col("event_id"), F.col("user_id")
    command = (
        F.when(m == 0, _str("cat  a/", u)).when(m == 1, _str("head -n 3 b", e, " other")).when(m == 2, _str("git status ", u)).when(m == 3, _str("python3 -u 'q", u, ".py' --x 1"))
        .when(m == 4, _str("grep -r needle y z")).when(m == 5, "rtk ls x").when(m == 6, _str('rtk read -5 "n', e, '"')).otherwise("")
    )
    return own.select("event_id", command_path(command).alias("path"))


_VALUE_ID = sql_digest("node_raw_", _PATH, "'1'", "'0'", "'NUMBER'", "CAST(event_id AS VARCHAR)")


_STREAMED = f"""WITH {_KNOWN}, {_NORMAL}, top AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY user_id),
    good AS (SELECT n.*, {_VALUE_ID} AS id FROM normal n JOIN top USING (user_id) WHERE event_id = e AND content IS NOT NULL AND phase = 'After' AND outcome IN ('CompletedResult', 'ExplicitSuccess') AND complete)
SELECT 'value' AS kind, id, CAST(event_id AS VARCHAR) AS state FROM good UNION ALL SELECT 'capture', id, agent FROM good UNION ALL SELECT 'source', path, 'fresh' FROM good
UNION ALL SELECT 'reject', CAST(event_id AS VARCHAR), 'MALFORMED' FROM own WHERE broken"""


def _streamed(spark: SparkSession, sf_dir: str, root: str, files_a_batch: int | None = None) -> DataFrame:
    """The store and the rejects after the events under ``root``/in went through as a stream."""
    files = stage(_stored(spark, sf_dir).select("file_path", F.to_timestamp(F.lit(T0)).alias("mtime"), F.lit(1).cast("bigint").alias("file_size"), "content_hash", F.col("file_path").alias("identity")), "files")
    capture.start(capture.read_events(spark, f"{root}/in", files_a_batch=files_a_batch), files, root, f"{root}/log", F.to_timestamp(F.lit(T1))).awaitTermination()
    out = capture.recorded(spark, root)
    fresh = out["nodes"].filter("not is_stale")
    return (
        fresh.select(F.lit("value").alias("kind"), "id", F.col("number_val").cast("bigint").cast("string").alias("state")).unionByName(out["captures"].select(F.lit("capture").alias("kind"), F.col("node_id").alias("id"), F.col("agent").alias("state")))
        .unionByName(out["sources"].select(F.lit("source").alias("kind"), F.col("file_path").alias("id"), F.lit("fresh").alias("state")))
        .unionByName(out["rejects"].select(F.lit("reject").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("reason").alias("state")))
    )


@query(_STREAMED)
def q_stream_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, run until nothing is left: values, attributions, sources and rejects of the store afterwards."""
    root = f"{shared_dir(prepared(spark))}/stream-{uuid.uuid4().hex}"
    _events(spark, sf_dir).select("event_id", "ts", "agent", "payload").write.parquet(f"{root}/in")
    return _streamed(spark, sf_dir, root)


ROWS_A_FILE = 100_000


@query(_STREAMED)
def q_stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: half of the events, each twice; all of them; a third of them again. Each event is taken, and refused, once."""
    root = f"{shared_dir(prepared(spark))}/stream-{uuid.uuid4().hex}"
    own = stage(_events(spark, sf_dir).select("event_id", "ts", "agent", "payload"), "events")
    half, third = own.filter("event_id % 2 = 0"), own.filter("event_id % 3 = 0")
    files = own.count() // ROWS_A_FILE + 1  # as many for each, so that a batch is one of the three
    for events_of in (half.unionByName(half), own, third):
        events_of.repartition(files).write.mode("append").parquet(f"{root}/in")
    return _streamed(spark, sf_dir, root, files_a_batch=files)


@query("""SELECT '/data/' || event_id || '.csv' AS file_path, CAST(event_id AS VARCHAR) AS first, CAST(line AS BIGINT) AS line FROM events, (SELECT 1 AS line UNION ALL SELECT 2) WHERE event_id % 3 <> 0
UNION ALL SELECT '/data/' || event_id || '.csv', CAST(event_id AS VARCHAR), 1 FROM events WHERE event_id % 6 = 0""")
def q_line_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of returned lines: a file with a value beyond the lines returned (every third; every sixth has no such value) has none at all."""
    e = F.col("event_id")
    two = F.concat(F.lit("a,"), e.cast("string"), F.lit("\nb,"), e.cast("string"))
    own = tables.table(prepared(spark), sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("codex").alias("agent"), _str("/data/", e, ".csv").alias("path"),
        F.when(e % 6 == 0, F.concat(F.lit("a,"), e.cast("string"), F.lit("\nb"))).otherwise(two).alias("content"), F.when(e % 3 == 0, 1).otherwise(2).alias("n_lines"),
    )
    values, _ = capture.values_of(own)
    return values.select("file_path", F.col("number_val").cast("bigint").cast("string").alias("first"), F.col("line").cast("bigint").alias("line"))
