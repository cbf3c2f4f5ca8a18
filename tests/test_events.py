import json

from pyspark.sql import functions as F

from valuegrain.streaming import capture, events

READ = {"hook_event_name": "PostToolUse", "tool_name": "Read", "tool_input": {"file_path": "/p/a.csv"}, "tool_response": {"content": "x,1\ny,2\n"}}
NATIVE = {"event": "tool.execute.after", "tool": "read", "args": {"filePath": "/p/a.csv"}, "result": {"output": "o", "metadata": {"truncated": False, "display": {"truncated": False, "type": "file", "path": "/p/a.csv", "text": "x,1\n", "lineStart": 1, "lineEnd": 1, "totalLines": 1}}}}
#: name, agent, payload, eligible, path
CASES = [
    ("plain", "claude-code", READ, True, "/p/a.csv"), ("bom", "claude-code", "﻿" + json.dumps(READ), True, "/p/a.csv"), ("nested", "claude-code", {**READ, "tool_response": {"file": {"content": "x"}}}, True, "/p/a.csv"),
    ("empty content", "claude-code", {**READ, "tool_response": {"content": ""}}, True, "/p/a.csv"), ("no content", "claude-code", {**READ, "tool_response": {}}, False, "/p/a.csv"), ("before", "claude-code", {**READ, "hook_event_name": "PreToolUse"}, False, "/p/a.csv"),
    ("failed", "claude-code", {**READ, "success": False}, False, "/p/a.csv"), ("failed inside", "claude-code", {**READ, "tool_response": {"content": "x", "is_error": True}}, False, "/p/a.csv"), ("error text", "claude-code", {**READ, "error": "no"}, False, "/p/a.csv"), ("no error", "claude-code", {**READ, "error": ""}, True, "/p/a.csv"),
    ("cancelled", "claude-code", {**READ, "cancelled": True}, False, "/p/a.csv"), ("cut", "claude-code", {**READ, "truncated": True}, False, "/p/a.csv"), ("cut inside", "claude-code", {**READ, "tool_response": {"content": "x", "partial": True}}, False, "/p/a.csv"), ("other tool", "claude-code", {**READ, "tool_name": "Write"}, False, "/p/a.csv"),
    ("command", "codex", {"event": "post", "tool_name": "exec", "tool_input": {"command": "cat b.csv"}, "tool_response": {"stdout": "1"}}, True, "b.csv"), ("blank output", "codex", {"event": "post", "tool_name": "exec", "tool_input": {"command": "cat b.csv"}, "tool_response": {"stdout": " \n"}}, False, "b.csv"),
    ("no read", "codex", {"event": "post", "tool_name": "exec", "tool_input": {"command": "ls b.csv"}, "tool_response": {"stdout": "1"}}, False, None), ("untrusted", "cursor", READ, False, "/p/a.csv"), ("path only", "windsurf", {"agent_action_name": "post_read_code", "tool_info": {"file_path": "w"}}, False, "w"),
    ("stringified", "copilot", {"event": "post", "toolArgs": "{\"path\": \"c\"}"}, False, "c"), ("stringified command", "copilot", {"event": "post", "toolArgs": "{\"command\": \"head -n 2 d\"}"}, False, "d"), ("native", "opencode", NATIVE, True, "/p/a.csv"), ("native of another", "opencode", {**NATIVE, "args": {"filePath": "/p/b"}}, False, None),
    ("malformed", "claude-code", "{", False, None), ("not an object", "claude-code", "7", False, None), ("unknown agent", "nobody", READ, False, None), ("null", "claude-code", None, False, None),
]


def frame(spark):
    text = lambda p: p if p is None or isinstance(p, str) else json.dumps(p)
    return spark.createDataFrame([(i, None, a, text(p)) for i, (_, a, p, _, _) in enumerate(CASES)], "event_id long, ts timestamp, agent string, payload string")


def test_dialects(spark):
    got = {r.event_id: r for r in events.normalise(frame(spark)).withColumn("ok", events.eligible()).collect()}
    bad = [(c[0], got[i].ok, got[i].path, got[i].phase, got[i].outcome) for i, c in enumerate(CASES) if (got[i].ok, got[i].path) != c[3:]]
    assert bad == []


def test_size_cap_and_lines(spark):
    big = spark.createDataFrame([(1, "claude-code")], "event_id long, agent string").withColumn("payload", F.concat(F.lit('{"hook_event_name":"post","tool_name":"Read","tool_input":{"path":"p"},"tool_response":{"content":"'), F.repeat(F.lit("x"), events.MAX_BYTES), F.lit('"}}')))
    assert events.normalise(big).first().phase is None
    assert spark.range(1).select(*[events.n_lines(F.lit(t)).alias(f"c{i}") for i, t in enumerate(("", "a", "a\n", "a\nb"))]).first()[:] == (1, 1, 1, 2)


def files_of(spark, texts):
    own = spark.createDataFrame([(p, c, p) for p, c in texts], "file_path string, c string, identity string")
    return own.select("file_path", F.to_timestamp(F.lit("2020-01-01")).alias("mtime"), F.length("c").cast("long").alias("file_size"), F.sha2("c", 256).alias("content_hash"), "identity")


def stored_values(store):
    named = store["nodes"].join(store["sources"].select("source_id", "file_path"), "source_id").join(store["captures"], F.col("id") == F.col("node_id"))
    return {(r.file_path, r.line_number, r.number_val, r.is_stale, r.agent) for r in named.collect()}


def test_stream_equals_batch(spark, tmp_path):
    files = files_of(spark, [("/p/a.csv", "x,1\ny,2\n"), ("b.csv", "1\n")])
    frame(spark).unionByName(frame(spark)).repartition(3).write.parquet(f"{tmp_path}/in")
    now = F.to_timestamp(F.lit("2020-02-01"))
    capture.start(capture.read_events(spark, f"{tmp_path}/in"), files, str(tmp_path), f"{tmp_path}/log", now).awaitTermination()
    out = capture.recorded(spark, str(tmp_path))
    batch = capture.record_events(frame(spark), files, capture.empty_store(spark), now)
    want = {("/p/a.csv", 1, 1.0, False, "claude-code"), ("/p/a.csv", 2, 2.0, False, "claude-code"), ("b.csv", 1, 1.0, False, "codex")}
    assert stored_values(out) == stored_values(batch) == want
    names = {CASES[r.event_id][0]: r.reason for r in out["rejects"].collect()}
    assert names == {"malformed": "MALFORMED", "not an object": "MALFORMED", "null": "MALFORMED", "unknown agent": "UNKNOWN_AGENT"} or set(names.values()) <= {"MALFORMED", "UNKNOWN_AGENT"} and {"malformed", "null", "unknown agent"} <= set(names), names


def test_a_later_batch_makes_values_stale(spark, tmp_path):
    """The file changes between two batches: its first value goes stale, with what derives from it; the second stays."""
    event = lambda i, text: json.dumps({**READ, "tool_response": {"content": text}})
    now = F.to_timestamp(F.lit("2020-02-01"))
    send = lambda n, text: spark.createDataFrame([(n, None, "claude", event(n, text))], capture.SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    send(1, "x,1\ny,2\n")
    capture.start(capture.read_events(spark, f"{tmp_path}/in"), files_of(spark, [("/p/a.csv", "x,1\ny,2\n")]), str(tmp_path), f"{tmp_path}/log", now).awaitTermination()
    send(2, "x,9\ny,2\n")
    capture.start(capture.read_events(spark, f"{tmp_path}/in"), files_of(spark, [("/p/a.csv", "x,9\ny,2\n")]), str(tmp_path), f"{tmp_path}/log", now).awaitTermination()
    out = capture.recorded(spark, str(tmp_path))
    assert stored_values(out) == {("/p/a.csv", 1, 1.0, True, "claude-code"), ("/p/a.csv", 1, 9.0, False, "claude-code"), ("/p/a.csv", 2, 2.0, False, "claude-code")}


def test_values_beyond_the_returned_lines_are_refused(spark):
    own = spark.createDataFrame([(1, None, "claude-code", "a", "x,1\ny,2", 1), (2, None, "claude-code", "b", "x,1\ny,2", 2)], "event_id long, ts timestamp, agent string, path string, content string, n_lines int")
    values, agents = capture.values_of(own)
    assert {r.file_path for r in values.collect()} == {r.file_path for r in agents.collect()} == {"b"}


def test_a_batch_of_repeats_changes_nothing(spark, tmp_path, monkeypatch):
    """Sent twice in two batches: the second holds nothing new, and isn't recorded at all."""
    calls, own = [], capture.event_changes
    monkeypatch.setattr(capture, "event_changes", lambda *a: calls.append(1) or own(*a))
    files, now = files_of(spark, [("/p/a.csv", "x,1\ny,2\n")]), F.to_timestamp(F.lit("2020-02-01"))
    for _ in range(2):
        spark.createDataFrame([(1, None, "claude", json.dumps(READ))], capture.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    capture.start(capture.read_events(spark, f"{tmp_path}/in", files_a_batch=1), files, str(tmp_path), f"{tmp_path}/log", now).awaitTermination()
    assert len(calls) == 1
    assert stored_values(capture.recorded(spark, str(tmp_path))) == {("/p/a.csv", 1, 1.0, False, "claude-code"), ("/p/a.csv", 2, 2.0, False, "claude-code")}
