"""Completed-read events: from JSON text to a path, a content and whether its values may be recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.functions.text import command_path

#: The largest payload, and which agent speaks which dialect and is trusted with values.
MAX_BYTES = 8 * 1024 * 1024
STRUCTURED, COMMAND, PATH_ONLY, DUAL, NATIVE = ("claude-code", "cursor", "codex"), ("gemini", "vibe", "pi", "hermes"), ("windsurf",), ("copilot",), ("opencode",)
READ_TOOLS = {"claude-code": ("Read",), "codex": ("read_file", "ReadFile", "Read")}
COMMAND_TOOLS = {"claude-code": ("Bash",), "codex": ("Bash", "bash", "execute_command", "ExecuteCommand", "exec")}


def _text(v: Column, path: str) -> Column:
    """A JSON string; null for anything else."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _flag(v: Column, path: str) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def _is(v: Column, path: str, value: bool) -> Column:
    own = F.try_variant_get(v, path, "variant")
    return F.coalesce((F.schema_of_variant(own) == "BOOLEAN") & (F.try_variant_get(v, path, "boolean") == value), F.lit(False))


def _there(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def _first(*texts: Column) -> Column:
    return F.coalesce(*texts)


def _error(v: Column, path: str) -> Column:
    own = F.try_variant_get(v, path, "variant")
    return F.coalesce(own.isNotNull() & ~F.is_variant_null(own) & (F.coalesce(_text(v, path), F.lit("?")) != ""), F.lit(False))


def _any(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def n_lines(text: Column) -> Column:
    """Lines of a text; a last line feed ends a line and begins none."""
    return F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(text, "\r?\n$", ""), "\n")))


def normalise(events: DataFrame) -> DataFrame:
    """Events (event_id, agent, payload) with path, content, phase, outcome, complete and n_lines; malformed ones have a null phase.

    ``agent`` null means the structured dialect. Texts over the cap are malformed.
    """
    small = F.when(F.octet_length("payload") <= MAX_BYTES, F.regexp_replace("payload", "^\\uFEFF", ""))
    agent = F.coalesce(F.col("agent"), F.lit("claude-code"))
    own = events.withColumn("_v", F.try_parse_json(small)).withColumn("_agent", agent)
    v, agent = F.col("_v"), F.col("_agent")
    args = F.try_parse_json(_text(v, "$.toolArgs"))
    structured_path = _first(_text(v, "$.tool_input.path"), _text(v, "$.tool_input.file_path"))
    structured_content = _first(_text(v, "$.tool_response.content"), _text(v, "$.tool_response.file.content"), _text(v, "$.tool_response.text"))
    pick = lambda *paths: F.coalesce(*[F.when(_there(v, p), F.coalesce(_text(v, p), F.lit("\x00"))) for p in paths])  # noqa: E731  the first that is there decides
    command = F.nullif(pick("$.tool_input.command", "$.command", "$.args.command"), F.lit("\x00"))
    stdout = _text(v, "$.tool_response.stdout")
    command_content = F.when(F.trim(F.regexp_replace(stdout, r"\s", "")) != "", stdout)
    action = F.nullif(pick("$.agent_action_name", "$.event", "$.hook_event_name"), F.lit("\x00"))
    seen_path = F.when(action == "post_read_code", _first(_text(v, "$.tool_info.file_path"), F.when(~_there(v, "$.tool_info.file_path"), _text(v, "$.file_path"))))
    is_structured = agent.isin(*STRUCTURED) & structured_path.isNotNull()
    is_dual = agent.isin(*DUAL) & _any(_there(v, "$.tool_input"), _there(v, "$.tool_response"))
    args_path = F.coalesce(_text(args, "$.path"), F.when(~_there(args, "$.path"), _text(args, "$.file_path")))
    args_command = _text(args, "$.command")
    native_path, shown = _text(v, "$.args.filePath"), _text(v, "$.result.metadata.display.text")
    number = lambda p: F.try_variant_get(v, p, "bigint")
    total, pieces = number("$.result.metadata.display.totalLines"), F.size(F.split(shown, "\n"))
    true_lines = F.when(shown == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(shown, "\n$", ""), "\n")))
    bad = lambda base: _any(_is(v, f"{base}.success", False), *[_flag(v, f"{base}.{k}") for k in ("failed", "canceled", "cancelled", "is_error", "isError")], _error(v, f"{base}.error"))
    is_native = F.coalesce(
        agent.isin(*NATIVE) & (_text(v, "$.event") == "tool.execute.after") & (_text(v, "$.tool") == "read") & (native_path != "") & _text(v, "$.result.output").isNotNull() & ~bad("$") & ~bad("$.result")
        & _is(v, "$.result.metadata.truncated", False) & _is(v, "$.result.metadata.display.truncated", False) & (_text(v, "$.result.metadata.display.type") == "file")
        & (_text(v, "$.result.metadata.display.path") == native_path) & (number("$.result.metadata.display.lineStart") == 1) & (number("$.result.metadata.display.lineEnd") == total)
        & ((true_lines == total) | (true_lines + 1 == total) | (pieces == total) | (pieces + 1 == total)),
        F.lit(False),
    )
    by_args = agent.isin(*DUAL) & ~is_dual
    path = (
        F.when(is_native, native_path).when(is_structured | is_dual, structured_path).when(agent.isin(*PATH_ONLY), seen_path)
        .when(by_args & args_path.isNotNull(), args_path).when(by_args & args_command.isNotNull(), command_path(args_command)).otherwise(command_path(command))
    )
    content = (
        F.when(is_native, shown).when(is_structured | is_dual, structured_content).when(agent.isin(*PATH_ONLY) | (by_args & (args_path.isNotNull() | args_command.isNotNull())), F.lit(None).cast("string"))
        .otherwise(command_content)
    )
    event = F.lower(F.coalesce(F.nullif(pick("$.event", "$.hook_event_name", "$.event_name", "$.agent_action_name"), F.lit("\x00")), F.lit("")))
    phase = F.when(is_native, "After").when(event.contains("pre") | event.contains("before"), "Before").when(event.contains("post") | event.contains("after"), "After").otherwise("Unknown")
    canceled = _any(*[_flag(v, f"{b}.{k}") for b in ("$", "$.tool_response") for k in ("canceled", "cancelled")])
    failed = _any(*[x for b in ("$", "$.tool_response") for x in (_is(v, f"{b}.success", False), _flag(v, f"{b}.failed"), _flag(v, f"{b}.is_error"), _flag(v, f"{b}.isError"), _error(v, f"{b}.error"))])
    cut = _any(*[_flag(v, f"$.{k}") for k in ("truncated", "partial", "filtered")], *[_flag(v, f"$.tool_response.{k}") for k in ("truncated", "is_truncated", "partial", "filtered")])
    outcome = (
        F.when(is_native, "CompletedResult").when(canceled, "Canceled").when(failed, "Failed").when(content.isNotNull(), "CompletedResult")
        .when(_is(v, "$.success", True) | F.coalesce(_text(v, "$.agent_action_name") == "post_read_code", F.lit(False)), "ExplicitSuccess").otherwise("Unknown")
    )
    tool = F.nullif(pick("$.tool_name", "$.toolName"), F.lit("\x00"))
    asked = F.coalesce(_text(v, "$.tool_input.command"), _text(v, "$.command"))
    by_tool = F.lit(False)
    for name in READ_TOOLS:
        ran = tool.isin(*COMMAND_TOOLS[name]) & command_path(asked).isNotNull()
        by_tool = by_tool | ((agent == name) & path.isNotNull() & (tool.isin(*READ_TOOLS[name]) | ran))
    qualifies = is_native | F.coalesce(by_tool, F.lit(False))
    known = v.isNotNull() & agent.isin(*STRUCTURED, *COMMAND, *PATH_ONLY, *DUAL, *NATIVE) & ~(agent.isin(*PATH_ONLY) & action.isNull())
    out = own.withColumns({"path": F.when(known, path), "content": F.when(known, content), "phase": F.when(known, phase), "outcome": F.when(known, outcome), "complete": F.when(known, qualifies & (is_native | ~(failed | canceled | cut)))})
    return out.withColumn("n_lines", F.when(F.col("content").isNotNull(), n_lines(F.col("content")))).drop("_v", "_agent")


def eligible() -> Column:
    """Whether a normalised event's values may be recorded: completed, whole, and with content."""
    return F.coalesce((F.col("phase") == "After") & F.col("outcome").isin("CompletedResult", "ExplicitSuccess") & F.col("complete") & F.col("content").isNotNull(), F.lit(False))


def snapshot_matches(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with ``matches``: the content is the source's as stored, or all but one last line end of it."""
    own = sources.select(F.col("file_path").alias("_p"), F.col("content_hash").alias("_h"))
    joined = events.join(own, F.col("path") == F.col("_p"), "left")
    same = F.lit(False)
    for end in ("", "\n", "\r\n"):
        same = same | (F.sha2(F.concat(F.col("content"), F.lit(end)), 256) == F.col("_h"))
        if end:
            same = same | (F.col("content").endswith(end) & (F.sha2(F.substring("content", 1, F.char_length("content") - len(end)), 256) == F.col("_h")))
    return joined.withColumn("matches", F.coalesce(same, F.lit(False))).drop("_p", "_h")
