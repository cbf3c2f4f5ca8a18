"""Status of the value graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.functions.values import value_text


def totals(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total"), F.count_if(~F.col("is_stale")).alias("active"), F.count_if("is_stale").alias("stale"))


def stale(nodes: DataFrame) -> DataFrame:
    """(id, value_kind, value, reason) of the stale nodes."""
    text = value_text(F.col("value_kind"), F.col("number_val"), F.col("date_val"), F.col("duration_secs"))
    return nodes.filter("is_stale").select("id", "value_kind", text.alias("value"), F.coalesce("stale_reason", F.lit("UNKNOWN")).alias("reason"))


def as_json(nodes: DataFrame) -> DataFrame:
    """One JSON line for the totals and one for each stale node, so that the report never is one cell."""
    head = totals(nodes).select(F.lit(0).alias("section"), F.lit("").alias("key"), F.to_json(F.struct("total", "active", "stale")).alias("line"))
    rows = stale(nodes).select(F.lit(1).alias("section"), F.col("id").alias("key"), F.to_json(F.struct("id", "value_kind", "value", "reason")).alias("line"))
    return head.unionByName(rows)


def as_text(nodes: DataFrame, stale_only: bool = False) -> DataFrame:
    """Lines with a sort key."""
    counted = totals(nodes)
    lines = F.array(
        F.struct(F.lit("1").alias("key"), F.format_string("Total values:  %d", "total").alias("line")),
        F.struct(F.lit("2").alias("key"), F.format_string("Active values: %d", "active").alias("line")),
        F.struct(F.lit("3").alias("key"), F.format_string("Stale values:  %d", "stale").alias("line")),
    )
    head = counted.select(F.lit(0).alias("section"), F.explode(lines).alias("l")).select("section", "l.key", "l.line")
    rows = stale(nodes).select(F.lit(1).alias("section"), F.col("id").alias("key"), F.format_string("- [%s] %s = %s (%s)", "id", "value_kind", "value", "reason").alias("line"))
    return rows if stale_only else head.unionByName(rows)
