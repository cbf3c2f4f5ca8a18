"""Verification of claimed derivations in bulk, and the nodes and edges of those that hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.functions import values as V
from valuegrain.functions.values import try_cast
from valuegrain.operators.graph import STALE_PARENT
from valuegrain.plans import formula
from valuegrain.sources.staging import stage

#: The operations, and parents of an aggregate.
OPERATIONS = ("EXPRESSION", "DATE_DIFF", "DURATION_SUM", "DURATION_AVG")
AGGREGATES = ("DURATION_SUM", "DURATION_AVG")
MAX_PARENTS = 26


def shape_faults(claims: DataFrame) -> DataFrame:
    """Claims with ``fault``: what is wrong before any parent is looked up, else null."""
    n, distinct = F.size("parent_ids"), F.size(F.array_distinct("parent_ids"))
    temporal = F.col("operation") != "EXPRESSION"
    fault = (
        F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "OPERATION")
        .when((n < 1) | (n > MAX_PARENTS), "PARENT_COUNT")
        .when((F.col("operation") == "DATE_DIFF") & (n != 2), "PARENT_COUNT")
        .when(F.col("operation").isin(*AGGREGATES) & ((n < 2) | (distinct < n)), "PARENT_COUNT")
        .when(temporal & F.col("expression").isNotNull(), "EXPRESSION")
        .when(~temporal & (F.trim(F.coalesce("expression", F.lit(""))) == ""), "EXPRESSION")
        .when(~temporal & (F.octet_length("expression") > formula.MAX_BYTES), "EXPRESSION")
        .when(~temporal & F.col("result_unit").isNotNull(), "UNIT")
        .when(~temporal & try_cast(F.col("result"), "double").isNull(), "RESULT")
        .when(temporal & F.col("result").isNotNull() & V.claim_seconds(F.col("result"), F.coalesce("result_unit", F.lit("seconds"))).isNull(), "RESULT")
    )
    return claims.withColumn("fault", fault)


def with_parents(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims with ``parents``: their parents' kinds and values in order; missing ones have a null kind.

    A claim has at most 26 parents, so a group is small; one node may serve any number of claims.
    """
    # the outer form keeps what ``parent_ids`` is computed from out of a filter below the rows it makes
    each = claims.select("claim_id", F.posexplode_outer("parent_ids").alias("place", "_parent")).filter("place is not null")
    own = nodes.select(F.col("id").alias("_n"), "value_kind", "number_val", "date_val", "duration_secs", "is_stale")
    joined = each.join(own, F.col("_parent") == F.col("_n"), "left")
    fields = F.struct("place", "value_kind", "number_val", "date_val", "duration_secs", "is_stale")
    grouped = joined.groupBy(F.col("claim_id").alias("_c")).agg(F.array_sort(F.collect_list(fields)).alias("parents"))
    return claims.join(grouped, F.col("claim_id") == F.col("_c"), "left").drop("_c")


def coercion(parents: Column) -> Column:
    """What a formula made of its temporal parents, as a text; null if it has none."""
    has = lambda kind: F.exists(parents, lambda p: F.coalesce(p["value_kind"] == kind, F.lit(False)))
    read = F.concat_ws(" and ", F.when(has("DATE"), "dates as seconds since 1970"), F.when(has("DURATION"), "durations as their seconds"))
    return F.when(read != "", F.concat(F.lit("The formula reads "), read, F.lit("; its result is a number, not a duration.")))


def verify(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claims with parents, ``status`` (OK, MISMATCH, INVALID_INPUT), ``message``, ``warning``, ``number`` and ``secs`` as computed.

    The warning says which temporal parents a formula took for numbers; null where it took none.

    Claims are (claim_id, parent_ids, operation, expression, result, result_unit); a temporal claim
    without a result is computed and holds. Nothing is written.
    """
    shaped = F.col("fault").isNull()
    checked = shape_faults(claims)
    sought = with_parents(checked.withColumns({"_given": F.col("parent_ids"), "parent_ids": F.when(shaped, F.col("parent_ids"))}), nodes)
    own = stage(sought.select(*[F.col("_given").alias(c) if c == "parent_ids" else F.col(c) for c in claims.columns], "fault", F.when(shaped, F.col("parents")).alias("parents")), "claims")
    expression = F.col("operation") == "EXPRESSION"
    is_formula = shaped & F.coalesce(expression, F.lit(False))
    as_number = F.transform("parents", lambda p: F.coalesce(p["number_val"], F.unix_seconds(p["date_val"]).cast("double"), p["duration_secs"].cast("double")))
    formulas = own.filter(is_formula).withColumn("_own", formula.in_tasks(F.col("expression"), as_number))
    own = formulas.unionByName(own.filter(~is_formula).withColumn("_own", F.lit(None).cast(formulas.schema["_own"].dataType)))
    own = own.withColumns({"_number": F.col("_own.value"), "_known": F.col("_own.known")})
    number, known = F.col("_number"), F.col("_known")
    secs_of = F.transform("parents", lambda p: p["duration_secs"])
    total = F.aggregate(secs_of, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    in_range = F.when(F.abs(total) <= V.CLAIM_SECONDS, total)
    n = F.size("parents")
    mean = F.when(in_range % n == 0, F.floor(in_range / n))
    diff = V.date_diff(F.get("parents", F.lit(0))["date_val"], F.get("parents", F.lit(1))["date_val"])
    secs = F.when(F.col("operation") == "DATE_DIFF", diff).when(F.col("operation") == "DURATION_SUM", in_range.cast("bigint")).when(F.col("operation") == "DURATION_AVG", mean.cast("bigint"))
    kind = F.when(F.col("operation") == "DATE_DIFF", "DATE").otherwise("DURATION")
    own = own.withColumns({"number": F.when(expression & ~F.isnan(number) & (F.abs(number) < float("inf")), number), "known": known, "secs": secs, "wanted": kind})
    claimed = V.claim_seconds(F.col("result"), F.coalesce("result_unit", F.lit("seconds")))
    missing = F.exists("parents", lambda p: p["value_kind"].isNull())
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(missing, "MISSING_PARENT").when(expression & ~F.col("known"), "EXPRESSION").when(expression & F.col("number").isNull(), "NOT_FINITE")
        .when(~expression & F.exists("parents", lambda p: p["value_kind"] != F.col("wanted")), "PARENT_KIND").when(~expression & F.col("secs").isNull(), "NOT_EXACT")
    )
    holds = F.when(expression, V.close(F.col("number"), try_cast(F.col("result"), "double"))).otherwise(F.col("result").isNull() | (claimed == F.col("secs")))
    done = own.withColumns({"_shaped": shaped, "fault": fault, "holds": holds})
    computed = lambda c: F.when(F.col("_shaped"), F.col(c)).alias(c)
    return done.select(
        *claims.columns, "parents", computed("number"), computed("secs"), F.when(F.col("fault").isNotNull(), "INVALID_INPUT").when(F.col("holds"), "OK").otherwise("MISMATCH").alias("status"),
        F.coalesce("fault", F.when(F.col("holds"), "").otherwise("VALUE")).alias("message"), F.when(F.col("_shaped") & expression, coercion(F.col("parents"))).alias("warning"),
    )


def derived(verdicts: DataFrame) -> DataFrame:
    """Claims that hold, with the derived node's id, kind, computed value and staleness (born stale of a stale parent)."""
    ok = verdicts.filter("status = 'OK'")
    is_number = F.col("operation") == "EXPRESSION"
    any_stale = F.exists("parents", lambda p: p["is_stale"])
    return ok.select(
        "claim_id", "parent_ids", "operation", "expression",
        F.when(is_number, V.derived_id(F.col("parent_ids"), F.col("operation"), V.number_text(F.col("number")))).otherwise(V.duration_id(F.col("parent_ids"), F.col("operation"), F.col("secs"))).alias("id"),
        F.when(is_number, "NUMBER").otherwise("DURATION").alias("value_kind"), F.col("number").alias("number_val"), F.col("secs").alias("duration_secs"),
        any_stale.alias("is_stale"), F.when(any_stale, STALE_PARENT).alias("stale_reason"),
    )


def new_edges(rows: DataFrame) -> DataFrame:
    """One edge for each distinct parent of a derived node, in operand order."""
    return rows.select("id", "operation", "expression", F.posexplode(F.array_distinct("parent_ids")).alias("operand", "parent_id")).select("parent_id", F.col("id").alias("child_id"), "operand", "operation", "expression").distinct()


def reuse(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived durations with ``reuse``: NEW, REUSED where the same node and lineage are stored, CONFLICT where the id has others."""
    from valuegrain.operators.graph import operands

    stored = operands(edges).groupBy(F.col("child_id").alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("operand", "parent_id"))), lambda x: x["parent_id"]).alias("_lineage"), F.min("operation").alias("_op"), F.max("operation").alias("_op2"))
    own = nodes.select(F.col("id").alias("_n"), F.col("duration_secs").alias("_secs"))
    joined = rows.filter("value_kind = 'DURATION'").join(own, F.col("id") == F.col("_n"), "left").join(stored, F.col("id") == F.col("_c"), "left")
    order = lambda a: F.when(F.col("operation") == "DATE_DIFF", a).otherwise(F.array_sort(a))
    same = (order(F.array_distinct("parent_ids")) == order(F.col("_lineage"))) & (F.col("_op") == F.col("operation")) & (F.col("_op2") == F.col("operation")) & (F.col("_secs") == F.col("duration_secs"))
    state = F.when(F.col("_n").isNull(), "NEW").when(F.coalesce(same, F.lit(False)), "REUSED").otherwise("CONFLICT")
    return joined.select(*rows.columns, state.alias("reuse"))


def derive(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(derived nodes, their edges without those on cycles, verdicts)."""
    from valuegrain.operators.graph import reject_cycles

    verdicts = stage(verify(claims, nodes), "verdicts")
    rows = derived(verdicts)
    kept, _ = reject_cycles(edges, new_edges(rows))
    return rows, kept, verdicts


def aggregate_durations(rows: DataFrame, key: str, secs: str = "duration_secs") -> DataFrame:
    """(key, n, total, mean) of durations by group: exact sums within range, the mean only if it is a whole second."""
    total = F.sum(F.col(secs).cast("decimal(38,0)"))
    out = rows.groupBy(key).agg(F.count("*").alias("n"), total.alias("_t"))
    ranged = F.when(F.abs("_t") <= V.CLAIM_SECONDS, F.col("_t").cast("bigint"))
    return out.select(key, "n", ranged.alias("total"), F.when(ranged % F.col("n") == 0, (ranged / F.col("n")).cast("bigint")).alias("mean"))
