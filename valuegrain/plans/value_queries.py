"""Queries on values: durations, claims, verification, derivation, extraction, identities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.functions import numbers as N
from valuegrain.functions import values as V
from valuegrain.operators import extract, record, verify
from valuegrain.plans import fixtures as fx
from valuegrain.plans.registry import query, sql_digest, sql_duration, sql_number, sql_xsd
from valuegrain.sources.staging import prepared, shared_dir, stage
from valuegrain.sources.tables import table, text_lines, texts


def _str(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _shown(x: Column) -> Column:
    """A whole number that may be null, as text: data frames of other libraries show such columns in different types."""
    return x.cast("string")


@query(fx.ctes() + "SELECT k, n, CAST(CASE WHEN shipped >= ordered THEN shipped - ordered END AS VARCHAR) AS secs FROM fx_lines")
def q_date_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.view(spark, sf_dir, "fx_lines")
    return own.select("k", F.col("n").cast("bigint").alias("n"), _shown(V.date_diff(F.timestamp_seconds("ordered"), F.timestamp_seconds("shipped"))).alias("secs"))


@query(fx.ctes() + "SELECT k, count(*) AS n, CAST(sum(secs) AS BIGINT) AS total FROM fx_gaps GROUP BY k HAVING count(*) BETWEEN 2 AND 26")
def q_duration_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.aggregate_durations(fx.view(spark, sf_dir, "fx_gaps"), "k", "secs").filter("n between 2 and 26").select("k", "n", "total")


@query(fx.ctes() + "SELECT c, count(*) AS n, CAST(CASE WHEN CAST(sum(secs + k % 7) AS BIGINT) % count(*) = 0 THEN CAST(sum(secs + k % 7) AS BIGINT) // count(*) END AS VARCHAR) AS mean FROM fx_gaps GROUP BY c")
def q_duration_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.view(spark, sf_dir, "fx_gaps").select("c", (F.col("secs") + F.col("k") % 7).alias("secs"))
    return verify.aggregate_durations(own, "c", "secs").select("c", "n", _shown(F.col("mean")).alias("mean"))


#: Signed, with hours, minutes and seconds.
_MIXED = "(CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END * (secs + CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 3600 * (n % 5) WHEN 2 THEN n % 60 ELSE 60 * (k % 50) + n END) // CASE WHEN k % 6 = 1 THEN 86400 ELSE 1 END)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    more = F.when(k % 4 == 0, F.lit(0)).when(k % 4 == 1, (n % 5) * 3600).when(k % 4 == 2, n % 60).otherwise((k % 50) * 60 + n)
    signed = F.when(k % 3 == 0, F.lit(-1)).otherwise(F.lit(1)) * (F.col("secs") + more)
    return fx.view(spark, sf_dir, "fx_gaps").select("k", F.col("n").cast("bigint").alias("n"), F.floor(signed / F.when(k % 6 == 1, F.lit(86400)).otherwise(F.lit(1))).cast("bigint").alias("secs"))


@query(fx.ctes(f"mixed AS (SELECT k, n, CAST({_MIXED} AS BIGINT) AS secs FROM fx_gaps)") + f"SELECT k, n, {sql_duration('secs')} AS text FROM mixed")
def q_duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("k", "n", V.duration_text(F.col("secs")).alias("text"))


@query(fx.ctes(f"mixed AS (SELECT k, n, CAST({_MIXED} AS BIGINT) AS secs FROM fx_gaps)") + f"SELECT k, n, {sql_xsd('secs')} AS text FROM mixed")
def q_xsd_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("k", "n", V.xsd_duration(F.col("secs")).alias("text"))


_UNITS = "units AS (SELECT * FROM (VALUES ('seconds', 1), ('minutes', 60), ('hours', 3600), ('days', 86400), ('weeks', 604800)) t(unit, scale))"
_SHOWN = """shown AS (SELECT k, n, secs, unit, scale, CAST(abs(secs) % scale AS HUGEINT) * 1000000000000 AS scaled, abs(secs) // scale AS whole0 FROM mixed, units
), parts AS (SELECT *, scaled % scale = 0 AS exact, CASE WHEN scaled % scale = 0 THEN scaled // scale ELSE (scaled + scale // 2) // scale END AS f0 FROM shown
), digits AS (SELECT *, CASE WHEN f0 = 1000000000000 THEN 0 ELSE f0 END AS f, whole0 + CASE WHEN f0 = 1000000000000 THEN 1 ELSE 0 END AS whole FROM parts
), plain AS (SELECT *, CASE WHEN f = 0 THEN CAST(whole AS VARCHAR) ELSE whole || '.' || rtrim(lpad(CAST(f AS VARCHAR), 12, '0'), '0') END AS p FROM digits)"""


@query(fx.ctes(f"mixed AS (SELECT k, n, CAST({_MIXED} AS BIGINT) AS secs FROM fx_gaps)", _UNITS, _SHOWN) + """
SELECT k, n, unit, CASE WHEN secs < 0 AND p <> '0' THEN '-' || p ELSE p END AS decimal, NOT exact AS approximate,
CASE WHEN exact THEN '' ELSE 'approximately ' END || CASE WHEN secs < 0 AND p <> '0' THEN '-' || p ELSE p END || ' ' || CASE WHEN whole = 1 AND f = 0 THEN rtrim(unit, 's') ELSE unit END AS text FROM plain""")
def q_duration_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.explode(F.array(*[F.lit(u) for u in V.UNITS]))
    own = _mixed(spark, sf_dir).withColumn("unit", units).withColumn("d", V.unit_display(F.col("secs"), F.col("unit")))
    return own.select("k", "n", "unit", "d.decimal", "d.approximate", "d.text")


@query(fx.ctes() + """SELECT k, n, CAST(CASE k % 6 WHEN 0 THEN secs * 60 WHEN 1 THEN -secs WHEN 2 THEN CASE WHEN n % 2 = 0 THEN secs * 1800 END WHEN 3 THEN secs * 864 WHEN 4 THEN NULL ELSE secs END AS VARCHAR) AS secs
FROM (SELECT k, n, secs // 86400 AS secs FROM fx_gaps)""")
def q_claim_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.view(spark, sf_dir, "fx_gaps").withColumn("d", F.floor(F.col("secs") / 86400).cast("bigint"))
    k, d = F.col("k") % 6, F.col("d")
    half = F.when(F.col("n") % 2 == 0, _str(F.floor(d / 2).cast("bigint"), F.when(d % 2 == 0, ".0").otherwise(".5"))).otherwise(_str(d, ".", d, "x"))
    lexeme = F.when(k == 0, _str(d, "")).when(k == 1, _str("-", d, "000e-3")).when(k == 2, half).when(k == 3, _str(d, "e-2")).when(k == 4, _str(d, ".0000000001")).otherwise(_str("+", d, ".000"))
    unit = F.when(k == 0, "minutes").when(k == 2, "hours").when(k == 3, "days").otherwise("seconds")
    return own.select("k", F.col("n").cast("bigint").alias("n"), _shown(V.claim_seconds(lexeme, unit)).alias("secs"))


# Claims


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _leaf(df: DataFrame, node_id: Column, kind: str, value: Column, stale: Column | None = None) -> DataFrame:
    typed = {"NUMBER": "number_val", "DATE": "date_val", "DURATION": "duration_secs"}
    types = {"number_val": "double", "date_val": "timestamp", "duration_secs": "bigint"}
    return df.select(node_id.alias("id"), F.lit(kind).alias("value_kind"), *[(value.cast(t) if typed[kind] == c else _null(t)).alias(c) for c, t in types.items()], (stale if stale is not None else F.lit(False)).alias("is_stale"))


def _price_claims(spark: SparkSession, sf_dir: str, formula: Column | None = None, claimed: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims on the lines' prices, discounts and taxes, and these; other formulas and results may be given."""
    own = stage(fx.view(spark, sf_dir, "fx_lines").withColumn("tag", _str(F.col("k"), ":", F.col("n"))), "lines")
    ids = {p: F.concat(F.lit(p), F.col("tag")) for p in ("P:", "X:", "Y:")}
    nodes = _leaf(own, ids["P:"], "NUMBER", F.col("price")).unionByName(_leaf(own, ids["X:"], "NUMBER", F.col("discount"))).unionByName(_leaf(own, ids["Y:"], "NUMBER", F.col("tax")))
    value = F.col("price") * (F.lit(1.0) - F.col("discount")) * (F.lit(1.0) + F.col("tax"))
    bad = F.col("k") % 13 == 0
    claims = own.select(
        (F.col("k") * 100 + F.col("n")).alias("claim_id"), F.array(*ids.values()).alias("parent_ids"), F.lit("EXPRESSION").alias("operation"),
        (F.when(F.col("k") % 17 == 0, "a * (1 - b)").when(F.col("k") % 2 == 0, "a * (1 - b) * (1 + c)").otherwise("(1+c)*a - (c + 1) * a*b") if formula is None else formula).alias("expression"),
        (F.when(bad, value * 1.01).otherwise(value).cast("string") if claimed is None else claimed).alias("result"), _null("string").alias("result_unit"),
    )
    return claims, nodes


@query(fx.ctes() + """SELECT k * 100 + n AS claim_id, CASE WHEN k % 17 = 0 THEN 'INVALID_INPUT' WHEN k % 13 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status,
CAST(CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(floor(price * (1 - discount) * (1 + tax) * 1000 + 0.12345) AS BIGINT) END AS VARCHAR) AS computed FROM fx_lines""")
def q_verify_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verify.verify(*_price_claims(spark, sf_dir))
    return out.select("claim_id", "status", _shown(F.floor(F.col("number") * 1000 + 0.12345).cast("bigint")).alias("computed"))


@query(fx.ctes() + """SELECT k * 100 + n AS claim_id, CASE WHEN k % 13 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status,
CAST(CAST(floor(CASE k % 3 WHEN 0 THEN price * (k % 10000 + 1) + discount * discount - tax WHEN 1 THEN (k % 10000 + 1) - -price / (1 + discount) + tax * 0 ELSE price % (k % 10000 + 1) + discount * tax END * 1000 + 0.12345) AS BIGINT) AS VARCHAR) AS computed FROM fx_lines""")
def q_verify_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About as many formulas as there are orders, up to 30,000."""
    c, a, b, t, k = (F.col("k") % 10000 + 1).cast("bigint"), F.col("price"), F.col("discount"), F.col("tax"), F.col("k") % 3
    text = F.when(k == 0, _str("a * ", c, " + b ^ 2 - c")).when(k == 1, _str(c, " - -a / (1 + b) + c * 0")).otherwise(_str("a % ", c, " + b*c"))
    value = F.when(k == 0, a * c + b * b - t).when(k == 1, c + a / (F.lit(1.0) + b)).otherwise(a % c + b * t)
    claimed = F.when(F.col("k") % 13 == 0, value + 1 + F.abs(value)).otherwise(value).cast("string")
    out = verify.verify(*_price_claims(spark, sf_dir, text, claimed))
    return out.select("claim_id", "status", _shown(F.floor(F.col("number") * 1000 + 0.12345).cast("bigint")).alias("computed"))


_READS = "'The formula reads ' || CASE k % 3 WHEN 0 THEN 'dates as seconds since 1970' WHEN 1 THEN 'dates as seconds since 1970 and durations as their seconds' ELSE 'durations as their seconds' END || '; its result is a number, not a duration.'"


@query(fx.ctes() + f"""SELECT k * 100 + n AS claim_id, CASE WHEN k % 13 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status, CAST(CASE k % 3 WHEN 0 THEN shipped - ordered WHEN 1 THEN ordered + secs ELSE secs * 2 END AS VARCHAR) AS computed, {_READS} AS warning
FROM (SELECT *, shipped - ordered AS secs FROM fx_lines WHERE shipped >= ordered)""")
def q_verify_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over dates and durations: they count as seconds, the result is a number, and a warning says so."""
    own = stage(fx.view(spark, sf_dir, "fx_lines").filter("shipped >= ordered").withColumns({"tag": _str(F.col("k"), ":", F.col("n")), "secs": F.col("shipped") - F.col("ordered")}), "lines")
    at = {p: F.concat(F.lit(p), F.col("tag")) for p in ("O:", "S:", "D:")}
    nodes = _leaf(own, at["O:"], "DATE", F.timestamp_seconds("ordered")).unionByName(_leaf(own, at["S:"], "DATE", F.timestamp_seconds("shipped"))).unionByName(_leaf(own, at["D:"], "DURATION", F.col("secs")))
    k = F.col("k") % 3
    value = F.when(k == 0, F.col("secs")).when(k == 1, F.col("ordered") + F.col("secs")).otherwise(F.col("secs") * 2)
    claims = own.select(
        (F.col("k") * 100 + F.col("n")).alias("claim_id"), F.when(k == 0, F.array(at["O:"], at["S:"])).when(k == 1, F.array(at["O:"], at["D:"])).otherwise(F.array(at["D:"])).alias("parent_ids"), F.lit("EXPRESSION").alias("operation"),
        F.when(k == 0, "b - a").when(k == 1, "a + b").otherwise("2 * a").alias("expression"), F.when(F.col("k") % 13 == 0, value * 2 + 100).otherwise(value).cast("string").alias("result"), _null("string").alias("result_unit"),
    )
    out = verify.verify(claims, nodes)
    return out.select("claim_id", "status", _shown(F.col("number").cast("bigint")).alias("computed"), "warning")


def _gap_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = stage(fx.view(spark, sf_dir, "fx_lines").withColumn("tag", _str(F.col("k"), ":", F.col("n"))), "lines")
    first, second = F.concat(F.lit("O:"), F.col("k").cast("string")), F.concat(F.lit("S:"), F.col("tag"))
    orders = own.select("k", "ordered").distinct()
    nodes = _leaf(orders, first, "DATE", F.timestamp_seconds("ordered"), F.col("k") % 37 == 0).unionByName(_leaf(own, second, "DATE", F.timestamp_seconds("shipped")))
    secs = F.col("shipped") - F.col("ordered") + F.when(F.col("k") % 13 == 0, F.lit(1)).otherwise(F.lit(0))
    unit = F.element_at(F.array(*[F.lit(u) for u in V.UNITS]), (F.col("n") % 5 + 1).cast("int"))
    scale = V.unit_seconds(unit)
    fits = secs % scale == 0
    claims = own.select(
        (F.col("k") * 100 + F.col("n")).alias("claim_id"), F.array(first, second).alias("parent_ids"), F.lit("DATE_DIFF").alias("operation"), _null("string").alias("expression"),
        F.when(F.col("k") % 19 == 0, _null("string")).when(fits, F.floor(secs / scale).cast("bigint").cast("string")).otherwise(secs.cast("string")).alias("result"),
        F.when(F.col("k") % 19 != 0, F.when(fits, unit).otherwise("seconds")).alias("result_unit"),
    )
    return claims, nodes, own


@query(fx.ctes() + """SELECT k * 100 + n AS claim_id, CASE WHEN shipped < ordered THEN 'INVALID_INPUT' WHEN k % 13 = 0 AND k % 19 <> 0 THEN 'MISMATCH' ELSE 'OK' END AS status,
CAST(CASE WHEN shipped >= ordered THEN shipped - ordered END AS VARCHAR) AS secs FROM fx_lines""")
def q_verify_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, nodes, _ = _gap_claims(spark, sf_dir)
    return verify.verify(claims, nodes).select("claim_id", "status", _shown(F.col("secs")).alias("secs"))


@query("""SELECT o_orderkey AS claim_id, 'INVALID_INPUT' AS status, CASE o_orderkey % 8 WHEN 0 THEN 'OPERATION' WHEN 1 THEN 'PARENT_COUNT' WHEN 2 THEN 'PARENT_COUNT' WHEN 3 THEN 'EXPRESSION' WHEN 4 THEN 'UNIT'
WHEN 5 THEN 'RESULT' WHEN 6 THEN 'MISSING_PARENT' ELSE 'PARENT_COUNT' END AS message FROM orders""")
def q_verify_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepared(spark) and table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    m, me = F.col("k") % 8, F.concat(F.lit("O:"), F.col("k").cast("string"))
    nodes = _leaf(own, me, "DURATION", F.col("k"))
    none = F.array().cast("array<string>")
    claims = own.select(
        F.col("k").alias("claim_id"), F.when(m == 1, none).when(m == 2, F.array(me, me)).when(m == 6, F.array(me, F.lit("nowhere"))).when(m == 7, F.transform(F.sequence(F.lit(1), F.lit(27)), lambda i: i.cast("string"))).otherwise(F.array(me)).alias("parent_ids"),
        F.when(m == 0, "duration_sum").when(m.isin(2, 6), "DURATION_SUM").otherwise("EXPRESSION").alias("operation"), F.when(m.isin(2, 6), _null("string")).when(m == 3, " ").otherwise("a").alias("expression"),
        F.when(m == 5, "many").when(m.isin(2, 6), _null("string")).otherwise("1").alias("result"), F.when(m == 4, "days").alias("result_unit"),
    )
    return verify.verify(claims, nodes).select("claim_id", "status", "message")


_GAP_ID = sql_digest("node_drv_", "'DURATION'", "'DATE_DIFF'", "CAST(shipped - ordered AS VARCHAR)", "'2'", "'O:' || k || ',' || 'S:' || k || ':' || n")


@query(fx.ctes() + f"""SELECT k * 100 + n AS claim_id, {_GAP_ID} AS id, shipped - ordered AS duration_secs, k % 37 = 0 AS is_stale, CASE WHEN k % 37 = 0 THEN 'PARENT_NODE_STALE' END AS stale_reason
FROM fx_lines WHERE shipped >= ordered AND (k % 13 <> 0 OR k % 19 = 0)""")
def q_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, nodes, _ = _gap_claims(spark, sf_dir)
    return verify.derived(verify.verify(claims, nodes)).select("claim_id", "id", "duration_secs", "is_stale", "stale_reason")


@query(fx.ctes() + f"""SELECT k * 100 + n AS claim_id, {_GAP_ID} AS id, CASE WHEN k % 2 = 1 THEN 'NEW' WHEN k % 6 = 0 THEN 'CONFLICT' ELSE 'REUSED' END AS reuse
FROM fx_lines WHERE shipped >= ordered AND (k % 13 <> 0 OR k % 19 = 0)""")
def q_derive_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, nodes, _ = _gap_claims(spark, sf_dir)
    rows = stage(verify.derived(verify.verify(claims, nodes)), "derived").withColumn("k", F.floor(F.col("claim_id") / 100))
    known = rows.filter("k % 2 = 0")
    stored = known.select("id", F.when(F.col("k") % 6 == 0, F.col("duration_secs") + 1).otherwise(F.col("duration_secs")).alias("duration_secs"))
    edges = verify.new_edges(known).withColumn("edge_id", F.col("operand"))
    return verify.reuse(rows.drop("k"), stored, edges).select("claim_id", "id", "reuse")


@query(fx.ctes(_UNITS, _SHOWN.replace("FROM mixed, units", "FROM (SELECT k, n, shipped - ordered AS secs FROM fx_lines WHERE shipped >= ordered AND (k % 13 <> 0 OR k % 19 = 0)), units WHERE unit = 'weeks'"))
    + "SELECT k * 100 + n AS claim_id, CASE WHEN exact THEN '' ELSE 'approximately ' END || p || ' ' || CASE WHEN whole = 1 AND f = 0 THEN 'week' ELSE 'weeks' END AS text FROM plain")
def q_derive_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, nodes, _ = _gap_claims(spark, sf_dir)
    return verify.derived(verify.verify(claims, nodes)).select("claim_id", V.unit_display(F.col("duration_secs"), F.lit("weeks"))["text"].alias("text"))


@query(fx.ctes() + "SELECT k * 100 + n AS claim_id, CAST(i AS INT) AS place, CASE i WHEN 0 THEN 'P:' WHEN 1 THEN 'X:' ELSE 'Y:' END || k || ':' || n AS parent_id, CASE i WHEN 0 THEN price WHEN 1 THEN discount ELSE tax END AS number_val FROM fx_lines, range(3) r(i)")
def q_claim_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verify.with_parents(*_price_claims(spark, sf_dir))
    return out.select("claim_id", F.explode(F.arrays_zip("parents", "parent_ids")).alias("p")).select("claim_id", "p.parents.place", F.col("p.parent_ids").alias("parent_id"), "p.parents.number_val")


_ROOT = sql_digest("node_raw_", "'orders/' || k || '.csv'", "CAST(n + 1 AS VARCHAR)", "'0'", "'NUMBER'", sql_number("price"))


@query(fx.ctes() + f"SELECT k, n, {_ROOT} AS id FROM fx_lines")
def q_root_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.view(spark, sf_dir, "fx_lines")
    path = _str("orders/", F.col("k"), ".csv")
    return own.select("k", F.col("n").cast("bigint").alias("n"), V.root_id(path, F.col("n") + 1, F.lit(0), F.lit("NUMBER"), V.number_text(F.col("price"))).alias("id"))


# Extraction


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(prepared(spark) and table(spark, sf_dir, "documents"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), "text")


_NUMBER = r"[0-9][0-9.,]*(?:[eE][+-]?[0-9]+)?"
_WORD = r"[\p{L}\p{N}_]"
_UNIT_LIST = ", ".join(f"'{u}'" for u in N.UNIT_SUFFIXES)
#: Tokens of the documents' lines in SQL. The documents hold no ISO dates and no digits beyond ASCII, so nothing is masked.
_TOKENS = rf"""lines AS (SELECT doc_id, unnest(generate_series(0, len(parts) - 1)) AS line, unnest(parts) AS t, whole FROM (SELECT doc_id, text AS whole, string_split_regex(text, '\r?\n') AS parts FROM documents WHERE text IS NOT NULL)
), found AS (SELECT *, regexp_extract_all(t, '{_NUMBER}') AS f, string_split_regex(t, '{_NUMBER}') AS g FROM lines WHERE regexp_matches(t, '[0-9]')
), each AS (SELECT doc_id, line, i - 1 AS "at", rtrim(f[i], '.,') AS raw, right(coalesce(CASE WHEN i > 1 THEN f[i - 1] END, ''), 1) || g[i] AS l, substr(f[i], length(rtrim(f[i], '.,')) + 1) || coalesce(g[i + 1], '') || coalesce(f[i + 1], '') AS r
    FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM found)
), tokens AS (SELECT *, NOT regexp_matches(l, '{_WORD}$') AND (w = '' OR (lower(w) IN ({_UNIT_LIST}) AND regexp_matches(w, '^[A-Za-z]+$') AND NOT regexp_matches(raw, '[eE]')))
    AND NOT (regexp_matches(raw, '[eE]') AND NOT contains(raw, '.') AND regexp_matches(l, '[A-Za-z0-9_]-$')) AS admitted FROM (SELECT *, regexp_extract(r, '^{_WORD}+') AS w FROM each))"""
#: Their values, for tokens without a comma (the documents' tokens have none) in the convention with a decimal point.
_VALUES = rf"""signed AS (SELECT *, CASE WHEN regexp_matches(before, '{_WORD}$') OR length(run) - length(replace(run, '-', '')) >= 2 THEN '' ELSE run END AS sign FROM (
    SELECT *, substr(bare, length(before) + 1) AS run FROM (SELECT *, regexp_replace(bare, '[-+(]+$', '') AS before FROM (SELECT *, regexp_replace(l, '[$€£¥]$', '') AS bare FROM tokens WHERE admitted)))
), valued AS (SELECT *, CASE WHEN regexp_matches(raw, '^[0-9]*\.?[0-9]*([eE][+-]?[0-9]+)?$') THEN CAST(raw AS DOUBLE) * CASE WHEN starts_with(sign, '-') <> (contains(sign, '(') AND starts_with(r, ')')) THEN -1 ELSE 1 END END AS x FROM signed)"""


@query(f"""WITH {_TOKENS}, {_VALUES} SELECT 'documents/' || doc_id AS file_path, line + 1 AS line, row_number() OVER (PARTITION BY doc_id, line ORDER BY "at") - 1 AS occurrence, 'NUMBER' AS value_kind, CASE WHEN x = 0 THEN 0.0 ELSE x END AS number_val
FROM valued WHERE x IS NOT NULL""")
def q_extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_documents(spark, sf_dir)).select("file_path", F.col("line").cast("bigint").alias("line"), F.col("occurrence").cast("bigint").alias("occurrence"), "value_kind", "number_val")


@query(f"""WITH {_TOKENS}, {_VALUES}, counted AS (SELECT doc_id, count(x) AS n, count(*) - count(x) AS bad FROM valued GROUP BY doc_id)
SELECT 'documents/' || d.doc_id AS file_path, coalesce(n, 0) AS n_values, coalesce(bad, 0) AS n_malformed FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id""")
def q_extract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.counts(_documents(spark, sf_dir)).select("file_path", F.col("n_values").cast("bigint").alias("n_values"), F.col("n_malformed").cast("bigint").alias("n_malformed"))


@query(f"""WITH {_TOKENS} SELECT doc_id, CAST(line AS INT) AS line, CAST("at" AS INT) AS "at", raw, admitted FROM tokens""")
def q_token_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepared(spark) and table(spark, sf_dir, "documents")
    tokens = own.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.col("text").rlike("[0-9]")).select("doc_id", "line", F.posexplode(N.tokens(N.masked(F.col("text")))).alias("at", "t"))
    return tokens.select("doc_id", "line", "at", "t.raw", N.admitted(F.col("t")).alias("admitted"))


#: One text for each order: a date, an amount in one of two conventions, a plain number.
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepared(spark) and table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    eu = F.col("o_orderkey") % 2 == 0
    whole = F.floor(cents / 100).cast("bigint")
    us_text = F.format_number(whole, 0)
    amount = F.when(eu, F.concat(F.translate(us_text, ",", "."), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))).otherwise(F.concat(us_text, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))
    content = F.concat(F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" is "), amount, F.lit("\nwidth "), (F.col("o_orderkey") % 1000).cast("string"), F.lit("px and item-"), F.col("o_orderkey").cast("string"), F.lit("x\n"), F.lit("seen "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))
    return own.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("file_path"), content.alias("content"), _null("string").alias("number_format"))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""SELECT 'orders/' || o_orderkey AS file_path, 1 AS line, 0 AS occurrence, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS secs FROM orders
UNION ALL SELECT 'orders/' || o_orderkey, 3, 0, CAST(epoch(o_orderdate) AS BIGINT) - 3600 FROM orders""")
def q_extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.extract(_rendered(spark, sf_dir)).filter("value_kind = 'DATE'")
    return out.select("file_path", "line", "occurrence", F.unix_seconds("date_val").alias("secs"))


@query(f"""SELECT 'orders/' || o_orderkey AS file_path, CASE WHEN o_orderkey % 2 = 0 AND {_CENTS} >= 100000 THEN 'eu' ELSE 'us' END AS number_format FROM orders""")
def q_extract_auto_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_format(_rendered(spark, sf_dir)).select("file_path", "number_format")


@query(f"""SELECT 'orders/' || o_orderkey AS file_path, 1 AS line, 1 AS occurrence, CAST({_CENTS} AS BIGINT) AS cents FROM orders WHERE o_orderkey % 2 = 1 OR {_CENTS} >= 100000
UNION ALL SELECT 'orders/' || o_orderkey, 1, 1, {_CENTS} // 100 * 100 FROM orders WHERE o_orderkey % 2 = 0 AND {_CENTS} < 100000
UNION ALL SELECT 'orders/' || o_orderkey, 1, 2, {_CENTS} % 100 * 100 FROM orders WHERE o_orderkey % 2 = 0 AND {_CENTS} < 100000
UNION ALL SELECT 'orders/' || o_orderkey, 2, 0, (o_orderkey % 1000) * 100 FROM orders""")
def q_extract_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts below 1,000 in the convention with a decimal comma are two numbers: nothing in their text tells otherwise."""
    out = extract.extract(_rendered(spark, sf_dir)).filter("value_kind = 'NUMBER'")
    cents = F.round(F.col("number_val") * 100).cast("bigint")
    return out.select("file_path", "line", "occurrence", cents.alias("cents"))


@query("""SELECT 'nation/' || c_nationkey AS file_path, count(*) AS n_values, count(*) FILTER (WHERE nth <= 40) AS n_kept FROM (
    SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer) GROUP BY 1""")
def q_value_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation with a line for each customer; of what is extracted the first 40 values are kept."""
    own = prepared(spark) and table(spark, sf_dir, "customer")
    files = own.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("keys"))
    content = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("customer "), k.cast("string"))), "\n")
    values = extract.extract(files.select(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("file_path"), content.alias("content"), _null("string").alias("number_format")))
    return record.within_limit(stage(values, "values"), 40).groupBy("file_path").agg(F.count("*").alias("n_values"), F.count_if("kept").alias("n_kept"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(1 AS BIGINT) AS place, CAST(1234 AS BIGINT) AS amount FROM orders")
def q_extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of text files, in the order of their keys, which follow each other: a line's number less its place among the file's keys is one."""
    own = table(prepared(spark), sf_dir, "orders")
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    own.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of 1.234,50"))).write.text(folder)
    values = stage(extract.extract_lines(text_lines(spark, folder, "part-*")), "values")
    keys = values.filter("occurrence = 0").select("file_path", "line", F.col("number_val").cast("bigint").alias("k"))
    amounts = values.filter("occurrence = 1").select(F.col("file_path").alias("_p"), F.col("line").alias("_l"), F.floor("number_val").alias("amount"))
    first = keys.groupBy(F.col("file_path").alias("_f")).agg(F.min("k").alias("first"))
    met = keys.join(amounts, (F.col("file_path") == F.col("_p")) & (F.col("line") == F.col("_l"))).join(first, F.col("file_path") == F.col("_f"))
    return met.select(F.col("k").cast("string").alias("k"), (F.col("line") - F.col("k") + F.col("first")).alias("place"), "amount")
