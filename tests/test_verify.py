import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from valuegrain.operators.verify import verify
from valuegrain.plans import formula

NODES = [("p0", "NUMBER", 10.0, None, None), ("p1", "NUMBER", 4.0, None, None), ("z", "NUMBER", 0.0, None, None), ("d1", "DURATION", None, None, 7), ("d2", "DURATION", None, None, 8)]
#: parents, operation, formula, claim, unit, status, message
CASES = [
    (["p0", "p1"], "EXPRESSION", "a + b", "14", None, "OK", ""), (["p0", "p1"], "EXPRESSION", "a + b", "15", None, "MISMATCH", "VALUE"), (["p0", "p1"], "EXPRESSION", "a - b ^ 2", "-6", None, "OK", ""), (["p0", "p1"], "EXPRESSION", "-a ^ 2 + b*0", "-100", None, "OK", ""),
    (["p0", "p1"], "EXPRESSION", "a / b % 2", "0.5", None, "OK", ""), (["p0", "z"], "EXPRESSION", "a / b", "1", None, "INVALID_INPUT", "NOT_FINITE"), (["p0"], "EXPRESSION", "a + b", "1", None, "INVALID_INPUT", "EXPRESSION"), (["p0", "p1"], "EXPRESSION", "a", "10", None, "INVALID_INPUT", "EXPRESSION"),
    (["p0"], "EXPRESSION", "sin(a)", "1", None, "INVALID_INPUT", "EXPRESSION"), (["p0"], "EXPRESSION", "((a)", "1", None, "INVALID_INPUT", "EXPRESSION"), (["p0"], "EXPRESSION", "2*50 + a*0", "100", None, "OK", ""), (["d1", "d2"], "DURATION_SUM", None, "15", "seconds", "OK", ""),
    (["d1", "d2"], "DURATION_SUM", None, "0.25", "minutes", "OK", ""), (["d1", "d2"], "DURATION_AVG", None, None, None, "INVALID_INPUT", "NOT_EXACT"), (["d1", "p0"], "DURATION_SUM", None, None, None, "INVALID_INPUT", "PARENT_KIND"), (["d1", "gone"], "DURATION_SUM", None, None, None, "INVALID_INPUT", "MISSING_PARENT"),
    (["d1", "d1"], "DURATION_SUM", None, None, None, "INVALID_INPUT", "PARENT_COUNT"), (["d1", "d2"], "duration_sum", None, None, None, "INVALID_INPUT", "OPERATION"), (["p0"], "EXPRESSION", "a", None, None, "INVALID_INPUT", "RESULT"),
]


def test_claims(spark):
    nodes = spark.createDataFrame([(*n, False) for n in NODES], "id string, value_kind string, number_val double, date_val timestamp, duration_secs long, is_stale boolean")
    claims = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], "claim_id long, parent_ids array<string>, operation string, expression string, result string, result_unit string")
    got = {r.claim_id: (r.status, r.message) for r in verify(claims, nodes).collect()}
    assert [(CASES[i], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][5:]] == []


def test_grammar():
    assert formula.names("a*(b+e)") == {0, 1, 4}
    for text in ("ab", "a b", "a+", "(a", "a)", "A", "a;b", "", "a" * 5000, "(" * 300 + "a" + ")" * 300):
        with pytest.raises(formula.FormulaError):
            formula.to_column(text, F.array(F.lit(1.0)))


def test_many_formulas_in_tasks(spark):
    """Ten thousand formulas give what the first of them give as Columns."""
    forms = ["a / b", "a % b", "a ^ b", "-a ^ 2", "(a + b) * 1.5e1 - a", "b - a / 0", "a %% b", "2 ^ 3 ^ a", "a + z", "(a", "b * (a - a)", "a", ""] + [f"a * {i} + b - {i}.5" for i in range(10_000)]
    nodes = spark.createDataFrame([("x", "NUMBER", 7.0, None, None, False), ("y", "NUMBER", -2.5, None, None, False), ("d", "DURATION", None, None, 90, False)], "id string, value_kind string, number_val double, date_val timestamp, duration_secs long, is_stale boolean")
    rows = [(i, ["x", "y"] if "b" in f or "z" in f else ["x"], "EXPRESSION", f, "1", None) for i, f in enumerate(forms)] + [(-1, ["d"], "EXPRESSION", "a * 2", "180", None)]
    schema = "claim_id long, parent_ids array<string>, operation string, expression string, result string, result_unit string"
    out = {r.claim_id: r for r in verify(spark.createDataFrame(rows, schema), nodes).collect()}
    assert len(out) == len(rows) and out[-1].status == "OK" and "durations as their seconds" in out[-1].warning and out[0].warning is None
    given = spark.createDataFrame([(r[0], r[3], [7.0, -2.5][: len(r[1])]) for r in rows[:40]], "i long, f string, p array<double>")
    value, known = formula.evaluate([r[3] for r in rows[:40]], F.col("f"), F.col("p"))
    own = formula.in_tasks(F.col("f"), F.col("p"))
    for r in given.select("i", value.alias("v"), known.alias("k"), own["value"].alias("w"), own["known"].alias("l")).collect():
        assert r.k == r.l and (not r.k or (r.v is None or r.v != r.v or abs(r.v) == float("inf")) == (r.w is None)), r
        assert r.w is None or abs(r.v - r.w) <= 1e-12 * abs(r.v), r
    assert all(abs(out[i + 13].number - (7.0 * i - 2.5 - i - 0.5)) < 1e-9 for i in range(0, 10_000, 97))


def test_shapes():
    """Formulas that differ in their decimals only are translated once, and computed with their own decimals."""
    formula._kernel.cache_clear()
    texts = [f"a * {i} + {i}e-1 - .5" for i in range(500)] + ["2 3", "a 1", "2e.5", "a 2e", None, "1", "a"]
    values, known = formula.evaluated(texts, pa.array([[2.0]] * 505 + [[], [2.0]]))
    assert formula._kernel.cache_info().misses == 7
    assert [abs(v - (2.0 * i + i / 10 - 0.5)) < 1e-9 for i, v in enumerate(values[:500])] == [True] * 500
    assert known.tolist() == [True] * 500 + [False] * 5 + [True, True] and values[505:].tolist() == [1.0, 2.0]


def test_claims_are_read_once(spark, tmp_path):
    """What is wrong before any parent is looked up is judged with the rest: the verdicts rest on one staged table."""
    nodes = spark.createDataFrame([(*n, False) for n in NODES], "id string, value_kind string, number_val double, date_val timestamp, duration_secs long, is_stale boolean")
    rows = [(1, ["d1", "d2"], "DURATION_SUM", None, "15", None), (2, ["d1"] * 30, "EXPRESSION", "a", "1", None)]
    spark.createDataFrame(rows, "claim_id long, parent_ids array<string>, operation string, expression string, result string, result_unit string").write.parquet(str(tmp_path / "claims"))
    out = verify(spark.read.parquet(str(tmp_path / "claims")), nodes)
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    got = {r.claim_id: (r.parent_ids, r.parents and len(r.parents), r.secs, r.message) for r in out.collect()}
    assert got == {1: (["d1", "d2"], 2, 15, ""), 2: (["d1"] * 30, None, None, "PARENT_COUNT")}
