from pyspark.sql import functions as F

from valuegrain.functions import values as V
from valuegrain.functions.text import absolute_path, command_path, iri_part, relative_path, turtle_literal


def test_duration_text(spark):
    cases = [(864000, "10d"), (8130, "2h 15m 30s"), (3605, "1h 0m 5s"), (0, "0s"), (-432000, "-5d"), (86401, "1d 1s"), (93600, "1d 2h"), (93605, "1d 2h 0m 5s"), (86460, "1d 0h 1m"), (60, "1m"), (59, "59s"), (3660, "1h 1m")]
    got = spark.createDataFrame(cases, "s long, want string").select("want", V.duration_text(F.col("s")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_number_text(spark):
    cases = [(100.0, "100"), (0.0, "0"), (1234.5, "1234.5"), (-2.25, "-2.25"), (123456789012345.0, "123456789012345")]
    assert all(r.want == r.got for r in spark.createDataFrame(cases, "x double, want string").select("want", V.number_text(F.col("x")).alias("got")).collect())


def test_claims_are_exact(spark):
    cases = [
        ("7", "days", 604800), ("4.5e1", "days", 3888000), (".1", "minutes", 6), ("6" + "0" * 40 + "e-38", "seconds", 600), ("1.5", "seconds", None), ("", "days", None), ("1", "day", None), ("1e129", "seconds", None),
        ("-2", "hours", -7200), ("+3.0", "weeks", 1814400), ("0e5", "days", 0), (".", "days", None), ("1..2", "days", None), ("9223372036854775", "seconds", 9223372036854775), ("9223372036854776", "seconds", None), ("0.0000001", "weeks", None), ("1e-7", "weeks", None), ("5e-1", "hours", 1800),
    ]
    got = spark.createDataFrame(cases, "x string, unit string, want long").select("x", "want", V.claim_seconds(F.col("x"), F.col("unit")).alias("got")).collect()
    assert [r for r in got if r.want != r.got] == []


def test_unit_display(spark):
    cases = [(3888000, "days", "45 days", False), (1, "minutes", "approximately 0.016666666667 minutes", True), (86400, "days", "1 day", False), (-5400, "hours", "-1.5 hours", False), (0, "weeks", "0 weeks", False)]
    got = spark.createDataFrame(cases, "s long, unit string, want string, about boolean").withColumn("d", V.unit_display(F.col("s"), F.col("unit"))).collect()
    assert all(r.d.text == r.want and r.d.approximate == r.about for r in got), got


def test_xsd_duration(spark):
    cases = [(0, "PT0S"), (86400, "P1D"), (-90061, "-P1DT1H1M1S"), (59, "PT59S"), (3600, "PT1H")]
    assert all(r.want == r.got for r in spark.createDataFrame(cases, "s long, want string").select("want", V.xsd_duration(F.col("s")).alias("got")).collect())


def test_identities(spark):
    df = spark.range(1).select(
        V.duration_id(F.array(F.lit("a"), F.lit("b")), F.lit("DURATION_SUM"), F.lit(5)).alias("ab"), V.duration_id(F.array(F.lit("b"), F.lit("a")), F.lit("DURATION_SUM"), F.lit(5)).alias("ba"),
        V.duration_id(F.array(F.lit("a"), F.lit("b")), F.lit("DATE_DIFF"), F.lit(5)).alias("dab"), V.duration_id(F.array(F.lit("b"), F.lit("a")), F.lit("DATE_DIFF"), F.lit(5)).alias("dba"),
        *[V.root_id(F.lit("p"), F.lit(1), F.lit(o), F.lit("NUMBER"), F.lit("7")).alias(f"r{o}") for o in (0, 1)],
    ).first()
    assert df.ab == df.ba and df.dab != df.dba and df.r0 != df.r1


def test_tolerance(spark):
    inf = float("inf")
    cases = [(1.0, 1.0, True), (1.0, 1.0 + 1e-10, True), (1.0, 1.001, False), (0.0, 1e-15, True), (0.0, 1e-9, False), (1e-20, -1e-20, False), (inf, inf, False), (float("nan"), 1.0, False)]
    assert all(r.want == r.got for r in spark.createDataFrame(cases, "a double, b double, want boolean").select("want", V.close(F.col("a"), F.col("b")).alias("got")).collect())


def test_paths_and_commands(spark):
    cases = [("head -n 3 f", "f"), ("grep -r x f", "f"), ("git status", None), ("rtk read a.csv", "a.csv"), ("rtk cat a.csv", None), ("cat -5 'b c'", "b"), ("tail -n x f", "x"), ("", None), (None, None), ("python3 -c 3 s.py", "s.py")]
    got = spark.createDataFrame(cases, "c string, want string").select("c", "want", command_path(F.col("c")).alias("got")).collect()
    assert [r for r in got if r.want != r.got] == []
    r = spark.range(1).select(iri_part(F.lit("a b~*é/")).alias("i"), turtle_literal(F.lit('a"\\\n\x01')).alias("t"), relative_path(F.lit("/p/a/b"), "/p").alias("r"), relative_path(F.lit("/q/a"), "/p").alias("o"), relative_path(F.lit("../x"), "/p").alias("c"), absolute_path(F.lit("a"), "/p").alias("x")).first()
    assert (r.i, r.t, r.r, r.o, r.c, r.x) == ("a%20b~%2A%C3%A9%2F", 'a\\"\\\\\\n\\u0001', "a/b", None, None, "/p/a")


def test_duration_units_of_every_order(spark):
    from valuegrain.plans import value_queries

    folder = "/root/testdata/sf0.001"
    scales = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}

    def shown(secs, unit):
        exact = abs(secs) * 10**12 % scales[unit] == 0
        whole, part = divmod((2 * abs(secs) * 10**12 + scales[unit]) // (2 * scales[unit]), 10**12)
        plain = f"{whole}.{part:012d}".rstrip("0") if part else str(whole)
        decimal = "-" * (secs < 0 and plain != "0") + plain
        return decimal, not exact, f"{'' if exact else 'approximately '}{decimal} {unit[:-1] if (whole, part) == (1, 0) else unit}"

    rows = value_queries._mixed(spark, folder).collect()
    want = [(r.k, r.n, u, *shown(r.secs, u)) for r in rows for u in scales]
    assert any(r.k % 5 for r in rows)
    assert sorted(tuple(r) for r in value_queries.q_duration_units(spark, folder).collect()) == sorted(want)
