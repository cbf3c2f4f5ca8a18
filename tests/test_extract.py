import random

import pytest
from pyspark.sql import functions as F

from valuegrain.operators import record
from valuegrain.operators.extract import counts, extract, extract_lines, malformed
from valuegrain.sources import tables

#: text, format, expected values (dates as ISO days), malformed candidates
CASES = [
    ("revenue,120000", "us", [120000.0], 0), ("1,234.56", "us", [1234.56], 0), ("1.234,56", "eu", [1234.56], 0), ("1.234,56", "us", [], 1), ("1,234.56", "eu", [], 1),
    ("(500)", "us", [-500.0], 0), ("-(500)", "us", [500.0], 0), ("-42 and +7", "us", [-42.0, 7.0], 0), ("$1,000,000", "us", [1000000.0], 0), ("10,200,300", "us", [10.0, 200.0, 300.0], 0), ("sum 10,200,300", "us", [10200300.0], 0),
    ("1,000,000", "us", [1000000.0], 0), ("10,20,30", "us", [10.0, 20.0, 30.0], 0), ("-1,2", "us", [-1.0, 2.0], 0), ("12.5kg 99.9ms 100GB", "us", [12.5, 99.9, 100.0], 0), ("1st 4faf 0x1a2b foo123", "us", [], 0),
    ("96a3adc0-f76e-4faf-81e6-5b0578c2c46d", "us", [], 0), ("1.5e3 2e-2", "us", [1500.0, 0.02], 0), ("--100", "us", [100.0], 0), ("a-5", "us", [5.0], 0), ("2026-01-15,500", "us", ["2026-01-15", 15500.0], 0),
    ("on 2026-01-15 it was 5.", "us", ["2026-01-15", 5.0], 0), ("2026-13-40 x 7", "us", [7.0], 1), ("2024-02-29T10:00:00Z 3", "us", ["2024-02-29", 3.0], 0), ("1.2.3", "us", [], 1), ("-0", "us", [0.0], 0), ("5m2", "us", [2.0], 0) if False else ("5m 2", "us", [5.0, 2.0], 0),
    ("0,123", "us", [0.0, 123.0], 0), ("€5", "us", [5.0], 0), ("-$5", "us", [-5.0], 0), ("($5)", "us", [-5.0], 0), ("1.234.567", "eu", [1234567.0], 0), ("3,5", "eu", [3.5], 0), ("1" * 320, "us", [], 1), ("", "us", [], 0), ("none", "us", [], 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"{i:03d}", t, f) for i, (t, f, _, _) in enumerate(CASES)], "file_path string, content string, number_format string")


def test_vectors(spark, docs):
    rows = extract(docs).withColumn("day", F.date_format("date_val", "yyyy-MM-dd")).orderBy("file_path", "line", "occurrence").collect()
    bad = {r.file_path: r.n_malformed for r in malformed(docs).collect()}
    for i, (text, form, want, n) in enumerate(CASES):
        own = [r.number_val if r.value_kind == "NUMBER" else r.day for r in rows if r.file_path == f"{i:03d}"]
        assert own == want and bad.get(f"{i:03d}", 0) == n, (text, form, own, bad.get(f"{i:03d}", 0))


def test_lines_occurrences_and_auto(spark):
    df = spark.createDataFrame([("a", "1 1\r\n2 2026-01-02\n", None), ("b", "x 1.000,5\n2.000", "auto"), ("c", None, None)], "file_path string, content string, number_format string")
    rows = [(r.file_path, r.line, r.occurrence, r.value_kind, r.number_val) for r in extract(df).orderBy("file_path", "line", "occurrence").collect()]
    assert rows == [("a", 1, 0, "NUMBER", 1.0), ("a", 1, 1, "NUMBER", 1.0), ("a", 2, 0, "DATE", None), ("a", 2, 1, "NUMBER", 2.0), ("b", 1, 0, "NUMBER", 1000.5), ("b", 2, 0, "NUMBER", 2000.0)]
    assert {r.file_path: (r.n_values, r.n_malformed) for r in counts(df).collect()} == {"a": (4, 0), "b": (2, 0), "c": (0, 0)}


def test_files_in_splits_equal_whole_texts(spark, tmp_path):
    """Files of some MB read in splits of 64 KB: numbers, lines and formats are those of the whole texts."""
    rng = random.Random(2)
    line = lambda i: rng.choice([f"row {i} is {rng.randrange(10**6)}", "no digit", "", f"on 2024-03-{i % 28 + 1:02d} -{i}.5e1", "x " * 40 + str(i)])
    whole = {}
    for name, first in (("a", "1.234,5"), ("b", "1,234.5"), ("c", "")):
        rows = [line(i) for i in range(40_000 if name == "a" else 9_000)]
        rows[20_000 % len(rows)] = first  # far from the file's start
        rows[-1] = "9.876,5" if name == "b" else "last 7"
        whole[name] = ("\r\n" if name == "b" else "\n").join(rows) + ("" if name == "a" else "\n")
        (tmp_path / f"{name}.txt").write_bytes(whole[name].encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        lines = tables.text_lines(spark, str(tmp_path), "*.txt")
        assert lines.rdd.getNumPartitions() > 10
        assert lines.agg(F.max(F.octet_length("text"))).first()[0] < 1000
        got = {(r.file_path.rsplit("/", 1)[-1][0], *r[1:]) for r in extract_lines(lines).collect()}
    finally:
        for name, x in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{name}", x)
    docs = spark.createDataFrame([(k, v, None) for k, v in whole.items()], "file_path string, content string, number_format string")
    assert got == {tuple(r) for r in extract(docs).collect()}
    given = {r.number_val for r in extract_lines(tables.text_lines(spark, str(tmp_path), "c.txt"), "EU").collect()}
    assert given and None not in {r.line for r in extract_lines(tables.text_lines(spark, str(tmp_path), "c.txt")).collect()}


def test_the_limit_orders_one_block_only(spark):
    """One source has most of the values; its order is needed only in the block in which the limit lies."""
    rng = random.Random(3)
    rows = [("hot", i // 3, i % 3) for i in range(9_000)] + [("cold", i, 0) for i in range(20)] + [("edge", i, 0) for i in range(100)] + [(None, 1, 0)]
    rng.shuffle(rows)
    values = spark.createDataFrame(rows, "file_path string, line int, occurrence int").repartition(5)
    for limit in (1, 100, 3072, 3073, 5000, 100_000):
        out = record.within_limit(values, limit)
        kept = {(r.file_path, r.line, r.occurrence) for r in out.filter("kept").collect()}
        assert kept == {r for name in ("hot", "cold", "edge", None) for r in sorted(x for x in rows if x[0] == name)[:limit]} and out.count() == len(rows)
    window = [x for x in record.within_limit(values, 5000)._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number" in x and "Window" in x]
    assert window and all("_block" in x for x in window)
