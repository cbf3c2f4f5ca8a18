"""Typed values out of texts: one row for each number and date, with line and occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.functions import numbers as N
from valuegrain.sources.staging import stage

KIND = "struct<value_kind:string,number_val:double,date_val:timestamp>"


def with_format(docs: DataFrame) -> DataFrame:
    """``number_format`` resolved once for each text."""
    given = F.lower(F.coalesce(F.col("number_format"), F.lit("auto")))
    return docs.withColumn("number_format", F.when(given.isin("us", "eu"), given).otherwise(N.auto_format(F.coalesce("content", F.lit("")))))


def found(line: Column, number_format: Column) -> Column:
    """All candidates of a line: dates first, then numbers; both typed columns are null in a malformed one."""
    ts, double = F.lit(None).cast("timestamp"), F.lit(None).cast("double")
    dates = F.transform(N.dates(line), lambda d: F.struct(F.lit("DATE").alias("value_kind"), double.alias("number_val"), N.date_value(d).alias("date_val")))
    blanks = line.rlike("[ \t]")
    eu = number_format == "eu"
    each = F.transform(F.filter(N.tokens(N.masked(line)), N.admitted), lambda t: F.transform(N.values(t, eu, blanks), lambda x: F.struct(F.lit("NUMBER").alias("value_kind"), x.alias("number_val"), ts.alias("date_val"))))
    return F.concat(dates.cast(f"array<{KIND}>"), F.flatten(each).cast(f"array<{KIND}>"))


def lines(docs: DataFrame) -> DataFrame:
    """(file_path, line, found): one row for each line with a digit."""
    own = with_format(docs).select("file_path", "number_format", F.posexplode(F.split("content", "\r?\n")).alias("at", "text")).filter(F.col("text").rlike(r"(?U)\d"))
    return own.select("file_path", (F.col("at") + 1).alias("line"), found(F.col("text"), F.col("number_format")).alias("found"))


def _good(v: Column) -> Column:
    return v["number_val"].isNotNull() | v["date_val"].isNotNull()


def extract(docs: DataFrame) -> DataFrame:
    """(file_path, line, occurrence, value_kind, number_val, date_val) of (file_path, content, number_format).

    Occurrences count the values of a line from 0; malformed candidates don't advance them.
    """
    out = lines(docs).select("file_path", "line", F.posexplode(F.filter("found", _good)).alias("occurrence", "v"))
    return out.select("file_path", "line", "occurrence", "v.*")


def extract_lines(rows: DataFrame, number_format: str = "auto") -> DataFrame:
    """As ``extract``, of lines (file_path, line, text) as ``sources.tables.text_lines`` reads them: a text of any size, no row of which is more than a line.

    An automatic format is that of the file's first line whose numbers tell one; a first pass finds it.
    """
    own = rows.filter(F.col("text").rlike(r"(?U)\d"))
    if number_format.lower() in ("us", "eu"):
        known = own.withColumn("number_format", F.lit(number_format.lower()))
    else:
        told = own.select("file_path", "line", N.shaped(F.col("text")).alias("shape")).filter("shape is not null")
        formats = stage(told.groupBy(F.col("file_path").alias("_p")).agg(F.min_by("shape", "line").alias("number_format")), "formats")
        known = own.join(formats, F.col("file_path") == F.col("_p"), "left").withColumn("number_format", F.coalesce("number_format", F.lit("us")))
    out = known.select("file_path", "line", F.posexplode(F.filter(found(F.col("text"), F.col("number_format")), _good)).alias("occurrence", "v"))
    return out.select("file_path", "line", "occurrence", "v.*")


def malformed(docs: DataFrame) -> DataFrame:
    """(file_path, line, n_malformed) of lines with malformed candidates."""
    return lines(docs).select("file_path", "line", F.size(F.filter("found", lambda v: ~_good(v))).alias("n_malformed")).filter("n_malformed > 0")


def counts(docs: DataFrame) -> DataFrame:
    """(file_path, n_values, n_malformed) of every text."""
    own = lines(docs).groupBy("file_path").agg(F.sum(F.size(F.filter("found", _good))).alias("n_values"), F.sum(F.size(F.filter("found", lambda v: ~_good(v)))).alias("n_malformed"))
    every = docs.select(F.col("file_path").alias("_p")).distinct()
    return every.join(own, F.col("_p") == F.col("file_path"), "left").select(F.col("_p").alias("file_path"), F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_malformed", F.lit(0)).alias("n_malformed"))
