"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.sources import staging
from valuegrain.sources.staging import drop_stage, shared_dir  # noqa: F401  for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_BYTE_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` is that for ASCII texts and much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8(text: str | None) -> bytes:
    """Bytes of a text; a null is empty. Spark strings are valid UTF-8 wherever Arrow accepts them."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def utf8_lower(text: str | None) -> bytes:
    return utf8(text).translate(_BYTE_LOWER)


def words_of(data: bytes) -> list[bytes]:
    """Words of the class [^\\x20\\x09-\\x0D]: just what bytes.split() splits at."""
    return data.split()


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def stage(df: DataFrame, name: str) -> DataFrame:
    """A staged copy of a table, compressed harder: what is staged here grows with the corpus."""
    return staging.stage(df, name, {"compression": "zstd"})


CARRIED = "_carried"


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list[str | None]], list[list]]],
    carry: list[str] | None = None,
    also: list[str] | None = None,
) -> DataFrame:
    """Add columns that Python derives from whole texts, one Arrow batch at a time.

    ``make`` is called once a task and returns a function from the batch's texts (and the
    lists of the ``also`` columns) to one list for each field. The carried columns travel in
    one struct, so their names never clash with the fields'. No shuffle, no state beyond a batch.
    """
    carried = df.columns if carry is None else carry
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias(CARRIED) if carried else F.lit(True).alias(CARRIED),
        F.col(f"`{text_col}`").alias("_text"),
        *[F.col(f"`{c}`").alias(f"_also{i}") for i, c in enumerate(also or [])],
    )
    schema = T.StructType([packed.schema[CARRIED], *[T.StructField(n, t) for n, t in fields]])
    arrow = [to_arrow(t) for _, t in fields]
    n_also = len(also or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            args = [batch.column(1 + i).to_pylist() for i in range(1 + n_also)]
            made = work(*args)
            columns = [batch.column(0)] + [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[CARRIED, *[n for n, _ in fields]])

    return packed.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def carried_but(df: DataFrame, *names: str) -> list[Column]:
    """All carried columns but those with the names of new ones, which replace them."""
    return unpack(df, *[c for c in df.schema[CARRIED].dataType.names if c not in names])


def unpack(df: DataFrame, *names: str) -> list[Column]:
    """Carried columns as top-level ones."""
    return [F.col(f"{CARRIED}.`{n}`").alias(n) for n in names]
