"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.session import scratch_path

#: Fixed value: what separates words, as a Java and Python character class.
SPACES = r"[ \x09-\x0D]+"
#: The same characters as a list, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: work is done once and survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, also where lambdas inside use it often."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def boxed(docs: DataFrame) -> DataFrame:
    """Rows as one struct `row`, so that no column of the input can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unboxed(df: DataFrame, names: list[str], text: Column | None = None) -> DataFrame:
    """The boxed columns again, `text` replaced where one is given."""
    fields = [(F.col("row")[c] if c != "text" or text is None else text).alias(c) for c in names]
    return df.select(*fields)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL; the right side's keys go."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    joined = left.join(other, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"_r_{k}" for k in keys])
