"""Raw tickets from CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline import constants as C
from kerbline.schema import VIOLATIONS_RAW
from kerbline.session import use_utc
from kerbline.sources.records import read_csv_records

# Tried in this order after Spark's own ISO forms; month-first before day-first.
TIMESTAMP_FORMATS = (
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy",
    "M-d-yyyy H:mm:ss", "M-d-yyyy H:mm", "M-d-yyyy",
    "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy",
    "d MMM yyyy H:mm:ss", "d MMM yyyy", "MMM d, yyyy H:mm:ss", "MMM d, yyyy",
    "yyyy-M-d h:mm:ss a", "yyyy-M-d h:mm a", "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "d/M/yyyy h:mm:ss a", "d/M/yyyy h:mm a",
    "M-d-yyyy h:mm:ss a", "M-d-yyyy h:mm a", "MMM d, yyyy h:mm:ss a", "d MMM yyyy h:mm:ss a",
    "M/d/yyyy H:mm:ss.SSSSSS", "M/d/yyyy H:mm:ss.SSS", "d/M/yyyy H:mm:ss.SSSSSS", "d/M/yyyy H:mm:ss.SSS",
)


def parse_timestamp(text: Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """Each value parsed on its own; no zone means UTC; unknown forms give null."""
    plain = F.trim(text)
    return F.coalesce(plain.try_cast("timestamp"), *[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


def read_violations_text(spark: SparkSession, path: str, schema: T.StructType = VIOLATIONS_RAW,
                         multi_line: bool = False) -> DataFrame:
    """The CSV as text columns, with the missing-value texts turned into nulls.

    ``multi_line`` allows line breaks inside quotes; files are then read twice, and still in splits.
    """
    use_utc(spark)
    return known_texts(read_csv_records(spark, path, schema) if multi_line else text_reader(spark.read, schema).csv(path))


def text_reader(reader, schema: T.StructType = VIOLATIONS_RAW):
    """A batch or stream reader of ticket files: all columns as text, and a header in another order is an error."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return reader.schema(text).option("header", True).option("escape", '"').option("enforceSchema", False)


def known_texts(raw: DataFrame) -> DataFrame:
    """Texts that stand for a missing value become null."""
    return raw.select([F.when(~F.col(c).isin(*C.MISSING_TEXTS), F.col(c)).alias(c) for c in raw.columns])


def _typed(field: T.StructField, formats: tuple[str, ...]) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return parse_timestamp(value, formats)
    if isinstance(field.dataType, T.StringType):
        return value
    return F.trim(value).try_cast(field.dataType)


def type_violations(text: DataFrame, schema: T.StructType = VIOLATIONS_RAW,
                    formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> DataFrame:
    """Text columns to typed columns; values that do not parse become null."""
    return text.select([_typed(f, formats).alias(f.name) for f in schema])


def rejected_counts(text: DataFrame, schema: T.StructType = VIOLATIONS_RAW,
                    formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> DataFrame:
    """One row: per typed column, how many non-null texts did not parse."""
    checked = [f for f in schema if not isinstance(f.dataType, T.StringType)]
    return text.agg(*[
        F.count_if(F.col(f.name).isNotNull() & _typed(f, formats).isNull()).alias(f.name) for f in checked
    ])


def rejected_rows(text: DataFrame, schema: T.StructType = VIOLATIONS_RAW,
                  formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> DataFrame:
    """The texts of rows without id or with a value that does not parse, and the names of these columns."""
    lost = [
        F.when(F.col(f.name).isNotNull() & _typed(f, formats).isNull() if f.nullable else _typed(f, formats).isNull(), F.lit(f.name))
        for f in schema if not f.nullable or not isinstance(f.dataType, T.StringType)
    ]
    return text.withColumn("rejected", F.array_compact(F.array(*lost))).where(F.size("rejected") > 0)


def read_violations(spark: SparkSession, path: str, schema: T.StructType = VIOLATIONS_RAW,
                    formats: tuple[str, ...] = TIMESTAMP_FORMATS, multi_line: bool = False) -> DataFrame:
    return type_violations(read_violations_text(spark, path, schema, multi_line), schema, formats)


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids that occur more than once; labels assume there are none."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
