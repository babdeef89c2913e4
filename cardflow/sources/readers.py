"""Typed CSV and parquet scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.functions.exprs import finite_or_null
from cardflow.sources import schemas

TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss"
DATE_PATTERN = "yyyy-MM-dd"


def lenient_timestamp(text: Column) -> Column:
    """Timestamp without zone; unreadable text becomes null."""
    return F.try_to_timestamp(text, F.lit(TIMESTAMP_PATTERN)).cast("timestamp_ntz")


def lenient_date(text: Column) -> Column:
    return F.try_to_date(text, DATE_PATTERN)


def label_value(text: Column) -> Column:
    """`"1.0"` -> 1, `"0"` -> 0; anything that is not a label -> null."""
    number = text.try_cast("double")
    return F.when(number == 1, F.lit(1)).when(number == 0, F.lit(0)).cast("byte")


def numbers_without_nan(df: DataFrame) -> DataFrame:
    """NaN is not null to an aggregate, so it is turned into null once, at ingest."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: finite_or_null(F.col(c)) for c in doubles}) if doubles else df


def _csv(spark: SparkSession, path: str, schema: T.StructType, keep_others: bool = False) -> DataFrame:
    """The columns of `schema` by name, whatever their order in the files; unreadable values are null.

    A missing column is an error, and so is a file whose header differs from the first one's. Other
    columns are dropped, or kept as numbers.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    others = [name for name in header if keep_others and name not in schema.fieldNames()]
    return rows.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema],
        *[F.col(name).try_cast("double").alias(name) for name in others])


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return numbers_without_nan(_csv(spark, path, schemas.TXN)).withColumns({
        "tms": lenient_timestamp(F.col("tms")), "stm_dt": lenient_date(F.col("stm_dt")),
    })


def read_cards(spark: SparkSession, path: str, schema: T.StructType = schemas.CARD) -> DataFrame:
    """Further static columns are read as `schema` declares them, else as numbers, and pass through to the matrix."""
    return numbers_without_nan(_csv(spark, path, schema, keep_others=True)).withColumn(
        "card_create_dt", lenient_date(F.col("card_create_dt")))


def read_customers(spark: SparkSession, path: str, schema: T.StructType = schemas.CST) -> DataFrame:
    return numbers_without_nan(_csv(spark, path, schema, keep_others=True))


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.ACCNO).withColumn(
        "open_accno_dt", lenient_date(F.col("open_accno_dt")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.TRAIN).withColumn("label", label_value(F.col("label")))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Target cards with `row_order`, a sortable position in the file.

    Spark numbers no rows on a scan. The file, the offset of the block inside it and a counter
    inside the block order the rows exactly as they were written, however the scan was split.
    """
    rows = _csv(spark, path, schemas.TARGET)
    return rows.select(
        "card_no",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("row_order"),
    )


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan, pruned to `columns` when given."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
