"""CSV scans, the derived-table sink and schema listing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattweave.functions.dates import timestamp_of_text
from wattweave.sources.schemas import with_text_timestamp

CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header: columns are found by name, in any order; those that are not declared are not read.

    Empty fields and NA are null. Types are declared, so there is no inference pass; a field that does not parse fails
    the read, as does a missing column.
    """
    rows = spark.read.options(**CSV_OPTIONS, nullValue="NA", emptyValue="").csv(path)
    return rows.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit("")).cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Checked:
    """Good rows, rejected rows, and one row with the numbers `good` and `rejected`.

    The numbers are a query of their own: an Observation would give them with the rows, but in Spark 4.1 a session with
    one cannot send the functions of a classifier to its tasks any more (ObservationManager is not serializable).
    """

    rows: DataFrame
    rejects: DataFrame
    counts: DataFrame


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> Checked:
    """As read_csv(), but a field that does not parse rejects its row and not the whole read.

    Rejects: (columns, fields): the names of the fields that do not parse, and all fields of the row as text. Each
    part is a scan of the text when it is used; store it first if several are wanted of a large file.
    """
    text = spark.read.options(**CSV_OPTIONS, nullValue="NA", emptyValue="").csv(path)
    given = {f.name: F.nullif(F.col(f"`{f.name}`"), F.lit("")) for f in schema.fields}
    parsed = {f.name: given[f.name].try_cast(f.dataType) for f in schema.fields}
    bad = F.filter(F.array(*[F.when(given[n].isNotNull() & parsed[n].isNull(), F.lit(n)) for n in given]), lambda x: x.isNotNull())
    marked = text.select(F.struct(*[v.alias(n) for n, v in parsed.items()]).alias("row"), bad.alias("columns"),
                         F.create_map(*[x for n in given for x in (F.lit(n), given[n])]).alias("fields"))
    counts = marked.agg(F.count_if(F.size("columns") == 0).alias("good"), F.count_if(F.size("columns") > 0).alias("rejected"))
    return Checked(marked.where(F.size("columns") == 0).select("row.*"), marked.where(F.size("columns") > 0).select("columns", "fields"), counts)


def read_csv_text(spark: SparkSession, path: str, schema: T.StructType, parse: bool = True) -> DataFrame:
    """CSV whose timestamp is read as text and, by default, parsed afterwards."""
    rows = read_csv(spark, path, with_text_timestamp(schema))
    return rows.withColumn("timestamp", timestamp_of_text("timestamp")) if parse else rows


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS, nullValue="NA").csv(path)


def drop_index(df: DataFrame) -> DataFrame:
    """Remove the row-number column that a CSV export leaves behind: the first one, if it has no name."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[1:]]) if df.columns[0] in ("", "_c0") else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table in `buckets` buckets by hash of the keys, sorted in each: tables with the same number of buckets by equal
    keys join without an exchange. Returns the table as read."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type; read from the plan, no scan."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")
