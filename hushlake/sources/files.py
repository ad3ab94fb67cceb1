"""Text, mapping and name-list sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.operators.native import integrity
from hushlake.plans.registry import MAX_BYTES

_HEADER = ("firstname", "lastname", "first_name", "last_name", "prénom", "nom")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text, status); files over 50 MiB have no text and say so."""
    files = spark.read.format("binaryFile").load(path).select("path", F.when(F.col("length") <= MAX_BYTES, F.col("content").cast("string")).alias("text"), F.when(F.col("length") <= MAX_BYTES, "ok").otherwise("too_large").alias("status"))
    return files


def is_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Whether files are spreadsheets: the archive's magic number and its content list in the first 4 KiB."""
    head = F.substring("content", 1, 4096)
    return spark.read.format("binaryFile").load(path).select("path", ((F.hex(F.substring("content", 1, 4)) == "504B0304") & F.contains(F.hex(head), F.hex(F.lit("[Content_Types].xml")))).alias("is_xlsx"))


def write_mapping(table: DataFrame, path: str) -> None:
    """Entries and their manifest, before any text that needs them is written; nothing for an empty table, an error where one is already."""
    if table.isEmpty():
        return
    table.write.mode("errorifexists").parquet(f"{path}/entries")
    integrity(table.sparkSession.read.parquet(f"{path}/entries")).write.mode("errorifexists").parquet(f"{path}/manifest")


def read_mapping(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    table = spark.read.parquet(f"{path}/entries")
    if verify:
        saved, now = spark.read.parquet(f"{path}/manifest").first(), integrity(table).first()
        if saved != now:
            raise ValueError("the mapping differs from its manifest")
    return table


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name) of a list ``first[,last]``, lower case, distinct, without its header."""
    raw = spark.read.text(path).select(F.split("value", ",").alias("p"))
    raw = raw.where(~F.exists("p", lambda x: F.lower(F.trim(x)).isin(*_HEADER)))
    each = raw.select(F.explode(F.array(F.struct(F.lit("first").alias("kind"), F.trim(F.get("p", F.lit(0))).alias("name")), F.struct(F.lit("last").alias("kind"), F.trim(F.get("p", F.lit(1))).alias("name")))).alias("n"))
    return each.select("n.kind", F.lower("n.name").alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
