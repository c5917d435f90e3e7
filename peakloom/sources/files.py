"""Readers and writers: Parquet, CSV and structure-data files in, Parquet, CSV and JSON summaries out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chem import formula_mass
from ..functions.molfile import with_connection_table
from ..schemas import require


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Only the columns asked for reach the scan."""
    df = spark.read.parquet(path)
    return require(df, columns).select(columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def file_info(df: DataFrame) -> DataFrame:
    """(file, bytes, n_rows) of the files behind a table."""
    meta = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return meta.groupBy("file", "bytes").agg(F.count("*").alias("n_rows"))


def column_info(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "column string, type string, nullable boolean")


def read_sdf(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """One row a record of a structure-data file: title, molfile, and the data items as text columns (``properties``: item to column).

    Records are cut at '$$$$' lines by Spark's own reader, so a large file is read by many tasks.
    """
    raw = spark.read.text(path, lineSep="$$$$").select(F.regexp_replace("value", r"\r", "").alias("value"))
    raw = raw.select(F.regexp_replace("value", r"^\n", "").alias("value")).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")

    def item(tag: str) -> Column:
        found = F.regexp_extract("value", r"(?s)>[^\n]*<" + tag + r">[^\n]*\n(.*?)(?:\n\s*\n|\s*$)", 1)
        return F.nullif(F.trim(found), F.lit(""))

    body = F.split("value", r"(?m)^>\s*<", 2)
    return raw.select(F.trim(F.split_part("value", F.lit("\n"), F.lit(1))).alias("title"), F.get(body, 0).alias("molfile"), *[item(tag).alias(name) for tag, name in properties.items()])


def clean_structures(records: DataFrame, inchikey: str = "inchikey", mass: str = "exact_mass", formula: str | None = None) -> DataFrame:
    """Records with a full key (its first 14 characters become ``structure``) and a positive mass, which where it is
    absent comes from ``formula``."""
    return with_fate(records, inchikey, mass, formula).where("fate = 'kept'").drop("fate")


def with_fate(records: DataFrame, inchikey: str = "inchikey", mass: str = "exact_mass", formula: str | None = None, table: bool = False) -> DataFrame:
    """``records`` with structure, a numeric mass and ``fate``: kept, empty (no molecule block), short key or bad mass.

    With ``table`` a mass that neither an item nor a formula gives comes from the molecule's connection table, whose own columns stay.
    """
    sources = [F.col(mass).cast("string").try_cast("double")]
    if formula:
        sources.append(formula_mass(F.col(formula)))
    if table:
        records = with_connection_table(records)
        sources.append(F.col("table_mass"))
    out = records.withColumn(mass, F.coalesce(*sources))
    empty = ~F.coalesce("molfile", F.lit("")).rlike(r"\S") if "molfile" in records.columns else F.lit(False)
    fate = F.when(empty, "empty").when(F.coalesce(F.length(inchikey), F.lit(0)) < 14, "short key").when(F.coalesce(F.col(mass) > 0, F.lit(False)), "kept").otherwise("bad mass")
    return out.withColumn("fate", fate).withColumn("structure", F.substring(inchikey, 1, 14))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a temporary one in a local session that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="peakloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once where several steps read it, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """zstd Parquet; arrays stay array columns."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """A small table of metrics as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
