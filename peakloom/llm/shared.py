"""What the operators share: the shared scratch folder, and how a plan is cut there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20  # what a Python worker is handed at once


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in small batches, so that a worker's memory doesn't follow Spark's 10,000 rows.

    Spark reads these settings when a plan runs, which is after the operator has returned; they are so set for
    the session, and only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        digits = re.fullmatch(r"(\d+)b?", spark.conf.get(key), re.I)
        if not digits or not 0 < int(digits[1]) <= most:
            spark.conf.set(key, most)


def scratch_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a local session, as in tests, gets a temporary
    folder; on a cluster that would be a folder of the driver alone, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="peakloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage with files that outlive any executor, and computes ``df`` once where several
    later steps read it.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; other columns, however named, are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
