"""Tables in the folder that driver and executors share, and joins whose strategy follows a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Settings of a session that these jobs run in, each with the value that counts as not set: shuffle files go at the end
#: of the execution that made them, and a batch of rows on its way to Python has so many bytes at most.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("true", "false"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("4194304", "67108864b"),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, one machine) gets a folder of its own; on a cluster its executors
    would each write to their own disk, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        path = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    for key, (value, unset) in SETTINGS.items():
        if spark.conf.get(key, unset) == unset:
            spark.conf.set(key, value)
    return path.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what came before. Shuffle files of an
    execution go as soon as it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned, once no later result reads them."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def joined_small(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = 20_000) -> DataFrame:
    """Join a written table ``right``: broadcast it while it has at most ``rows`` rows, else sort-merge.

    ``right`` must be cheap to count (a written table) and have narrow rows.
    """
    few = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)
