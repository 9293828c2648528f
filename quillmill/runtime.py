"""Session helpers: tables, the shared folder, lineage cuts and task sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own if that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


_made: list[str] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Removes the folders of fresh_dir() made so far; results that were read from them are gone. Gives their number."""
    n = 0
    while _made:
        fs, p = hadoop_fs(spark, _made.pop())
        n += bool(fs.delete(p, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor doesn't cost the lineage before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Like cut(), but as parquet: columns can be pruned when it is read again."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df_rows: int, rows_a_task: int, spark: SparkSession) -> int:
    """Tasks so that none gets more than rows_a_task rows; at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-df_rows // rows_a_task), 1)


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    n = cores or os.cpu_count() or 8
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("quillmill")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def blank_to_null(col):
    """White space of any kind at the ends removed; what is empty then is null."""
    c = F.regexp_replace(col, r"^[\s\x1c-\x1f\x85\p{Z}\x{FEFF}]+|[\s\x1c-\x1f\x85\p{Z}\x{FEFF}]+$", "")
    return F.when(c == "", None).otherwise(c)
