"""Session settings, and tables that end lineage, in one place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "stratafuse", **conf: str) -> SparkSession:
    """A session with ANSI semantics, UTC and adaptive plans; keyword names take _ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine a temporary one if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratafuse-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, evaluated once into a table of its own in the shared folder and read back from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table of :func:`stored` behind df, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/table-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
