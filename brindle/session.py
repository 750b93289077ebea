"""Sessions and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "brindle", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; on a cluster, pass what the cluster's defaults don't set."""
    builder = SparkSession.builder.appName(name).master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where it is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark.sparkContext, "_brindle_tables", None)
        if where is None:
            where = spark.sparkContext._brindle_tables = tempfile.mkdtemp(prefix="brindle-")
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it: cuts the lineage of loops, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/brindle/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no frame in use reads any more; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_brindle_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
