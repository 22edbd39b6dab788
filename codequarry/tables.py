"""Tables that cut the lineage of iterative work: written once in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir says; on a single machine that says nothing (as in tests), a folder of its own."""
    if path := spark.conf.get("spark.checkpoint.dir", ""):
        return path
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="codequarry-"))
    return _own[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table that is read back from the shared folder: what follows never makes it again, also when executors are lost. Such a table stays as it is."""
    if "written_path" in df.__dict__:
        return df
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_path"] = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["written_path"])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
