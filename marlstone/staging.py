"""Stage boundaries: results kept as tables in the folder that spark.checkpoint.dir names, readable by all executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKED = "zstd"  #: hashes and ids as hexadecimal digits take half of what Parquet's default leaves of them


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name.  Where no shared folder is set (tests on one machine), it is a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(sc, "_marlstone_stages", None)
        if root is None:
            root = sc._marlstone_stages = tempfile.mkdtemp(prefix="marlstone-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/stages/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "stage") -> DataFrame:
    """df, worked out once: written as Parquet and read back, with its statistics and for as few columns as are asked for."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
