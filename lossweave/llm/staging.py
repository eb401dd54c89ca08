"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
(tests, notebooks on one machine) a folder of this machine is used instead.
A staged table cuts lineage and survives lost executors, unlike a cache.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    global _own
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if _own is None:
            _own = tempfile.mkdtemp(prefix="lossweave-")
            atexit.register(shutil.rmtree, _own, True)
        return f"file://{_own}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lossweave/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def repeatable(df: DataFrame, name: str) -> DataFrame:
    """df for operators that read it twice and need the same rows in the same tasks.

    Files and driver rows are read alike each time.  What a shuffle, a sample, a
    cached table or Python code makes may come in another order, so it is staged.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stage(df, name) if re.search(r"Exchange|Sample|InMemoryTableScan|Arrow|Python|Pandas|Join|Aggregate|Window|Coalesce", plan) else df


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at.getParent(), True)
