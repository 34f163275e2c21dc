"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_base: str | None = None


def build_session(app_name: str = "profilar", master: str | None = None, **conf: str) -> SparkSession:
    """Session with runtime re-planning on; cluster settings come from the submitter."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint location.

    A machine-local folder is made only when the session names no location
    and runs in local mode, where driver and executors are one process; it goes
    when that process ends.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        global _local_base
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="profilar-")
            atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
        base = _local_base
    return os.path.join(base, "profilar-" + uuid.uuid4().hex)


def save_and_reload(df, name: str = "step"):
    """Cut lineage through a parquet table in the shared folder."""
    path = os.path.join(shared_folder(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
