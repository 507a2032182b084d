"""Session helpers: where shared scratch data lives, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would lose data with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def use_utc(spark: SparkSession) -> SparkSession:
    """All zone-less timestamps in the library are UTC; pin the session to match."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def own_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session with the settings of ``spark`` and others, which stay out of it; catalog and cluster are shared.

    Streams keep the settings that they start with, so those are made for a stream alone.
    """
    session = spark.newSession()
    for name, value in {**dict(spark.conf.getAll), **settings}.items():
        if session.conf.get(name, None) != value:
            try:
                session.conf.set(name, value)
            except PySparkException:  # fixed for the whole application, so the same there
                if name in settings:
                    raise
    return session
