"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a narrow lookup table that may be broadcast; results do not depend on it.
MOST_BROADCAST = 200_000


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickweave")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under the cluster's checkpoint folder.

    The folder named by the session is used as it is. A session without one gets a
    temporary folder of this machine if its master is local, as in tests; on a
    cluster, executors would write to their own disks, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tickweave-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tickweave/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    For tables that several later branches scan: they prune columns of the
    stored copy instead of running the upstream plan again, and a lost
    executor costs a re-read only.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(
    df: DataFrame, max_rows: int = MOST_BROADCAST, is_stored: bool = False
) -> DataFrame:
    """Store a lookup table, count it and hint a broadcast only if it is small.

    A larger table comes back without a hint, so the join shuffles and AQE
    may split its skewed partitions.
    """
    stored = df if is_stored else stage(df)
    return F.broadcast(stored) if stored.count() <= max_rows else stored
