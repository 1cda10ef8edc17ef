"""Session helpers shared by all operators: sessions for tests and benchmarks, and shared-folder checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in rows, that the engine sends to every executor. Larger ones take a shuffled path.
BROADCAST_ROWS = 200_000
#: Most bytes of text that are sent to every executor.
BROADCAST_BYTES = 16_000_000


def build_session(cores: int | str = "*", app: str = "keyloom", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session is the caller's."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", os.environ.get("KEYLOOM_SHARED_DIR") or os.path.join(tempfile.gettempdir(), f"keyloom-{uuid.uuid4().hex[:12]}"))  # one machine
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, one machine) a temporary folder stands in for it.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    made = os.path.join(tempfile.gettempdir(), f"keyloom-{uuid.uuid4().hex[:12]}")
    spark.sparkContext.setCheckpointDir(made)
    return made


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written to the shared folder (lineage is cut and survives lost executors)."""
    shared = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    place = f"{shared.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(place)
    _written.append(place)
    return df.sparkSession.read.parquet(place)


def place_for(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, that ``drop_settled`` removes."""
    place = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(place)
    return place


_written: list[str] = []


def drop_settled(spark: SparkSession) -> int:
    """Deletes every table that ``settled`` wrote for this process so far; results that still read them are lost, so
    call it when they are consumed. Returns how many were removed."""
    jvm, removed = spark._jvm, 0
    while _written:
        place = jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return removed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
