"""Session construction and lineage handling."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: wall-clock timestamps compare equal with the
# SQL oracle only in UTC; ANSI makes bad casts fail loudly (tolerant parsing
# uses try_* functions explicitly); AQE re-plans joins and partition counts
# from runtime statistics, which is what keeps broadcast decisions honest.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Wide projections fused into one whole-stage method exceed the JVM's JIT
    # size limit (8000 bytes of bytecode) and then run interpreted; at this
    # limit Spark falls back to per-operator code that the JIT compiles.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# Only honoured when this call starts the JVM (local mode / client driver).
DEFAULT_DRIVER_MEMORY = "16g"


def build_session(master: str | None = None, app: str = "coachload",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.driver.memory"] = DEFAULT_DRIVER_MEMORY
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for reliable checkpoints.

    On a cluster the operator names it in ``spark.checkpoint.dir``; we only
    read it.  Only a local-mode session (tests, a laptop) without one gets a
    fresh scratch folder; a cluster session without one is an error, since a
    machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not fallback:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        fallback = tempfile.mkdtemp(prefix="coachload-ckpt-")
    sc.setCheckpointDir(configured or fallback)
    return sc.getCheckpointDir() or configured or fallback


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the checkpoint folder and read back.

    For results that several plans read: column pruning, pushdown and file
    sizes survive, so Catalyst decides from bytes whether a side of a join is
    small enough to broadcast (``spark.sql.autoBroadcastJoinThreshold``).
    """
    path = f"{scratch_path(df.sparkSession, name)}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """The shuffle files of plans that nothing refers to any more: Spark deletes
    them once the driver has collected its garbage, which may take hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def still_there(df: DataFrame) -> bool:
    """Whether a materialized table's folder has not been cleared since."""
    try:
        df.sparkSession.read.schema(df.schema).parquet(*{os.path.dirname(f) for f in df.inputFiles()})
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder next to the checkpoints for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "tables", name)
