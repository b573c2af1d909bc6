"""Session settings and the shared working folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "provenor", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; sizes are left to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; its temporary folder goes
    when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="provenor-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


# so many rows go to one task where rows are dealt out by their number
ROWS_PER_TASK = 500_000


def tasks_for(spark: SparkSession, n_rows: int) -> int:
    """Tasks for ``n_rows`` rows: as many as run at once, or more, so that a task's memory does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // ROWS_PER_TASK))


_JOB: ContextVar[str | None] = ContextVar("provenor_job", default=None)


def working_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, in the folder of the running job if there is one."""
    folder = _JOB.get() or spark.sparkContext.applicationId
    return f"{shared_root(spark).rstrip('/')}/provenor/{folder}/{label}-{uuid.uuid4().hex}"


def job(run: Callable) -> Callable:
    """A step whose results are all written: what it stored in between is removed when it ends, well or not."""
    @wraps(run)
    def wrapped(spark: SparkSession, *args, **kwargs):
        if _JOB.get():
            return run(spark, *args, **kwargs)
        token = _JOB.set(f"job-{uuid.uuid4().hex}")
        try:
            return run(spark, *args, **kwargs)
        finally:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/provenor/{_JOB.get()}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _JOB.reset(token)

    return wrapped


# while a step is written: its shuffle files go with it, and a Python task gets its rows 8 MB at a time
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STEP = {
    SHUFFLE_CLEANUP: "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later stages then read stable Parquet columns, so a lost executor repeats a
    scan and never a non-deterministic upstream step. The shuffle files of the step
    go as soon as it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = working_path(spark, label)
    before = {key: spark.conf.get(key, None) for key in STEP}
    for key, value in STEP.items():
        spark.conf.set(key, value)
    try:
        df.write.mode("errorifexists").option("compression", "snappy").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
