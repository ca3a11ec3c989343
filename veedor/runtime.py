"""Session defaults and shared staging."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_PATHS: dict[str, list[str]] = {}


def get_session(app: str = "veedor", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="veedor-")
    return _LOCAL_DIRS[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete what this application staged; results that read it must be done."""
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that nothing will read again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` once to the shared folder (with the writer's ``options``) and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the plan),
    fixes floating-point sums so that every later comparison sees the same value, and
    gives the planner a known size, so that it broadcasts only what is under its threshold.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def set_for(spark: SparkSession, name: str, value: str):
    """A setting of the session for the jobs that are run meanwhile."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is run meanwhile go when it ends, not when the driver happens to collect its garbage."""
    return set_for(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def single_value(df: DataFrame):
    """The one value of a one-row, one-column result (a count, a threshold); None without rows.

    As a literal it is compared in the scan; as a nested subquery every later expression
    would carry the plan it came from.
    """
    row = df.first()
    return None if row is None else row[0]
