"""Session defaults for local runs and tests; a cluster brings its own session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "tillscope") -> SparkSession:
    """Local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TILLSCOPE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the cluster's shared one, or a new local one where none is set."""
    shared = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if shared:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="tillscope-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


#: Stages of this process: folders to remove at its end, and the open scopes, innermost last.
_FOLDERS: dict[str, object] = {}
_SCOPES: list[dict] = []


def _remove(path: str, jvm, configuration) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(configuration).delete(target, True)


def _remove_all() -> None:
    for path, (jvm, configuration) in list(_FOLDERS.items()):
        try:
            _remove(path, jvm, configuration)
        except Exception:  # the JVM has gone first; the folder is named by its application
            return


def scratch(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder, removed with the open scope or the process."""
    root = f"{ensure_checkpoint_dir(spark)}/stages-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].setdefault("paths", []).append(path)
    else:
        if not _FOLDERS:
            atexit.register(_remove_all)
        _FOLDERS[root] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return path


def staged(df: DataFrame) -> DataFrame:
    """Rows written once as Parquet to the checkpoint folder and read from there by every later use.

    For a stage that several branches read, where the reference stores a table. Later uses read
    only the columns they need; executors may be lost. Inside a `stage_scope` the same plan is stored
    once, and its folder goes with the scope; other stages go with the process.
    """
    spark = df.sparkSession
    if _SCOPES:
        for plan, stored in _SCOPES[-1].get(df.semanticHash(), ()):
            if plan.sameSemantics(df):
                return stored
    path = scratch(spark)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].setdefault(df.semanticHash(), []).append((df, stored))
    return stored


@contextmanager
def stage_scope(spark: SparkSession):
    """Stages made inside are shared and removed at the end; use their results before."""
    _SCOPES.append({})
    try:
        yield
    finally:
        for path in _SCOPES.pop().get("paths", []):
            _remove(path, spark._jvm, spark._jsc.hadoopConfiguration())
