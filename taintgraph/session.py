"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def get_spark(master: str = "local[*]", app: str = "taintgraph", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where that is unset and the session runs on this
    machine alone is it a local one of our own; on a cluster that is an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master is {master})")
        if "local" not in _OWN:
            _OWN["local"] = tempfile.mkdtemp(prefix="taintgraph-")
            atexit.register(_drop_local, _OWN["local"])
        base = "file://" + _OWN["local"]
    return f"{base.rstrip('/')}/taintgraph-{spark.sparkContext.applicationId}"


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _drop_at_exit(spark: SparkSession) -> None:
    """The application's folder goes with the application: what was written there serves its own results only."""
    root = shared_dir(spark)
    if root in _OWN:
        return
    _OWN[root] = root
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session's process may have ended first
            pass

    atexit.register(drop)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, a lost executor costs nothing
    before this point, and the planner gets true sizes for what follows."""
    _drop_at_exit(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._taintgraph_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Remove a table written by :func:`cut` that nothing will read again."""
    path = getattr(df, "_taintgraph_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
