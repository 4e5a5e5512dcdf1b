"""Session helpers: building a local session for tests and finding shared storage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench.  On a cluster, pass the cluster's own session instead."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (
        SparkSession.builder.master(master)
        .appName("panelcast")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PANELCAST_DRIVER_MEM", "16g"))
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` is used as given.  A folder of our own is
    set only where the session names none and everything runs in one JVM (tests);
    on any other master a local folder would be seen by one machine only, so this raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set and the master is {sc.master}: "
                "name a folder that the driver and all executors share")
        conf_dir = os.path.join(os.environ.get("TMPDIR", "/tmp"), "panelcast-checkpoints")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for tables written mid-job."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/panelcast-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Survives executor loss (the files are on shared storage, unlike a local
    checkpoint), computes the plan once (an RDD checkpoint runs it twice), and
    the re-read relation carries real size statistics, so the planner can
    still choose broadcast joins on it.
    """
    return write_stage(df, name)[0]


def write_stage(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """:func:`cut_lineage` with the table's path, for :func:`drop_path` once nothing reads it any more."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp()}/panelcast-{sc.applicationId}.zip"  # Spark serves it from there
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`cut_lineage` once nothing reads it any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _files(fs, path) -> list[tuple]:
    status = fs.getFileStatus(path)
    if not status.isDirectory():
        return [(status.getPath().toString(), status.getLen(), status.getModificationTime())]
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))


def session_key(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ("lineitem", "part", "supplier")) -> tuple:
    """Key for per-session memos of what is derived from ``tables``.

    A restarted context has a new application id, so a new session never picks up tables bound to a
    stopped one; files that were written anew have other sizes or times, so nothing stale is used."""
    conf, out = spark._jsc.hadoopConfiguration(), []
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        out += _files(path.getFileSystem(conf), path)
    return (spark.sparkContext.applicationId, id(spark), sf_dir, tuple(out))
