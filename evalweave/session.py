"""Session settings, the shared work folder and package shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "evalweave", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's own checkpoint folder.

    Only where neither is set (local tests) a temporary folder is made; off local mode that is refused, as a folder of
    one machine would be lost with it.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not _is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evalweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        set_to = "file://" + folder
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


_made: list[str] = []


def track(path: str) -> str:
    """``path``, to be deleted by ``drop_intermediates``."""
    _made.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    Results read these tables when they run, so they stay until ``drop_intermediates``.
    """
    path = track(f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the tables that ``materialise`` wrote in this application, once no result needs them. Returns how many."""
    jvm, n = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package's code (once per application), wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="evalweave-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "evalweave_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in {".py", ".yaml", ".txt"}:
                z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
