"""Session helpers: a tuned local session for tests/bench and a shared scratch area.

Scratch data (round-trips, drop folders, checkpoints) always lives below the
folder the cluster names in ``spark.checkpoint.dir`` so that every executor can
read it.  A folder of our own is made only when that setting is absent and the master is ``local``, where
driver and executors are one process; any other master without it is an error.

Scratch folders belong to the application: ``clean_scratch`` removes those made so far (the caller of a query does
that once it has the result), and what is left goes when the application ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = 8, app: str = "opsward", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; set one only if unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="opsward-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root, owned by this application."""
    path = f"{checkpoint_root(spark)}/opsward-scratch/{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        atexit.register(_clean_at_exit, spark)
    _SCRATCH.setdefault(app, []).append(path)
    return path


def clean_scratch(spark: SparkSession) -> int:
    """Removes the scratch folders this application has made; frames that read them are no longer usable."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def _clean_at_exit(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        clean_scratch(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package once per application, so Python functions of it run there whatever their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="opsward-ship-"), "opsward.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
