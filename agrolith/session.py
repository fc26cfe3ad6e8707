"""Session construction and the shared checkpoint folder.

On a cluster the checkpoint folder is whatever the cluster names in
``spark.checkpoint.dir`` (a shared file system). Only in local mode may that
setting be absent; then a scratch folder is picked here. Elsewhere it is an
error.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "agrolith", extra: dict | None = None) -> SparkSession:
    """Get or create a session with AQE on and the UI off."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("AGROLITH_DRIVER_MEMORY", "16g"))
    # numpy inside Python workers: one BLAS thread per task slot
    conf["spark.executorEnv.OPENBLAS_NUM_THREADS"] = "1"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="agrolith-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut(df):
    """Materialise ``df`` into the reliable checkpoint folder and return a short-lineage copy.

    Used at step boundaries of multi-pass operators: later plans start from the
    written files (small plans, fast to optimise) and survive lost executors.
    The temporary cache makes the checkpoint write read the computed rows
    instead of recomputing them.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    c = p.checkpoint(eager=True)
    p.unpersist()
    return c


def stage_table(df, name: str):
    """Write ``df`` once as Parquet into the checkpoint folder and read it back.

    For a table that several plans read: they prune its columns and start from
    written files, which a lost executor cannot take away.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``agrolith`` importable in the Python workers (the ``--py-files`` route).

    Functions sent to ``mapInPandas`` reference this package; on a cluster the
    executors only have what the application ships, so the package is zipped
    once per application on the driver and added with ``addPyFile``.
    """
    import os
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="agrolith-pyfiles-"), "agrolith.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
