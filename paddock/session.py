"""Session helpers: local sessions for tests/bench and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on; a cluster deployment sets them in its own
# session config, ``local_session`` sets them for tests and the bench.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "paddock") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read. It
    is set here (to a fresh local folder) only when the session has none, as
    in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        # unset: our own folder in tests and local runs; a cluster must name a shared one
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # core configs cannot be changed at runtime, so only the context is told
        conf_dir = tempfile.mkdtemp(prefix="paddock-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def storage_bytes(spark: SparkSession) -> int:
    """Memory for cached blocks of all executors together (in local mode the driver's)."""
    sc = spark.sparkContext._jsc.sc()
    driver = sc.env().blockManager().blockManagerId().hostPort()
    found, each = {}, sc.getExecutorMemoryStatus().iterator()
    while each.hasNext():
        one = each.next()
        found[one._1()] = one._2()._1()
    return int(sum(n for name, n in found.items() if len(found) == 1 or name != driver))


def materialize(df, name: str):
    """Write ``df`` as parquet into a fresh folder under the shared checkpoint
    folder and read it back: cuts lineage (executor loss re-reads files),
    computes a table once when several branches or a sampling pass (range
    partitioning) read it, and gives the optimizer real size statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
