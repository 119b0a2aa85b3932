"""Spark session and checkpoint helpers.

Everything in the library takes a ``SparkSession`` that the caller owns; the
helpers here only build a sensible local session for tests/bench and resolve
a shared checkpoint folder for iterative jobs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "consonance",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session tuned for local runs; cluster runs pass their own conf."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CONSONANCE_DRIVER_MEMORY", "16g"))
    )
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_library(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only a local-mode session without one (tests) gets a
    fresh private folder. On a cluster without the setting we refuse, because
    a machine-local folder does not survive executor loss.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext access: the conf must name the folder
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder for iterative jobs")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="consonance-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir must name a shared folder for iterative jobs")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_group(df: DataFrame, cols: list[str | Column]) -> DataFrame:
    """Hash-partition by the group key into ``spark.sql.shuffle.partitions`` parts before a
    CPU-heavy grouped pandas kernel.

    An explicit partition count is not coalesced by AQE, so the groups of a small
    input still spread over all cores; the following ``groupBy(cols)`` reuses this
    partitioning (no second shuffle). The count is the configured shuffle parallelism, so it
    follows the data as the rest of the job does.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan as it is; one of fewer splits than cores (a small file) is dealt out to them, for what each row costs
    afterwards."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Make this package importable in Python workers (the programmatic ``--py-files``).

    Grouped kernels and ``mapInPandas`` functions live in this package; executors that
    did not start with it on their path import it from the shipped zip. Done once per
    application.
    """
    import zipfile

    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: no SparkContext
        sc, key = None, "connect"
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="consonance-lib-"), "consonance.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for here, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith((".py", ".jsonl")):
                    full = os.path.join(here, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(zpath)
    else:
        spark.addArtifacts(zpath, pyfile=True)
    _SHIPPED.add(key)
