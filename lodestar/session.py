"""Session and scratch-space helpers.

On a cluster the shared scratch folder is whatever ``spark.checkpoint.dir``
names; we only pick a local folder when that setting is absent (tests, local
runs).  Intermediate tables written by operators go below that folder, so a
lost executor never loses a lineage cut.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Make ``lodestar`` importable on every executor (``addPyFile`` of a zip, once per context).

    UDFs and ``mapInPandas`` functions refer to module-level helpers, which the
    executors must import.  On a cluster this is what ``--py-files`` does.
    """
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_lodestar_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = checkpoint_root(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    # The zip goes to the shared scratch folder when that is a plain path; Spark's
    # file server ships it to the executors either way.
    if "://" in root:
        out = tempfile.mkdtemp(prefix="lodestar-pkg-")
    else:
        out = os.path.join(root, f"lodestar-pkg-{uuid.uuid4().hex[:12]}")
        os.makedirs(out, exist_ok=True)
    archive = shutil.make_archive(os.path.join(out, "lodestar"), "zip", os.path.dirname(pkg_dir), "lodestar")
    sc.addPyFile(archive)
    sc._lodestar_shipped = True


def spread(df, factor: int = 2):
    """Round-robin an under-partitioned input over the cluster, else leave it alone.

    A file with one row group is read by one task however many splits it has.
    Only when the scan has fewer partitions than ``factor x`` the default
    parallelism is it repartitioned; a large input (many files and row groups)
    keeps its scan partitioning and pays no shuffle.
    """
    target = df.sparkSession.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lodestar") -> SparkSession:
    """Session for tests and benchmarks on one machine; UI off, AQE on."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` if the cluster set it.

    Only when it is unset (local tests) do we create one under the system temp
    folder and register it, so ``DataFrame.checkpoint()`` works as well.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestar-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    # SparkContext keeps its own copy; register it so df.checkpoint() works.
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared scratch root."""
    root = checkpoint_root(spark)
    if root.startswith("file:"):
        root = root[len("file:"):]
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
