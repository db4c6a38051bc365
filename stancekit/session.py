"""Session and scratch-location helpers."""
from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stancekit")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without one (tests) gets a folder of its own, once a
    session; any other master has to name a folder that all executors share.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = own_root(spark.conf.get("spark.master", ""))
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def own_root(master: str) -> str:
    """A machine-local folder, for a local master only."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"master {master!r} needs spark.checkpoint.dir: a folder that all executors share")
    return tempfile.mkdtemp(prefix="stancekit-ckpt-")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/stancekit/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the scratch tables this process has made (from the ``since``-th on)."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    paths, _SCRATCH[since:] = _SCRATCH[since:], []
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(hadoop).delete(path, True)
    return len(paths)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Owns the scratch tables and persisted frames made inside: use the results
    inside, both are gone afterwards."""
    since, before = len(_SCRATCH), set(_persisted(spark))
    try:
        yield
    finally:
        for k, rdd in _persisted(spark).items():
            if k not in before:
                rdd.unpersist(False)
        drop_scratch(spark, since)


def _persisted(spark: SparkSession) -> dict:
    return dict(spark.sparkContext._jsc.getPersistentRDDs())


def data_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def materialize(df, name: str):
    """Write ``df`` once as Parquet below the checkpoint root and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan only once
    and leaves a durable table a restarted job can read (``scratch_scope`` or
    ``drop_scratch`` removes it).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROW_GROUP = 128 << 20


def input_bytes(df) -> int:
    """Bytes of what a plan reads, as its sources state them (files: their size)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df, *keys):
    """Deals rows over all cores by ``keys`` where the input is less than a row group a core.

    A file is read by row groups: a small input lands in a task or two, whatever the number of cores, and work of many times
    the text's size (n-grams) would run there alone. Larger inputs, and ones of unknown size, stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if input_bytes(df) < cores * ROW_GROUP else df
