"""Session helpers: a session for tests and benches, and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and the
    master is local, as in tests, a temporary folder of this machine is taken.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tessera-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(own)
    atexit.register(shutil.rmtree, own, True)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialize df in the shared folder and forget how it was made.

    Its files are deleted when nothing refers to it any more if the session is started with
    spark.cleaner.referenceTracking.cleanCheckpoints, as sessions of this module are.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in at least three partitions a core, for work that costs far more than moving the rows; a scan that has as many already is left alone."""
    spark = df.sparkSession
    want = 3 * spark.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= want else df.repartition(want, F.xxhash64(key))


def partitions_for(spark: SparkSession, groups: int) -> int:
    """Partitions for groups that are each worked on in Python: one a group, up to what the session shuffles into or four a core.

    A number that is given is left alone by the adaptive planner, which would put groups
    of few bytes but much work into one task.
    """
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(1, min(groups, most))
