"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast explicitly only when Spark's own size estimate is below this many bytes.
BROADCAST_BYTES = 32 << 20


def local_session(cpus: str = "*", app: str = "tarnlight", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    _reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reach_workers(spark: SparkSession) -> None:
    """Let the Python workers import this package also where the driver found it through sys.path only."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root


def unambiguous(df: DataFrame) -> DataFrame:
    """df without columns whose names clash with another's but for the case: of such columns the one
    in lower case stays, else the first. Operators then find their columns whatever else a table holds."""
    names = df.columns
    keep: dict[str, int] = {}
    for i, name in enumerate(names):
        low = name.lower()
        if low not in keep or (name == low and names[keep[low]] != low):
            keep[low] = i
    if len(keep) == len(names):
        return df
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{i}").alias(names[i]) for i in sorted(keep.values())])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; make one only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tarnlight-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """df as a table written to the shared checkpoint folder and read back.

    The lineage ends here, the result survives the loss of executors, and later plans see its true
    size. The tables of a session are removed when the driver's process ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/tarnlight-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _remove_written(spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session may have ended first
        pass


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the size estimate allows it; else df, and Spark shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Split a small scan over all cores before CPU-bound Python work.

    A few small files give too few tasks to occupy the cluster. Larger inputs, which already
    have at least that many splits, pass unchanged, so nothing is shuffled at scale.
    """
    sc = df.sparkSession.sparkContext
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():  # not a scan: counting its partitions would run it
        return df
    if plan.execute().getNumPartitions() >= sc.defaultParallelism:
        return df
    return df.repartition(sc.defaultParallelism * per_core)
