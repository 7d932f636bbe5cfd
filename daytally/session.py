"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE coalesces small shuffle partitions, splits skewed joins (also where the
# split costs one more shuffle) and splits hot partitions before a write.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# Most bytes, as stored or shuffled, that one task reads. A row in a sort or hash table takes
# some ten times its stored bytes; with Spark's 128 MB and 64 MB the memory of a task follows
# the table up to gigabytes.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
}
UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def _bytes(size: str) -> int:
    """A size as Spark's settings name it."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << UNITS[unit]


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built; sizes that are smaller
    already stay."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    for key, most in TASK_BYTES.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


NO_ESTIMATE = 1 << 62  # what Spark says of rows that are no table

_ours: dict[int, tuple[str, str]] = {}  # per session: the number found, and the number put


def size_shuffles(spark: SparkSession, df: DataFrame, bytes_per_partition: int = 16 << 20) -> SparkSession:
    """Set the number of shuffle partitions to suit the tables that df reads.

    The session's own number is the least: AQE merges partitions that turn out
    small, but cannot split an aggregation's shuffle that has too few. The number
    follows each call, so that a small query after a large one gets the session's
    own again; a number that somebody else has set meanwhile counts as the own.
    """
    key = "spark.sql.shuffle.partitions"
    now = spark.conf.get(key)
    own, put = _ours.get(id(spark), (now, now))
    if put != now:
        own = now
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(x for x in sizes if x < NO_ESTIMATE)
    wanted = str(max(int(own), -(-read // bytes_per_partition)))
    _ours[id(spark)] = own, wanted
    spark.conf.set(key, wanted)
    return spark


def in_ranges_of(df: DataFrame, column: str) -> bool:
    """Whether the rows of each task are a range of a column, as `repartitionByRange` deals them."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return plan.outputPartitioning().toString().startswith(f"rangepartitioning({column}#")


def shuffles(df: DataFrame) -> bool:
    """Whether df needs any shuffle."""
    return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("daytally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is made up only where the setting is absent, which
    is the case in local tests.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="daytally-")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; for tables that are
    small or used more than once. Deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/daytally/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place.getParent())
    return spark.read.schema(df.schema).parquet(path)
