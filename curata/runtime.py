"""Session helpers: test sessions, the shared checkpoint folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side up to which :func:`join_checked` broadcasts it.
BROADCAST_ROWS = 20_000

#: Rows in one Arrow batch sent to Python. Documents can be 100 KB and more, so the default of 10,000 is too many.
ARROW_ROWS = 512


def local_session(cores: int | str = 8, app: str = "curata") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine a temporary one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="curata-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends there: a lost executor costs only the tasks that were running, and everything downstream sees the
    same rows each time.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.curata_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "curata_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of the operators that send whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a broadcast of ``right`` if it has at most ``limit`` rows, else by sort-merge, where Spark splits hot keys.

    ``right`` should be a materialised table, for it is counted first.
    """
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def share(spark: SparkSession, value):
    """Broadcast ``value``, whose size the caller has bounded; the function that comes back gives it in a task.

    It travels pickled by value, so executors need no installed copy of its class.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get
