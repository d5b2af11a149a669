"""The state of a data loader as a versioned table: epochs in a hashed order, exclusions, save, restore and clean-up.

Every epoch has an order of its own, made of the seed, the epoch and the key, without the prompts that were excluded in an
earlier epoch. A saved state is a folder for its step: where the loader is, and which prompts were excluded since the state
before. A folder counts once its state is there, which is written last, so a job that dies while saving leaves the state
before in force. Keys never come to the driver; it sees the numbers of the steps.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators.mixing import shuffled_key
from curata.runtime import free_name
from curata.sources.tables import ranged_total

_STATE = "epoch long, batch long"


class State(NamedTuple):
    """Where a loader stopped: ``batch`` of ``epoch`` is the next one that it gives."""

    step: int
    epoch: int
    batch: int


def batches(prompts: DataFrame, key: str, epoch: int, per_batch: int, seed: int, exclusions: DataFrame | None = None, start: int = 0) -> DataFrame:
    """``prompts`` with ``epoch, batch, place``, from batch ``start`` on; a last batch that is not full is dropped.

    ``exclusions(key, epoch)`` leaves out prompts that were excluded before ``epoch``, so an epoch keeps its order however
    often the loader stops in it. Repeated keys are rows of their own; rows with a null key are left out, for they could
    never be excluded.
    """
    rows = prompts.where(F.col(key).isNotNull())
    if exclusions is not None:
        rows = rows.join(exclusions.where(F.col("epoch") < epoch).select(key).distinct(), key, "left_anti")
    index, order = free_name(rows, "curata_index"), free_name(rows, "curata_order")
    placed = ranged_total(rows.withColumn(order, shuffled_key(f"{seed}:{epoch}", F.col(key))), [order, key], F.lit(1), index).drop(order)
    full = placed.count() // per_batch
    batch = F.expr(f"{index} div {per_batch}")
    out = placed.withColumns({"epoch": F.lit(epoch).cast("long"), "batch": batch, "place": F.col(index) % per_batch}).drop(index)
    return out.where((F.col("batch") < full) & (F.col("batch") >= start))


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _steps(spark: SparkSession, path: str, table: str) -> list[int]:
    """Steps whose ``table`` is written whole, in order."""
    system, pattern = _files(spark, f"{path}/step=*/{table}/_SUCCESS")
    return sorted(int(f.getPath().getParent().getParent().getName().removeprefix("step=")) for f in system.globStatus(pattern) or [])


def save(spark: SparkSession, path: str, state: State, excluded: DataFrame | None = None) -> None:
    """Commit ``state``. ``excluded`` has, in its first column, the keys that were excluded since the state before.

    A step that is saved already is saved anew, and states of later steps, which a resumed loader has left behind, go.
    """
    system, target = _files(spark, f"{path}/step={state.step}")
    for later in [s for s in _steps(spark, path, "state") if s > state.step]:
        system.delete(_files(spark, f"{path}/step={later}")[1], True)
    system.delete(target, True)
    if excluded is not None:
        rows = excluded.select(F.col(excluded.columns[0]), F.lit(state.epoch).cast("long").alias("epoch"))
        rows.where(F.col(rows.columns[0]).isNotNull()).distinct().write.parquet(f"{path}/step={state.step}/excluded")
    spark.createDataFrame([(state.epoch, state.batch)], _STATE).coalesce(1).write.parquet(f"{path}/step={state.step}/state")


def load(spark: SparkSession, path: str, key: str, kind: str = "long", step: int | None = None) -> tuple[State, DataFrame]:
    """The last committed state, or that of ``step``, and its exclusions ``key, epoch``; ``State(-1, 0, 0)`` before any."""
    saved = [s for s in _steps(spark, path, "state") if step is None or s <= step]
    if step is not None and saved[-1:] != [step]:
        raise ValueError(f"step {step} was not saved or is cleaned up")
    none = spark.createDataFrame([], f"`{key}` {kind}, epoch long")
    if not saved:
        return State(-1, 0, 0), none
    last = saved[-1]
    row = spark.read.schema(_STATE).parquet(f"{path}/step={last}/state").first()
    whole = [s for s in _steps(spark, path, "all") if s in saved]
    since = whole[-1] if whole else -1
    parts = [f"{path}/step={s}/excluded" for s in _steps(spark, path, "excluded") if s in saved and s > since]
    parts += [f"{path}/step={since}/all"] if whole else []
    return State(last, row.epoch, row.batch), spark.read.schema(none.schema).parquet(*parts) if parts else none


def clean_up(spark: SparkSession, path: str, key: str, kind: str = "long", keep: int = 2) -> list[int]:
    """Delete all but the last ``keep`` states; what the deleted ones excluded is first written beside the oldest kept."""
    saved = _steps(spark, path, "state")
    old, kept = saved[:-keep], saved[-keep:]
    if not old:
        return []
    if kept[0] not in _steps(spark, path, "all"):
        _, exclusions = load(spark, path, key, kind, kept[0])
        exclusions.groupBy(key).agg(F.min("epoch").alias("epoch")).write.mode("overwrite").parquet(f"{path}/step={kept[0]}/all")
    system, _ = _files(spark, path)
    for s in old:
        system.delete(_files(spark, f"{path}/step={s}")[1], True)
    return old
