"""Lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master (tests) may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back.

    Unlike a checkpoint the files bring their own size, so loops should use this: a checkpoint keeps
    the planner's estimate, which joins multiply round by round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, work: Callable, items: Sequence, at_once: int = 8) -> list:
    """``work`` for each item as concurrent Spark jobs, a scheduler pool each; results in order of the items.

    For a handful of independent fits whose stages are too short to fill a cluster one after the other. The first
    failure is raised with the item's name once the others have ended.
    """

    def one(i: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side-{i}")
        try:
            return work(items[i])
        except Exception as error:
            error.add_note(f"item {items[i]!r}")
            raise

    if not items:
        return []
    with ThreadPoolExecutor(min(at_once, len(items))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(one), i) for i in range(len(items))]
        return [w.result() for w in waiting]
