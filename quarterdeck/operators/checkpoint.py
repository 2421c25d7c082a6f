"""Cutting a long plan. Files written to the cluster's shared folder survive the loss of an executor."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session in one process gets a temporary folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quarterdeck-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, materialised in the shared folder, without its plan."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Steps keyed by company: what `cut_by` makes inside keeps its partitioning, and joins, groups and windows whose keys contain it need no exchange.
    Adaptive execution would forget the partitioning, so it rests here; a company's rows are few, so no partition is skewed."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cut_by(df: DataFrame, key: str = "cik") -> DataFrame:
    """`cut`, dealt by the key; dealt anew only where the plan has lost it."""
    return cut(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))
