"""Writing result tables (K6, K8, K9, K11) so that no reader sees half a write, and run records."""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from quarterdeck import schemas
from quarterdeck.operators.checkpoint import cut


PART, COMMITS, DATA = "_part", "_commits", "_data"


def _fs(spark: SparkSession, path: str):
    """(file system, path) of a path, for listing, renaming and removing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _committed(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the newest commit of a table, and the folder of each of its parts; (0, {}) before the first one."""
    fs, folder = _fs(spark, f"{path}/{COMMITS}")
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()] if fs.exists(folder) else []
    if not numbers:
        return 0, {}
    last = max(numbers)
    return last, json.loads(spark.read.text(f"{path}/{COMMITS}/{last:012d}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, parts: dict[str, str]) -> None:
    """The one step that makes a write visible: a finished folder gets its number by renaming."""
    made = f"{path}/{COMMITS}/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(parts, sort_keys=True),)], "value string").coalesce(1).write.text(made)
    (fs, source), (_, target) = _fs(spark, made), _fs(spark, f"{path}/{COMMITS}/{number:012d}")
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"{path}: another run has committed number {number}")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table as of its newest commit. A schema is needed before the first one and for a table without rows."""
    folders = sorted(_committed(spark, path)[1].values())
    reader = spark.read if schema is None else spark.read.schema(schema)
    if not folders:
        if schema is None:
            raise FileNotFoundError(f"{path}: no rows committed")
        return spark.createDataFrame([], schema)
    return reader.parquet(*[f"{path}/{DATA}/{f}" for f in folders])


def _publish(rows: DataFrame, path: str, column: str, touched: list) -> None:
    """Replaces the touched parts of a table by ``rows``. New files go to a folder of their own; readers see the old table until the commit and the new one
    after it, also if the run ends in between. ``touched`` is as short as the run's dates or the buckets, never a list of companies."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    number, parts = _committed(spark, path)
    rows.withColumn(PART, F.col(column).cast("string")).write.partitionBy(PART).parquet(f"{path}/{DATA}/{run}")
    fs, folder = _fs(spark, f"{path}/{DATA}/{run}")
    filled = [f.getPath().getName().removeprefix(f"{PART}=") for f in fs.listStatus(folder) if f.isDirectory() and f.getPath().getName().startswith(f"{PART}=")]
    kept = {value: place for value, place in parts.items() if value not in {str(t) for t in touched}}
    _commit(spark, path, number + 1, kept | {value: f"{run}/{PART}={value}" for value in filled})


def tidy(spark: SparkSession, path: str) -> None:
    """Removes files that the newest commit doesn't name, once no reader of an older one is left."""
    used = set(_committed(spark, path)[1].values())
    fs, folder = _fs(spark, f"{path}/{DATA}")
    for run in fs.listStatus(folder) if fs.exists(folder) else []:
        parts = [f.getPath() for f in fs.listStatus(run.getPath())]
        for part in parts:
            if part.getName().startswith(f"{PART}=") and f"{run.getPath().getName()}/{part.getName()}" not in used:
                fs.delete(part, True)
        if not any(place.startswith(f"{run.getPath().getName()}/") for place in used):
            fs.delete(run.getPath(), True)


def write_run(tables: dict[str, DataFrame], root: str, scored: DataFrame | None = None) -> None:
    """K8, K9: one table per name, one part per as_of; read them by read_table. ``scored`` names the (cik, as_of) of this run, by default those in any of its
    tables: their rows are replaced, so a flag that is gone disappears, even the last one. Other companies and dates stay."""
    if scored is None:
        frames = [df.select("cik", "as_of") for df in tables.values()]
        scored = frames[0]
        for df in frames[1:]:
            scored = scored.union(df)
    scored = cut(scored.select("cik", "as_of").distinct())
    dates = [r["as_of"] for r in scored.select("as_of").distinct().collect()]
    for name, df in tables.items():
        path = f"{root}/{name}"
        kept = read_table(df.sparkSession, path, df.schema).where(F.col("as_of").isin(dates)).join(scored, ["cik", "as_of"], "left_anti")
        _publish(df.unionByName(kept.select(*df.columns)), path, "as_of", dates)


def write_bucketed(df: DataFrame, path: str, key: str = "cik", buckets: int = 64, batch: DataFrame | None = None) -> None:
    """K6: periods spread over hash buckets of the company, so that a partial rerun rewrites only the buckets it touches. ``batch`` names the
    companies of this run, by default those of ``df``; rows of other companies in a touched bucket stay. Each bucket is written by
    one task, as some 10,000 buckets of 1 GB for 10 TB of periods; choose ``buckets`` by the size of the table when it is first written and keep it."""
    bucket = F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")
    new = df.withColumn("bucket", bucket)
    done = cut((df if batch is None else batch).select(key, bucket).distinct())
    touched = [r["bucket"] for r in done.select("bucket").distinct().collect()]
    kept = read_table(df.sparkSession, path, new.schema).where(F.col("bucket").isin(touched)).join(done.select(key), key, "left_anti")
    rows = new.unionByName(kept.select(*new.columns)).repartition("bucket").sortWithinPartitions("bucket", key)
    _publish(rows, path, "bucket", touched)


class Run:
    """A running job. ``stats`` takes single values; ``staged`` counts rows while they are materialised."""

    def __init__(self, job: str):
        self.id, self.job, self.stats = uuid.uuid4().hex, job, {}

    def staged(self, df: DataFrame, **counters: Column) -> DataFrame:
        """The rows, materialised once; the aggregates over them, seen in the same pass, are then in the run's stats."""
        watch = Observation(f"{self.job}-{uuid.uuid4().hex}")
        rows = cut(df.observe(watch, *[c.alias(name) for name, c in counters.items()]))
        self.stats.update(watch.get)
        return rows

    def texts(self) -> dict[str, str]:
        return {k: str(v) for k, v in self.stats.items() if v is not None}


@contextmanager
def recorded(spark: SparkSession, job: str, path: str) -> Iterator[Run]:
    """A row when the job starts and one when it ends, also after an error, which is raised again."""
    run, started = Run(job), datetime.now(timezone.utc)

    def append(status: str, finished: datetime | None, stats: dict, error: str | None) -> None:
        spark.createDataFrame([(run.id, job, started, finished, status, stats, error)], schemas.JOB_RUN).coalesce(1).write.mode("append").parquet(path)

    append("running", None, {}, None)
    try:
        yield run
    except BaseException as e:
        append("failed", datetime.now(timezone.utc), run.texts(), f"{type(e).__name__}: {e}"[:2000])
        raise
    append("succeeded", datetime.now(timezone.utc), run.texts(), None)


def runs(log: DataFrame) -> DataFrame:
    """The last state of every run; one that died without a word is still running."""
    columns = [c for c in log.columns if c != "run_id"]
    last = log.groupBy("run_id").agg(F.max_by(F.struct(*columns), F.coalesce("finished_at", F.to_timestamp(F.lit("0001-01-01")))).alias("r"))
    return last.select("run_id", "r.*")
