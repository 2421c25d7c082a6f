"""Written stages in the cluster's shared folder, and Arrow helpers that all operators use."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarterdeck.shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quarterdeck-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """The same rows, read back from Parquet: lineage is cut, later readers prune columns, lost executors cost nothing. At most `files` files, if given, as
    each file of a local folder makes Hadoop start processes that set its permissions."""
    path = new_path(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files below a staged frame that no later frame reads."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts have at most 1,000 rows: a session's larger setting is lowered, as a task holds several batches at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def released() -> None:
    """Gives back to the system what Arrow and the C library hold for later use. Spark keeps a worker for a minute after its task, when the executor's next stage needs the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mapped(df: DataFrame, schema: str | T.StructType, start: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with a function that `start` makes once per task, so that tables are built once and batches stay batches. After its task a worker keeps
    no more memory than it holds data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        try:
            for batch in batches:
                yield from work(batch)
        finally:
            work = batch = None
            released()

    ship(df.sparkSession)
    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def appended(df: DataFrame, source: str, fields: list[T.StructField], start: Callable[[], Callable[[list], list[list]]], most: int = 2 << 20) -> DataFrame:
    """Adds columns computed from the values of one text column (UTF-8 bytes or None), some `most` bytes of text at a time. A column of df with a result's
    name is replaced."""
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    read = [f.name for f in kept] + ([source] if source in names else [])
    schema = T.StructType([*kept, *fields])

    def begin() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        work = start()

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(read.index(source))
            for rows in slices(texts, most):
                part = batch.slice(*rows)
                values = part.column(read.index(source)).cast(pa.binary()).to_pylist()
                made = [pa.array(v, type=arrow_type(f.dataType)) for v, f in zip(work(values), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=[f.name for f in schema.fields])

        return one

    return mapped(df.select(*read), schema, begin)


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(offset, rows) of runs of rows of some MB of text; a longer text is a run by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held + size > most and i > at:
            yield at, i - at
            at, held = i, 0
        held += size
    if len(sizes) > at:
        yield at, len(sizes) - at


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return simple[kind.simpleString()]
