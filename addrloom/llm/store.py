"""Files that executors share: the folder in ``spark.checkpoint.dir`` and what lies in it.

A cluster names the folder in ``spark.checkpoint.dir``; only in local mode, where
that is unset (tests, notebooks), a temporary one is made. Tasks write each file under a name
of their own. Those of a kept table stay under it, and only what successful tasks
report is read; those of a model are renamed, so a task that is run again after a
loss leaves the same file. Readers map a file into memory; a remote one is fetched once per
process into an unlinked temporary file.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="addrloom-shared-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_OWN["dir"])
    return _OWN["dir"]


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in replicated files of the shared folder, with the lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written as a table in the shared folder, compressed, and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that a task gathers to a row group of a kept table.
GROUP_BYTES = 8 << 20


def keep(df: DataFrame, name: str) -> DataFrame:
    """The same, written by the Python workers: a file for each partition with rows.

    For tables whose rows come from a worker anyway. On a local file system Hadoop's
    writer starts three processes for each file to set permissions, each for a moment
    as large as the JVM; this one starts none. Every attempt writes a file of a name of
    its own and reports it, and the table is what successful tasks reported: a file of
    an attempt that failed, whose input may have ended early, or that another attempt
    was ahead of, is never read. Their rows are counted again in what is read. The names
    and counts, one for each partition, reach the driver.
    """
    path = new_folder(df.sparkSession, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, file = 0, f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.parquet"
        if (first := next((b for b in batches if len(b)), None)) is not None:
            held, size = [first], first.nbytes
            with writing(file) as f, pq.ParquetWriter(f, first.schema, compression="zstd") as writer:
                rows = len(first)
                for batch in batches:
                    if size >= GROUP_BYTES:
                        writer.write_table(pa.Table.from_batches(held).combine_chunks())
                        held, size = [], 0
                    held.append(batch)
                    size += batch.nbytes
                    rows += len(batch)
                writer.write_table(pa.Table.from_batches(held).combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([rows], pa.int64())], ["file", "n"])

    made = df.mapInArrow(write, "file string, n long").where("n > 0").collect()
    if not made:
        return df.sparkSession.createDataFrame([], df.schema)
    out = df.sparkSession.read.schema(df.schema).parquet(*sorted(r["file"] for r in made))
    if (found := out.count()) != (n := sum(r["n"] for r in made)):
        raise RuntimeError(f"{path} holds {found} rows of {n}")
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


@contextlib.contextmanager
def writing(uri: str) -> Iterator[object]:
    """A stream to a file that is visible only when complete."""
    part = f"{uri}.{uuid.uuid4().hex}"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part := _local(part), "wb") as f:
            yield f
        os.replace(part, path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    part = path + part.removeprefix(uri)
    with system.open_output_stream(part) as f:
        yield f
    system.move(part, path)


def put(uri: str, data: bytes | memoryview) -> None:
    """Write a whole file, visible only when complete."""
    with writing(uri) as f:
        f.write(data)


#: Files that a worker keeps mapped; beyond it those not used for longest go.
MOST_MAPPED = 4096
_MAPPED: OrderedDict[str, np.ndarray] = OrderedDict()


def mapped(uri: str) -> np.ndarray | None:
    """The bytes of a shared file, mapped into memory; None if there is none."""
    if uri in _MAPPED:
        _MAPPED.move_to_end(uri)
    else:
        while len(_MAPPED) >= MOST_MAPPED:
            _MAPPED.popitem(last=False)
        if (path := _local(uri)) is not None:
            if not os.path.exists(path):
                return None
            _MAPPED[uri] = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        else:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return None
            with tempfile.NamedTemporaryFile() as f, system.open_input_stream(path) as source:
                shutil.copyfileobj(source, f, 1 << 22)
                f.flush()
                _MAPPED[uri] = np.memmap(f.name, np.uint8, "r") if f.tell() else np.zeros(0, np.uint8)
    return _MAPPED[uri]


#: Rows of an Arrow batch of texts: an executor holds a few batches at a time, and texts can be long.
TEXT_ROWS, SHORT_ROWS = 512, 10_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """From now on no Arrow batch of this session has more than ``TEXT_ROWS`` rows."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))


@contextlib.contextmanager
def short_rows(spark: SparkSession) -> Iterator[None]:
    """What runs inside handles short rows in larger Arrow batches."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(SHORT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def spread(df: DataFrame, rows: int, each: int) -> int:
    """Partitions for ``rows`` rows at about ``each`` to a partition, the session's setting at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
