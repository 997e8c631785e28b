"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gzip
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Owned:
    """The paths that a piece of work took in the shared folder, by label."""

    def __init__(self) -> None:
        self._paths: list[tuple[str, str]] = []

    def add(self, label: str, path: str) -> None:
        self._paths.append((label, path))

    def clear(self, spark: SparkSession, but: str | None = None) -> None:
        """Removes what was written, but for one label. Frames that read it can't be computed any more."""
        gone = [path for label, path in self._paths if label != but]
        self._paths = [x for x in self._paths if x[0] == but]
        for path in gone:
            remove(spark, path)


_owners: ContextVar[tuple[Owned, ...]] = ContextVar("owners", default=())


@contextmanager
def owned() -> Iterator[Owned]:
    """Collects what is written inside the block, in this thread alone; whoever opened the block may clear it.

    Blocks nest: an outer one owns what the inner ones do.
    """
    tables = Owned()
    token = _owners.set((*_owners.get(), tables))
    try:
        yield tables
    finally:
        _owners.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a temporary folder for the
    rest of its time; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None:
            at = shared_dir.own = tempfile.mkdtemp(prefix="graphloom-")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for tables in _owners.get():
        tables.add(label, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and returns it as read from there.

    This cuts the lineage: a lost executor costs no recomputation of what stands
    before. A block of ``owned`` around it can remove the table once results are stored.
    """
    path = place(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """Writes a table dealt by a key: what reads it, whichever columns, finds its rows dealt into so many parts.

    The table's name lasts as long as the session; its files go with the folder's others.
    """
    spark, name, stored = df.sparkSession, f"graphloom_{uuid.uuid4().hex}", f"{key}_of_bucket"
    rows = df.withColumnRenamed(key, stored).repartition(parts, stored)
    rows.write.format("parquet").option("compression", "zstd").option("path", place(spark, label)).bucketBy(parts, stored).saveAsTable(name)
    # A table's own columns bear its name, which hides from a union that its branches are dealt alike; a new one does not.
    return spark.table(name).withColumnRenamed(stored, key).select(df.columns)


def _at(spark: SparkSession, path: str):
    """A path with its file system, of any kind that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _at(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file."""
    place, files = _at(spark, path)
    out = files.create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if there is one, so that of several writers one alone gets True."""
    at, files = _at(spark, path)
    files.mkdirs(at.getParent())
    try:
        if files.getUri().getScheme() == "file":
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        else:
            files.create(at, False).close()
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def entries(spark: SparkSession, path: str) -> dict[str, float]:
    """What stands in a folder, with the times of last change in seconds; nothing if there is none."""
    at, files = _at(spark, path)
    return {x.getPath().getName(): x.getModificationTime() / 1000 for x in files.listStatus(at)} if files.exists(at) else {}


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    at, files = _at(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def absolute(spark: SparkSession, path: str) -> str:
    """A path as an absolute one: of local files without a scheme, of others as a URL."""
    at, files = _at(spark, os.path.expanduser(path))
    return re.sub(r"\Afile:(//)?(?=/)", "", str(files.makeQualified(at).toString())).rstrip("/")


def promote(spark: SparkSession, folder: str, path: str) -> None:
    """Makes the one part file of a folder that Spark wrote the file at a path."""
    (part,) = (n for n in entries(spark, folder) if n.startswith("part-"))
    at, files = _at(spark, path)
    files.delete(at, False)
    files.rename(_at(spark, f"{folder}/{part}")[0], at)
    remove(spark, folder)
    if path.startswith("/"):  # whoever edits a local file does not know of its checksum
        name = at.getName()
        with suppress(FileNotFoundError):
            os.remove(os.path.join(os.path.dirname(path), f".{name}.crc"))


def _file(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an absolute path, and the path there."""
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


def files_below(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path) of the files with a suffix below the folders of a path or pattern, hidden ones left out.

    The driver lists the first folder alone; tasks list the folders in it.
    """
    at, files = _at(spark, os.path.expanduser(path))
    found = list(files.globStatus(at) or [])
    if not found:
        raise FileNotFoundError(path)
    plain = lambda status: re.sub(r"\Afile:(//)?(?=/)", "", status.getPath().toString())
    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name)
    inside = [x for s in found for x in (files.listStatus(s.getPath()) if s.isDirectory() else [s]) if not hidden(x.getPath().getName())]
    here = [(plain(s), s.isDirectory()) for s in inside if s.isDirectory() or s.getPath().getName().endswith(suffix)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths = [top]
                if folder:
                    files, below = _file(top)
                    head = top[: len(top) - len(below)]  # what a URL has before the path
                    rest = lambda p, n=len(below): p[n:].split("/")
                    listed = files.get_file_info(pa.fs.FileSelector(below, recursive=True))
                    paths = [head + i.path for i in listed if i.is_file and i.path.endswith(suffix) and not any(map(hidden, rest(i.path)))]
                for k in range(0, len(paths), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(paths[k : k + 10_000], pa.string())], names=["path"])

    tops = spark.createDataFrame(here, "top string, folder boolean")
    parts = max(1, min(len(here), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return tops.repartition(parts, "top").mapInArrow(run, "path string")


def texts_at(rows: DataFrame, bytes_at_once: int = 4 << 20) -> DataFrame:
    """Adds ``content``, the whole file at each row's ``path`` (unzipped if it ends in ``.gz``), read inside the tasks, so that small files are not tasks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, texts, held = 0, [], 0
            for n, path in enumerate(batch.column("path").to_pylist()):
                files, at = _file(path)
                with files.open_input_file(at) as file:
                    texts.append(gzip.decompress(file.read()) if at.endswith(".gz") else file.read())
                held += len(texts[-1])
                if held >= bytes_at_once or n + 1 == batch.num_rows:
                    part = batch.slice(first, n + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "content"])
                    first, texts, held = n + 1, [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    read = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, f"{fields}, content binary")
    return read.withColumn("content", F.col("content").cast("string"))


def put_texts(rows: DataFrame) -> int:
    """Writes each row's ``text`` as the file at its ``path`` (from ``absolute``), inside the tasks; how many there were.

    A file appears whole or not at all, and a task that runs again writes the same files. Paths
    that end in ``.gz`` get gzipped text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, at = _file(path)
                files.create_dir(at.rpartition("/")[0], recursive=True)
                part = f"{at}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(gzip.compress(text.encode(), 6, mtime=0) if at.endswith(".gz") else text.encode())
                files.move(part, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = rows.select("path", "text").mapInArrow(run, "n bigint")
    return done.agg(F.sum("n")).first()[0] or 0

