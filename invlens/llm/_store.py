"""The cluster's shared folder: intermediate tables and the files that operators write."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it.

    Only a local session without the setting (tests, the small bench) gets a
    folder of its own; on a cluster a missing setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="invlens-llm-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return str(d)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/invlens-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def brought(df: DataFrame, name: str):
    """The rows of a small table, one by one: computed in one job and written, then read in a few jobs, however many partitions there were."""
    return written(df, name).coalesce(8).toLocalIterator()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(file system, path in it) for a folder or file URI of any store that Arrow knows; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def commit_file(uri: str, write) -> None:
    """Calls ``write(stream)`` on a temporary name and then renames it, so that a reader never sees half a file."""
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(temp) as out:
        write(out)
    store.move(temp, path)


def give_back() -> None:
    """Hands memory that Arrow's and C's allocators hold for later use back to the system; Spark keeps a worker process after its task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package shipped to the executors first, as ``--py-files`` would; once per session.

    A worker gives back what a task no longer needs, so that idle workers and
    the steps after it are not charged with the largest step so far.
    """
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_invlens_shipped", False):
        import zipfile
        from pathlib import Path

        root = Path(__file__).resolve().parent.parent
        archive = os.path.join(tempfile.mkdtemp(prefix="invlens-py-"), "invlens.zip")  # the driver serves it to the executors
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(archive)
        sc._invlens_shipped = True

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
