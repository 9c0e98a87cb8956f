"""Intermediate tables and files in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; a lost executor
then costs a re-read and nothing else.  Files that are not tables (the memory-mapped
language model) go to the same folder.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master (tests) and an error on a cluster,
    whose executors would not see the driver's folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone; the folder's own cleaner takes the rest
            continue


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    if not _made:
        atexit.register(_sweep)
    path = f"{shared_root(spark)}/tessera/{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    found = {os.path.dirname(f) for f in df.inputFiles()}
    for name in found:
        _remove(df.sparkSession, name)
    _made[:] = [(spark, path) for spark, path in _made if not any(f.endswith(path.rpartition("/")[2]) for f in found)]


def local_path(uri: str) -> str | None:
    """The plain path of a ``file:`` URI, None for any other store."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_bytes(uri: str, chunks: list[bytes]) -> None:
    """Write one file from an executor, atomically, so a retried task leaves no half file."""
    plain = local_path(uri)
    if plain is not None:
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        part = f"{plain}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            for chunk in chunks:
                out.write(chunk)
        os.replace(part, plain)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(part, path)


def fetch(uri: str) -> str:
    """A local path that can be memory-mapped: the file itself, or a copy of a remote one."""
    plain = local_path(uri)
    if plain is not None:
        return plain
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    copy = os.path.join(tempfile.gettempdir(), "tessera-" + uuid.uuid5(uuid.NAMESPACE_URL, uri).hex)
    if not os.path.exists(copy):
        part = f"{copy}.{uuid.uuid4().hex}"
        with store.open_input_stream(path) as src, open(part, "wb") as out:
            while block := src.read(1 << 22):
                out.write(block)
        os.replace(part, copy)
    return copy


_shipped: set[str] = set()
_BATCH_SETTING, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` after this package has been sent to the executors, once per application.

    Batches are counted in rows first, and texts can be long: where the session sets no limit in bytes,
    one is set, so that a batch takes 8 MB and a row, in the executor and in its Python worker.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))
    if context.applicationId not in _shipped:
        import zipfile
        from pathlib import Path

        package = Path(__file__).resolve().parent.parent
        archive = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera_code.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent).as_posix())
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)
