"""The folder for intermediate data that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a local folder only where there are no other machines."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"/tmp/checkpoints/rillflow-{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _place(spark, path)
    return store.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    store, where = _place(spark, path)
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []


def erase(spark: SparkSession, path: str) -> None:
    store, where = _place(spark, path)
    store.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    store, where = _place(spark, path)
    _, part = _place(spark, f"{path}.part")
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(where, False)
    if not store.rename(part, where):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _place(spark, path)
    stream = store.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
