"""Spark session helpers.

Nothing here builds an engine of its own: it only sets the handful of
session options every operator in the package relies on (UTC session
time zone, AQE, Arrow) and resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    master: str | None = None,
    app_name: str = "tidepool",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the package defaults applied.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    ``master="local[8]"``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.ui") and not k.startswith("spark.driver"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on an existing session
                pass
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session (on a cluster this names a
    shared file system). Only when it is unset -- local runs and tests -- a
    fresh scratch folder is created and registered.
    """
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is useless (and unsafe) when executors come and go
            raise ValueError("set spark.checkpoint.dir to a folder on shared storage")
        d = tempfile.mkdtemp(prefix="tidepool-ckpt-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df, name: str = "table"):
    """Cut lineage: write ``df`` as a parquet table in a fresh folder under the
    shared checkpoint folder and read it back. Later stages and retried tasks
    read these files, never a recomputation (columnar and compressed, so
    cheaper than a row checkpoint)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    out.scratch = path
    return out


def discard(*tables) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_path(path: str) -> str:
    """POSIX form of a ``file:`` URI (for pyarrow / os code on a shared mount)."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def fs_list(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """``(name, is_dir)`` of the entries of a folder on any Hadoop file system
    (local, HDFS, object stores); empty when the folder does not exist."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)]


def fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def fs_delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file in one step, unless it exists: whether it was created.

    The text goes to a hidden file beside it, which is then renamed without
    overwriting (``FileContext.rename``, as Spark's own streaming logs do), so
    that readers see the whole file or none and of two writers one wins.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(hidden, target, options)
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True
