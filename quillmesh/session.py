"""Session helpers: loading tables, shipping the package, cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Where the tables made by ``cut`` lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "quillmesh") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python functions of the package are pickled by reference, so workers that
    don't have it on their path need a copy.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillmesh-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "quillmesh_ship.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder is made here, which only a session on one
    machine can use; on a cluster that would lose data, so it is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quillmesh-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan above starts from files that survive the loss of executors, with
    known sizes, and nothing below is computed twice. ``discard`` deletes the
    files of tables that no later plan reads.
    """
    return counted(df, tag)[0]


def counted(df: DataFrame, tag: str = "t") -> tuple[DataFrame, int]:
    """``cut``, with the number of rows counted while they are written."""
    table, seen = measured(df, tag)
    return table, seen["n"]


def measured(df: DataFrame, tag: str = "t", **sums: Column) -> tuple[DataFrame, dict]:
    """``cut``, with the rows (``n``) and other aggregates taken while they are written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table, seen.get


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        path = _paths.pop(t, None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
