"""Tables in the folder that driver and executors share, to cut the lineage of iterations, and code for the executors."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder if all runs on this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_stratalith_tables", None)
        if root is None:
            root = spark.sparkContext._stratalith_tables = Path(tempfile.mkdtemp(prefix="stratalith-")).as_uri()
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a SparkContext."""
    sc = spark.sparkContext
    if not getattr(sc, "_stratalith_shipped", False):
        package = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="stratalith-code-"), "stratalith_code.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, str(p.relative_to(package.parent)))
        sc.addPyFile(target)
        atexit.register(shutil.rmtree, os.path.dirname(target), ignore_errors=True)
        sc._stratalith_shipped = True


#: What this driver has made, by session: results may read it as long as the driver lives.
_MADE: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clean() -> None:
    """At the driver's end its tables go. If the JVM is gone before, those on this machine go."""
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:
            with contextlib.suppress(OSError):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"))
    _MADE.clear()


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Tables that are made inside go at its end, so nothing that reads them may be used any more."""
    before = len(_MADE)
    try:
        yield
    finally:
        for spark, path in _MADE[before:]:
            _delete(spark, path)
        del _MADE[before:]


class Scratch:
    """Written tables of one operator call.

    ``keep`` writes a DataFrame and gives back one that reads the written table, so a lost executor
    costs only the tasks that it ran. ``drop`` removes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_root(spark)}/stratalith-{name}-{uuid.uuid4().hex}"
        _MADE.append((spark, self.root))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, df: DataFrame, table: str, codec: str = "zstd", rows: int | None = None, per_file: int = 50_000) -> DataFrame:
        """rows: how many there are at most, if that is known. Then no file gets less than per_file of
        them on average, whatever number of shuffle partitions made them."""
        if rows is not None:
            df = df.coalesce(1 + rows // per_file)
        df.write.option("compression", codec).parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            _delete(self.spark, self.path(table))

    def settle(self) -> None:
        """Shuffle files of finished plans go now: Spark deletes them when the driver's JVM collects its garbage, whenever that is."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
