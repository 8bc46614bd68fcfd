"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

Made = TypeVar("Made")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Where the session names none a folder of this machine is made and set if the
    master is local; a cluster without one raises, because its executors could not
    read each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _new_path(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"quire-{spark.sparkContext.applicationId}", uuid.uuid4().hex)


#: Whether an execution removes the files of its shuffles at its end.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends in files that every executor can read, so a lost executor
    costs nothing and a result that is used several times is computed once. Files of
    the shuffles that led to it go as soon as it is written, not when the driver
    happens to collect its garbage.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, buckets: int, order: str) -> DataFrame:
    """Write ``df`` bucketed by ``key``, so that sums and joins by it need no shuffle.

    Rows should already be partitioned by the key into as many parts.
    """
    spark = df.sparkSession
    name = f"quire_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(order).option("path", _new_path(spark)).saveAsTable(name)
    return spark.table(name)


_MADE: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, make: Callable[[], Made]) -> Made:
    """What `make` gives, made once an application: an index that several queries read."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def clear(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; results read from it end."""
    for key in [k for k in _MADE if k[0] == spark.sparkContext.applicationId]:
        del _MADE[key]
    for t in spark.catalog.listTables():
        if t.name.startswith("quire_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), f"quire-{spark.sparkContext.applicationId}"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark application.

    Tasks import it by name; executors that lack it on their path get it so.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
