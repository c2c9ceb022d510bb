"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing each round to the folder that the session names in
``spark.checkpoint.dir``. Written tables survive the loss of executors and, unlike cached blocks, keep
column statistics, so that AQE still sees their size.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.conf.get("spark.master", "")
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
    where = getattr(checkpoint_dir, "own", None)
    if where is None or not os.path.isdir(where):
        where = tempfile.mkdtemp(prefix="bytegrove-")
        checkpoint_dir.own = where
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


_ROOTS: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clear() -> None:
    """Removes all scratch tables of this driver, as it does by itself at its end; answers that read them are void then."""
    while _ROOTS:
        spark, root = _ROOTS.pop()
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, root)
        except Exception:  # noqa: BLE001  the session is gone, and its folder is the cluster's to clean
            return


class Scratch:
    """Tables of one operator run. ``save`` writes and reads back; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/bytegrove-{label}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append((spark, self.root))
        self._n = 0
        self._paths: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def counted(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """``save``, with aggregates over the rows taken while they are written instead of by a job of their own."""
        seen = Observation()
        # The columns are those of df; what is read back has no observation in its plan.
        out = self.save(df.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
        return out, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            for own in [x for x in self._paths if x[0] is df]:
                self._paths.remove(own)
                path = own[1]
                _remove(self.spark, path)
