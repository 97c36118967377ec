"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python functions find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="locusframe-"), f"{root.name}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors see; one of our own only on a single machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        folder = _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="locusframe-"))
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage, deleted when their reader is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/locusframe-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for at in [i for i, (df, _) in enumerate(self.kept) if any(df is x for x in kept)][::-1]:
            _delete(self.spark, self.kept.pop(at)[1])

    def drop_all_but(self, *needed: DataFrame) -> None:
        self.drop(*[df for df, _ in self.kept if not any(df is x for x in needed)])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
