"""Session helpers: table loading, the shared work folder and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_paths: dict[int, tuple] = {}  # of materialized tables, by id(DataFrame)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; zone-less timestamps become instants in the session's zone (UTC by contract)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A local master may do without; it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuslens-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder, with the writer's options, and read it back.

    It cuts the lineage: a lost executor costs no recomputation of what stands before. The table stays (the returned
    DataFrame reads it) until discard() or until the folder is dropped.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslens-{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[id(found)] = (weakref.ref(found), path)
    return found


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables. Only when everything made of them is itself written: a lost executor's tasks would read them again."""
    for df in tables:
        ref, path = _paths.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ensure_on_workers(spark: SparkSession) -> None:
    """Ship this package to the Python workers when it is neither installed there nor on their path.

    And let batches that go to them hold 8 MB instead of 64, unless the session has a size of its own: rows with whole texts
    are large, and a worker holds a batch several times over.
    """
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, "8m")
    app = spark.sparkContext.applicationId
    on_path = [os.path.realpath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]
    if app in _shipped or os.path.realpath(ROOT) in on_path:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="corpuslens-ship-"), "corpuslens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "corpuslens").rglob("*"):
            if p.suffix in (".py", ".csv"):
                z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
