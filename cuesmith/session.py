"""What a session needs before the library's Python functions can run on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: set[str] = set()
#: Bytes of an Arrow batch, where the session has Spark's own default of 64 MB: a worker holds a batch some times over.
ARROW_BATCH = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once per application, and keep Arrow batches small."""
    app = spark.sparkContext.applicationId
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(ARROW_BATCH))
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="cuesmith-ship-"), "cuesmith.zip")
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(os.path.abspath(at))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is named, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.environ.get("CUESMITH_TEST_SHARED") or tempfile.mkdtemp(prefix="cuesmith-")
        os.environ["CUESMITH_TEST_SHARED"] = at
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder, in the application's part of it, which goes when it ends."""
    folder = f"{shared_dir(spark)}/cuesmith-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        _folders.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Slim rows of which each becomes much work, dealt by keys to all cores: a small file would be one task."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so a lost executor loses no finished work."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
