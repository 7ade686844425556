"""Session helpers: tables by name, written tables that cut lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; callers count the side first.
BROADCAST_ROWS = 200_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once for each application, so that they need no installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-memloom-")) / "memloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables in ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests);
    on a cluster, whose executors don't share such a folder, an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-memloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_marked: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, and the rows
    survive the loss of any executor. What an application wrote is deleted when it ends."""
    spark = df.sparkSession
    ship(spark)
    root = f"{shared_dir(spark)}/memloom/{spark.sparkContext.applicationId}"
    if root not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (Spark then shuffles both
    sides). ``df`` should be cheap to count, such as a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
