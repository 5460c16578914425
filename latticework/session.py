"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where a table is dealt by its size.
ROWS = 1_000_000

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="latticework-py-")) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session or the application. Only with a local master, where
    one machine does all the work (tests), may it be unset; a folder is then made, one for each application."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="latticework-")
    return _LOCAL[app]


def folder(spark: SparkSession) -> str:
    """A new folder of this application below the shared one."""
    return f"{shared_dir(spark)}/latticework/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application stored in the shared folder; call it when its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/latticework/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *by: str, rows: int = ROWS) -> DataFrame:
    """``df`` dealt by the columns ``by`` so that a task has about ``rows`` rows, however large the table; as it is, where the session's number of partitions
    suffices for that. ``df`` is counted first."""
    parts = -(-df.count() // rows)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here, and lost executors cost no wave."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
