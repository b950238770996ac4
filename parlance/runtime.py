"""Makes the package importable in the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: list[str] = []
_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting (tests, a laptop) gets a folder of
    its own; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="parlance-"))
    return f"file://{_LOCAL[0]}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, until ``clean_up``."""
    _FOLDERS.append(f"{shared_folder(spark)}/parlance/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its rows and their order in files stay, a lost executor costs one step."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete the folders made so far. For when their results have been read: they are lazy, so nothing else can know."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # not itself run from an archive
        archive = Path(tempfile.mkdtemp(prefix="parlance-")) / "parlance.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


#: Bytes of one input split, Spark's own default.
SPLIT_BYTES = 128 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate: near the size of files right behind a scan, of little use behind a join."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions(scan: DataFrame, size: int) -> int:
    """How many partitions of ``size`` bytes a scan and what is selected from it fill, at least ``spark.sql.shuffle.partitions``.

    0 if they are no more than the cores: adaptive execution fills these as well.
    """
    spark, parts = scan.sparkSession, estimated_bytes(scan) // size
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > spark.sparkContext.defaultParallelism else 0


def spread(df: DataFrame) -> DataFrame:
    """A scan smaller than one split per core, dealt over all cores; a larger one has enough splits of its own.

    A small Parquet file is often one row group, hence one task, however costly
    the functions on its rows are. Columns and filters still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SPLIT_BYTES else df
