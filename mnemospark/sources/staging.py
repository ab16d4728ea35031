"""Tables written to the folder that all executors share, to cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it. Only a local session without that setting gets
    a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what came before,
    and the shuffle files of the written plan are removed at once. ``batch_rows`` bounds
    the rows that a Python worker gets at a time.
    """
    return staged_parts([df], name, batch_rows)


def staged_parts(parts: Iterable[DataFrame], name: str, batch_rows: int | None = None) -> DataFrame:
    """The union of one or more frames, ``staged`` one after the other, so that the disk holds the shuffle files of one at a time."""
    path = None
    for df in parts:
        path = path or new_path(df.sparkSession, name)
        _write(df, path, batch_rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(df: DataFrame, key: str, rows: int, most: int = 8) -> list[DataFrame]:
    """A staged table in parts by the hash of ``key``: one for each ``rows`` rows, ``most`` at most, each of which reads the table."""
    return sliced([df], key, min(most, 1 + df.count() // rows))[0]


def sliced(tables: list[DataFrame], key: str, n: int) -> list[list[DataFrame]]:
    """Each table in ``n`` parts by the hash of ``key``, alike for all."""
    at = F.pmod(F.xxhash64(F.lit(n), key), F.lit(n))
    return [[df.where(at == k) for k in range(n)] if n > 1 else [df] for df in tables]


def _write(df: DataFrame, path: str, batch_rows: int | None) -> None:
    spark = df.sparkSession
    settings = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def if_small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A staged table of ids, to be broadcast if it has at most ``rows`` rows; beyond, joins shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unstage(df: DataFrame) -> None:
    """Delete what ``staged`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if root.split(":", 1)[-1].lstrip("/") in path:
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
