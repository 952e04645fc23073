"""Session helpers: lineage cuts in the shared folder, table access, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting always comes from the session. Only where it is unset (tests, local mode) a temporary
    folder of this machine is used, and it is written into the session so that later calls agree.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="linklake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders of the tables that this process has written.
_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this process has put into the shared folder. Results that are still to be read need them,
    so call it at the end of a job."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables written into the shared folder, to cut lineage so that a lost executor costs a re-read, not a re-run.

    ``put`` writes a frame as Parquet and reads it back; ``drop`` deletes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _WRITTEN.append(self.base)

    def put(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._linklake_path = path  # type: ignore[attr-defined]
        return out

    def put_counted(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """As ``put``, with aggregates that are observed while the table is written, so that counting costs no job."""
        seen = Observation(f"put-{uuid.uuid4().hex}")
        out = self.put(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]))
        return out, {k: v or 0 for k, v in seen.get.items()}

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_linklake_path", None)
        if path:
            self.delete(path)

    def delete(self, path: str) -> None:
        _delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits_broadcast(df: DataFrame, limit_bytes: int = 8 << 20) -> bool:
    """Whether Catalyst's size estimate of ``df`` is below ``limit_bytes``; the guard before every broadcast hint."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes


def maybe_broadcast(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """A broadcast hint only behind a size check; beyond it the planner's shuffle join is the other way."""
    return F.broadcast(df) if fits_broadcast(df, limit_bytes) else df


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")
