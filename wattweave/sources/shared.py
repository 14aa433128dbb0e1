"""The cluster's shared folder: reliable checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session. A local session without the setting gets a folder of its own."""
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
    if named:
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="wattweave-"))
    return context.getCheckpointDir()


class Job:
    """Intermediate tables and checkpoints made inside ``with Job(spark) as job`` are listed; when the block ends well
    they are removed, when it fails they stay for a look. Results must be written by then: see ``job.write``."""

    active: list[Job] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Job:
        Job.active.append(self)
        return self

    def __exit__(self, kind, error, trace) -> None:
        Job.active.remove(self)
        if kind is None:
            for path in self.paths:
                remove(self.spark, path)

    def write(self, df: DataFrame, path: str) -> None:
        """Write the rows beside the path and put them in its place when all are there: a reader sees the old table or
        the new one. The name is changed by the file system; in an object store that is a copy."""
        staged = f"{path}.staged-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        files, (old, new) = file_system(self.spark, path), (java_path(self.spark, p) for p in (path, staged))
        files.delete(old, True)
        if not files.rename(new, old):
            raise OSError(f"{staged} could not be renamed to {path}")


def java_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return java_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(java_path(spark, path), True)


def listed(path: str) -> str:
    for job in Job.active[-1:]:
        job.paths.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and cut the lineage; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    out = df.checkpoint(eager=True)
    if Job.active:
        written = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if written.isDefined():
            listed(written.get())
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return listed(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def rewritten(df: DataFrame) -> DataFrame:
    """The rows as a table of files in the shared folder, for frames that are made from themselves round by round.

    A checkpoint keeps the size that was estimated for its plan, and a join multiplies its sides' estimates: over rounds
    that number has ever more digits, until the driver's memory holds no more of them. Files have their real size.
    """
    path = new_path(df.sparkSession, "rewritten")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the files of a rewritten table that nothing reads any more."""
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        remove(table.sparkSession, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block, what a query has shuffled is removed as it ends, not when the driver collects its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per context: their tasks import it by name."""
    context = spark.sparkContext
    if getattr(context, "_wattweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    with tempfile.NamedTemporaryFile(prefix="wattweave-", suffix=".zip", delete=False) as file:
        with zipfile.ZipFile(file, "w") as archive:
            for source in sorted(package.rglob("*.py")):
                archive.write(source, source.relative_to(package.parent))
    context.addPyFile(file.name)
    context._wattweave_shipped = True
