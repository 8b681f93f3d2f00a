"""Session construction and the few settings that operators read from it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "rotaloom", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes: UTC, AQE with skew handling, Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again.

    The folder is ``spark.checkpoint.dir`` of the session. The table outlives executors; ``drop_table``
    deletes one that is no longer read, ``scratch`` those made inside it, ``clear_work`` all of the session.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted with the tables of ``scratch`` and ``clear_work``."""
    path = f"{_work_folder(spark)}/{uuid.uuid4().hex}"
    for made in _SCRATCH:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``cut_lineage`` makes inside the block when the block ends; results that read
    them must be written by then."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            _delete(spark, path)


def _work_folder(spark: SparkSession) -> str:
    """The session's folder; a temporary one only where driver and tasks are one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/rotaloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table made by ``cut_lineage``."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def clear_work(spark: SparkSession) -> None:
    """Deletes all tables that ``cut_lineage`` made in this session."""
    _delete(spark, _work_folder(spark))


def reachable(spark: SparkSession) -> SparkSession:
    """``spark`` with this package sent to its Python workers, once a session, by Spark's own file server."""
    context = spark.sparkContext
    if _SENT.get("to") != context.applicationId:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "rotaloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for source in sorted(home.rglob("*.py")):
                z.write(source, str(source.relative_to(home.parent)))
        context.addPyFile(str(archive))
        _SENT["to"] = context.applicationId
    return spark


_SENT: dict[str, str] = {}
