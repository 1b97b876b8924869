"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends, and not some time after it is forgotten.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, app: str = "gradpath", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the one it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own setting where there is one.

    Only a local session without a setting gets a temporary folder. On a cluster a
    machine-local folder would be lost with its machine, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", "")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="gradpath-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)  # our own folder, of this run only
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The result survives lost executors and has no past to recompute. A written table is
    computed once, where a checkpoint of the same rows runs its last stage twice. The
    tables of an application lie in one folder, which ``forget_steps`` removes.
    """
    path = f"{steps_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps_folder(spark: SparkSession) -> str:
    """The shared folder that the tables of this application lie in."""
    return f"{ensure_checkpoint_dir(spark)}/steps-{spark.sparkContext.applicationId}"


def forget_steps(spark: SparkSession) -> None:
    """Remove the tables that this application has written to cut lineage, when no DataFrame
    that reads them is needed any more; for the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(steps_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(*tables: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` has written and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        home = steps_folder(spark)
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[0].endswith(home.rpartition("/")[2]):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run in here go when their query ends. Each writes its
    result, so none of them is read again; left alone they would pile up until the driver's
    memory is cleared of them."""
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)
