"""Session settings and lineage cuts shared by jobs, tests and the benchmark."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict = {}


def build_session(master: str | None = None, app: str = "ledgerline", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster.

    Only a local master may go without one (tests, a laptop): there all tasks see the same disk, and a temporary folder is
    made and removed when the driver ends.  Elsewhere each executor would write to its own disk, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None and context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if folder is None:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    folder = f"{checkpoint_folder(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str, folders: bool = False) -> list[str]:
    """Names in a folder, or only those of folders; none if it is not there."""
    store, at = _at(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at) if f.isDirectory() or not folders] if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def drop_folders(spark: SparkSession) -> int:
    """Delete all folders that `new_folder` named in this application; frames that read them end with it."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for folder in made:
        delete(spark, folder)
    return len(made)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them from there.

    For frames that several passes read: a lost executor costs a re-read instead
    of a recomputation, and later passes load only the columns they use.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_alone(spark: SparkSession, build, name: str = "step") -> DataFrame:
    """`stored(build(), name)`; the tables that were written on the way are deleted.  What others read must be there before."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    out = stored(build(), name)
    for folder in made[before:-1]:
        delete(spark, folder)
    made[before:-1] = []
    return out
